"""Identifiers as Column expressions: parsing, validity, patterns between columns, name-based UUIDs. All of it stays in the JVM.

A null identifier gives null results.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from idloom.operators import identifiers as ids

SEGMENT = "struct<num: int, offset: int, segment: string, vendor: string, package: string, namespace: string, type: string, ver_major: bigint, ver_minor: bigint, is_type: boolean, is_wildcard: boolean, is_uuid_tail: boolean>"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once, however often it is used; keeps nested expressions small."""
    return F.get(F.transform(F.array(value), lambda x: then(x)), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, jvm_pattern(ids.EDGES), "")


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def _number(text: Column) -> Column:
    return F.when(text.rlike(rf"\A{ids.VERSION}\z"), text.try_cast("bigint"))


def _fits(text: Column, pattern: bool) -> Column:
    """Whether a text is an identifier, or a pattern."""
    short = (F.length(text) <= ids.MAX_LENGTH // 2) | (utf16_length(strip(text)) <= ids.MAX_LENGTH)
    whole = text.rlike(jvm_pattern(ids.WHOLE))
    whole = whole | text.rlike(jvm_pattern(ids.ONE)) if pattern else whole
    return short & (whole | (text.contains("*") & text.rlike(jvm_pattern(ids.STARRED)) & (text == F.lower(text))))


def valid_or_null(text: Column) -> Column:
    """Whether there is no error: as is_valid, but outer spaces before the prefix don't matter."""
    return _fits(text, False)


def jvm_pattern(pattern: str) -> str:
    """A pattern of module identifiers; only the end of a text is written in another way."""
    return pattern.replace(r"\Z", r"\z")


def _star_cause(text: Column) -> Column:
    at = F.instr(text, "*")
    return (
        F.when(~text.startswith(ids.PREFIX), ids.NO_PREFIX)
        .when(at == 0, F.lit(None))
        .when(F.length(F.regexp_replace(text, r"[^*]", "")) > 1, ids.ONE_STAR)
        .when(at < F.length(text), ids.STAR_END)
        .when(~F.substring(text, -2, 1).isin(".", "~"), ids.STAR_BORDER)
    )


def _whole_cause(raw: Column) -> Column:
    return (
        F.when(raw != F.lower(raw), ids.LOWER)
        .when(~raw.startswith(ids.PREFIX), ids.NO_PREFIX)
        .when(utf16_length(raw) > ids.MAX_LENGTH, ids.TOO_LONG)
        .when(raw.contains(".."), ids.DOUBLE_DOT)
        .when(raw.endswith("."), ids.END_DOT)
        .when(raw.contains("~~"), ids.DOUBLE_TILDE)
        .when(raw.isin(ids.PREFIX, ids.PREFIX + "~"), ids.ONLY_PREFIX)
    )


def _parts(raw: Column) -> Column:
    """Parts with their number, offset, whether they are a UUID tail, text without outer spaces, and tokens."""
    found = F.filter(F.regexp_extract_all(F.substr(raw, F.lit(len(ids.PREFIX) + 1)), F.lit("[^~]*~|[^~]+"), F.lit(0)), lambda p: p != "~")

    def numbered(texts: Column) -> Column:
        def part(p: Column, i: Column) -> Column:
            before = F.length(F.array_join(F.slice(texts, F.lit(1), i), "")) + len(ids.PREFIX)
            tail = (i > 0) & (i == F.size(texts) - 1) & p.rlike(rf"\A{ids.UUID_TAIL}\z")
            tokens = F.split(F.regexp_replace(strip(p), r"~\z", ""), r"\.", -1)
            return F.struct((i + 1).alias("num"), before.alias("offset"), p.alias("part"), tail.alias("tail"), strip(p).alias("text"), tokens.alias("tokens"))

        return F.transform(texts, part)

    return let(found, numbered)


def _segment(p: Column) -> Column:
    """The segment of a part."""
    tokens = p["tokens"]
    star = F.element_at(tokens, -1) == "*"
    named = lambda i: F.when(~p["tail"] & (F.size(tokens) - star.cast("int") > i), F.get(tokens, F.lit(i)))
    return F.struct(
        p["num"].cast("int").alias("num"),
        p["offset"].cast("int").alias("offset"),
        p["text"].alias("segment"),
        *[F.coalesce(named(i), F.lit("")).alias(field) for i, field in enumerate(ids.NAMES)],
        F.coalesce(F.substr(named(4), F.lit(2)).try_cast("bigint"), F.lit(0)).cast("bigint").alias("ver_major"),
        named(5).try_cast("bigint").alias("ver_minor"),
        p["text"].endswith("~").alias("is_type"),
        (star & ~p["tail"]).alias("is_wildcard"),
        p["tail"].alias("is_uuid_tail"),
    )


def _segment_cause(p: Column) -> Column:
    tokens, size, fifth = p["tokens"], F.size(p["tokens"]), F.get(p["tokens"], F.lit(4))
    star = F.element_at(tokens, -1) == "*"
    bad = F.filter(F.slice(tokens, 1, 4), lambda t: ~t.rlike(rf"\A{ids.TOKEN}\z"))
    n = size - star.cast("int")
    return (
        F.when(p["text"].isin("", "~"), ids.EMPTY_SEGMENT)
        .when(F.array_contains(tokens, ""), ids.EMPTY_TOKEN)
        .when(size > 6, ids.TOO_MANY)
        .when(~star & (size < 5), ids.TOO_FEW)
        .when(~star & (F.size(bad) > 0), F.concat(F.lit(ids.BAD_TOKEN), F.get(bad, F.lit(0))))
        .when((n > 4) & ~fifth.startswith("v"), ids.MAJOR_V)
        .when((n > 4) & _number(F.substr(fifth, F.lit(2))).isNull(), ids.MAJOR_INT)
        .when((n > 5) & _number(F.get(tokens, F.lit(5))).isNull(), ids.MINOR_INT)
    )


def _part_error(p: Column, shown: Column) -> Column:
    told = F.concat(F.lit(ids.SEGMENT_ERROR), p["num"], F.lit(" @ offset "), p["offset"], F.lit(": '"), p["part"], F.lit("': "), _segment_cause(p))
    return F.when(p["tail"], F.lit(None)).when(p["part"].contains("-"), F.concat(F.lit(ids.ID_ERROR), shown, F.lit(f": {ids.HYPHEN}"))).otherwise(told)


def segments(text: Column) -> Column:
    """The segments of a text, right if its error is null."""
    return F.transform(_parts(strip(text)), _segment)


def error(text: Column, pattern: bool = False) -> Column:
    """Why a text is no identifier (or pattern); null if it is one."""
    raw = strip(text)
    starred = F.lit(True) if pattern else text.contains("*")
    shown = F.when(starred, raw).otherwise(text)
    whole = lambda cause, quoted: F.concat(F.lit(ids.ID_ERROR), quoted, F.lit(": "), cause)

    def of_parts(parts: Column) -> Column:
        first = F.get(F.filter(F.transform(parts, lambda p: _part_error(p, shown)), lambda e: e.isNotNull()), F.lit(0))
        single = ~starred & (F.size(parts) == 1) & ~raw.endswith("~")
        return F.coalesce(first, F.when(F.size(parts) == 0, whole(F.lit(ids.NO_SEGMENTS), shown)), F.when(single, whole(F.lit(ids.SINGLE), shown)))

    told = F.coalesce(F.when(starred, whole(_star_cause(raw), text)), whole(_whole_cause(raw), shown), let(_parts(raw), of_parts))
    return F.when(text.isNull() | _fits(text, pattern), F.lit(None)).otherwise(told)


def is_valid(text: Column) -> Column:
    return F.coalesce(text.startswith(ids.PREFIX) & _fits(text, False), F.lit(False))


def validation(text: Column) -> Column:
    return let(error(text), lambda e: F.struct(text.alias("id"), e.isNull().alias("ok"), e.isNull().alias("valid"), F.coalesce(e, F.lit("")).alias("error"), text.contains("*").alias("is_wildcard")))


def parsed(text: Column) -> Column:
    none = F.array().cast(f"array<{SEGMENT}>")
    starred = text.contains("*")
    return let(error(text), lambda e: F.struct(e.isNull().alias("ok"), F.when(e.isNull(), segments(text)).otherwise(none).alias("segments"), e.alias("error"), (text.endswith("~") & ~starred).alias("is_schema"), starred.alias("is_wildcard")))


def is_type(text: Column) -> Column:
    return text.endswith("~")


def name_uuid(text: Column) -> Column:
    """Version 5 UUID of the text in the format's namespace."""
    return let(F.sha1(F.concat(F.unhex(F.lit(ids.NAMESPACE.hex)), F.encode(text, "UTF-8"))), _dashed)


def _dashed(digest: Column) -> Column:
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    cut = lambda a, n: F.substring(digest, a, n)
    return F.concat(cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-"), variant, cut(18, 3), F.lit("-"), cut(21, 12))


def id_uuid(text: Column) -> Column:
    return let(error(text), lambda e: F.struct(text.alias("id"), F.when(e.isNull(), name_uuid(text)).otherwise("").alias("uuid"), e.alias("error")))


def segment_fits(p: Column, c: Column) -> Column:
    minor = p["ver_minor"].isNull() | p["ver_minor"].eqNullSafe(c["ver_minor"])
    names = [p[n] == c[n] for n in ids.NAMES]
    open_names = [(p[n] == "") | (p[n] == c[n]) for n in ids.NAMES]
    every = lambda cs: reduce(and_, cs)
    starred = every(open_names) & ((p["ver_major"] == 0) | (p["ver_major"] == c["ver_major"])) & minor
    plain = every(names) & (p["ver_major"] == c["ver_major"]) & minor & (p["is_type"] == c["is_type"])
    return F.when(p["is_uuid_tail"], p["segment"] == c["segment"]).when(p["is_wildcard"], starred).otherwise(plain)


def segments_match(pattern: Column, candidate: Column) -> Column:
    """Whether segments match the segments of a pattern, both columns."""
    places = F.sequence(F.lit(0), F.size(pattern) - 1)
    return (F.size(pattern) <= F.size(candidate)) & F.forall(places, lambda i: segment_fits(F.get(pattern, i), F.get(candidate, i)))


def matches(candidate: Column, pattern: Column) -> Column:
    """match and error, for columns of candidates and patterns."""
    both = let(F.struct(segments(pattern).alias("p"), segments(candidate).alias("c")), lambda x: segments_match(x["p"], x["c"]))
    return let(F.coalesce(error(candidate), error(pattern, True)), lambda e: F.struct(F.when(e.isNull(), both).otherwise(False).alias("match"), pattern.alias("pattern"), candidate.alias("candidate"), e.alias("error")))
