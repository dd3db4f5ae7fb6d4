"""Personal data: fixed forms as seeds, and bootstrapped contextual extraction of what else stands where they stand.

One pass finds the base spans and all other identifier-like tokens (at least five characters without the punctuation around them, with an at
sign or three digits), each with its lexical patterns: the word before it, the two before it, the word after it, and those
on both sides. Patterns and instances (values) form a graph. Spark scores it in rounds: a pattern's score for a kind is
the mean of its instances' scores, smoothed; an instance that is no seed takes the mean of its patterns' scores; seeds keep 1, for
each kind that they have. Patterns with enough seeds of one kind and a high score then mark the unseen identifiers in the same
place. Scores are taken over the whole corpus, in joins and aggregations by pattern and by value; nothing of it is collected, and
joins by pattern are salted, as one word may stand before a third of all identifiers.

Defined results: null and empty texts have no spans. Texts are searched whole; offsets are code points, ends exclusive.
Base spans of a kind don't overlap each other; discovered spans overlap no base span, and of several kinds the
best scored counts (then the first listed). Rows repeat as in the input; null ids are kept; further columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.llm.common import map_texts, table, written

KINDS = ("email", "ip", "card", "phone")
#: Rounds of scoring; score and distinct seeds from which a pattern extracts.
ROUNDS, SCORE, SEEDS = 3, 0.8, 8
#: Characters of a context word that a pattern shows; longer words go by their hash.
WORD = 64
#: Parts that the identifiers of a pattern are dealt to.
SALTS = 16
#: Discoveries that may be broadcast.
FEW = 100_000
_SPAN = "struct<start: int, kind: int, end: int>"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# digits before a match would have been part of it, so looking behind keeps long runs linear
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT, _SPACES = re.compile("[0-9]"), re.compile(r"[\x20\x09-\x0D]")
_MARK = re.compile(r"[0-9@][^\x20\x09-\x0D]*")
_EDGES = ".,;:!?()[]{}<>\"'`|*_-="


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, low = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        low = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            low = m.end()
        at = text.find("@", low)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_part, m.groups()))]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m.group())) <= 15]
        out.sort()
    return out


def _part(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def _shown(word: str) -> str:
    return word if len(word) <= WORD else "#" + xxhash.xxh3_64_hexdigest(word.encode())


def before(text: str, at: int, n: int) -> list[str]:
    """The last n words before a place, whole whatever their length."""
    size = 64
    while True:
        words = text[max(0, at - size) : at].split()
        if size >= at or len(words) > n:  # the first of more may be cut
            return words[-n:]
        size *= 4


def after(text: str, at: int) -> list[str]:
    size = 64
    while True:
        words = text[at : at + size].split()
        if at + size >= len(text) or len(words) > 1:
            return words[:1]
        size *= 4


def patterns(text: str, start: int, end: int) -> list[str]:
    """The contexts of an identifier: `_` is its place; the word's own edges (punctuation) count as part of its neighbours."""
    left = [_shown(w.lower()) for w in before(text, start, 2)] or ["^"]
    right = [_shown(w.lower()) for w in after(text, end)] or ["$"]
    return [f"{left[-1]} _", *([f"{' '.join(left)} _"] if len(left) > 1 else []), f"_ {right[0]}", f"{left[-1]} _ {right[0]}"]


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """Other identifier-like tokens, of any length."""
    out, done = [], 0
    starts = [s for s, _, _ in base]
    reach = np.maximum.accumulate([e for _, _, e in base]).tolist() if base else []
    for m in _MARK.finditer(text):
        if m.start() < done:
            continue
        start, size = m.start(), 64
        while start > done:  # back to the white space before it
            low = max(done, m.start() - size)
            gaps = [g.end() for g in _SPACES.finditer(text, low, m.start())]
            start, size = (gaps[-1], size) if gaps else (low, size * 4)
            if gaps:
                break
        done = m.end()
        token = text[start : m.end()]
        value = token.strip(_EDGES)
        if len(value) < 5 or "@" not in value and len(_DIGIT.findall(value)) < 3:
            continue
        start += len(token) - len(token.lstrip(_EDGES))
        end = start + len(value)
        i = bisect_left(starts, end)
        if i and reach[i - 1] > start:
            continue
        out.append((start, end, value))
    return out


def _lists(rows: list[list[tuple]], fields: list[tuple[str, pa.DataType]]) -> pa.ListArray:
    flat = [x for row in rows for x in row]
    columns = [pa.array([x[i] for x in flat], t) for i, (_, t) in enumerate(fields)]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, names=[n for n, _ in fields]))


def _key(value: str) -> int:
    return xxhash.xxh3_64_intdigest(value.encode()) - (1 << 63)


def scanned(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns to keep, base (spans) with their patterns and values (hashed), seen (other identifiers)."""
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema.fields)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, seen = [], []
        for t in batch.column("__text").to_pylist():
            t = t or ""
            own = base_spans(t)
            base.append([(s, k, e, _key(t[s:e]), patterns(t, s, e)) for s, k, e in own])
            seen.append([(s, -1, e, _key(v), patterns(t, s, e)) for s, e, v in candidates(t, own)])
        kind = [("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value", pa.int64()), ("patterns", pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), _lists(base, kind), _lists(seen, kind)], names=[*keep, "base", "seen"])

    row = "array<struct<start: int, kind: int, end: int, value: bigint, patterns: array<string>>>"
    return map_texts(docs.select(*keep, F.col(text).alias("__text")), "__text", run, f"{fields}base {row}, seen {row}")


def _salted(found: DataFrame) -> DataFrame:
    return found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def scored(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """p, kind, score, seeds of the patterns of edges (p, i, kind; kind below zero: no seed)."""
    edges = written(edges.distinct())
    seeds = edges.filter("kind >= 0").select("i", "kind").distinct().withColumn("s", F.lit(1.0))
    plain = edges.select("p", "i").distinct()
    of_pattern = plain.groupBy("p").agg(F.count("*").alias("n"))
    others = written(plain.join(seeds.select("i").distinct(), "i", "left_anti").withColumn("salt", F.pmod(F.xxhash64("i"), F.lit(SALTS)).cast("int")))
    of_other = others.groupBy("i").agg(F.count("*").alias("n"))
    known = seeds
    for left in range(rounds, 0, -1):
        sums = plain.join(known, "i").groupBy("p", "kind").agg(F.sum("s").alias("s"), F.count_if(F.col("s") == 1.0).alias("seeds"))
        found = written(sums.join(of_pattern, "p").select("p", "kind", (F.col("s") / (F.col("n") + 2)).alias("score"), "seeds"))
        if left > 1:
            guess = others.join(_salted(found), ["p", "salt"]).groupBy("i", "kind").agg(F.sum("score").alias("s")).join(of_other, "i")
            known = seeds.union(guess.select("i", "kind", F.least(F.col("s") / F.col("n"), F.lit(0.99))))
    return found


def _found(docs: DataFrame, keep: list[str], text: str, score: float, seeds: int) -> DataFrame:
    """k0, k1, ... (the columns to keep), base with values and patterns, new (null without a discovery)."""
    # ids are given once and written with the rows
    rows = written(scanned(docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("t")), [f"k{i}" for i in range(len(keep))], "t").withColumn("rid", F.monotonically_increasing_id()))
    every = rows.select(F.explode(F.concat("base", "seen")).alias("x")).select(F.explode("x.patterns").alias("p"), F.col("x.value").alias("i"), "x.kind")
    good = scored(every).filter((F.col("score") >= score) & (F.col("seeds") >= seeds)).select("p", "score", F.col("kind").alias("k"))
    met = rows.select("rid", F.explode("seen").alias("x")).select("rid", "x.start", "x.end", F.explode("x.patterns").alias("p"))
    met = met.withColumn("salt", F.pmod(F.xxhash64("rid", "start"), F.lit(SALTS)).cast("int")).join(_salted(good), ["p", "salt"])
    best = met.groupBy("rid", "start", "end").agg(F.max(F.struct("score", (-F.col("k")).alias("k"))).alias("b"))
    new = best.groupBy("rid").agg(F.collect_list(F.struct("start", (-F.col("b.k")).alias("kind"), "end")).alias("new"))
    return rows.join(new, "rid", "left")


def spans(docs: DataFrame, keep: list[str], text: str = "text", score: float = SCORE, seeds: int = SEEDS) -> DataFrame:
    """The columns to keep, base and spans (arrays of start, kind, end in order; kind numbers KINDS)."""
    plain = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    rows = _found(docs, keep, text, score, seeds).withColumn("base", plain)
    return rows.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "base", F.array_sort(F.concat("base", F.coalesce("new", F.array().cast(f"array<{_SPAN}>")))).alias("spans"))


def shown(spans_: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def redacted(docs: DataFrame, text: str = "text", score: float = SCORE, seeds: int = SEEDS) -> DataFrame:
    """The documents with every span replaced by its kind in brackets. Overlapping spans are replaced as one, by
    the kind of the first. A null text stays null.

    Spans depend on a text alone, so discoveries are kept by two hashes of it, and texts are read twice but not
    shuffled while there are at most FEW discoveries; beyond that, the join shuffles."""
    columns = [f"c{i}" for i in range(len(docs.columns))]  # whatever their own names are
    at = docs.columns.index(text)
    fields = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    own = docs.toDF(*columns).withColumn("h", F.struct(F.xxhash64(columns[at]).alias("a"), F.xxhash64(F.lit(1), columns[at]).alias("b")))
    new = written(_found(own, ["h"], columns[at], score, seeds).filter("new is not null").select(F.col("k0").alias("h"), "new").dropDuplicates(["h"]))
    small = new.count() <= FEW
    joined = own.join(F.broadcast(new) if small else new, "h", "left").select(*columns, "new")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for t, more in zip(batch.column(at).to_pylist(), batch.column("new").to_pylist(), strict=True):
            own = base_spans(t) if t else []
            if more:
                own = sorted([*own, *((s["start"], s["kind"], s["end"]) for s in more)])
            if own:
                parts, end = [], 0
                for s, k, e in own:
                    if s >= end:
                        parts += [t[end:s], f"[{KINDS[k]}]"]
                    end = max(end, e)
                t = "".join(parts) + t[end:]
            out.append(t)
        return pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == at else batch.column(i) for i in range(len(columns))], names=columns)

    return map_texts(joined, columns[at], run, fields).toDF(*docs.columns)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans for every document."""
    found = spans(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    counts = [F.expr(f"size(filter(base, x -> x.kind = {k}))").cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


QUERIES = {"op8_pii": op8}
SQL: dict[str, str] = {}
