"""Query expressions: `pattern[key=value, key="value"]`, parsed on the driver and planned as one Column condition."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from idloom.operators import identifiers as ids
from idloom.operators.extraction import filters_match

# Messages.
NO_BRACKET = "Invalid query: missing closing bracket ']'"
TYPE_FILTER = "Invalid query: filters cannot be used with type patterns (ending with ~ or ~*)"
STAR = "Invalid query: wildcard patterns must end with .* or ~*"
START = "Invalid query: pattern must start with 'gts.'"
INCOMPLETE = "Invalid query: incomplete GTS ID pattern"
LIMIT = 100


@dataclass
class Query:
    pattern: str
    filters: dict[str, str] = field(default_factory=dict)
    error: str | None = None


def _pattern_error(pattern: str) -> str | None:
    if "*" in pattern:
        if not pattern.endswith((".*", "~*")):
            return STAR
        return None if pattern.startswith(ids.PREFIX) else START
    try:
        last = ids.parse(pattern)[-1]
    except ids.Invalid as e:
        return f"Invalid query: {e}"
    return None if last.is_type or last.ver_major else INCOMPLETE


def parse_query(text: str) -> Query:
    """Whatever stands between a second bracket and the end is ignored; later values of a key win."""
    pieces = text.split("[")
    query = Query(pieces[0].strip(ids.SPACE))
    if len(pieces) > 1:
        inner = pieces[1].strip(ids.SPACE)
        if not inner.endswith("]"):
            query.error = NO_BRACKET
        elif query.pattern.endswith(("~", "~*")):
            query.error = TYPE_FILTER
        else:
            for part in inner[:-1].split(","):
                key, equals, value = part.strip(ids.SPACE).partition("=")
                if equals:
                    query.filters[key.strip(ids.SPACE)] = re.sub(r"^[\"']|[\"']\Z", "", value.strip(ids.SPACE))
    if query.error is None:
        query.error = _pattern_error(query.pattern)
    return query


def pattern_condition(pattern: str, segments: Column, first: Callable[[str], Column] | None = None) -> Column:
    """Whether segments of valid ids match a pattern that is known now; false for a pattern that is none.

    first gives a function of a field's name: the first segment's fields as columns of their own, so that the conditions
    on them reach the scan."""
    try:
        want = ids.parse(pattern, True)
    except ids.Invalid:
        return F.lit(False)
    out = []
    for i, p in enumerate(want):
        field = first if first is not None and i == 0 else F.get(segments, F.lit(i)).__getitem__
        if p.is_uuid_tail:
            out.append(field("segment") == p.segment)
            continue
        out += [field(n) == getattr(p, n) for n in ids.NAMES if getattr(p, n) or not p.is_wildcard]
        if p.ver_major or not p.is_wildcard:
            out.append(field("ver_major") == p.ver_major)
        if p.ver_minor is not None:
            out.append(field("ver_minor") == F.lit(p.ver_minor).cast("bigint"))
        if not p.is_wildcard:
            out.append(field("is_type") == p.is_type)
    return reduce(lambda a, b: a & b, [*out, F.coalesce(F.size(segments) >= len(want), F.lit(False))])


def match_each(patterns: list[str], segments: Column, error: Column) -> Column:
    """An array of pattern, match and error: an id's segments and error against patterns that are known now."""
    one = lambda p: F.struct(F.lit(p).alias("pattern"), F.when(error.isNull(), pattern_condition(p, segments)).otherwise(False).alias("match"), F.coalesce(error, F.lit(ids.error(p, True))).alias("error"))
    return F.array(*map(one, patterns))


def condition(query: Query, segments: Column, content: Column, first: Callable[[str], Column] | None = None) -> Column:
    """Ids first: they are cheap, and documents are parsed only for ids that match."""
    found = pattern_condition(query.pattern, segments, first)
    return found & F.when(found, filters_match(content, query.filters)).otherwise(False) if query.filters else found
