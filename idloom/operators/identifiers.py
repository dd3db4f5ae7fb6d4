"""Typed identifiers in plain Python: for patterns on the driver and for document logic in Arrow batches.

`idloom.functions.columns` states the same rules as Column expressions for whole tables; tests hold the two together.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import asdict, dataclass

# Fixed values of the identifier format.
PREFIX = "gts."
URI_PREFIX = "gts://"
MAX_LENGTH = 1024
#: What counts as white space at the ends.
SPACE = "\t\n\v\f\r                  　﻿"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "gts")
UUID_TAIL = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
TOKEN = "[a-z_][a-z0-9_]*"
NUMBER = "0|[1-9][0-9]*"
ID_ERROR = "Invalid GTS identifier: "
SEGMENT_ERROR = "Invalid GTS segment #"
LOWER = "Must be lower case"
NO_PREFIX = "Does not start with 'gts.'"
TOO_LONG = "Too long"
DOUBLE_DOT = "Double dots not allowed"
END_DOT = "Cannot end with a dot"
DOUBLE_TILDE = "Double tildes not allowed"
ONLY_PREFIX = "ID cannot be just the prefix"
HYPHEN = "Must not contain '-'"
NO_SEGMENTS = "No valid segments found"
SINGLE = "Single-segment instance IDs are prohibited. Instance IDs must be chained with a type segment (e.g., gts.vendor.pkg.ns.type.v1~instance.segment.v1)"
ONE_STAR = "The wildcard '*' token is allowed only once"
STAR_END = "The wildcard '*' token is allowed only at the end of the pattern"
STAR_BORDER = "The wildcard '*' must be preceded by '.' or '~' (token boundary)"
EMPTY_SEGMENT = "Empty segment"
EMPTY_TOKEN = "Empty token"
TOO_MANY = "Too many tokens"
TOO_FEW = "Too few tokens"
BAD_TOKEN = "Invalid segment token: "
MAJOR_V = "Major version must start with 'v'"
MAJOR_INT = "Major version must be an integer"
MINOR_INT = "Minor version must be an integer"

#: The largest version: integers up to it are held by doubles.
MOST = 1 << 53


def _at_most(most: int) -> str:
    """A pattern of the integers from 0 to a number, without leading zeros."""
    digits = str(most)
    n = len(digits)
    below = [f"{digits[:i]}[{int(i == 0)}-{int(d) - 1}][0-9]{{{n - i - 1}}}" for i, d in enumerate(digits) if int(d) > int(i == 0)]
    return "(?:" + "|".join(["0", f"[1-9][0-9]{{0,{n - 2}}}", *below, digits]) + ")"


# Whole identifiers and patterns as regular expressions that Python and the JVM read alike; what they don't match is parsed to tell why.
VERSION = _at_most(MOST)
_SP = "[" + "".join(f"\\u{ord(c):04x}" for c in SPACE) + "]*"
EDGES = rf"\A{_SP[:-1]}+|{_SP[:-1]}+\Z"
_PLAIN = rf"{TOKEN}(?:\.{TOKEN}){{3}}\.v{VERSION}(?:\.{VERSION})?"
_FREE = r"[^.~*\-]+\."
_STARTED = rf"\A{_SP}gts\.~?(?:{_SP}{_PLAIN}~)"
#: An identifier without a star.
WHOLE = rf"{_STARTED}+(?:{_SP}{_PLAIN}|{UUID_TAIL})?{_SP}\Z"
#: A pattern of one instance segment.
ONE = rf"\A{_SP}gts\.~?{_SP}{_PLAIN}{_SP}\Z"
#: With a star; upper case is left to another test, as names before a star aren't looked at.
STARRED = rf"{_STARTED}*(?:{_SP}(?!{_SP[:-1]})(?:(?:{_FREE}){{1,4}}|(?:{_FREE}){{4}}v{VERSION}\.))?\*{_SP}\Z"

_uuid, _token, _number = (re.compile(p) for p in (UUID_TAIL, TOKEN, NUMBER))
_whole = re.compile(WHOLE)
NAMES = ("vendor", "package", "namespace", "type")


class Invalid(ValueError):
    """Carries the message that is a result's error."""


@dataclass(frozen=True)
class Segment:
    num: int
    offset: int
    segment: str
    vendor: str = ""
    package: str = ""
    namespace: str = ""
    type: str = ""
    ver_major: int = 0
    ver_minor: int | None = None
    is_type: bool = False
    is_wildcard: bool = False
    is_uuid_tail: bool = False


def strip(text: str) -> str:
    return text.strip(SPACE)


def number(text: str) -> int | None:
    """Integers that print as they are written and that doubles hold."""
    return int(text) if _number.fullmatch(text) and len(text) <= 16 and int(text) <= MOST else None


def _segment(num: int, offset: int, part: str) -> Segment:
    def need(ok: bool, cause: str) -> None:
        if not ok:
            raise Invalid(f"{SEGMENT_ERROR}{num} @ offset {offset}: '{part}': {cause}")

    text = strip(part)
    need(text not in ("", "~"), EMPTY_SEGMENT)
    is_type = text.endswith("~")
    tokens = text.removesuffix("~").split(".")
    need(all(tokens), EMPTY_TOKEN)
    need(len(tokens) <= 6, TOO_MANY)
    star = tokens[-1] == "*"
    if not star:
        need(len(tokens) >= 5, TOO_FEW)
        for t in tokens[:4]:
            need(bool(_token.fullmatch(t)), BAD_TOKEN + t)
    named = tokens[:-1] if star else tokens
    fields: dict = dict(zip(NAMES, named, strict=False))
    if len(named) > 4:
        need(named[4].startswith("v"), MAJOR_V)
        fields["ver_major"] = number(named[4][1:])
        need(fields["ver_major"] is not None, MAJOR_INT)
    if len(named) > 5:
        fields["ver_minor"] = number(named[5])
        need(fields["ver_minor"] is not None, MINOR_INT)
    return Segment(num, offset, text, is_type=is_type, is_wildcard=star, **fields)


def _star_cause(text: str) -> str | None:
    at = text.find("*")
    if not text.startswith(PREFIX):
        return NO_PREFIX
    if at < 0:
        return None
    if text.count("*") > 1:
        return ONE_STAR
    if at < len(text) - 1:
        return STAR_END
    return None if text[at - 1] in ".~" else STAR_BORDER


def parse(text: str, pattern: bool = False) -> list[Segment]:
    """The segments; raises Invalid. A pattern may be one instance segment, and any text with a star is one."""
    if pattern or "*" in text:
        whole = text
        pattern, text = True, strip(text)
        if cause := _star_cause(text):
            raise Invalid(f"{ID_ERROR}{whole}: {cause}")
    raw = strip(text)
    utf16 = len(raw) + sum(c > "￿" for c in raw)
    for bad, cause in (
        (raw != raw.lower(), LOWER),
        (not raw.startswith(PREFIX), NO_PREFIX),
        (utf16 > MAX_LENGTH, TOO_LONG),
        (".." in raw, DOUBLE_DOT),
        (raw.endswith("."), END_DOT),
        ("~~" in raw, DOUBLE_TILDE),
        (raw in (PREFIX, PREFIX + "~"), ONLY_PREFIX),
    ):
        if bad:
            raise Invalid(f"{ID_ERROR}{text}: {cause}")
    parts = [p for p in re.findall("[^~]*~|[^~]+", raw[len(PREFIX) :]) if p != "~"]
    out, offset = [], len(PREFIX)
    for i, part in enumerate(parts):
        if 0 < i == len(parts) - 1 and _uuid.fullmatch(part):
            out.append(Segment(i + 1, offset, part, is_uuid_tail=True))
        elif "-" in part:
            raise Invalid(f"{ID_ERROR}{text}: {HYPHEN}")
        else:
            out.append(_segment(i + 1, offset, part))
        offset += len(part)
    if not out:
        raise Invalid(f"{ID_ERROR}{text}: {NO_SEGMENTS}")
    if not pattern and len(out) == 1 and not out[0].is_type:
        raise Invalid(f"{ID_ERROR}{text}: {SINGLE}")
    return out


def error(text: str, pattern: bool = False) -> str | None:
    try:
        parse(text, pattern)
    except Invalid as e:
        return str(e)
    return None


def is_valid(text: object) -> bool:
    if not isinstance(text, str) or not text.startswith(PREFIX):
        return False
    return len(text) <= MAX_LENGTH and bool(_whole.match(text)) or error(text) is None


def fits(p: Segment, c: Segment) -> bool:
    """Whether a candidate's segment fits a pattern's at the same place."""
    if p.is_uuid_tail:
        return p.segment == c.segment
    if p.is_wildcard:
        names = all(getattr(p, n) in ("", getattr(c, n)) for n in NAMES)
        return names and p.ver_major in (0, c.ver_major) and p.ver_minor in (None, c.ver_minor)
    return all(getattr(p, n) == getattr(c, n) for n in (*NAMES, "ver_major", "is_type")) and p.ver_minor in (None, c.ver_minor)


def match(candidate: str, pattern: str) -> tuple[bool, str | None]:
    try:
        have, want = parse(candidate), parse(pattern, True)
    except Invalid as e:
        return False, str(e)
    return len(want) <= len(have) and all(map(fits, want, have)), None


def to_uuid(text: str) -> str:
    return str(uuid.uuid5(NAMESPACE, text))


def record(s: Segment) -> dict:
    return asdict(s)
