"""Text functions that mean the same in Spark and in DuckDB's RE2."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


_BEFORE, _BEHIND = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def _opens_with_word(rest: str) -> bool:
    """Whether all that a pattern may go on with is a word character."""
    if re.match(r"[A-Za-z0-9_]|\\w(?![*?])", rest):
        return not re.match(r"(?:\\w|[A-Za-z0-9_])(?:[*?]|\{0)", rest)
    group = re.match(r"\((?:\?:)?([^()\\\[\]]+)\)(?![*?{])", rest)
    return bool(group) and all(re.match(r"[A-Za-z0-9_](?![*?{])", x) for x in group[1].split("|"))


def _ends_with_word(before: str) -> bool:
    """Whether all that a pattern may have ended with is a word character."""
    if re.search(r"\\w\+?\Z", before):
        return True
    if re.search(r"(?<!\\)[A-Za-z0-9_]\Z", before):
        return True
    group = re.search(r"\((?:\?:)?([^()\\\[\]]+)\)\Z", before)
    return bool(group) and all(re.search(r"[A-Za-z0-9_]\Z", x) for x in group[1].split("|"))


@cache
def java(pattern: str) -> str:
    """A pattern written for RE2, for Java: word edges are ASCII ones there too.

    Where a word character must follow an edge, or must stand before it, one look to the other side says all.
    """
    out, rest = "", pattern
    while (at := rest.find(r"\b")) >= 0:
        before, rest = out + rest[:at], rest[at + 2 :]
        inside = before.count("[") - before.count(r"\[") > before.count("]") - before.count(r"\]")
        if inside or before.endswith("\\"):
            out = before + r"\b"
        elif _opens_with_word(rest):
            out = before + _BEFORE
        elif _ends_with_word(before):
            out = before + _BEHIND
        else:
            out = before + _EDGE
    return out + rest


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(java(pattern))


def extract(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match or group, '' if there is none."""
    return F.regexp_extract(text, java(pattern), group)


_ESCAPED = r"\\."
#: A literal pattern behind what an expression may follow, up to here; and what closes it from here on.
_OPEN_PATTERN = r"[=(:,;\[!&|?{}+\-~^%<> ]/(?:\\.|\[(?:\\.|[^\]\\])*\]|[^/\\\[])*\z"
_CLOSES_PATTERN = r"^(?:\\.|\[(?:\\.|[^\]\\])*\]|[^/\\\[])*/"


def inside_string(text: Column, at: Column) -> Column:
    """Whether column ``at`` (from 1) of a line of code lies in a quoted string, a template or a literal pattern."""
    before, behind = F.substring(text, F.lit(1), at - 1), F.substring(text, at, F.length(text))
    bare = F.regexp_replace(before, _ESCAPED, "")
    odd = [F.regexp_count(bare, F.lit(q)) % 2 == 1 for q in ("'", '"', "`")]
    return odd[0] | odd[1] | odd[2] | (before.rlike(_OPEN_PATTERN) & behind.rlike(_CLOSES_PATTERN))


def inside_string_sql(text: str, at: str) -> str:
    """The same for DuckDB."""
    before, behind = f"substr({text}, 1, {at} - 1)", f"substr({text}, {at})"
    bare = f"regexp_replace({before}, '{_ESCAPED}', '', 'g')"
    odd = " OR ".join(f"(length({bare}) - length(replace({bare}, {q}, ''))) % 2 = 1" for q in ("chr(39)", "chr(34)", "chr(96)"))
    return f"({odd} OR (regexp_matches({before}, '{_OPEN_PATTERN}') AND regexp_matches({behind}, '{_CLOSES_PATTERN}')))"


def trim_all(text: Column) -> Column:
    """Without white space (space and 0x09 to 0x0D) on both ends; trim() alone takes spaces."""
    return F.regexp_replace(text, r"^[\x09-\x0D ]+|[\x09-\x0D ]+\z", "")


def round_half_up(x: Column) -> Column:
    """Halves go up, towards positive infinity."""
    return F.floor(x + 0.5)


def redact(text: Column) -> Column:
    """Secrets masked, pattern after pattern."""
    for pattern, mask in REDACTIONS:
        text = F.regexp_replace(text, java(pattern), mask)
    return text


# Shapes of well-known secrets, in the order in which they are masked.
REDACTIONS = [
    (r"\bAKIA[0-9A-Z]{16}\b", "[aws-key]"),
    (r"\bgh[pousr]_[A-Za-z0-9]{20,}\b", "[github-token]"),
    (r"\bsk-[A-Za-z0-9]{20,}\b", "[api-key]"),
    (r"\bxox[abprs]-[A-Za-z0-9-]{10,}\b", "[slack-token]"),
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "[private-key]"),
    (r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "[jwt]"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]"),
    (r"\b[0-9]{16,}\b", "[number]"),
    (r"(?i)(password|passwd|secret|token)[ ]*[:=][ ]*[^ ]+", "[credential]"),
]
