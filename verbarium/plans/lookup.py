"""Plans of a lookup: glob patterns as LIKE with a pushed-down prefix or a reversed suffix."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT, WILDCARD, PREFIX, LOOSE_EXACT, LOOSE_PREFIX, TERM_CONTAINS, CONTENT = range(7)


@dataclass(frozen=True)
class Query:
    raw: str

    @property
    def q(self) -> str:
        return self.raw.strip().lower()

    @property
    def has_wildcard(self) -> bool:
        return bool(re.search(r"[?*]", self.q))

    @property
    def has_space(self) -> bool:
        return " " in self.q


def to_like(pattern: str) -> str:
    """``*`` any run, ``?`` one code point; everything else, brackets too, is literal."""
    return "".join("%" if c == "*" else "_" if c == "?" else "\\" + c if c in "%_\\" else c for c in pattern)


def literal_prefix(pattern: str) -> str:
    return re.match(r"[^?*]*", pattern)[0]


def literal_suffix(pattern: str) -> str | None:
    """What follows the last wildcard of a pattern that starts with one, if two characters or more."""
    if not re.match(r"[?*]", pattern):
        return None
    tail = re.search(r"[^?*]*$", pattern)[0]
    return tail if len(tail) >= 2 else None


def prefix_upper_bound(prefix: str) -> str | None:
    """The least string above all that start with a prefix, in code-point order."""
    for i in range(len(prefix) - 1, -1, -1):
        c = ord(prefix[i]) + 1
        c = 0xE000 if 0xD800 <= c < 0xE000 else c
        if c <= 0x10FFFF:
            return prefix[:i] + chr(c)
    return None


def glob(pattern: str, term: str = "term", reverse: str = "term_rev") -> Column:
    """A predicate that prunes by the literal prefix, or on the reversed column by the literal suffix."""
    like = F.col(term).like(to_like(pattern))
    if tail := literal_suffix(pattern):
        return F.col(reverse).startswith(tail[::-1]) & like
    if head := literal_prefix(pattern):
        return F.col(term).startswith(head) & like
    return like
