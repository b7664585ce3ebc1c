"""Whitespace, length and word functions on strings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Unicode white space, spelled out so that every regex engine agrees.
SPACE = r"\s\x0b\x1c-\x1f\x85\p{Z}"
WORD = r"\p{L}\p{N}_"


def as_text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def collapse(text: Column) -> Column:
    """Runs of white space become one blank, ends trimmed, null becomes ''."""
    return F.trim(F.regexp_replace(as_text(text), f"[{SPACE}]+", " "))


def compact(text: Column, limit: int) -> Column:
    """collapse, then the first `limit` characters."""
    return F.substring(collapse(text), 1, limit)


def fast_compact(text: Column, limit: int) -> Column:
    """Line breaks become blanks, ends stripped, inner runs kept."""
    flat = F.regexp_replace(as_text(text), r"[\n\r]", " ")
    return F.substring(F.regexp_replace(flat, f"^[{SPACE}]+|[{SPACE}]+$", ""), 1, limit)


def word_count(text: Column) -> Column:
    """Number of runs without white space."""
    return F.regexp_count(as_text(text), F.lit(f"[^{SPACE}]+"))


def has_any(text: Column, needles: list[str]) -> Column:
    """Does the lower-cased text contain any of the needles? One regular expression of plain words."""
    return F.lower(text).rlike("|".join(_plain(n) for n in needles))


def _plain(needle: str) -> str:
    """A regular expression that matches the needle itself."""
    return "".join(c if c.isalnum() or c in " _=" else "\\" + c for c in needle)


def flag(condition: Column) -> Column:
    """'1' or '0'."""
    return F.when(condition, "1").otherwise("0")


def has_hangul(text: Column) -> Column:
    return as_text(text).rlike("[가-힣]")


def slug_join(values: Column, sep: str = " ") -> Column:
    return F.array_join(values, sep)
