"""Deterministic prompt rewrite used when no generator is at hand."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sessionloom.functions.base import let
from sessionloom.functions.text import collapse

# First applicable replacement wins; Latin needles ignore case.
REPLACEMENTS = {
    "좀": "한번",
    "보여줘": "열어서 확인해줘",
    "찾아줘": "검색해서 확인해줘",
    "돌려봐": "실행해서 확인해봐",
    "고쳐": "수정해",
    "추가해줘": "넣어줘",
    "요약해줘": "정리해줘",
    "show me": "pull up",
    "find": "look for",
    "run": "execute",
    "fix": "patch",
}


def _folded(text: Column, needle: str) -> Column:
    return F.lower(text) if needle.isascii() else text


def replace_first(text: Column, needle: str, new: str) -> Column:
    """Replace the first hit only; Latin needles ignore ASCII case."""
    return let(
        F.instr(_folded(text, needle), needle),
        lambda at: F.concat(
            F.substring(text, F.lit(1), at - 1), F.lit(new), F.substring(text, at + len(needle), F.length(text))
        ),
    )


def _draft(text: Column) -> Column:
    polite = F.when(text.rlike("[가-힣]"), F.concat(text, F.lit(" 확인 부탁해"))).otherwise(
        F.concat(F.lit("please "), text)
    )
    for needle, new in reversed(REPLACEMENTS.items()):
        hit = F.contains(_folded(text, needle), F.lit(needle))
        polite = F.when(hit, replace_first(text, needle, new)).otherwise(polite)
    return polite


def rule_rewrite(prompt: Column) -> Column:
    """First applicable replacement, else a polite prefix or suffix by script."""
    return strip_output(let(collapse(prompt), _draft))


def _unquote(body: Column) -> Column:
    pair = (body.startswith('"') & body.endswith('"')) | (body.startswith("'") & body.endswith("'"))
    # A lone quote character is both start and end: dropping both leaves nothing.
    inner = F.when(F.length(body) >= 2, F.substring(body, F.lit(2), F.length(body) - 2)).otherwise("")
    return F.when(pair, inner).otherwise(body)


def strip_output(text: Column) -> Column:
    """Drop list markers at the start and one pair of surrounding quotes."""
    body = F.trim(F.regexp_replace(collapse(text), r"^[-*\p{Nd}.)\s]+", ""))
    return collapse(let(body, _unquote))
