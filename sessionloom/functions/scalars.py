"""One-hot vectors, section maps and paraphrase checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from sessionloom.functions.base import let
from sessionloom.functions.text import SPACE, WORD, as_text, collapse, has_any
from sessionloom.schema import strings


def one_hot(value: Column, choices: Sequence[str]) -> Column:
    """1.0 at the lower-cased value; unknown values count as 'other' if listed, else 'unknown'."""
    fallback = "other" if "other" in choices else "unknown"
    low = F.lower(F.when(F.coalesce(value, F.lit("")) == "", "unknown").otherwise(value))
    known = F.when(low.isin(*choices), low).otherwise(fallback)
    return let(known, lambda k: F.transform(strings(choices), lambda c: F.when(c == k, 1.0).otherwise(0.0)))


def one_hot_other(value: Column, choices: Sequence[str]) -> Column:
    """Blank is 'unknown', anything unlisted is 'other'; all zero when 'other' is not listed."""
    low = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    low = F.when(low == "", "unknown").otherwise(low)
    known = F.when(low.isin(*choices), low).otherwise("other")
    return let(known, lambda k: F.transform(strings(choices), lambda c: F.when(c == k, 1.0).otherwise(0.0)))


def sections(text: Column) -> Column:
    """Map from [NAME] lines to the text below each of them; the last of equal names wins."""
    # A section starts at a line that is wholly in brackets.
    lines = F.split(text, "\n")
    named = F.transform(
        lines,
        lambda l: F.when(
            l.startswith("[") & l.endswith("]"), F.regexp_replace(l, r"^[\[\]]+|[\[\]]+$", "")
        ),
    )

    def body(ls: Column, heads: Column) -> Column:
        starts = F.filter(F.transform(heads, lambda h, i: F.when(h.isNotNull(), i)), lambda i: i.isNotNull())

        def one(start: Column, k: Column) -> Column:
            stop = F.coalesce(F.get(starts, k + 1), F.size(ls))
            inner = F.array_join(F.slice(ls, start + 2, stop - start - 1), "\n")
            return F.struct(
                F.get(heads, start).alias("key"), F.regexp_replace(inner, f"^[{SPACE}]+|[{SPACE}]+$", "").alias("value")
            )

        parts = F.transform(starts, one)
        last = F.filter(parts, lambda p, i: ~F.exists(F.slice(parts, i + 2, F.size(parts)), lambda o: o["key"] == p["key"]))
        return F.map_from_entries(last)

    return let(
        F.struct(lines.alias("l"), named.alias("h")), lambda s: body(s["l"], s["h"])
    )


# Pointing words that a rewrite has to keep.
DEIXIS = ["다시", "아까", "방금", "그때", "이전", "위에", "이거", "저거", "그거", "한번더", "한번 더", "한 번 더"]

# Patterns of file tokens, quoted code and sentence ends.
FILE_TOKEN = rf"[{WORD}./-]+\.[A-Za-z]{{1,5}}"
BACKTICK = "`([^`]+)`"
# The same tokens, tried only where a run of their characters begins or the last token ended: linear in a long run.
_FILE_IN_RUN = rf"(?:(?<![{WORD}./-])|\G)" + FILE_TOKEN
SENTENCE_END = "[.!?。！？]+"

# Words that show an action in a rewrite (first rule set).
ACTION_WORDS = {
    "run_tests": ["run", "test", "suite", "pytest", "jest", "vitest", "테스트", "돌려", "실행", "태워"],
    "run_bash": ["run", "execute", "cmd", "command", "bash", "build", "install", "vet", "dbt", "pod", "돌려", "실행", "빌드"],
    "lint_or_typecheck": ["lint", "type", "typecheck", "mypy", "tsc", "ruff", "정적", "타입"],
    "read_file": ["open", "read", "show", "look", "열어", "열어서", "보여", "읽어", "확인"],
    "grep_search": ["find", "search", "grep", "where", "reference", "usage", "찾아", "검색", "어디", "호출", "참조"],
    "glob_pattern": ["glob", "pattern", "files", "파일들", "패턴", "훑어"],
    "list_directory": ["list", "tree", "directory", "folder", "목록", "구조", "폴더", "디렉"],
    "edit_file": ["fix", "edit", "change", "update", "patch", "rename", "wrap", "add", "고쳐", "수정", "추가", "바꿔", "연결"],
    "apply_patch": ["patch", "edit", "change", "fix", "update", "rename", "refactor", "패치", "수정", "정리", "손봐"],
    "write_file": ["create", "write", "scaffold", "make", "fresh", "생성", "작성", "만들"],
    "ask_user": ["뭐부터", "해야 하나", "막막", "물어", "확인해", "질문"],
    "plan_task": ["plan", "계획", "방향", "먼저", "순서", "정리"],
    "respond_only": ["요약", "마무리", "여기까지", "고마워", "수고"],
    "web_search": ["search", "web", "latest", "요즘", "국룰", "비교", "검색"],
}

# The same for the second rule set, as case-insensitive alternatives.
_EDIT_WORDS = "고쳐|수정|바꿔|추가|넣어|패치|작성|만들|fix|change|add|update|patch|rename|write"
ACTION_PATTERNS = {
    "run_tests": "테스트|돌려|실행|run|test|suite|pytest|jest",
    "lint_or_typecheck": "lint|type|check|타입|검사|정적",
    "read_file": "열어|보자|봐|보여|확인|open|read|show|look",
    "grep_search": "찾아|검색|어디|위치|grep|find|search|where",
    "edit_file": _EDIT_WORDS,
    "write_file": _EDIT_WORDS,
    "apply_patch": _EDIT_WORDS,
    "ask_user": r"물어|질문|어느|뭐가|어떻게|맞나|should|which|what|\?",
}


def deixis_terms(text: Column) -> Column:
    return F.filter(strings(DEIXIS), lambda t: F.contains(text, t))


def tokens(text: Column, pattern: str, group: int = 0) -> Column:
    """Distinct matches, sorted."""
    return F.sort_array(F.array_distinct(_matches(text, pattern, group)))


def _matches(text: Column, pattern: str, group: int) -> Column:
    """Matches in order. File tokens are looked for only in pieces between blanks that have a dot before a letter."""
    if pattern != FILE_TOKEN:
        return F.regexp_extract_all(as_text(text), F.lit(pattern), F.lit(group))
    pieces = F.filter(F.split(as_text(text), " "), _may_hold_file)
    return F.flatten(F.transform(pieces, lambda p: F.regexp_extract_all(p, F.lit(_FILE_IN_RUN), F.lit(0))))


def _may_hold_file(piece: Column) -> Column:
    return F.contains(piece, F.lit(".")) & piece.rlike(r"\.[A-Za-z]")


def file_tokens(text: Column) -> Column:
    return tokens(text, FILE_TOKEN)


def backtick_tokens(text: Column) -> Column:
    return tokens(text, BACKTICK, 1)


def missing_in(values: Column, text: Column) -> Column:
    """Values that the text does not contain."""
    return F.filter(values, lambda v: ~F.contains(text, v))


def subset_kept(pattern: str, original: Column, paraphrase: Column, group: int = 0) -> Column:
    """Every token of the original is a token of the paraphrase."""
    return F.size(F.array_except(_matches(original, pattern, group), _matches(paraphrase, pattern, group))) == 0


def action_words_kept(action: Column, paraphrase: Column) -> Column:
    """First rule set: any word of the action's list; actions without a list pass."""
    out = F.lit(True)
    for name, words in ACTION_WORDS.items():
        out = F.when(action == name, has_any(paraphrase, words)).otherwise(out)
    return out


def action_pattern_kept(action: Column, paraphrase: Column) -> Column:
    """Second rule set: the action's pattern is found; actions without one pass."""
    out = F.lit(True)
    for name, pattern in ACTION_PATTERNS.items():
        out = F.when(action == name, as_text(paraphrase).rlike(f"(?i){pattern}")).otherwise(out)
    return out


def sentences_masked(text: Column) -> Column:
    """Sentence count with dots in numbers and file tokens masked (second rule set)."""

    def mask(piece: Column) -> Column:
        plain = F.regexp_replace(piece, r"(?<=\p{Nd})\.(?=\p{Nd})", "<DOT>")
        return F.when(_may_hold_file(plain), F.regexp_replace(plain, _FILE_IN_RUN, "<FILE>")).otherwise(plain)

    # Dots are masked piece by piece, since neither numbers nor file tokens hold blanks.
    pieces = F.transform(F.split(as_text(text), " "), lambda p: F.when(F.contains(p, F.lit(".")), mask(p)).otherwise(p))
    return F.size(F.filter(F.split(F.array_join(pieces, " "), SENTENCE_END), lambda p: p.rlike(f"[^{SPACE}]")))


def sentences_protected(text: Column) -> Column:
    """Sentence count with dots in numbers, calls, names and file tokens protected (first rule set)."""

    def protect(t: Column) -> Column:
        out = F.regexp_replace(t, r"(?<=\p{Nd})\.(?=\p{Nd})", "<DOT>")
        out = F.regexp_replace(out, rf"\.(?=[A-Za-z_][{WORD}]*\()", "<DOT>")
        out = F.regexp_replace(out, rf"(?<![{SPACE}])\.(?=[A-Za-z_])", "<DOT>")
        return F.aggregate(
            file_tokens(t), out, lambda acc, tok: F.replace(acc, tok, F.replace(tok, F.lit("."), F.lit("<DOT>")))
        )

    def count(t: Column) -> Column:
        parts = F.filter(F.split(protect(t), SENTENCE_END), lambda p: F.trim(p) != "")
        return F.when(t == "", 0).otherwise(F.greatest(F.lit(1), F.size(parts)))

    return let(collapse(text), count)


def length_ratio(original: Column, paraphrase: Column) -> Column:
    return F.length(as_text(paraphrase)) / F.greatest(F.length(as_text(original)), F.lit(1))


def length_kept(original: Column, paraphrase: Column) -> Column:
    """[0.4, 4.0] for originals of at most 12 characters, else [0.5, 2.2]."""
    ratio = length_ratio(original, paraphrase)
    return F.when(F.length(as_text(original)) <= 12, ratio.between(0.4, 4.0)).otherwise(ratio.between(0.5, 2.2))
