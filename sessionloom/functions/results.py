"""Status, type and counts read from the text of an action result."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sessionloom.functions.buckets import band
from sessionloom.functions.text import has_any

EXIT_NONZERO = "exit(?: code)?[=: ]+[1-9]"

# Ordered number patterns; the first pattern found decides.
COUNT_PATTERNS = {
    "files": [r"(\d+)\s+files?", r"patched\s+(\d+)\s+files?", r"modified\s+(\d+)\s+files?"],
    "matches": [r"(\d+)\s+matches?", r"found\s+(\d+)\s+occurrences?", r"(\d+)\s+occurrences?"],
    "lines": [r"\((\d+)l\)", r"(\d+)\s+lines?", r"read\s+[^ ]+\s+\((\d+)l\)"],
    "tests": [r"(\d+)\s+tests?", r"(\d+)\s+passed", r"collected\s+(\d+)"],
    "failed": [r"(\d+)\s+failed", r"failures?\s*[:=]\s*(\d+)"],
}
COUNT_CUTS = [0, 1, 2, 5, 10, 25, 50, 100]


def _low(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def status(result: Column) -> Column:
    """none / fail / ok / other."""
    low = _low(result)
    fail = has_any(low, ["failed", "failure", "error"]) | low.rlike(EXIT_NONZERO)
    good = has_any(low, ["ok", "passed", "success", "exit=0", "exit code 0"])
    return F.when(low == "", "none").when(fail, "fail").when(good, "ok").otherwise("other")


def status_with_empty(result: Column) -> Column:
    """status, with results that found nothing told apart."""
    low = _low(result)
    nothing = has_any(low, ["no match", "0 match", "no result", "0 result", "empty"])
    return F.when(low == "", "none").when(nothing, "empty").otherwise(status(low))


def status_inspect(result: Column) -> Column:
    """none / fail / empty / ok."""
    low = _low(result)
    fail = has_any(low, ["failed", "failure", "error", "traceback", "exit code 1"])
    nothing = has_any(low, ["no match", "0 match", "no result", "0 result", "empty", "not found"])
    return F.when(low == "", "none").when(fail, "fail").when(nothing, "empty").otherwise("ok")


def status_heads(result: Column) -> Column:
    """none / error / ok / other, Korean words included."""
    low = _low(result)
    bad = has_any(low, ["error", "failed", "failure", "exception", "traceback", "panic", "hunk", "conflict", "에러", "실패"])
    good = has_any(low, ["pass", "passed", "success", "green", "ok", "exit=0", "no issues", "통과", "성공"])
    return F.when(low == "", "none").when(bad, "error").when(good, "ok").otherwise("other")


def result_type(last_action: Column, result: Column, inspect: bool = False) -> Column:
    """Kind of the last result from the action and its text, first rule that holds."""
    low = _low(result)
    kind = (
        F.when((last_action == "read_file") | F.contains(F.concat(F.lit(" "), low, F.lit(" ")), F.lit(" read ")), "read")
        .when((last_action == "grep_search") | has_any(low, ["matches", "occurrences"]), "grep")
        .when(last_action == "glob_pattern", "glob")
        .when((last_action == "list_directory") | has_any(low, ["entries"]), "list")
    )
    if inspect:
        return kind.when(last_action.isin("run_tests", "run_bash", "lint_or_typecheck"), "exec").otherwise("other")
    return (
        kind.when((last_action == "run_tests") | has_any(low, ["tests", "pytest"]), "test")
        .when((last_action == "lint_or_typecheck") | has_any(low, ["lint", "type", "mypy", "tsc", "clippy"]), "lint")
        .when((last_action == "run_bash") | low.startswith("exit="), "bash")
        .when(
            last_action.isin("apply_patch", "edit_file", "write_file") | has_any(low, ["patched", "modified", "wrote"]),
            "patch",
        )
        .when(low == "", "none")
        .otherwise("other")
    )


def first_count(text: Column, kind: str) -> Column:
    """Number captured by the first pattern of the kind that is found, null without."""
    return first_number(text, COUNT_PATTERNS[kind])


def first_number(text: Column, patterns: list[str]) -> Column:
    low = _low(text)
    found = [F.regexp_extract(low, p, 1) for p in patterns]
    return F.coalesce(*[F.when(f != "", f.try_cast("long")) for f in found])


def added_removed(text: Column) -> tuple[Column, Column]:
    """Bands of inserted and deleted line counts."""
    pair = r"([0-9]+)\s*(?:insertions?|added).{0,30}?([0-9]+)\s*(?:deletions?|removed)"
    low = _low(text)
    plus, minus = F.regexp_extract(low, pair, 1), F.regexp_extract(low, pair, 2)
    both = plus != ""
    return (
        band(F.when(both, plus.try_cast("long")).otherwise(first_number(text, [r"(\d+)\+"])), COUNT_CUTS),
        band(F.when(both, minus.try_cast("long")).otherwise(first_number(text, [r"(\d+)-"])), COUNT_CUTS),
    )


def exit_zero(text: Column) -> Column:
    """'1' for a zero exit code, '0' for another one, 'na' without."""
    low = _low(text)
    return F.when(has_any(low, ["exit=0", "exit code 0"]), "1").when(low.rlike(EXIT_NONZERO), "0").otherwise("na")


def found_nothing(text: Column) -> Column:
    return _low(text).rlike(r"\b(no|0)\s+(matches|results|occurrences)\b|not\s+found|found\s+0")
