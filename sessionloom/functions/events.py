"""Functions over the ordered history of a session step (array of event structs).

All of them are row-local array expressions: no shuffle, usable in batch and streaming.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from sessionloom.functions.base import let
from sessionloom.functions.text import compact
from sessionloom.operators.ordered import last_items


def items(history: Column) -> Column:
    return F.coalesce(history, F.array().cast("array<struct<role:string,content:string,name:string,args:map<string,string>,result_summary:string>>"))


def filled(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def acts(history: Column) -> Column:
    """Events that carry an action name."""
    return F.filter(items(history), lambda e: filled(e["name"]))


def action_names(history: Column) -> Column:
    return F.transform(acts(history), lambda e: e["name"])


def trace_names(history: Column) -> Column:
    """Names of events in the assistant_action role, 'unknown_action' when blank."""
    return F.transform(
        F.filter(items(history), lambda e: e["role"] == "assistant_action"),
        lambda e: F.when(F.trim(F.coalesce(e["name"], F.lit(""))) == "", "unknown_action").otherwise(F.trim(e["name"])),
    )


def nth_last(values: Column, n: int, default: str = "NONE") -> Column:
    """n-th element from the end (1 = last)."""
    return F.coalesce(F.get(values, F.size(values) - n), F.lit(default))


def tail_text(values: Column, k: int, sep: str = ">", empty: str = "START") -> Column:
    return F.when(F.size(values) > 0, F.array_join(last_items(values, k), sep)).otherwise(empty)


def ngrams(values: Column, n: int, sep: str) -> Column:
    """Adjacent n-tuples joined by sep, in order."""
    count = F.greatest(F.size(values) - (n - 1), F.lit(0))
    out = F.slice(values, F.lit(1), count)
    for i in range(1, n):
        out = F.zip_with(out, F.slice(values, F.lit(i + 1), count), lambda a, b: F.concat(a, F.lit(sep), b))
    return out


def last_where(history: Column, test, value, default: Column) -> Column:
    """value(event) of the newest event passing test."""
    return F.coalesce(
        let(F.filter(items(history), test), lambda es: value(F.get(es, F.size(es) - 1))), default
    )


def last_result(history: Column, limit: int = 500) -> Column:
    return last_where(
        history, lambda e: filled(e["result_summary"]), lambda e: compact_or_null(e["result_summary"], limit), F.lit("")
    )


def compact_or_null(text: Column, limit: int) -> Column:
    return F.when(text.isNotNull(), compact(text, limit))


def last_user(history: Column, limit: int = 500, need_content: bool = False) -> Column:
    """Newest user message; need_content skips user events without text."""

    def test(e: Column) -> Column:
        said = F.coalesce(e["role"] == "user", F.lit(False))
        return said & filled(e["content"]) if need_content else said

    return last_where(history, test, lambda e: compact_or_null(e["content"], limit), F.lit(""))


def is_list(value: Column) -> Column:
    """Argument values that hold the JSON text of a list."""
    return value.startswith("[") & F.from_json(value, "array<string>").isNotNull()


def value_list(value: Column) -> Column:
    """Elements of a list value, a scalar as a list of one."""
    return F.when(value.startswith("["), F.coalesce(F.from_json(value, "array<string>"), F.array(value))).otherwise(
        F.array(value)
    )


def quoted(text: Column) -> Column:
    """JSON string literal."""
    return let(F.to_json(F.array(text)), lambda j: F.substring(j, F.lit(2), F.length(j) - 2))


def args_json(args: Column, comma: str = ", ", colon: str = ": ") -> Column:
    """JSON text of an argument map with sorted keys."""

    def render(value: Column) -> Column:
        listed = F.transform(F.from_json(value, "array<string>"), quoted)
        return F.when(is_list(value), F.concat(F.lit("["), F.array_join(listed, comma), F.lit("]"))).otherwise(quoted(value))

    pairs = F.transform(
        F.array_sort(F.map_entries(args)),
        lambda p: F.concat(quoted(p["key"]), F.lit(colon), render(p["value"])),
    )
    return F.concat(F.lit("{"), F.array_join(pairs, comma), F.lit("}"))


def event_signature(event: Column) -> Column:
    """SHA-1 of the event as JSON with sorted keys and no blanks; absent fields are left out."""
    fields = [
        ("args", args_json(event["args"], ",", ":")),
        ("content", quoted(event["content"])),
        ("name", quoted(event["name"])),
        ("result_summary", quoted(event["result_summary"])),
        ("role", quoted(event["role"])),
    ]
    shown = [F.when(event[k].isNotNull(), F.concat(F.lit(f'"{k}":'), v)) for k, v in fields]
    return F.sha1(F.encode(F.concat(F.lit("{"), F.concat_ws(",", *shown), F.lit("}")), "UTF-8"))


def flat_value(args: Column) -> Column:
    """Argument map as 'key=value' parts sorted by key; list values joined by blanks, empty ones left out."""

    def one(value: Column) -> Column:
        parts = F.filter(F.transform(F.from_json(value, "array<string>"), lambda v: F.trim(v)), lambda v: v != "")
        return F.when(is_list(value), F.array_join(parts, " ")).otherwise(F.trim(F.coalesce(value, F.lit(""))))

    pairs = F.transform(
        F.array_sort(F.map_entries(args)), lambda p: F.struct(p["key"].alias("k"), one(p["value"]).alias("v"))
    )
    kept = F.filter(pairs, lambda p: p["v"] != "")
    return F.coalesce(F.array_join(F.transform(kept, lambda p: F.concat(p["k"], F.lit("="), p["v"])), " "), F.lit(""))


def has_args(args: Column) -> Column:
    return F.coalesce(F.size(args) > 0, F.lit(False))


def last_args(history: Column, limit: int) -> Column:
    """JSON of the newest non-empty arguments of an action, 'none' without any."""
    return last_where(
        history, lambda e: filled(e["name"]) & has_args(e["args"]),
        lambda e: compact_or_null(args_json(e["args"]), limit), F.lit("none"),
    )


def last_action_args(history: Column, limit: int = 260) -> Column:
    """JSON of the newest action's arguments even when it has none ('')."""
    return last_where(
        history, lambda e: filled(e["name"]),
        lambda e: F.when(e.isNotNull(), F.coalesce(compact_or_null(args_json(e["args"]), limit), F.lit(""))), F.lit("none"),
    )


def event_lines(history: Column, k: int, args_limit: int = 110, result_limit: int = 120) -> Column:
    """'name args=.. result=..' of the newest k actions, in time order."""
    return F.transform(
        last_items(acts(history), k),
        lambda e: F.concat(
            e["name"], F.lit(" args="),
            F.coalesce(compact_or_null(args_json(e["args"]), args_limit), F.lit("{}")),
            F.lit(" result="), compact(e["result_summary"], result_limit),
        ),
    )


def arg_values(
    history: Column, keys: Sequence[str], limit: int, item_limit: int = 100, value_limit: int = 120
) -> Column:
    """Argument values for a set of keys, gathered newest event first.

    Gathering stops after the event that reaches the limit; of what was gathered the
    oldest `limit` values stay, in oldest-first order (a list value comes out reversed).
    """
    return F.reverse(last_items(gathered(history, keys, limit, item_limit, value_limit), limit))


def gathered(history: Column, keys: Sequence[str], limit: int, item_limit: int, value_limit: int) -> Column:
    """Argument values newest event first, until an event brings them to `limit`."""
    none = F.array().cast("array<string>")

    def of_key(args: Column, key: str) -> Column:
        value = F.try_element_at(args, F.lit(key))
        many = F.transform(F.from_json(value, "array<string>"), lambda v: compact(v, item_limit))
        one = F.array(compact(value, value_limit))
        return F.when(~filled(value), none).when(is_list(value), many).otherwise(one)

    per_event = F.transform(F.reverse(items(history)), lambda e: F.concat(*[of_key(e["args"], k) for k in keys]))
    return F.aggregate(
        per_event, none, lambda acc, vs: F.when(F.size(acc) >= limit, acc).otherwise(F.concat(acc, vs))
    )


def dedupe_tail(values: Column, limit: int, fold_case: bool = True, width: int = 140) -> Column:
    """Drop blanks and all but the last occurrence; of the rest the oldest `limit` stay."""
    key = (lambda v: F.lower(v)) if fold_case else (lambda v: v)

    def distinct(vs: Column) -> Column:
        return F.filter(
            vs,
            lambda v, i: (v != "")
            & ~F.exists(F.slice(vs, i + 2, F.size(vs)), lambda later: key(later) == key(v)),
        )

    return F.slice(let(F.transform(values, lambda v: compact(v, width)), distinct), 1, limit)


# Patterns of paths and globs.
PATH = (
    r"(?i)[\p{L}\p{N}_./\\-]+\.(?:py|js|jsx|ts|tsx|json|md|txt|ya?ml|toml|go|rs|java|kt|cpp|c|h|css|html|sql|sh|ps1)"
)
GLOB = (
    r"(?:\*\*?[/.\p{L}\p{N}_-]*|[/.\p{L}\p{N}_-]*\*\*?|[/.\p{L}\p{N}_-]*\*[/.\p{L}\p{N}_-]*|\{[^}]+\}|\[[^\]]+\])"
)
PATH_KEYS = ["path", "paths", "file", "files"]
PATTERN_KEYS = ["pattern", "query", "glob"]
CMD_KEYS = ["cmd", "command", "commands", "script"]
TARGET_KEYS = ["target", "targets", "name", "symbol"]


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def open_files(meta: Column) -> Column:
    return F.coalesce(meta["workspace"]["open_files"], F.array().cast("array<string>"))


def recent_paths(history: Column, meta: Column, limit: int, variant: str = "base") -> Column:
    """Open files, then path arguments, then paths found in results and arguments.

    The scan over events runs newest first and stops once 2 * limit values are held.
    variant: 'base', 'heads' (case-sensitive, wider values) or 'inspect' (arguments deduplicated).
    """
    widths = {"base": (100, 120, 140), "heads": (120, 160, 160), "inspect": (120, 160, 180)}[variant]
    if variant == "inspect":
        named = recent_arg_values(history, PATH_KEYS, limit)
    else:
        named = arg_values(history, PATH_KEYS, limit, *widths[:2])
    chunks = F.transform(
        F.reverse(items(history)),
        lambda e: F.flatten(
            F.concat(
                F.array(find_all(e["result_summary"], PATH)),
                F.transform(
                    F.coalesce(F.map_values(e["args"]), F.array().cast("array<string>")), lambda v: find_all(v, PATH)
                ),
            )
        ),
    )
    # The stop test runs after an event was read, so the newest event is always scanned.
    first = F.concat(open_files(meta), named, F.coalesce(F.get(chunks, F.lit(0)), F.array().cast("array<string>")))
    rest = F.aggregate(
        F.slice(chunks, F.lit(2), F.size(chunks)),
        first,
        lambda acc, vs: F.when(F.size(acc) >= 2 * limit, acc).otherwise(F.concat(acc, vs)),
    )
    return dedupe_tail(rest, limit, fold_case=variant != "heads", width=widths[2])


def recent_arg_values(history: Column, keys: Sequence[str], limit: int) -> Column:
    """Argument values newest first, deduplicated (the inspect form)."""
    return dedupe_tail(gathered(history, keys, limit, 120, 160), limit, width=180)


def recent_patterns(history: Column, prompt: Column, limit: int, variant: str = "base") -> Column:
    """Pattern arguments, then globs found in the prompt."""
    if variant == "inspect":
        named, reach, width = recent_arg_values(history, PATTERN_KEYS, limit), 800, 180
    else:
        widths = (100, 120) if variant == "base" else (120, 160)
        named = arg_values(history, PATTERN_KEYS, limit, *widths)
        reach, width = 600, 140 if variant == "base" else 120
    values = F.concat(named, find_all(compact(prompt, reach), GLOB))
    return dedupe_tail(values, limit, fold_case=variant != "heads", width=width)


def edited_files(history: Column) -> Column:
    """Files named by edit, patch and write events, newest first, until six are held."""

    def of(e: Column) -> Column:
        lists = [
            F.when(filled(F.try_element_at(e["args"], F.lit(k))), value_list(F.try_element_at(e["args"], F.lit(k)))).otherwise(
                F.array().cast("array<string>")
            )
            for k in ("path", "file", "paths", "files")
        ]
        return F.when(e["name"].isin("edit_file", "apply_patch", "write_file"), F.concat(*lists)).otherwise(
            F.array().cast("array<string>")
        )

    return F.aggregate(
        F.transform(F.reverse(items(history)), of),
        F.array().cast("array<string>"),
        lambda acc, vs: F.when(F.size(acc) >= 6, acc).otherwise(F.concat(acc, vs)),
    )


def norm_path(value: Column) -> Column:
    """Forward slashes, no outer blanks, lower case."""
    return F.lower(F.trim(F.replace(F.coalesce(value, F.lit("")), F.lit("\\"), F.lit("/"))))


def base_name(path: Column) -> Column:
    """Last path component; trailing slashes are dropped first."""
    return F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]*)$", 1)


def extension(path: Column, longest: int = 12) -> Column:
    """Lower-cased letters and digits after the last dot at the end, '' without."""
    return F.lower(F.regexp_extract(path, rf"\.([A-Za-z0-9]{{1,{longest}}})$", 1))


def suffix(path: Column) -> Column:
    """Suffix with its dot in lower case; 'no_ext' without one (hidden names have none)."""
    return let(
        F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1)), lambda s: F.when(s == "", "no_ext").otherwise(s)
    )


def sorted_extensions(paths: Column, longest: int = 12) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(paths, lambda p: extension(p, longest)), lambda x: x != "")))


def read_paths(history: Column) -> Column:
    """Normalised paths that earlier read_file events named."""
    of = lambda e: F.array(*[norm_path(F.try_element_at(e["args"], F.lit(k))) for k in ("path", "file", "filepath")])
    reads = F.filter(items(history), lambda e: e["name"] == "read_file")
    return F.filter(F.array_distinct(F.flatten(F.transform(reads, of))), lambda p: p != "")


def overlaps(paths: Column, others: Column) -> Column:
    """Do the two path lists share a normalised path?"""
    clean = lambda ps: F.filter(F.transform(ps, norm_path), lambda p: p != "")
    return F.coalesce(F.arrays_overlap(clean(paths), clean(others)), F.lit(False))


def count_of(values: Column, *names: str) -> Column:
    return F.size(F.filter(values, lambda v: v.isin(*names)))


def user_turns(history: Column) -> Column:
    return F.size(F.filter(items(history), lambda e: e["role"] == "user"))


def failed(text: Column) -> Column:
    """Failure words or a non-zero exit code."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return low.rlike("failed|failure|error") | low.rlike("exit(?: code)?[=: ]+[1-9]")


def failed_results(history: Column) -> Column:
    return F.size(F.filter(items(history), lambda e: failed(e["result_summary"])))


# Failure terms counted by the trace view.
FAILURE_TERMS = ["fail", "failed", "error", "traceback", "exception", "timeout", "missing", "not found"]


def trace_results(history: Column) -> Column:
    """Lower-cased, stripped results of assistant_action events that are not blank."""
    texts = F.transform(
        F.filter(items(history), lambda e: e["role"] == "assistant_action"),
        lambda e: F.lower(F.trim(F.coalesce(e["result_summary"], F.lit("")))),
    )
    return F.filter(texts, lambda t: t != "")


def failure_terms(history: Column) -> Column:
    """Occurrences of each failure term in the last eight results."""
    joined = F.array_join(last_items(trace_results(history), 8), " ")
    return let(joined, lambda j: sum((F.regexp_count(j, F.lit(t)) for t in FAILURE_TERMS[1:]), F.regexp_count(j, F.lit(FAILURE_TERMS[0]))))


def sorted_counts(values: Column) -> Column:
    """'name:count' of each distinct value, sorted by name, joined by blanks."""
    named = F.transform(
        F.array_sort(F.array_distinct(values)),
        lambda v: F.concat(v, F.lit(":"), F.size(F.filter(values, lambda x: x == v)).cast("string")),
    )
    return F.array_join(named, " ")


def symbols(text: Column, limit: int) -> Column:
    """Identifiers, back-ticked and quoted parts, common words left out."""
    found = F.concat(
        find_all(text, r"(?<![\p{L}\p{N}_])[A-Za-z_][A-Za-z0-9_]{2,}(?![\p{L}\p{N}_])"),
        find_all(text, "`([^`]{2,80})`", 1),
        find_all(text, "['\"]([^'\"]{2,80})['\"]", 1),
    )
    tokens = F.filter(
        F.transform(found, lambda s: compact(s, 80)),
        # Words that are no symbols.
        lambda s: (s != "") & ~F.lower(s).isin("the", "and", "for", "with", "this", "that", "please"),
    )
    return dedupe_tail(tokens, limit)


def primary_language(mix: Column, known: Sequence[str] | None = None) -> Column:
    """Key of the largest share, first key on ties, lower case; 'none' when empty, 'other' when unlisted."""
    ranked = F.array_max(
        F.transform(
            F.map_entries(mix),
            lambda e, i: F.struct(F.coalesce(e["value"], F.lit(0.0)).alias("v"), (-i).alias("i"), F.lower(e["key"]).alias("k")),
        )
    )
    name = F.coalesce(ranked["k"], F.lit("none"))
    if known is None:
        return name
    return F.when(name.isin(*known), name).otherwise("other")


def top_language(mix: Column, default: str = "unknown") -> Column:
    """Like primary_language with the key's own case."""
    ranked = F.array_max(
        F.transform(
            F.map_entries(mix),
            lambda e, i: F.struct(F.coalesce(e["value"], F.lit(0.0)).alias("v"), (-i).alias("i"), e["key"].alias("k")),
        )
    )
    return F.coalesce(ranked["k"], F.lit(default))
