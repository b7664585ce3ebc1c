"""SQL building blocks over the events of a session step (DuckDB)."""

from __future__ import annotations

from itertools import count

from sessionloom.catalog.oracle import GROUP_CASE, arr, compact, head, q, tail

_ids = count()


def let(value: str, body) -> str:
    """body(name) with value bound to name."""
    v = f"v{next(_ids)}"
    return f"list_transform([{value}], lambda {v}: {body(v)})[1]"


def has(text: str, needles) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(n)})" for n in needles) + ")"


ACTS = "list_filter(evs, lambda e: coalesce(e.name, '') <> '')"
NAMES = "list_transform(list_filter(evs, lambda e: coalesce(e.name, '') <> ''), lambda e: e.name)"

LAST_RESULT = f"coalesce({compact('(list_filter(evs, lambda e: coalesce(e.res, ' + q('') + ') <> ' + q('') + '))[-1].res', 500)}, '')"
LAST_USER = f"{compact('(list_filter(evs, lambda e: e.role = ' + q('user') + '))[-1].content', 500)}"
LAST_USER_SAID = compact(
    "(list_filter(evs, lambda e: e.role = 'user' AND coalesce(e.content, '') <> ''))[-1].content", 500
)


def args_json(args: str, comma: str = ", ", colon: str = ": ") -> str:
    a, x = f"a{next(_ids)}", f"x{next(_ids)}"
    return (
        f"'{{' || array_to_string(list_transform(list_sort({args}), lambda {a}: '\"' || {a}.k || '\"{colon}' || "
        f"CASE WHEN {a}.is_list THEN '[' || array_to_string(list_transform({a}.vs, lambda {x}: '\"' || {x} || '\"'), {q(comma)}) || ']' "
        f"ELSE '\"' || {a}.v || '\"' END), {q(comma)}) || '}}'"
    )


LAST_ARGS_EV = "(list_filter(evs, lambda e: coalesce(e.name, '') <> '' AND len(coalesce(e.args, [])) > 0))[-1].args"


def last_args(n: int) -> str:
    return f"coalesce(left({args_json(LAST_ARGS_EV)}, {n}), 'none')"


def event_lines(k: int) -> str:
    e = f"e{next(_ids)}"
    return (
        f"list_transform({tail(ACTS, k)}, lambda {e}: {e}.name || ' args=' || coalesce(left({args_json(e + '.args')}, 110), '{{}}')"
        f" || ' result=' || {compact(e + '.res', 120)})"
    )


def gathered(keys, limit: int) -> str:
    e, k, a, acc, x = (f"{c}{next(_ids)}" for c in ("e", "k", "a", "acc", "x"))
    per = (
        f"list_transform(list_reverse(evs), lambda {e}: flatten(list_transform({arr(keys)}, lambda {k}: "
        f"flatten(list_transform(list_filter(coalesce({e}.args, []), lambda {a}: {a}.k = {k}), lambda {a}: {a}.vs)))))"
    )
    return (
        f"list_reduce({per}, lambda {acc}, {x}: CASE WHEN len({acc}) >= {limit} THEN {acc} ELSE list_concat({acc}, {x}) END, []::VARCHAR[])"
    )


def arg_values(keys, limit: int) -> str:
    return f"list_reverse({tail(gathered(keys, limit), limit)})"


def dedupe(values: str, limit: int, fold_case: bool = True, width: int = 140) -> str:
    x, v, i, z = (f"{c}{next(_ids)}" for c in ("x", "v", "i", "z"))
    low = (lambda t: f"lower({t})") if fold_case else (lambda t: t)
    shaped = f"list_transform({values}, lambda {x}: {compact(x, width)})"
    kept = let(
        shaped,
        lambda vs: f"list_filter({vs}, lambda {v}, {i}: {v} <> '' AND NOT list_contains(list_transform(list_slice({vs}, {i} + 1, len({vs})), "
        f"lambda {z}: {low(z)}), {low(v)}))",
    )
    return head(kept, limit)


PATH_RX = (
    r"(?i)[\p{L}\p{N}_./\\-]+\.(?:py|js|jsx|ts|tsx|json|md|txt|ya?ml|toml|go|rs|java|kt|cpp|c|h|css|html|sql|sh|ps1)"
)
GLOB_RX = (
    r"(?:\*\*?[/.\p{L}\p{N}_-]*|[/.\p{L}\p{N}_-]*\*\*?|[/.\p{L}\p{N}_-]*\*[/.\p{L}\p{N}_-]*|\{[^}]+\}|\[[^\]]+\])"
)
PATH_KEYS = ["path", "paths", "file", "files"]
PATTERN_KEYS = ["pattern", "query", "glob"]
CMD_KEYS = ["cmd", "command", "commands", "script"]
TARGET_KEYS = ["target", "targets", "name", "symbol"]


def found(text: str, rx: str, group: int = 0) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), {q(rx)}, {group})"


def recent_paths(limit: int, variant: str = "base") -> str:
    e, a, acc, x = (f"{c}{next(_ids)}" for c in ("e", "a", "acc", "x"))
    width = {"base": 140, "heads": 160, "inspect": 180}[variant]
    if variant == "inspect":
        named = dedupe(gathered(PATH_KEYS, limit), limit, width=180)
    else:
        named = arg_values(PATH_KEYS, limit)
    chunks = (
        f"list_transform(list_reverse(evs), lambda {e}: list_concat({found(e + '.res', PATH_RX)}, "
        f"flatten(list_transform(coalesce({e}.args, []), lambda {a}: {found(a + '.v', PATH_RX)}))))"
    )
    scanned = let(
        chunks,
        lambda c: f"list_reduce(list_slice({c}, 2, len({c})), lambda {acc}, {x}: CASE WHEN len({acc}) >= {2 * limit} THEN {acc} "
        f"ELSE list_concat({acc}, {x}) END, list_concat(list_concat(open_files, {named}), coalesce({c}[1], [])))",
    )
    return dedupe(scanned, limit, fold_case=variant != "heads", width=width)


def recent_patterns(limit: int, variant: str = "base") -> str:
    if variant == "inspect":
        named, reach, width = dedupe(gathered(PATTERN_KEYS, limit), limit, width=180), 800, 180
    else:
        named, reach, width = arg_values(PATTERN_KEYS, limit), 600, (140 if variant == "base" else 120)
    return dedupe(
        f"list_concat({named}, {found(compact('current_prompt', reach), GLOB_RX)})", limit, variant != "heads", width
    )


def nth_last(lst: str, n: int, default: str = "NONE") -> str:
    return f"coalesce({lst}[-{n}], {q(default)})"


def tail_text(lst: str, k: int, empty: str = "START") -> str:
    return f"CASE WHEN len({lst}) > 0 THEN array_to_string({tail(lst, k)}, '>') ELSE {q(empty)} END"


def ngrams(lst: str, n: int, sep: str) -> str:
    i = f"i{next(_ids)}"
    parts = f" || {q(sep)} || ".join(f"{lst}[{i} + {j}]" for j in range(n))
    return f"list_transform(range(1, greatest(len({lst}) - {n - 1}, 0) + 1), lambda {i}: {parts})"


def sorted_counts(lst: str) -> str:
    v, x = f"v{next(_ids)}", f"x{next(_ids)}"
    return (
        f"array_to_string(list_transform(list_sort(list_distinct({lst})), lambda {v}: {v} || ':' || "
        f"len(list_filter({lst}, lambda {x}: {x} = {v}))), ' ')"
    )


def groups_of(lst: str) -> str:
    g = f"g{next(_ids)}"
    return f"list_transform({lst}, lambda {g}: {GROUP_CASE(g)})"


def count_of(lst: str, *names: str) -> str:
    x = f"x{next(_ids)}"
    return f"len(list_filter({lst}, lambda {x}: {x} IN ({', '.join(q(n) for n in names)})))"


EXIT = "'exit(?: code)?[=: ]+[1-9]'"


def status(t: str) -> str:
    """t: lower-cased result."""
    return (
        f"CASE WHEN {t} = '' THEN 'none' WHEN {has(t, ['failed', 'failure', 'error'])} OR regexp_matches({t}, {EXIT}) THEN 'fail' "
        f"WHEN {has(t, ['ok', 'passed', 'success', 'exit=0', 'exit code 0'])} THEN 'ok' ELSE 'other' END"
    )


_EMPTY = ["no match", "0 match", "no result", "0 result", "empty"]


def status_with_empty(t: str) -> str:
    return f"CASE WHEN {t} = '' THEN 'none' WHEN {has(t, _EMPTY)} THEN 'empty' ELSE {status(t)} END"


def status_inspect(t: str) -> str:
    return (
        f"CASE WHEN {t} = '' THEN 'none' WHEN {has(t, ['failed', 'failure', 'error', 'traceback', 'exit code 1'])} THEN 'fail' "
        f"WHEN {has(t, [*_EMPTY, 'not found'])} THEN 'empty' ELSE 'ok' END"
    )


def status_heads(t: str) -> str:
    bad = ["error", "failed", "failure", "exception", "traceback", "panic", "hunk", "conflict", "에러", "실패"]
    good = ["pass", "passed", "success", "green", "ok", "exit=0", "no issues", "통과", "성공"]
    return f"CASE WHEN {t} = '' THEN 'none' WHEN {has(t, bad)} THEN 'error' WHEN {has(t, good)} THEN 'ok' ELSE 'other' END"


def result_type(last: str, t: str, inspect: bool = False) -> str:
    first = (
        f"CASE WHEN {last} = 'read_file' OR contains(' ' || {t} || ' ', ' read ') THEN 'read' "
        f"WHEN {last} = 'grep_search' OR {has(t, ['matches', 'occurrences'])} THEN 'grep' "
        f"WHEN {last} = 'glob_pattern' THEN 'glob' "
        f"WHEN {last} = 'list_directory' OR contains({t}, 'entries') THEN 'list' "
    )
    if inspect:
        return first + f"WHEN {last} IN ('run_tests', 'run_bash', 'lint_or_typecheck') THEN 'exec' ELSE 'other' END"
    return first + (
        f"WHEN {last} = 'run_tests' OR {has(t, ['tests', 'pytest'])} THEN 'test' "
        f"WHEN {last} = 'lint_or_typecheck' OR {has(t, ['lint', 'type', 'mypy', 'tsc', 'clippy'])} THEN 'lint' "
        f"WHEN {last} = 'run_bash' OR starts_with({t}, 'exit=') THEN 'bash' "
        f"WHEN {last} IN ('apply_patch', 'edit_file', 'write_file') OR {has(t, ['patched', 'modified', 'wrote'])} THEN 'patch' "
        f"WHEN {t} = '' THEN 'none' ELSE 'other' END"
    )


def first_count(t: str, patterns) -> str:
    """t: lower-cased text."""
    return "coalesce(" + ", ".join(f"TRY_CAST(nullif(regexp_extract({t}, {q(p)}, 1), '') AS BIGINT)" for p in patterns) + ")"


def band(x: str, cuts, prefix: str = "le") -> str:
    return (
        f"CASE WHEN {x} IS NULL THEN 'na' " + " ".join(f"WHEN trunc({x}) <= {c} THEN '{prefix}_{c}'" for c in cuts)
        + f" ELSE 'gt_{cuts[-1]}' END"
    )


def band_float(x: str, cuts, missing: str = "na", dots: bool = True) -> str:
    name = (lambda c: str(c)) if dots else (lambda c: str(c).replace(".", "_"))
    return (
        f"CASE WHEN {x} IS NULL THEN '{missing}' " + " ".join(f"WHEN {x} <= {float(c)!r}::DOUBLE THEN 'le_{name(c)}'" for c in cuts)
        + f" ELSE 'gt_{name(cuts[-1])}' END"
    )


def bin_floor(x: str, size: int) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'na' ELSE floor({x} / {float(size)!r}::DOUBLE)::BIGINT::VARCHAR END"


def count_band(n: str) -> str:
    return (
        f"CASE WHEN {n} <= 0 THEN '0' WHEN {n} = 1 THEN '1' WHEN {n} = 2 THEN '2' WHEN {n} <= 4 THEN '3_4' "
        f"WHEN {n} <= 8 THEN '5_8' ELSE 'gt_8' END"
    )


def prompt_band(n: str) -> str:
    return (
        f"CASE WHEN {n} <= 5 THEN 'le5' WHEN {n} <= 10 THEN 'le10' WHEN {n} <= 18 THEN 'le18' WHEN {n} <= 30 THEN 'le30' ELSE 'gt30' END"
    )


def norm_path(p: str) -> str:
    return f"lower(trim(replace(coalesce({p}, ''), chr(92), '/')))"


def base_name(p: str) -> str:
    return f"regexp_extract(regexp_replace({p}, '/+$', ''), '([^/]*)$', 1)"


def extension(p: str, longest: int = 12) -> str:
    return rf"lower(regexp_extract({p}, '\.([A-Za-z0-9]{{1,{longest}}})$', 1))"


def suffix(p: str) -> str:
    return rf"coalesce(nullif(lower(regexp_extract({base_name(p)}, '^.+(\.[^.]+)$', 1)), ''), 'no_ext')"


def sorted_exts(lst: str, longest: int = 12) -> str:
    p = f"p{next(_ids)}"
    return f"list_sort(list_distinct(list_filter(list_transform({lst}, lambda {p}: {extension(p, longest)}), lambda {p}: {p} <> '')))"


def primary_language(known=None, default: str = "none", lower: bool = True) -> str:
    name = "(list_filter(mix, lambda m: m.v = list_max(list_transform(mix, lambda n: n.v))))[1].k"
    name = f"coalesce({'lower(' + name + ')' if lower else name}, {q(default)})"
    if known is None:
        return name
    return f"CASE WHEN {name} IN ({', '.join(q(k) for k in known)}) THEN {name} ELSE 'other' END"


def symbols(text: str, limit: int) -> str:
    s = f"s{next(_ids)}"
    stop = ", ".join(q(w) for w in ("the", "and", "for", "with", "this", "that", "please"))

    def build(t: str) -> str:
        # RE2 has no lookaround: take whole word runs, keep those that are identifiers.
        words = (
            f"list_filter(regexp_extract_all({t}, '[\\p{{L}}\\p{{N}}_]+'), lambda {s}: regexp_full_match({s}, '[A-Za-z_][A-Za-z0-9_]{{2,}}'))"
        )
        every = f"list_concat(list_concat({words}, {found(t, '`([^`]{2,80})`', 1)}), {found(t, chr(91) + chr(39) + chr(34) + ']([^' + chr(39) + chr(34) + ']{2,80})[' + chr(39) + chr(34) + ']', 1)})"
        kept = f"list_filter(list_transform({every}, lambda {s}: {compact(s, 80)}), lambda {s}: {s} <> '' AND lower({s}) NOT IN ({stop}))"
        return dedupe(kept, limit)

    return let(text, build)


READ_PATHS = (
    "list_distinct(list_filter(flatten(list_transform(list_filter(evs, lambda e: e.name = 'read_file'), lambda e: "
    "list_transform(['path', 'file', 'filepath'], lambda k: " + norm_path("(list_filter(e.args, lambda a: a.k = k))[1].v")
    + "))), lambda p: p <> ''))"
)


def overlaps(a: str, b: str) -> str:
    p = f"p{next(_ids)}"
    clean = lambda x: f"list_filter(list_transform({x}, lambda {p}: {norm_path(p)}), lambda {p}: {p} <> '')"
    return f"list_has_any({clean(a)}, {clean(b)})"


def failed(t: str) -> str:
    return f"({has(t, ['failed', 'failure', 'error'])} OR regexp_matches({t}, {EXIT}))"


FAILED_RESULTS = "len(list_filter(evs, lambda e: " + failed("lower(coalesce(e.res, ''))") + "))"
USER_TURNS = "len(list_filter(evs, lambda e: e.role = 'user'))"
TRACE_NAMES = "list_transform(list_filter(evs, lambda e: e.role = 'assistant_action'), lambda e: coalesce(nullif(trim(e.name), ''), 'unknown_action'))"
_TRACE_RES = "list_filter(list_transform(list_filter(evs, lambda e: e.role = 'assistant_action'), lambda e: lower(trim(coalesce(e.res, '')))), lambda t: t <> '')"


def failure_terms() -> str:
    terms = ["fail", "failed", "error", "traceback", "exception", "timeout", "missing", "not found"]
    joined = f"coalesce(array_to_string({tail(_TRACE_RES, 8)}, ' '), '')"
    return "(" + " + ".join(f"len(regexp_extract_all({joined}, {q(t)}))" for t in terms) + ")"


# Common intermediate columns over sess.
FEAT = f"""
feat AS (
  SELECT *, {NAMES} AS an, {TRACE_NAMES} AS tn, {LAST_RESULT} AS lr, {LAST_USER} AS lu, {LAST_USER_SAID} AS lus FROM sess)
"""
