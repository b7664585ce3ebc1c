"""Model-input columns: text views, feature vectors and state maps of a session step.

Views are column expressions over shared intermediate columns. `prepare` adds only the
intermediates a view needs, in layers, so that each is computed once per row. There is
no shuffle anywhere: a view can run inside any batch or streaming plan.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from sessionloom.functions import buckets as B
from sessionloom.functions import events as E
from sessionloom.functions import keywords as KW
from sessionloom.functions import results as R
from sessionloom.functions import scalars as S
from sessionloom.functions.base import let
from sessionloom.functions.text import SPACE, compact, fast_compact, flag, has_any, word_count
from sessionloom.operators import keys
from sessionloom.operators.ordered import last_items
from sessionloom.schema import (
    CI_STATES,
    LABELS,
    LANG_PREFS,
    PRIMARY_LANGS,
    SHORT_NAME,
    TIERS,
    TRACE_CI_STATES,
    TRACE_LANG_PREFS,
    TRACE_PRIMARY_LANGS,
    lookup,
)

C = F.col


def _history():
    return F.col("history")


def _meta():
    return F.col("session_meta")


def _prompt():
    return F.col("current_prompt")


def _ws():
    return _meta()["workspace"]



def words(values: Column) -> Column:
    return F.array_join(values, " ")


def either(text: Column, default: str) -> Column:
    return F.when(text == "", default).otherwise(text)


def pairs(**parts) -> Column:
    """'name=value' parts joined by blanks, in order."""
    return F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in parts.items()])


def lines(*parts) -> Column:
    """Lines of a view; text arguments are literal."""
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def missing(value: Column, default: str = "unknown") -> Column:
    return F.coalesce(value, F.lit(default))


def dirty_low() -> Column:
    return missing(_ws()["git_dirty"].cast("string"))


# name -> (columns it reads, expression)
DERIVED: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {
    "an": ((), lambda: E.action_names(_history())),
    "groups": (("an",), lambda: F.transform(C("an"), lambda a: keys.action_group(a))),
    "lr": ((), lambda: E.last_result(_history())),
    "lu": ((), lambda: E.last_user(_history())),
    "lus": ((), lambda: E.last_user(_history(), need_content=True)),
    "rtype": (("an", "lr"), lambda: R.result_type(E.nth_last(C("an"), 1), C("lr"))),
    "rtype_i": (("an", "lr"), lambda: R.result_type(E.nth_last(C("an"), 1), C("lr"), inspect=True)),
    "events6": ((), lambda: E.event_lines(_history(), 6)),
    "paths6": ((), lambda: E.recent_paths(_history(), _meta(), 6)),
    "paths10": ((), lambda: E.recent_paths(_history(), _meta(), 10)),
    "pats5": ((), lambda: E.recent_patterns(_history(), _prompt(), 5)),
    "pats8": ((), lambda: E.recent_patterns(_history(), _prompt(), 8)),
    "state": ((), lambda: state_text()),
    "last_line": (("an", "lr", "rtype"), lambda: last_line()),
    "summary": (("an", "groups"), lambda: action_summary(C("an"), C("groups"))),
    "trace14": ((), lambda: trace_lines(_history(), 14)),
    "sim": (("lr", "lu", "an", "last_line", "events6", "state", "paths10"), lambda: sim_text()),
    "au_train": (("lr", "lu", "an", "last_line", "state", "paths6", "pats5"), lambda: au_text(full_header=True)),
    "au_serve": (("lr", "lu", "an", "last_line", "state", "paths6", "pats5"), lambda: au_text(full_header=False)),
    # sectioned text
    "h_paths": ((), lambda: E.recent_paths(_history(), _meta(), 8, "heads")),
    "h_files": ((), lambda: E.recent_paths(_history(), _meta(), 20, "heads")),
    "h_pats": ((), lambda: E.recent_patterns(_history(), _prompt(), 6, "heads")),
    "h_cmds": ((), lambda: E.arg_values(_history(), ["cmd", "command", "script"], 6, 120, 160)),
    "h_targets": ((), lambda: E.arg_values(_history(), ["target", "scope", "command", "cmd", "name"], 6, 120, 160)),
    "prompt_signal": (("lus",), lambda: F.concat_ws(" ", compact(_prompt(), 1200), C("lus"))),
    "context_signal": (
        ("h_paths", "h_pats", "h_cmds", "h_targets", "lr", "an"),
        lambda: F.concat_ws(
            " ", words(C("h_paths")), words(C("h_pats")), words(C("h_cmds")), words(C("h_targets")), C("lr"),
            words(last_items(C("an"), 16)),
        ),
    ),
    "hints": (
        ("prompt_signal", "context_signal", "rtype", "h_paths", "h_pats", "h_cmds"),
        lambda: KW.hint_flags(
            C("prompt_signal"), C("context_signal"), C("rtype"), F.size("h_paths"), F.size("h_pats"), F.size("h_cmds"),
            F.size(E.open_files(_meta())),
        ),
    ),
    "common": (("lus", "an", "hints", "h_paths", "h_files", "h_pats", "h_cmds", "h_targets", "lr", "rtype"), lambda: common_text()),
    # inspect texts
    "i_paths": ((), lambda: either(words(E.recent_paths(_history(), _meta(), 10, "inspect")), "none")),
    "i_pats": ((), lambda: either(words(E.recent_patterns(_history(), _prompt(), 8, "inspect")), "none")),
    "flow": (("an",), lambda: flow_text(C("an"))),
    "tn": ((), lambda: E.trace_names(_history())),
}


def prepare(rows: DataFrame, *names: str) -> DataFrame:
    """Add the named intermediates and what they need, one layer of columns at a time."""
    depth: dict[str, int] = {}

    def level(name: str) -> int:
        if name not in depth:
            depth[name] = 1 + max((level(d) for d in DERIVED[name][0]), default=0)
        return depth[name]

    for name in names:
        level(name)
    for layer in range(1, max(depth.values(), default=0) + 1):
        rows = rows.withColumns({n: DERIVED[n][1]() for n, d in depth.items() if d == layer})
    return rows


# --- shared parts -------------------------------------------------------------------


def header(source: str, full: bool = True, variant: int | None = None) -> Column:
    parts = [F.lit("query:"), F.lit(f"[SRC={source}]")]
    if variant is not None:
        parts.append(F.lit(f"[AUG=v{variant}]"))
    parts.append(F.concat(F.lit("[STEP="), B.band(_meta()["turn_index"], [2, 5, 10, 20]), F.lit("]")))
    if full:
        parts += [
            F.concat(F.lit("[PLEN="), B.prompt_band(_prompt()), F.lit("]")),
            F.concat(F.lit("[BUDGET="), B.budget_band(_meta()["budget_tokens_remaining"]), F.lit("]")),
            F.concat(F.lit("[LASTRES="), R.status_with_empty(C("lr")), F.lit("]")),
        ]
    return F.concat_ws(" ", *parts)


def state_text() -> Column:
    opened = E.open_files(_meta())
    return pairs(
        open_count=B.band(F.size(opened), [0, 1, 2, 5, 10]),
        open_exts=either(words(E.sorted_extensions(opened)), "none"),
        git_dirty=dirty_low(),
        ci=missing(_ws()["last_ci_status"]),
        lang=E.primary_language(_ws()["language_mix"], PRIMARY_LANGS),
        loc=B.band(_ws()["loc"], [1000, 5000, 20000, 50000]),
        turn=B.band(_meta()["turn_index"], [2, 5, 10, 20]),
    )


def last_line() -> Column:
    return pairs(
        action=E.nth_last(C("an"), 1),
        args=E.last_args(_history(), 160),
        result_type=C("rtype"),
        status=R.status(C("lr")),
        hint=compact(C("lr"), 120),
    )


def action_summary(names: Column, groups: Column) -> Column:
    tail = lambda v, k: either(F.array_join(last_items(v, k), ">"), "START")
    return pairs(
        tail3=tail(names, 3),
        tail6=tail(names, 6),
        group_tail6=tail(groups, 6),
        bigrams=words(last_items(E.ngrams(names, 2, ">"), 8)),
        group_bigrams=words(last_items(E.ngrams(groups, 2, ">"), 8)),
        counts=E.sorted_counts(names),
        group_counts=E.sorted_counts(groups),
    )


def flow_text(names: Column) -> Column:
    tail = lambda k: either(F.array_join(last_items(names, k), ">"), "START")
    return pairs(
        last=E.nth_last(names, 1, "START"),
        prev=E.nth_last(names, 2, "START"),
        tail3=tail(3),
        tail6=tail(6),
        bigrams=words(last_items(E.ngrams(names, 2, ">"), 8)),
        counts=E.sorted_counts(names),
    )


def trace_lines(history: Column, k: int) -> Column:
    """Newest k actions with group, arguments, result type and result."""
    return F.transform(
        last_items(E.acts(history), k),
        lambda e: F.concat(
            F.lit("act="), e["name"], F.lit(" group="), keys.action_group(e["name"]),
            F.lit(" args="), F.when(E.has_args(e["args"]), compact(E.args_json(e["args"]), 140)).otherwise("none"),
            F.lit(" res_type="), R.result_type(e["name"], compact(e["result_summary"], 500)),
            F.lit(" res="), compact(e["result_summary"], 120),
        ),
    )


def hint_block() -> Column:
    """Paths, names, extensions, symbols, quoted parts, commands and patterns that are spelled out."""

    def block(s: Column) -> Column:
        return let(
            E.dedupe_tail(F.concat(E.dedupe_tail(E.find_all(s["text"], E.PATH), 8), s["recent"]), 10),
            lambda paths: F.concat_ws(
                " ",
                F.concat(F.lit("paths="), words(last_items(paths, 8))),
                F.concat(F.lit("files="), words(E.dedupe_tail(F.transform(paths, E.base_name), 8))),
                F.concat(F.lit("ext="), either(words(E.sorted_extensions(paths)), "none")),
                F.concat(F.lit("symbols="), words(E.symbols(s["text"], 10))),
                F.concat(F.lit("quoted="), words(E.dedupe_tail(quoted_parts(s["text"]), 8))),
            ),
        )

    combined = F.concat_ws(" ", compact(_prompt(), 900), C("lu"))
    return F.concat_ws(
        " ",
        let(F.struct(combined.alias("text"), C("paths6").alias("recent")), block),
        F.concat(F.lit("cmds="), words(E.arg_values(_history(), E.CMD_KEYS, 5))),
        F.concat(F.lit("patterns="), words(C("pats5"))),
    )


def quoted_parts(text: Column) -> Column:
    found = F.concat(E.find_all(text, "`([^`]{1,80})`", 1), E.find_all(text, "['\"]([^'\"]{1,80})['\"]", 1))
    return F.transform(found, lambda q: compact(q, 80))


# --- text views ---------------------------------------------------------------------


def sim_text() -> Column:
    exts = either(words(E.sorted_extensions(C("paths10"))), "none")
    signal = F.concat_ws(" ", compact(_prompt(), 1000), C("lu"), words(C("paths10")))
    return lines(
        header("sim"),
        "[CURRENT_PROMPT]", compact(_prompt(), 1000), "",
        "[ACTION_TAIL]", E.tail_text(C("an"), 6), "",
        "[LAST]", C("last_line"), "",
        "[FLOW]", either(F.array_join("events6", "\n"), "START"), "",
        "[STATE]", C("state"), "",
        "[PATHS]", F.concat(words(C("paths10")), F.lit(" ext="), exts), "",
        "[SYMBOLS]", words(E.symbols(signal, 14)),
    )


def au_text(full_header: bool) -> Column:
    """full_header: the four-part header used for training; otherwise only the step part."""
    visible = words(F.transform(last_items(E.open_files(_meta()), 6), E.base_name))
    state = F.concat_ws(
        " ", C("state"), F.concat(F.lit("edited="), words(E.dedupe_tail(E.edited_files(_history()), 6))),
        F.concat(F.lit("visible="), visible),
    )
    return lines(
        header("au", full_header),
        "[CURRENT_PROMPT]", compact(_prompt(), 700), "",
        "[DIRECT_HINTS]", hint_block(), "",
        "[ACTION_TAIL]", E.tail_text(C("an"), 3), "",
        "[LAST]", C("last_line"), "",
        "[STATE]", state,
    )


def whole_number(value: Column) -> Column:
    """Number text without a fraction when it has none."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def augmented(source: str, variant: int) -> Column:
    """View 0..4 of a row: base, trace, summary only, compact route, base plus summary."""
    base = C("sim") if source == "sim" else C("au_train")
    if variant == 0:
        return base
    if source == "sim":
        step, limit, light, route = B.band(_meta()["turn_index"], [2, 5, 10, 20]), 900, 320, "[COMPACT_SIM_ROUTE]"
    else:
        step, limit, light, route = missing(whole_number(_meta()["turn_index"]), "na"), 700, 260, "[COMPACT_AU_ROUTE]"
    head = F.concat(F.lit(f"query: [SRC={source}] [AUG=v{variant}] [STEP="), step, F.lit("]"))
    prompt = compact(_prompt(), limit)
    if variant == 1:
        parts = [
            head, "[CURRENT_PROMPT]", prompt, "[HISTORY_ACTION_TRACE]", either(F.array_join("trace14", "\n"), "START"),
            "[ACTION_SUMMARY]", C("summary"), "[STATE]", C("state"),
        ]
        return lines(*parts, *(["[PATHS]", words(C("paths10"))] if source == "sim" else []))
    if variant == 2:
        tools = F.concat_ws(
            " ",
            F.concat(F.lit("paths="), words(C("paths10"))),
            F.concat(F.lit("patterns="), words(C("pats8"))),
            F.concat(F.lit("cmds="), words(E.arg_values(_history(), E.CMD_KEYS, 6))),
            F.concat(F.lit("targets="), words(E.arg_values(_history(), E.TARGET_KEYS, 6))),
        )
        result = pairs(status=R.status(C("lr")), type=C("rtype"), hint=compact(C("lr"), 180))
        return lines(
            head, "[ACTION_SUMMARY_ONLY]", C("summary"), "[LAST_USER]", C("lu"), "[LAST_RESULT]", result, "[TOOLS]", tools
        )
    if variant == 3:
        place = pairs(
            lang=E.primary_language(_ws()["language_mix"]), open=words(last_items(E.open_files(_meta()), 8)), state=C("state")
        )
        return lines(head, route, C("summary"), "[PROMPT_LIGHT]", compact(prompt, light), "[WORKSPACE]", place)
    return lines(head, "[DIRECT]", base, "[TRACE_REPEAT_LIGHT]", C("summary"))


AUGMENTED_NEEDS = ("summary", "state", "trace14", "paths10", "pats8", "lr", "lu", "rtype")


def by_variant(texts: list[Column]) -> Column:
    """Array of (variant, text), to be exploded."""
    return F.array(*[F.struct(F.lit(i).alias("variant"), t.alias("text")) for i, t in enumerate(texts)])


def args_light() -> Column:
    patterns, cmds, targets = C("pats5"), E.arg_values(_history(), E.CMD_KEYS, 4), E.arg_values(_history(), E.TARGET_KEYS, 4)

    def named(name: str, values: Column, k: int, limit: int | None = None) -> Column:
        shown = (lambda v: compact(v, limit)) if limit else E.base_name
        return words(F.transform(last_items(values, k), lambda v: F.concat(F.lit(f"{name}="), shown(v))))

    return F.concat_ws(
        " ",
        pairs(
            paths_count=B.band(F.size("paths6"), [0, 1, 2, 4, 8]),
            patterns_count=B.band(F.size(patterns), [0, 1, 2, 4]),
            cmds_count=B.band(F.size(cmds), [0, 1, 2, 4]),
            targets_count=B.band(F.size(targets), [0, 1, 2, 4]),
            path_already_read=flag(E.overlaps(C("paths6"), E.read_paths(_history()))),
            path_in_open_files=flag(E.overlaps(C("paths6"), E.open_files(_meta()))),
        ),
        named("path", C("paths6"), 4), named("pattern", patterns, 3, 60), named("cmd", cmds, 3, 80),
        named("target", targets, 3, 60),
    )


def result_light() -> Column:
    lr = C("lr")
    return pairs(
        last_result_type=C("rtype"),
        last_result_status=R.status(lr),
        last_result_empty=flag(F.trim(lr) == ""),
        last_result_no_matches=flag(R.found_nothing(lr)),
        last_result_no_output=flag(has_any(lr, ["no output", "empty output"])),
        count_files=B.band(R.first_count(lr, "files"), [0, 1, 2, 5, 10, 25]),
        count_matches=B.band(R.first_count(lr, "matches"), [0, 1, 2, 5, 10, 25]),
        count_lines=B.band(R.first_count(lr, "lines"), [0, 20, 80, 200, 500]),
        count_tests=B.band(R.first_count(lr, "tests"), [0, 1, 2, 5, 10, 25]),
        count_failed=B.band(R.first_count(lr, "failed"), [0, 1, 2, 5, 10]),
        summary=compact(lr, 220),
    )


def action_trace() -> Column:
    an = C("an")
    n = lambda *names: E.count_of(an, *names)
    edits = ("apply_patch", "edit_file", "write_file")
    last, prev = E.nth_last(an, 1), E.nth_last(an, 2)
    return pairs(
        last_action=last,
        last2_actions=F.concat(prev, F.lit("_"), last),
        tail=either(words(last_items(an, 8)), "NONE"),
        na=F.size(an),
        nu=E.user_turns(_history()),
        hlen=F.size(E.items(_history())),
        fail=E.failed_results(_history()),
        patch=n(*edits),
        tests=n("run_tests"),
        read=n("read_file"),
        grep=n("grep_search"),
        bash=n("run_bash"),
        plen=B.band(word_count(compact(_prompt(), 1000)), [4, 10, 30, 60]),
        c_read=flag(n("read_file") > 0),
        c_edit=flag(n(*edits) > 0),
    )


def meta_block() -> Column:
    opened = E.open_files(_meta())
    return F.concat_ws(
        " ",
        pairs(
            user_tier=missing(_meta()["user_tier"]),
            language_pref=missing(_meta()["language_pref"]),
            budget=B.band(_meta()["budget_tokens_remaining"], [5000, 10000, 30000, 70000, 150000]),
            turn=B.band(_meta()["turn_index"], [2, 5, 10, 20]),
            elapsed=B.band(_meta()["elapsed_session_sec"], [120, 300, 900, 1800]),
            loc=B.band(_ws()["loc"], [1000, 5000, 20000, 50000]),
            git_dirty=dirty_low(),
            last_ci_status=missing(_ws()["last_ci_status"]),
            lang=E.primary_language(_ws()["language_mix"], PRIMARY_LANGS),
            open_files_count=B.band(F.size(opened), [0, 1, 2, 5, 10]),
        ),
        words(F.transform(last_items(opened, 4), lambda p: F.concat(F.lit("file="), E.base_name(p)))),
        words(F.transform(E.sorted_extensions(opened), lambda x: F.concat(F.lit("ext_"), x))),
    )


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"^[{SPACE}]+|[{SPACE}]+$", "")


def short_name(action: Column) -> Column:
    return F.coalesce(F.try_element_at(lookup(SHORT_NAME), action), F.replace(action, F.lit("_"), F.lit("")))


def trace_view() -> Column:
    """Prompt, banded action trace and metadata tokens."""
    tn = C("tn")
    short = F.transform(tn, short_name)

    def joined(k: int) -> Column:
        n = F.size(short)
        k_or_less = F.least(F.lit(k), F.greatest(n, F.lit(1)))
        return either(F.array_join(F.slice(short, F.greatest(n - k_or_less, F.lit(0)) + 1, k_or_less), "_"), "none")

    n = lambda *names: E.count_of(tn, *names)
    band = B.count_band
    per_action = [F.when(n(a) > 0, F.concat(F.lit(f"c_{SHORT_NAME[a]}="), band(n(a)))) for a in LABELS]
    trace = F.concat_ws(
        " ",
        pairs(
            last_action=joined(1), last2_actions=joined(2), last3_actions=joined(3), tail=words(last_items(short, 6)),
            na=band(F.size(tn)), nu=band(E.user_turns(_history())), hlen=band(F.size(E.items(_history()))), fail=band(E.failure_terms(_history())),
            patch=band(n("apply_patch", "edit_file", "write_file")), tests=band(n("run_tests", "lint_or_typecheck")),
            plen=B.band_unknown(word_count(_prompt()), [4, 8, 12, 20, 32, 64]),
        ),
        *per_action,
    )
    mix = F.transform(
        F.array_sort(F.coalesce(F.map_entries(_ws()["language_mix"]), F.array().cast("array<struct<key:string,value:double>>"))),
        lambda e: F.concat(
            F.lit("lang="), e["key"], F.lit(" lang_"), e["key"], F.lit("="),
            B.band_unknown(e["value"], [0.05, 0.1, 0.25, 0.5, 0.75, 1.0]),
        ),
    )
    opened = E.open_files(_meta())

    def file_tokens(path: Column) -> Column:
        name = F.replace(E.base_name(stripped(path)), F.lit(" "), F.lit("_"))
        ext = F.lower(stripped(F.regexp_extract(stripped(path), r"\.([^.]*)$", 1)))
        return F.concat_ws(
            " ", F.when(name != "", F.concat(F.lit("file="), name)), F.when(ext != "", F.concat(F.lit("ext_"), ext))
        )

    meta = F.concat_ws(
        " ",
        pairs(
            user_tier=missing(_meta()["user_tier"]),
            language_pref=missing(_meta()["language_pref"]),
            budget=B.band_unknown(_meta()["budget_tokens_remaining"], [1000, 5000, 10000, 30000, 70000, 150000]),
            turn=B.band_unknown(_meta()["turn_index"], [1, 3, 5, 10, 20, 40]),
            elapsed=B.band_unknown(_meta()["elapsed_session_sec"], [60, 300, 900, 1800, 3600, 7200]),
            loc=B.band_unknown(_ws()["loc"], [100, 1000, 5000, 20000, 100000]),
            git_dirty=dirty_low(),
            last_ci_status=missing(_ws()["last_ci_status"]),
        ),
        F.when(F.size(mix) > 0, words(mix)),
        pairs(open_files_count=B.band_unknown(F.size(opened), [0, 1, 2, 4, 8, 16])),
        F.when(F.size(opened) > 0, words(F.filter(F.transform(last_items(opened, 8), file_tokens), lambda t: t != ""))),
    )
    return stripped(
        lines("[CURRENT_PROMPT]", stripped(_prompt()), "", "[ACTION_TRACE]", trace, "", "[SESSION_META]", meta)
    )


def inspect_text(variant: int) -> Column:
    """View 0..4 for choosing among the four inspect actions."""
    lr, prompt = C("lr"), compact(_prompt(), 650)
    opened = either(words(last_items(E.open_files(_meta()), 10)), "none")
    band = B.band_float
    head = F.concat(
        F.lit(
            "query: choose inspection action from read_file grep_search glob_pattern list_directory "
            f"[SRC=sim] [AUG=v{variant}] [STEP="
        ),
        band(_meta()["turn_index"], [2, 5, 10, 20]), F.lit("] [PLEN="), B.prompt_band(_prompt()),
        F.lit("] [BUDGET="), band(_meta()["budget_tokens_remaining"], [5000, 12000, 20000]),
        F.lit("] [LASTRES="), R.status_inspect(lr), F.lit("]"),
    )
    result = lambda n: pairs(status=R.status_inspect(lr), type=C("rtype_i"), hint=compact(lr, n))
    if variant == 0:
        return lines(
            head, "[PROMPT]", prompt, "[LAST_ACTION]", C("flow"), "[LAST_RESULT]", result(260), "[OPEN_FILES]", opened,
            "[PATHS]", C("i_paths"), "[PATTERNS]", C("i_pats"),
        )
    if variant == 1:
        return lines(
            head, "[PROMPT]", prompt, "[LAST_USER]", C("lu"), "[LAST]",
            pairs(args=E.last_action_args(_history()), result=compact(lr, 320)),
            "[OPEN_AND_PATHS]", pairs(open=opened, paths=C("i_paths"), patterns=C("i_pats")),
        )
    if variant == 2:
        return lines(
            head, "[FLOW_FIRST]", C("flow"), "[RESULT]", result(320), "[TOOL_HINTS]",
            pairs(paths=C("i_paths"), patterns=C("i_pats"), open=opened), "[PROMPT_LIGHT]", compact(prompt, 260),
        )
    if variant == 3:
        dirty = F.when(_ws()["git_dirty"].isNull(), "na").otherwise(KW.python_bool(_ws()["git_dirty"]))
        return lines(
            head, "[DECISION_HINT]",
            "file content/reference/usage => grep_search | file path/open file => read_file | "
            "wildcard/find files => glob_pattern | folder/tree/list => list_directory",
            "[PROMPT]", prompt, "[STATE]",
            pairs(
                open_files_count=F.size(E.open_files(_meta())), git_dirty=dirty, top_lang=E.primary_language(_ws()["language_mix"])
            ),
            "[PATHS_PATTERNS]", F.concat_ws(" ", C("i_paths"), C("i_pats")),
        )
    return lines(
        head, "[COMPACT]",
        F.concat(F.lit("prompt="), compact(prompt, 420)), F.concat(F.lit("flow="), C("flow")),
        pairs(result_status=R.status_inspect(lr), result_type=C("rtype_i")),
        F.concat(F.lit("open="), opened), F.concat(F.lit("paths="), C("i_paths")), F.concat(F.lit("patterns="), C("i_pats")),
    )


INSPECT_NEEDS = ("lr", "lu", "rtype_i", "i_paths", "i_pats", "flow")


def common_text() -> Column:
    """Sectioned text: prompt, last user, flow, hints, arguments, result, state."""
    an, lr, opened = C("an"), C("lr"), E.open_files(_meta())
    recent = last_items(an, 16)
    last, prev = E.nth_last(an, 1), E.nth_last(an, 2)
    line = lambda name, value: F.concat(F.lit(f"{name}="), value.cast("string"))
    count = lambda action: F.least(E.count_of(recent, action), F.lit(5))
    added, removed = R.added_removed(lr)
    cuts = R.COUNT_CUTS
    return lines(
        "[COMMON]", "",
        "[PROMPT]", compact(_prompt(), 1200), "",
        "[LAST_USER]", C("lus"), "",
        "[FLOW]",
        line("last", last), line("prev", prev), line("last2", F.concat(prev, F.lit(">"), last)),
        line("recent", words(recent)), line("bigrams", words(E.ngrams(recent, 2, ">"))),
        line("test_count", count("run_tests")), line("lint_count", count("lint_or_typecheck")),
        line("bash_count", count("run_bash")), line("edit_count", count("edit_file")),
        line("patch_count", count("apply_patch")), line("write_count", count("write_file")), "",
        "[HINTS]", C("hints"), "",
        "[ARGS]",
        line("paths", words(C("h_paths"))), line("patterns", words(C("h_pats"))), line("cmds", words(C("h_cmds"))),
        line("targets", words(C("h_targets"))), line("n_files", B.band(F.size("h_files"), [0, 1, 2, 4, 8, 16])), "",
        "[RESULT]",
        line("status", R.status_heads(lr)), line("type", C("rtype")),
        line("count_files_bucket", B.band(R.first_count(lr, "files"), cuts)),
        line("count_matches_bucket", B.band(R.first_count(lr, "matches"), cuts)),
        line("count_lines_bucket", B.band(R.first_count(lr, "lines"), [0, 20, 80, 200, 500, 1000])),
        line("count_tests", B.band(R.first_count(lr, "tests"), cuts)),
        line("count_failed_tests", B.band(R.first_count(lr, "failed"), [0, 1, 2, 5, 10])),
        line("count_added", added), line("count_removed", removed), line("exit_zero", R.exit_zero(lr)), "",
        "[STATE]",
        line("git_dirty", F.when(_ws()["git_dirty"].isNull(), "").otherwise(KW.python_bool(_ws()["git_dirty"]))),
        line("open_files_count", B.band(F.size(opened), [0, 1, 2, 4, 8, 16])),
        line("open_exts", either(words(E.sorted_extensions(opened, 8)), "none")),
        line("last_ci_status", either(compact(_ws()["last_ci_status"], 80), "unknown")),
        line("top_lang", E.top_language(_ws()["language_mix"])),
        line("turn_bucket", B.turn_phase(_meta()["turn_index"])),
        line("budget_bucket", B.band(_meta()["budget_tokens_remaining"], [0, 5000, 10000, 20000, 50000])),
        line("budget_critical", B.budget_critical(_meta()["budget_tokens_remaining"])),
    )


def two_streams(text: Column) -> tuple[Column, Column]:
    """Semantic and context stream of a sectioned text."""
    parts = S.sections(text)
    stream = lambda names: F.concat_ws(
        "\n", *[x for n in names for x in (F.lit(f"[{n}]"), F.coalesce(F.try_element_at(parts, F.lit(n)), F.lit("")))]
    )
    return stream(["PROMPT", "LAST_USER", "HINTS"]), stream(["FLOW", "ARGS", "RESULT", "STATE"])


def _said(history: Column, limit: int, shorten) -> Column:
    users = F.filter(history, lambda e: F.coalesce((e["role"] == "user") & E.filled(e["content"]), F.lit(False)))
    return F.transform(users, lambda e: shorten(e["content"], limit))


def _results(history: Column, limit: int, shorten) -> Column:
    return F.transform(F.filter(history, lambda e: E.filled(e["result_summary"])), lambda e: shorten(e["result_summary"], limit))


def engineered_text() -> Column:
    """Repeated prompt, recent messages, results and arguments, action n-grams, keywords, metadata tokens."""
    hist, an = E.items(_history()), C("an")
    current = compact(_prompt(), 2200)
    users = words(last_items(_said(hist, 500, fast_compact), 4))
    results = words(last_items(_results(hist, 250, fast_compact), 4))
    with_args = F.filter(hist, lambda e: e["args"].isNotNull())
    args = words(
        last_items(F.transform(with_args, lambda e: words(KW.args_pairs(e["args"], "_", 200, fast_compact))), 4)
    )
    last = lambda k: _tail_joined(an, k, "_", "none")
    opened = F.transform(E.open_files(_meta()), lambda p: fast_compact(p, 120))
    open_text = words(last_items(opened, 8))
    mix = F.transform(
        F.coalesce(F.map_entries(_ws()["language_mix"]), F.array().cast("array<struct<key:string,value:double>>")),
        lambda e: F.concat(
            F.lit("lang_"), fast_compact(e["key"], 40), F.lit("_"),
            F.coalesce(F.round(e["value"], 2).cast("string"), F.lit("unknown")),
        ),
    )
    band = lambda v, cuts: B.band_float(v, cuts, missing="unknown")
    meta = F.concat_ws(
        " ",
        F.concat(F.lit("user_tier_"), fast_compact(_meta()["user_tier"], 80)),
        F.concat(F.lit("language_pref_"), fast_compact(_meta()["language_pref"], 80)),
        F.concat(F.lit("git_dirty_"), F.when(_ws()["git_dirty"].isNull(), "unknown").otherwise(KW.python_bool(_ws()["git_dirty"]))),
        F.concat(F.lit("ci_"), fast_compact(_ws()["last_ci_status"], 80)),
        F.concat(F.lit("budget_"), band(_meta()["budget_tokens_remaining"], [1000, 5000, 10000, 30000, 70000, 150000])),
        F.concat(F.lit("turn_"), band(_meta()["turn_index"], [1, 3, 5, 10, 20, 40])),
        F.concat(F.lit("elapsed_"), band(_meta()["elapsed_session_sec"], [60, 300, 900, 1800, 3600, 7200])),
        F.concat(F.lit("loc_"), band(_ws()["loc"], [100, 1000, 5000, 20000, 100000])),
        words(mix),
        open_text,
        words(F.transform(opened, lambda p: F.concat(F.lit("ext_"), E.suffix(p)))),
    )

    def assemble(s: Column) -> Column:
        spelled = F.concat_ws(" ", s["p"], s["u"], s["r"], s["a"], s["o"])
        return F.concat_ws(
            "\n",
            F.concat(F.lit("CURRENT_PROMPT "), s["p"]), F.concat(F.lit("CURRENT_PROMPT2 "), s["p"]),
            F.concat(F.lit("CURRENT_PROMPT3 "), s["p"]), F.concat(F.lit("RECENT_USER_MESSAGES "), s["u"]),
            F.concat(F.lit("ALL_ACTIONS "), words(s["an"])), F.concat(F.lit("LAST_ACTION "), s["l1"]),
            F.concat(F.lit("LAST2_ACTION "), s["l2"]), F.concat(F.lit("LAST3_ACTION "), s["l3"]),
            F.concat(F.lit("ACTION_BIGRAMS "), words(E.ngrams(s["an"], 2, "__"))),
            F.concat(F.lit("ACTION_TRIGRAMS "), words(E.ngrams(s["an"], 3, "__"))),
            F.concat(F.lit("RECENT_RESULTS "), s["r"]), F.concat(F.lit("RECENT_ARGS "), s["a"]),
            F.concat(F.lit("RECENT_ARGS2 "), s["a"]), F.concat(F.lit("KEYWORDS "), KW.keyword_tokens(spelled)),
            F.concat(F.lit("META "), s["m"]),
        )

    fields = {
        "p": current, "u": users, "r": results, "a": args, "o": open_text, "m": meta, "an": an,
        "l1": last(1), "l2": last(2), "l3": last(3),
    }
    return let(F.struct(*[v.alias(k) for k, v in fields.items()]), assemble)


def _tail_joined(names: Column, k: int, sep: str, empty: str) -> Column:
    """Last k names (fewer when there are fewer) joined by sep."""
    return either(F.array_join(last_items(names, k), sep), empty)


def story_text(with_state: bool = False) -> Column:
    hist = last_items(E.items(_history()), 12)
    args = F.flatten(F.transform(hist, lambda e: KW.args_pairs(e["args"], "=", 200)))
    parts = []
    if with_state:
        parts.append(F.concat(F.lit("STATE "), words(KW.state_tokens(_prompt(), _history(), _meta()))))
    parts.append(F.when(F.size("an") > 0, F.concat(F.lit("PREVIOUS_ACTION_SEQUENCE "), words(C("an")))))
    parts += [
        F.concat(F.lit("PREVIOUS_USER_REQUESTS "), words(last_items(_said(hist, 500, compact), 5))),
        F.concat(F.lit("PREVIOUS_TOOL_ARGS "), words(last_items(args, 12))),
        F.concat(F.lit("PREVIOUS_RESULTS "), words(last_items(_results(hist, 250, compact), 8))),
        F.concat(F.lit("CURRENT_PROMPT "), compact(_prompt(), 2200)),
    ]
    return F.concat_ws("\n", *parts)


def five_views() -> dict[str, Column]:
    hist, an = E.items(_history()), C("an")
    args = F.flatten(F.transform(hist, lambda e: KW.args_pairs(e["args"], "=", 250)))
    opened = F.transform(E.open_files(_meta()), lambda p: compact(p, 240))
    exts = F.transform(last_items(opened, 12), lambda p: F.concat(F.lit("ext_"), E.suffix(p)))
    last = lambda k: _tail_joined(an, k, "__", "none")
    names = F.concat_ws(
        " ", F.lit("ALL_ACTIONS"), words(an), F.lit("LAST_ACTION"), last(1), F.lit("LAST2_ACTION"), last(2),
        F.lit("LAST3_ACTION"), last(3), F.lit("ACTION_BIGRAMS"), words(E.ngrams(an, 2, "__")),
        F.lit("ACTION_TRIGRAMS"), words(E.ngrams(an, 3, "__")),
    )
    return {
        "current_prompt_view": compact(_prompt(), 2200),
        "history_user_text": words(last_items(_said(hist, 700, compact), 8)),
        "action_names_sequence": names,
        "action_args_and_paths": words(F.concat(last_items(args, 16), last_items(opened, 12), exts)),
        "result_summary_view": words(last_items(_results(hist, 400, compact), 10)),
    }


# --- feature vectors ----------------------------------------------------------------


def _per_label(fn) -> list[Column]:
    return [fn(label) for label in LABELS]


def features_base() -> Column:
    """93 doubles: action counts, last and previous action, metadata one-hots, 14 numbers."""
    an = C("an")
    prompt = compact(_prompt(), 1200)
    edits = ("apply_patch", "edit_file", "write_file")
    log = B.scaled_log
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    is_name = lambda n: lambda label: F.when(E.nth_last(an, n) == label, 1.0).otherwise(0.0)
    numeric = [
        log(F.size(an), 4.0), log(E.user_turns(_history()), 4.0), log(zero(_meta()["budget_tokens_remaining"]), 13.0),
        log(zero(_meta()["turn_index"]), 4.0), log(zero(_meta()["elapsed_session_sec"]), 8.0), log(zero(_ws()["loc"]), 12.0),
        F.coalesce(_ws()["git_dirty"], F.lit(False)).cast("double"), log(F.size(E.open_files(_meta())), 3.0),
        log(word_count(prompt), 5.0), log(F.length(prompt), 8.0), log(F.size(E.items(_history())), 4.0),
        log(E.failed_results(_history()), 3.0), log(E.count_of(an, *edits), 3.0), log(E.count_of(an, "run_tests"), 3.0),
    ]
    return F.concat(
        F.array(*_per_label(lambda a: log(E.count_of(an, a), 3.0))),
        F.array(*_per_label(is_name(1))),
        F.array(*_per_label(is_name(2))),
        S.one_hot(_meta()["user_tier"], TIERS),
        S.one_hot(_meta()["language_pref"], LANG_PREFS),
        S.one_hot(_ws()["last_ci_status"], CI_STATES),
        S.one_hot(E.primary_language(_ws()["language_mix"], PRIMARY_LANGS), PRIMARY_LANGS),
        F.array(*numeric),
    )


def features_trace() -> Column:
    """93 doubles with the trace vocabularies; every scaled number is clipped to 1."""
    tn, prompt = C("tn"), stripped(_prompt())
    log = lambda v, top: B.scaled_log_clipped(v, math.log1p(top))
    is_name = lambda n: lambda a: F.when(E.nth_last(tn, n, "__none__") == a, 1.0).otherwise(0.0)
    numeric = [
        log(F.size(tn), 16.0), log(E.user_turns(_history()), 16.0), log(_meta()["budget_tokens_remaining"], 200000.0),
        log(_meta()["turn_index"], 64.0), log(_meta()["elapsed_session_sec"], 10000.0), log(_ws()["loc"], 150000.0),
        F.coalesce(_ws()["git_dirty"], F.lit(False)).cast("double"), log(F.size(E.open_files(_meta())), 24.0),
        log(word_count(prompt), 128.0), log(F.length(prompt), 1000.0), log(F.size(E.items(_history())), 32.0),
        log(E.failure_terms(_history()), 16.0), log(E.count_of(tn, "apply_patch", "edit_file", "write_file"), 16.0),
        log(E.count_of(tn, "run_tests", "lint_or_typecheck"), 16.0),
    ]
    return F.concat(
        F.array(*_per_label(lambda a: log(E.count_of(tn, a), 12.0))),
        F.array(*_per_label(is_name(1))),
        F.array(*_per_label(is_name(2))),
        S.one_hot_other(_meta()["user_tier"], TIERS),
        S.one_hot_other(_meta()["language_pref"], TRACE_LANG_PREFS),
        S.one_hot_other(_ws()["last_ci_status"], TRACE_CI_STATES),
        S.one_hot(E.primary_language(_ws()["language_mix"], TRACE_PRIMARY_LANGS), TRACE_PRIMARY_LANGS),
        F.array(*numeric),
    )


def trace_feature_names() -> list[str]:
    """Column names of features_trace, in order."""
    blocks = [("count", LABELS), ("last", LABELS), ("prev", LABELS), ("user_tier", TIERS), ("language_pref", TRACE_LANG_PREFS),
              ("ci", TRACE_CI_STATES), ("primary_lang", TRACE_PRIMARY_LANGS)]
    names = [f"{p}_{v}" for p, values in blocks for v in values]
    # Names of the numeric block.
    return names + [
        "num_actions_log", "num_user_turns_log", "budget_log", "turn_index_log", "elapsed_log", "workspace_loc_log",
        "git_dirty", "open_files_count_log", "current_prompt_words_log", "current_prompt_chars_log", "history_len_log",
        "failed_count_log", "patch_count_log", "test_count_log",
    ]


PROMPT_PATH = (
    r"(?i)[A-Za-z]:[\\/]|[./\\][\p{L}\p{N}_./\\-]+|"
    r"(?<![\p{L}\p{N}_])[\p{L}\p{N}_.-]+\.(?:py|js|ts|tsx|json|csv|md|txt|yaml|yml|ipynb)(?![\p{L}\p{N}_])"
)


def state_map() -> Column:
    """Sparse state features as map<string,double>."""
    an, opened = C("an"), E.open_files(_meta())
    current = compact(_prompt(), 2200)
    results = F.lower(words(_results(E.items(_history()), 500, compact)))
    one = F.lit(1.0)

    def named(name: str, text: Column) -> Column:
        return F.struct(F.concat(F.lit(f"{name}="), text).alias("key"), one.alias("value"))

    def number(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("key"), value.cast("double").alias("value"))

    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    # Words that mark an error.
    errors = ["error", "failed", "fail", "exception", "traceback", "오류", "실패", "에러"]
    fixed = F.array(
        named("user_tier", compact(_meta()["user_tier"], 80)), named("language_pref", compact(_meta()["language_pref"], 80)),
        named("last_ci_status", compact(_ws()["last_ci_status"], 80)), named("git_dirty", KW.python_bool(_ws()["git_dirty"])),
        named("turn_bin", B.bin_floor(_meta()["turn_index"], 1)),
        named("budget_bin", B.bin_floor(_meta()["budget_tokens_remaining"], 10000)),
        named("elapsed_bin", B.bin_floor(_meta()["elapsed_session_sec"], 60)), named("loc_bin", B.bin_floor(_ws()["loc"], 5000)),
        number("history_len", F.size(E.items(_history()))), named("history_length_bin", B.bin_floor(F.size(E.items(_history())), 2)),
        named("prompt_len_bin", B.bin_floor(F.length(current), 40)), number("open_files_count", F.size(opened)),
        number("has_failed_in_last_result", yes(results.contains("fail"))),
        number("has_error_keyword", yes(has_any(F.concat_ws(" ", current, results), errors))),
        number("has_path_in_prompt", yes(current.rlike(PROMPT_PATH))),
        number("has_code_block_in_prompt", yes(current.contains("```"))),
        number("has_question_mark", yes(current.contains("?") | current.contains("？"))),
        *[number(f"count_{a}", E.count_of(an, a)) for a in ("read_file", "grep_search", "edit_file", "run_tests")],
    )
    files = F.flatten(F.transform(
        opened,
        lambda p: F.array(named("open_file", compact(p, 120)), named("open_ext", E.suffix(p)), named("open_file_extension", E.suffix(p))),
    ))
    entries = F.coalesce(F.map_entries(_ws()["language_mix"]), F.array().cast("array<struct<key:string,value:double>>"))
    ranked = F.sort_array(
        F.transform(entries, lambda e, i: F.struct(e["value"].alias("v"), (-i).alias("i"), e["key"].alias("k"))), asc=False
    )
    tops = F.transform(
        F.slice(ranked, 1, 2),
        lambda r, i: F.struct(
            F.concat(F.lit("workspace_language_top"), (i + 1).cast("string"), F.lit("="), compact(r["k"], 40)).alias("key"),
            one.alias("value"),
        ),
    )
    langs = F.transform(entries, lambda e: named("lang_mix", compact(e["key"], 40)))
    n = F.size(an)
    actions = F.when(n == 0, F.array(named("last_action", F.lit("NONE")))).otherwise(
        F.concat(
            F.array(
                named("last_action", E.nth_last(an, 1)), named("first_action", F.coalesce(F.get(an, F.lit(0)), F.lit(""))),
                number("action_count", n),
            ),
            F.when(n >= 2, F.array(named("last2_actions", F.array_join(last_items(an, 2), ">")))).otherwise(_no_entries()),
            F.when(n >= 3, F.array(named("last3_actions", F.array_join(last_items(an, 3), ">")))).otherwise(_no_entries()),
            let(
                last_items(an, 8),
                lambda r: F.transform(
                    F.array_distinct(r),
                    lambda a: F.struct(
                        F.concat(F.lit("recent_action="), a).alias("key"),
                        F.size(F.filter(r, lambda x: x == a)).cast("double").alias("value"),
                    ),
                ),
            ),
        )
    )
    return F.map_from_entries(F.concat(fixed, F.array_distinct(files), tops, F.array_distinct(langs), actions))


def _no_entries() -> Column:
    return F.array().cast("array<struct<key:string,value:double>>")


# --- table level --------------------------------------------------------------------


def by_domain(rows: DataFrame) -> DataFrame:
    """Text of the view that fits each row's domain, for a mixed table."""
    domain = keys.domain(C("id"))
    return prepare(rows, "sim", "au_serve").withColumn("text", F.when(domain == "au", C("au_serve")).otherwise(C("sim")))


def row_metadata(rows: DataFrame) -> DataFrame:
    """Slicing columns of a row: session, source, step, band, last and previous action, history length."""
    step = keys.step_number(C("id"))
    return prepare(rows, "an").select(
        "id", "action", keys.root_session(C("id"), "first").alias("session_id"), keys.domain(C("id")).alias("src"),
        step.alias("step"), keys.step_band(step).alias("step_group"),
        E.nth_last(C("an"), 1, "none").alias("last_action"), E.nth_last(C("an"), 2, "none").alias("prev_action"),
        F.size("an").alias("history_len"),
    )


def variant_weights(text: str) -> dict[int, float]:
    """'0:1.0,1:0.7' as {0: 1.0, 1: 0.7}."""
    return {int(k): float(v) for k, v in (p.split(":", 1) for p in text.split(",") if p.strip())}


def expand_views(rows: DataFrame, source: str, copies: int, weights: dict[int, float], mean_one: bool = True) -> DataFrame:
    """Each row once per view 0..copies, sharing one feature vector, with a sample weight.

    Every row gets the same views, so the mean weight is known from the view list alone
    and needs no pass over the data.
    """
    views = range(copies + 1)
    raw = [weights.get(v, 1.0) for v in views]
    scale = sum(raw) / len(raw) if mean_one and sum(raw) > 0 else 1.0
    ready = prepare(rows, "sim" if source == "sim" else "au_train", *AUGMENTED_NEEDS, "an")
    shaped = ready.withColumn("features", features_base())
    texts = F.array(*[
        F.struct(F.lit(v).alias("variant"), augmented(source, v).alias("text"), F.lit(raw[v] / scale).alias("weight"))
        for v in views
    ])
    return shaped.select("id", "action", "features", F.explode_outer(texts).alias("_v")).select("id", "action", "features", "_v.*")
