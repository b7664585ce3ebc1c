"""Text views, feature vectors and state maps."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from sessionloom.catalog import oracle_events as O
from sessionloom.catalog.oracle import SESS, arr, compact, has, join, q, sql, tail, words
from sessionloom.catalog.registry import query
from sessionloom.catalog.scalars import HINT_CTE, INSPECT_CTE, _hot_sql, hints_sql
from sessionloom.functions import keywords as KW
from sessionloom.functions import results as R
from sessionloom.functions import scalars as S
from sessionloom.operators import keys
from sessionloom.operators.metrics import rounded
from sessionloom.plans import views as V
from sessionloom.schema import (
    CI_STATES, LABELS, LANG_PREFS, PRIMARY_LANGS, SHORT_NAME, TIERS, TRACE_CI_STATES, TRACE_LANG_PREFS,
    TRACE_PRIMARY_LANGS,
)
from sessionloom.sources import derived

C = F.col
BASE = ("id", "current_prompt", "history", "session_meta", "action")


def rows_of(spark, folder):
    return derived.sessions(spark, folder).select(*BASE)


# --- SQL side -----------------------------------------------------------------------


def L(*parts):
    """Lines: literals in double-quoted python strings starting with '=' are text."""
    return " || chr(10) || ".join(q(p[1:]) if p.startswith("=") else p for p in parts)


def kv(**parts):
    return " || ' ' || ".join(f"'{k}=' || ({v})" for k, v in parts.items())


def either(t, default):
    return f"coalesce(nullif({t}, ''), {q(default)})"


_DIRTY = "coalesce(git_dirty::VARCHAR, 'unknown')"
_CI = "coalesce(ci, 'unknown')"
_SUMMARY = kv(
    tail3=O.tail_text("an", 3), tail6=O.tail_text("an", 6), group_tail6=O.tail_text("groups", 6),
    bigrams=join(tail(O.ngrams("an", 2, ">"), 8)), group_bigrams=join(tail(O.ngrams("groups", 2, ">"), 8)),
    counts=O.sorted_counts("an"), group_counts=O.sorted_counts("groups"),
)
_FLOW = kv(
    last=O.nth_last("an", 1, "START"), prev=O.nth_last("an", 2, "START"), tail3=O.tail_text("an", 3), tail6=O.tail_text("an", 6),
    bigrams=join(tail(O.ngrams("an", 2, ">"), 8)), counts=O.sorted_counts("an"),
)
_STATE = kv(
    open_count=O.band("len(open_files)", [0, 1, 2, 5, 10]), open_exts=either(join(O.sorted_exts("open_files")), "none"),
    git_dirty=_DIRTY, ci=_CI, lang=O.primary_language(PRIMARY_LANGS), loc=O.band("loc", [1000, 5000, 20000, 50000]),
    turn=O.band("turn_index", [2, 5, 10, 20]),
)
_LAST_LINE = kv(
    action=O.nth_last("an", 1), args=O.last_args(160), result_type="rtype", status=O.status("lrl"), hint=compact("lr", 120)
)
_TRACE14 = (
    "list_transform(" + tail(O.ACTS, 14) + ", lambda e: 'act=' || e.name || ' group=' || " + O.GROUP_CASE("e.name")
    + " || ' args=' || coalesce(left(" + O.args_json("e.args") + ", 140), 'none') || ' res_type=' || "
    + O.result_type("e.name", "lower(coalesce(" + compact("e.res", 500) + ", ''))")
    + " || ' res=' || " + compact("e.res", 120) + ")"
)


def _header(src, full=True):
    parts = [f"'query: [SRC={src}] [STEP=' || ({O.band('turn_index', [2, 5, 10, 20])}) || ']'"]
    if full:
        parts += [
            f"'[PLEN=' || ({O.prompt_band(words('current_prompt'))}) || ']'",
            f"'[BUDGET=' || ({O.band('budget', [5000, 12000, 20000])}) || ']'",
            f"'[LASTRES=' || ({O.status_with_empty('lrl')}) || ']'",
        ]
    return " || ' ' || ".join(parts)


V0 = f"""
v0 AS (
  SELECT *, {O.groups_of('an')} AS groups, lower(lr) AS lrl, {O.event_lines(6)} AS events6, {O.recent_paths(6)} AS paths6,
    {O.recent_paths(10)} AS paths10, {O.recent_patterns(5)} AS pats5, {O.recent_patterns(8)} AS pats8, {_STATE} AS state,
    {_TRACE14} AS trace14 FROM feat),
v1 AS (
  SELECT *, {O.result_type(O.nth_last('an', 1), 'lrl')} AS rtype, {O.result_type(O.nth_last('an', 1), 'lrl', True)} AS rtype_i,
    {_SUMMARY} AS summary, {_FLOW} AS flow FROM v0),
v2 AS (SELECT *, {_LAST_LINE} AS last_line FROM v1)
"""

_SIM = L(
    _header("sim"), "=[CURRENT_PROMPT]", compact("current_prompt", 1000), "=", "=[ACTION_TAIL]", O.tail_text("an", 6), "=",
    "=[LAST]", "last_line", "=", "=[FLOW]", either("array_to_string(events6, chr(10))", "START"), "=", "=[STATE]", "state", "=",
    "=[PATHS]", join("paths10") + " || ' ext=' || " + either(join(O.sorted_exts("paths10")), "none"), "=",
    "=[SYMBOLS]", join(O.symbols(f"({compact('current_prompt', 1000)} || ' ' || lu || ' ' || {join('paths10')})", 14)),
)


def _quoted(t):
    rx1, rx2 = "`([^`]{1,80})`", "['\"]([^'\"]{1,80})['\"]"
    return f"list_transform(list_concat({O.found(t, rx1, 1)}, {O.found(t, rx2, 1)}), lambda z: {compact('z', 80)})"


V_AU = f"""
au0 AS (
  SELECT *, {compact('current_prompt', 900)} || ' ' || lu AS comb FROM v2),
au1 AS (SELECT *, {O.dedupe('list_concat(' + O.dedupe(O.found('comb', O.PATH_RX), 8) + ', paths6)', 10)} AS hpaths FROM au0),
au2 AS (
  SELECT *, 'paths=' || {join(tail('hpaths', 8))} || ' files=' || {join(O.dedupe('list_transform(hpaths, lambda p: ' + O.base_name('p') + ')', 8))}
    || ' ext=' || {either(join(O.sorted_exts('hpaths')), 'none')} || ' symbols=' || {join(O.symbols('comb', 10))}
    || ' quoted=' || {join(O.dedupe(_quoted('comb'), 8))} || ' cmds=' || {join(O.arg_values(O.CMD_KEYS, 5))}
    || ' patterns=' || {join('pats5')} AS hintb,
    list_reduce(list_transform(list_reverse(evs), lambda e: CASE WHEN e.name IN ('edit_file', 'apply_patch', 'write_file') THEN
        flatten(list_transform(['path', 'file', 'paths', 'files'], lambda k: flatten(list_transform(list_filter(coalesce(e.args, []), lambda a: a.k = k), lambda a: a.vs))))
        ELSE [] END), lambda acc, x: CASE WHEN len(acc) >= 6 THEN acc ELSE list_concat(acc, x) END, []::VARCHAR[]) AS edited FROM au1),
au3 AS (
  SELECT *, state || ' edited=' || {join(O.dedupe('edited', 6))} || ' visible=' || {join('list_transform(' + tail('open_files', 6) + ', lambda p: ' + O.base_name('p') + ')')} AS astate FROM au2)
"""


def _au(full):
    return L(
        _header("au", full), "=[CURRENT_PROMPT]", compact("current_prompt", 700), "=", "=[DIRECT_HINTS]", "hintb", "=",
        "=[ACTION_TAIL]", O.tail_text("an", 3), "=", "=[LAST]", "last_line", "=", "=[STATE]", "astate",
    )


@query("view_sim_text", sql(SESS, O.FEAT, V0, select=f"SELECT id, {_SIM} AS text FROM v2"))
def view_sim_text(spark, folder):
    return V.prepare(rows_of(spark, folder), "sim").select("id", C("sim").alias("text"))


@query("view_au_text_train", sql(SESS, O.FEAT, V0, V_AU, select=f"SELECT id, {_au(True)} AS text FROM au3"))
def view_au_text_train(spark, folder):
    return V.prepare(rows_of(spark, folder), "au_train").select("id", C("au_train").alias("text"))


@query("view_au_text_serve", sql(SESS, O.FEAT, V0, V_AU, select=f"SELECT id, {_au(False)} AS text FROM au3"))
def view_au_text_serve(spark, folder):
    return V.prepare(rows_of(spark, folder), "au_serve").select("id", C("au_serve").alias("text"))


def _augmented_sql(src, variant):
    base = _SIM if src == "sim" else _au(True)
    if variant == 0:
        return base
    if src == "sim":
        step, limit, light, route = f"({O.band('turn_index', [2, 5, 10, 20])})", 900, 320, "=[COMPACT_SIM_ROUTE]"
    else:
        step, limit, light, route = "turn_index::BIGINT::VARCHAR", 700, 260, "=[COMPACT_AU_ROUTE]"
    head = f"'query: [SRC={src}] [AUG=v{variant}] [STEP=' || {step} || ']'"
    prompt = compact("current_prompt", limit)
    if variant == 1:
        parts = [head, "=[CURRENT_PROMPT]", prompt, "=[HISTORY_ACTION_TRACE]", either("array_to_string(trace14, chr(10))", "START"),
                 "=[ACTION_SUMMARY]", "summary", "=[STATE]", "state"]
        return L(*parts, *(["=[PATHS]", join("paths10")] if src == "sim" else []))
    if variant == 2:
        tools = kv(paths=join("paths10"), patterns=join("pats8"), cmds=join(O.arg_values(O.CMD_KEYS, 6)),
                   targets=join(O.arg_values(O.TARGET_KEYS, 6)))
        return L(head, "=[ACTION_SUMMARY_ONLY]", "summary", "=[LAST_USER]", "lu", "=[LAST_RESULT]",
                 kv(status=O.status("lrl"), type="rtype", hint=compact("lr", 180)), "=[TOOLS]", tools)
    if variant == 3:
        place = kv(lang=O.primary_language(), open=join(tail("open_files", 8)), state="state")
        return L(head, route, "summary", "=[PROMPT_LIGHT]", compact(prompt, light), "=[WORKSPACE]", place)
    return L(head, "=[DIRECT]", f"({base})", "=[TRACE_REPEAT_LIGHT]", "summary")


def _variants_sql(src):
    cte = "v2" if src == "sim" else "au3"
    return " UNION ALL ".join(f"SELECT id, {v} AS variant, {_augmented_sql(src, v)} AS text FROM {cte}" for v in range(5))


def _variants(spark, folder, src):
    ready = V.prepare(rows_of(spark, folder), "sim" if src == "sim" else "au_train", *V.AUGMENTED_NEEDS)
    texts = V.by_variant([V.augmented(src, v) for v in range(5)])
    return ready.select("id", F.explode_outer(texts).alias("v")).select("id", "v.*")


@query("view_sim_augmented", sql(SESS, O.FEAT, V0, select=_variants_sql("sim")))
def view_sim_augmented(spark, folder):
    return _variants(spark, folder, "sim")


@query("view_au_augmented", sql(SESS, O.FEAT, V0, V_AU, select=_variants_sql("au")))
def view_au_augmented(spark, folder):
    return _variants(spark, folder, "au")


@query("view_action_summary", sql(SESS, O.FEAT, V0, select="SELECT id, summary, flow FROM v2"))
def view_action_summary(spark, folder):
    return V.prepare(rows_of(spark, folder), "summary", "flow").select("id", "summary", "flow")


def _named_sql(name, values, k, limit=None):
    shown = compact("z", limit) if limit else O.base_name("z")
    return join(f"list_transform({tail(values, k)}, lambda z: '{name}=' || {shown})")


def _fl(test):
    return f"CASE WHEN {test} THEN '1' ELSE '0' END"


_AUX_CTE = f"aux AS (SELECT *, {O.arg_values(O.CMD_KEYS, 4)} AS cmds4, {O.arg_values(O.TARGET_KEYS, 4)} AS targets4, {O.READ_PATHS} AS reads FROM v2)"
_ARGS_LIGHT = kv(
    paths_count=O.band("len(paths6)", [0, 1, 2, 4, 8]), patterns_count=O.band("len(pats5)", [0, 1, 2, 4]),
    cmds_count=O.band("len(cmds4)", [0, 1, 2, 4]), targets_count=O.band("len(targets4)", [0, 1, 2, 4]),
    path_already_read=_fl(O.overlaps("paths6", "reads")), path_in_open_files=_fl(O.overlaps("paths6", "open_files")),
) + "".join(f" || ' ' || {x}" for x in (
    _named_sql("path", "paths6", 4), _named_sql("pattern", "pats5", 3, 60), _named_sql("cmd", "cmds4", 3, 80),
    _named_sql("target", "targets4", 3, 60)))
_CNT = lambda k: O.first_count("lrl", R.COUNT_PATTERNS[k])
_RESULT_LIGHT = kv(
    last_result_type="rtype", last_result_status=O.status("lrl"), last_result_empty=_fl("trim(lr) = ''"),
    last_result_no_matches=_fl(r"regexp_matches(lrl, '\b(no|0)\s+(matches|results|occurrences)\b|not\s+found|found\s+0')"),
    last_result_no_output=_fl(has("lr", ["no output", "empty output"])),
    count_files=O.band(_CNT("files"), [0, 1, 2, 5, 10, 25]), count_matches=O.band(_CNT("matches"), [0, 1, 2, 5, 10, 25]),
    count_lines=O.band(_CNT("lines"), [0, 20, 80, 200, 500]), count_tests=O.band(_CNT("tests"), [0, 1, 2, 5, 10, 25]),
    count_failed=O.band(_CNT("failed"), [0, 1, 2, 5, 10]), summary=compact("lr", 220),
)
_N = lambda *n: O.count_of("an", *n)
_EDITS = ("apply_patch", "edit_file", "write_file")
_ACTION_TRACE = kv(
    last_action=O.nth_last("an", 1), last2_actions=O.nth_last("an", 2) + " || '_' || " + O.nth_last("an", 1),
    tail=either(join(tail("an", 8)), "NONE"), na="len(an)", nu=O.USER_TURNS, hlen="len(evs)", fail=O.FAILED_RESULTS,
    patch=_N(*_EDITS), tests=_N("run_tests"), read=_N("read_file"), grep=_N("grep_search"), bash=_N("run_bash"),
    plen=O.band(words(compact("current_prompt", 1000)), [4, 10, 30, 60]), c_read=_fl(_N("read_file") + " > 0"),
    c_edit=_fl(_N(*_EDITS) + " > 0"),
)
_META_BLOCK = kv(
    user_tier="coalesce(user_tier, 'unknown')", language_pref="coalesce(language_pref, 'unknown')",
    budget=O.band("budget", [5000, 10000, 30000, 70000, 150000]), turn=O.band("turn_index", [2, 5, 10, 20]),
    elapsed=O.band("elapsed", [120, 300, 900, 1800]), loc=O.band("loc", [1000, 5000, 20000, 50000]), git_dirty=_DIRTY,
    last_ci_status=_CI, lang=O.primary_language(PRIMARY_LANGS), open_files_count=O.band("len(open_files)", [0, 1, 2, 5, 10]),
) + " || ' ' || " + join("list_transform(" + tail("open_files", 4) + ", lambda z: 'file=' || " + O.base_name("z") + ")") \
  + " || ' ' || " + join("list_transform(" + O.sorted_exts("open_files") + ", lambda z: 'ext_' || z)")


@query("view_aux_blocks", sql(SESS, O.FEAT, V0, _AUX_CTE, select=f"""
SELECT id, {_ARGS_LIGHT} AS args_light, {_RESULT_LIGHT} AS result_light, {_ACTION_TRACE} AS action_trace, {_META_BLOCK} AS meta FROM aux"""))
def view_aux_blocks(spark, folder):
    ready = V.prepare(rows_of(spark, folder), "paths6", "pats5", "lr", "rtype", "an")
    return ready.select(
        "id", V.args_light().alias("args_light"), V.result_light().alias("result_light"),
        V.action_trace().alias("action_trace"), V.meta_block().alias("meta"),
    )


_WSRX = r"'^[\s\x0b\x1c-\x1f\x85\p{Z}]+|[\s\x0b\x1c-\x1f\x85\p{Z}]+$'"
_STRIP = lambda t: f"regexp_replace({t}, {_WSRX}, '', 'g')"
_SHORT = "list_transform(tn, lambda a: CASE a " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in SHORT_NAME.items()) + " ELSE replace(a, '_', '') END)"
_T = lambda *n: O.count_of("tn", *n)
_UNK = lambda x, cuts: O.band_float(x, cuts, "unknown", dots=False)
_TRACE_TOKENS = (
    kv(last_action="coalesce(short[-1], 'none')",
       last2_actions=either(join(tail("short", 2), "_"), "none"), last3_actions=either(join(tail("short", 3), "_"), "none"),
       tail=join(tail("short", 6)), na=O.count_band("len(tn)"), nu=O.count_band(O.USER_TURNS), hlen=O.count_band("len(evs)"),
       fail=O.count_band(O.failure_terms()), patch=O.count_band(_T(*_EDITS)), tests=O.count_band(_T("run_tests", "lint_or_typecheck")),
       plen=_UNK(words("current_prompt"), [4, 8, 12, 20, 32, 64]))
    + "".join(f" || CASE WHEN {_T(a)} > 0 THEN ' c_{SHORT_NAME[a]}=' || ({O.count_band(_T(a))}) ELSE '' END" for a in LABELS)
)
_SHARE = _UNK("m.v", [0.05, 0.1, 0.25, 0.5, 0.75, 1.0])
_TRACE_META = (
    kv(user_tier="coalesce(user_tier, 'unknown')", language_pref="coalesce(language_pref, 'unknown')",
       budget=_UNK("budget", [1000, 5000, 10000, 30000, 70000, 150000]), turn=_UNK("turn_index", [1, 3, 5, 10, 20, 40]),
       elapsed=_UNK("elapsed", [60, 300, 900, 1800, 3600, 7200]), loc=_UNK("loc", [100, 1000, 5000, 20000, 100000]),
       git_dirty=_DIRTY, last_ci_status=_CI)
    + f" || coalesce(array_to_string(list_transform(list_sort(mix), lambda m: ' lang=' || m.k || ' lang_' || m.k || '=' || ({_SHARE})), ''), '')"
    + f" || ' open_files_count=' || ({_UNK('len(open_files)', [0, 1, 2, 4, 8, 16])})"
    + f" || coalesce(array_to_string(list_transform({tail('open_files', 8)}, lambda p: ' file=' || replace({O.base_name('p')}, ' ', '_') || ' ext_' || lower(regexp_extract(p, '\\.([^.]*)$', 1))), ''), '')"
)


@query("view_klue_text", sql(SESS, O.FEAT, f"sh AS (SELECT *, {_SHORT} AS short FROM feat)", select=f"""
SELECT id, {_STRIP('(' + L('=[CURRENT_PROMPT]', _STRIP('current_prompt'), '=', '=[ACTION_TRACE]', _TRACE_TOKENS, '=', '=[SESSION_META]', _TRACE_META) + ')')} AS text FROM sh"""))
def view_klue_text(spark, folder):
    return V.prepare(rows_of(spark, folder), "tn").select("id", V.trace_view().alias("text"))


def _log(x, d):
    return f"ln(1.0::DOUBLE + ({x})) / {float(d)!r}::DOUBLE"


def _logc(x, top):
    return f"least(1.0::DOUBLE, ln(1.0::DOUBLE + greatest(coalesce(({x})::DOUBLE, 0.0::DOUBLE), 0.0::DOUBLE)) / {math.log1p(top)!r}::DOUBLE)"


def _onehot_list(expr_text, n):
    return f"list_transform(range(1, {n + 1}), lambda i: substr({expr_text}, i, 1)::DOUBLE)"


def _is(lst, n, default="NONE"):
    return f"list_transform({arr(LABELS)}, lambda a: CASE WHEN {O.nth_last(lst, n, default)} = a THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


_PROMPT12 = compact("current_prompt", 1200)
_FEATS = "flatten([" + ", ".join([
    "[" + ", ".join(_log(_N(a), 3.0) for a in LABELS) + "]", _is("an", 1), _is("an", 2),
    _onehot_list(_hot_sql("user_tier", TIERS), 4), _onehot_list(_hot_sql("language_pref", LANG_PREFS), 4),
    _onehot_list(_hot_sql("ci", CI_STATES), 5), _onehot_list(_hot_sql(O.primary_language(PRIMARY_LANGS), PRIMARY_LANGS), 24),
    "[" + ", ".join([
        _log("len(an)", 4), _log(O.USER_TURNS, 4), _log("budget", 13), _log("turn_index", 4), _log("elapsed", 8), _log("loc", 12),
        "CASE WHEN git_dirty THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", _log("len(open_files)", 3), _log(words(_PROMPT12), 5),
        _log(f"length({_PROMPT12})", 8), _log("len(evs)", 4), _log(O.FAILED_RESULTS, 3), _log(_N(*_EDITS), 3), _log(_N("run_tests"), 3),
    ]) + "]",
]) + "])"
_FEATS_T = "flatten([" + ", ".join([
    "[" + ", ".join(_logc(_T(a), 12.0) for a in LABELS) + "]", _is("tn", 1, "__none__"), _is("tn", 2, "__none__"),
    _onehot_list(_hot_sql("user_tier", TIERS, True), 4), _onehot_list(_hot_sql("language_pref", TRACE_LANG_PREFS, True), 4),
    _onehot_list(_hot_sql("ci", TRACE_CI_STATES, True), 5),
    _onehot_list(_hot_sql(O.primary_language(TRACE_PRIMARY_LANGS), TRACE_PRIMARY_LANGS), 24),
    "[" + ", ".join([
        _logc("len(tn)", 16), _logc(O.USER_TURNS, 16), _logc("budget", 200000), _logc("turn_index", 64), _logc("elapsed", 10000),
        _logc("loc", 150000), "CASE WHEN git_dirty THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", _logc("len(open_files)", 24),
        _logc(words("current_prompt"), 128), _logc(f"length({_STRIP('current_prompt')})", 1000), _logc("len(evs)", 32),
        _logc(O.failure_terms(), 16), _logc(_T(*_EDITS), 16), _logc(_T("run_tests", "lint_or_typecheck"), 16),
    ]) + "]",
]) + "])"


def _vector_rows(df, names=None):
    long = df.select("id", F.posexplode_outer("f").alias("pos", "value"))
    name = [] if names is None else [keys.decode_label(C("pos"), names).alias("name")]
    return long.select("id", C("pos").cast("long").alias("pos"), *name, rounded(C("value")).alias("value"))


def _nonneg_budget(rows):
    """Budgets below zero have no logarithm in the unclipped layout; they count as used up."""
    meta = C("session_meta")
    return rows.withColumn(
        "session_meta",
        meta.withField("budget_tokens_remaining", F.greatest(meta["budget_tokens_remaining"], F.lit(0.0))),
    )


@query("feat_structured_e5", sql(SESS, O.FEAT, f"fv AS (SELECT id, {_FEATS} AS f FROM feat)", select="""
SELECT id, i - 1 AS pos, round(f[i], 6) AS value FROM (SELECT id, f, unnest(range(1, len(f) + 1)) AS i FROM fv)"""))
def feat_structured_e5(spark, folder):
    return _vector_rows(V.prepare(_nonneg_budget(rows_of(spark, folder)), "an").select("id", V.features_base().alias("f")))


@query("feat_structured_klue", sql(SESS, O.FEAT, f"fv AS (SELECT id, {_FEATS_T} AS f FROM feat)", select=f"""
SELECT id, i - 1 AS pos, ({arr(V.trace_feature_names())})[i] AS name, round(f[i], 6) AS value
FROM (SELECT id, f, unnest(range(1, len(f) + 1)) AS i FROM fv)"""))
def feat_structured_klue(spark, folder):
    ready = V.prepare(rows_of(spark, folder), "tn").select("id", V.features_trace().alias("f"))
    return _vector_rows(ready, V.trace_feature_names())


def _inspect_sql(v):
    opened = either(join(tail("open_files", 10)), "none")
    prompt = compact("current_prompt", 650)
    head = (
        "'query: choose inspection action from read_file grep_search glob_pattern list_directory "
        f"[SRC=sim] [AUG=v{v}] [STEP=' || ({O.band_float('turn_index', [2, 5, 10, 20])}) || '] [PLEN=' || ({O.prompt_band(words('current_prompt'))})"
        f" || '] [BUDGET=' || ({O.band_float('budget', [5000, 12000, 20000])}) || '] [LASTRES=' || ({O.status_inspect('lrl')}) || ']'"
    )
    result = lambda n: kv(status=O.status_inspect("lrl"), type="rtype_i", hint=compact("lr", n))
    if v == 0:
        return L(head, "=[PROMPT]", prompt, "=[LAST_ACTION]", "flow", "=[LAST_RESULT]", result(260), "=[OPEN_FILES]", opened,
                 "=[PATHS]", "ipaths", "=[PATTERNS]", "ipats")
    if v == 1:
        return L(head, "=[PROMPT]", prompt, "=[LAST_USER]", "lu", "=[LAST]", kv(args=O.last_args(260), result=compact("lr", 320)),
                 "=[OPEN_AND_PATHS]", kv(open=opened, paths="ipaths", patterns="ipats"))
    if v == 2:
        return L(head, "=[FLOW_FIRST]", "flow", "=[RESULT]", result(320), "=[TOOL_HINTS]",
                 kv(paths="ipaths", patterns="ipats", open=opened), "=[PROMPT_LIGHT]", compact(prompt, 260))
    if v == 3:
        dirty = "CASE WHEN git_dirty THEN 'True' ELSE 'False' END"
        return L(head, "=[DECISION_HINT]",
                 "=file content/reference/usage => grep_search | file path/open file => read_file | wildcard/find files => glob_pattern | folder/tree/list => list_directory",
                 "=[PROMPT]", prompt, "=[STATE]",
                 kv(open_files_count="len(open_files)", git_dirty=dirty, top_lang=O.primary_language()),
                 "=[PATHS_PATTERNS]", "ipaths || ' ' || ipats")
    return L(head, "=[COMPACT]", f"'prompt=' || {compact(prompt, 420)}", "'flow=' || flow",
             kv(result_status=O.status_inspect("lrl"), result_type="rtype_i"), f"'open=' || {opened}", "'paths=' || ipaths",
             "'patterns=' || ipats")


_INSP = f"""
iv AS (SELECT *, {either(join(O.recent_paths(10, 'inspect')), 'none')} AS ipaths, {either(join(O.recent_patterns(8, 'inspect')), 'none')} AS ipats FROM v2)
"""


@query("view_inspect", sql(SESS, O.FEAT, V0, _INSP, select=" UNION ALL ".join(
    f"SELECT id, {v} AS variant, {_inspect_sql(v)} AS text FROM iv" for v in range(5))))
def view_inspect(spark, folder):
    ready = V.prepare(rows_of(spark, folder), *V.INSPECT_NEEDS)
    texts = V.by_variant([V.inspect_text(v) for v in range(5)])
    return ready.select("id", F.explode_outer(texts).alias("v")).select("id", "v.*")


def _line(name, v):
    return f"'{name}=' || ({v})"


_CUTS = [0, 1, 2, 5, 10, 25, 50, 100]
_MIN5 = lambda a: f"least({O.count_of('recent', a)}, 5)"
_PAIR = r"([0-9]+)\s*(?:insertions?|added).{0,30}?([0-9]+)\s*(?:deletions?|removed)"


def _diff(group, rest):
    return O.band(
        f"(CASE WHEN regexp_matches(lrl, {q(_PAIR)}) THEN TRY_CAST(regexp_extract(lrl, {q(_PAIR)}, {group}) AS BIGINT) "
        f"ELSE {O.first_count('lrl', [rest])} END)", _CUTS)


_SECT = {
    "PROMPT": compact("current_prompt", 1200),
    "LAST_USER": "lus",
    "FLOW": L(
        _line("last", O.nth_last("an", 1)), _line("prev", O.nth_last("an", 2)),
        _line("last2", O.nth_last("an", 2) + " || '>' || " + O.nth_last("an", 1)), _line("recent", join("recent")),
        _line("bigrams", join(O.ngrams("recent", 2, ">"))), _line("test_count", _MIN5("run_tests")),
        _line("lint_count", _MIN5("lint_or_typecheck")), _line("bash_count", _MIN5("run_bash")), _line("edit_count", _MIN5("edit_file")),
        _line("patch_count", _MIN5("apply_patch")), _line("write_count", _MIN5("write_file"))),
    "HINTS": "hints",
    "ARGS": L(
        _line("paths", join("paths")), _line("patterns", join("pats")), _line("cmds", join("cmds")), _line("targets", join("targets")),
        _line("n_files", O.band(f"len({O.recent_paths(20, 'heads')})", [0, 1, 2, 4, 8, 16]))),
    "RESULT": L(
        _line("status", O.status_heads("lrl")), _line("type", "rtype"), _line("count_files_bucket", O.band(_CNT("files"), _CUTS)),
        _line("count_matches_bucket", O.band(_CNT("matches"), _CUTS)), _line("count_lines_bucket", O.band(_CNT("lines"), [0, 20, 80, 200, 500, 1000])),
        _line("count_tests", O.band(_CNT("tests"), _CUTS)), _line("count_failed_tests", O.band(_CNT("failed"), [0, 1, 2, 5, 10])),
        _line("count_added", _diff(1, r"(\d+)\+")), _line("count_removed", _diff(2, r"(\d+)-")),
        _line("exit_zero", f"CASE WHEN contains(lrl, 'exit=0') OR contains(lrl, 'exit code 0') THEN '1' WHEN regexp_matches(lrl, {O.EXIT}) THEN '0' ELSE 'na' END")),
    "STATE": L(
        _line("git_dirty", "CASE WHEN git_dirty THEN 'True' ELSE 'False' END"), _line("open_files_count", O.band("len(open_files)", [0, 1, 2, 4, 8, 16])),
        _line("open_exts", either(join(O.sorted_exts("open_files", 8)), "none")), _line("last_ci_status", either(compact("ci", 80), "unknown")),
        _line("top_lang", O.primary_language(None, "unknown", False)),
        _line("turn_bucket", "CASE WHEN turn_index <= 2 THEN 'early' WHEN turn_index <= 6 THEN 'mid' WHEN turn_index <= 12 THEN 'late' ELSE 'deep' END"),
        _line("budget_bucket", O.band("budget", [0, 5000, 10000, 20000, 50000])),
        _line("budget_critical", "CASE WHEN budget < 5000 THEN 1 ELSE 0 END")),
}
_COMMON_CTE = f"cm AS (SELECT *, {hints_sql()} AS hints FROM hin2),\nsx AS (SELECT *, " + ", ".join(
    f"{v} AS s_{k}" for k, v in _SECT.items()) + " FROM cm)"
_COMMON_TEXT = "'[COMMON]' || chr(10) || chr(10) || " + " || chr(10) || chr(10) || ".join(f"'[{k}]' || chr(10) || s_{k}" for k in _SECT)


def _stream_sql(names):
    return " || chr(10) || ".join(f"'[{n}]' || chr(10) || {_STRIP('s_' + n)}" for n in names)


@query("view_common_streams", sql(SESS, O.FEAT, HINT_CTE, _COMMON_CTE, select=f"""
SELECT id, {_COMMON_TEXT} AS text, {_stream_sql(['PROMPT', 'LAST_USER', 'HINTS'])} AS semantic,
  {_stream_sql(['FLOW', 'ARGS', 'RESULT', 'STATE'])} AS context FROM sx"""))
def view_common_streams(spark, folder):
    ready = V.prepare(rows_of(spark, folder), "common").select("id", C("common").alias("text"))
    semantic, context = V.two_streams(C("text"))
    return ready.select("id", "text", semantic.alias("semantic"), context.alias("context"))


@query("fn_split_sections", sql(SESS, O.FEAT, HINT_CTE, _COMMON_CTE, select=" UNION ALL ".join(
    [f"SELECT id, '{k}' AS section, {_STRIP('s_' + k)} AS body FROM sx" for k in _SECT] + ["SELECT id, 'COMMON', '' FROM sx"])))
def fn_split_sections(spark, folder):
    ready = V.prepare(rows_of(spark, folder), "common")
    return ready.select("id", F.explode_outer(S.sections(C("common"))).alias("section", "body"))


_FLATTEN = lambda t: _STRIP(f"regexp_replace(coalesce({t}, ''), '[\\n\\r]', ' ', 'g')")
_FAST = lambda t, n: f"left({_FLATTEN(t)}, {n})"
_LISTREPR = "CASE WHEN a.is_list THEN '[' || array_to_string(list_transform(a.vs, lambda x: '''' || x || ''''), ', ') || ']' ELSE a.v END"
_SAID = lambda lst, body: f"list_transform(list_filter({lst}, lambda e: e.role = 'user' AND coalesce(e.content, '') <> ''), lambda e: {body})"
_RESS = lambda lst, body: f"list_transform(list_filter({lst}, lambda e: coalesce(e.res, '') <> ''), lambda e: {body})"
_LASTK = lambda k, sep: either(join(tail("an", k), sep), "none")
_UNKD = lambda x, cuts: O.band_float(x, cuts, "unknown")
_JM0 = f"""
jm0 AS (SELECT *, {compact('current_prompt', 2200)} AS p,
  {join(tail(_SAID('evs', _FAST('e.content', 500)), 4))} AS u, {join(tail(_RESS('evs', _FAST('e.res', 250)), 4))} AS r,
  {join(tail("list_transform(list_filter(evs, lambda e: e.args IS NOT NULL), lambda e: coalesce(array_to_string(list_transform(e.args, lambda a: a.k || '_' || left(" + _LISTREPR + ", 200)), ' '), ''))", 4))} AS a,
  {join(tail('open_files', 8))} AS o FROM feat),
jm1 AS (SELECT *, p || ' ' || u || ' ' || r || ' ' || a || ' ' || o AS spelled,
  'user_tier_' || coalesce(user_tier, '') || ' language_pref_' || coalesce(language_pref, '') || ' git_dirty_' || CASE WHEN git_dirty THEN 'True' ELSE 'False' END
  || ' ci_' || coalesce(ci, '') || ' budget_' || ({_UNKD('budget', [1000, 5000, 10000, 30000, 70000, 150000])}) || ' turn_' || ({_UNKD('turn_index', [1, 3, 5, 10, 20, 40])})
  || ' elapsed_' || ({_UNKD('elapsed', [60, 300, 900, 1800, 3600, 7200])}) || ' loc_' || ({_UNKD('loc', [100, 1000, 5000, 20000, 100000])})
  || ' ' || {join("list_transform(mix, lambda m: 'lang_' || m.k || '_' || round(m.v, 2)::DOUBLE::VARCHAR)")} || ' ' || o || ' '
  || {join("list_transform(open_files, lambda z: 'ext_' || " + O.suffix('z') + ")")} AS meta FROM jm0)
"""
_KW = "array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN {has('spelled', w)} THEN {q(n)} END" for n, w in KW.KEYWORD_GROUPS.items()) + "], lambda x: x IS NOT NULL), ' ')"


@query("view_jm_text", sql(SESS, O.FEAT, _JM0, select=f"""
SELECT id, {L("'CURRENT_PROMPT ' || p", "'CURRENT_PROMPT2 ' || p", "'CURRENT_PROMPT3 ' || p", "'RECENT_USER_MESSAGES ' || u",
  "'ALL_ACTIONS ' || " + join('an'), "'LAST_ACTION ' || " + _LASTK(1, '_'), "'LAST2_ACTION ' || " + _LASTK(2, '_'), "'LAST3_ACTION ' || " + _LASTK(3, '_'),
  "'ACTION_BIGRAMS ' || " + join(O.ngrams('an', 2, '__')), "'ACTION_TRIGRAMS ' || " + join(O.ngrams('an', 3, '__')),
  "'RECENT_RESULTS ' || r", "'RECENT_ARGS ' || a", "'RECENT_ARGS2 ' || a", "'KEYWORDS ' || " + _KW, "'META ' || meta")} AS text FROM jm1"""))
def view_jm_text(spark, folder):
    return V.prepare(rows_of(spark, folder), "an").select("id", V.engineered_text().alias("text"))


_H12 = tail("evs", 12)
_ARGS_EQ = lambda lst, n: (
    f"flatten(list_transform({lst}, lambda e: list_transform(coalesce(e.args, []), lambda a: a.k || '=' || left({_LISTREPR}, {n}))))"
)
_STORY_REST = L(
    f"'PREVIOUS_USER_REQUESTS ' || {join(tail(_SAID(_H12, compact('e.content', 500)), 5))}",
    f"'PREVIOUS_TOOL_ARGS ' || {join(tail(_ARGS_EQ(_H12, 200), 12))}",
    f"'PREVIOUS_RESULTS ' || {join(tail(_RESS(_H12, compact('e.res', 250)), 8))}",
    f"'CURRENT_PROMPT ' || {compact('current_prompt', 2200)}",
)
_SEQ = f"CASE WHEN len(an) > 0 THEN 'PREVIOUS_ACTION_SEQUENCE ' || {join('an')} || chr(10) ELSE '' END"


@query("view_story_text", sql(SESS, O.FEAT, INSPECT_CTE, select=f"""
SELECT id, {compact('current_prompt', 2200)} AS prompt_only, {_SEQ} || {_STORY_REST} AS story,
  'STATE ' || {join('stokens')} || chr(10) || {_SEQ} || {_STORY_REST} AS story_state FROM ins6"""))
def view_story_text(spark, folder):
    ready = V.prepare(rows_of(spark, folder), "an")
    return ready.select(
        "id", V.compact(C("current_prompt"), 2200).alias("prompt_only"), V.story_text().alias("story"),
        V.story_text(with_state=True).alias("story_state"),
    )


@query("view_five", sql(SESS, O.FEAT, select=f"""
SELECT id, {compact('current_prompt', 2200)} AS current_prompt_view, {join(tail(_SAID('evs', compact('e.content', 700)), 8))} AS history_user_text,
  'ALL_ACTIONS ' || {join('an')} || ' LAST_ACTION ' || {_LASTK(1, '__')} || ' LAST2_ACTION ' || {_LASTK(2, '__')} || ' LAST3_ACTION ' || {_LASTK(3, '__')}
    || ' ACTION_BIGRAMS ' || {join(O.ngrams('an', 2, '__'))} || ' ACTION_TRIGRAMS ' || {join(O.ngrams('an', 3, '__'))} AS action_names_sequence,
  {join(f"flatten([{tail(_ARGS_EQ('evs', 250), 16)}, {tail('open_files', 12)}, list_transform({tail('open_files', 12)}, lambda z: 'ext_' || {O.suffix('z')})])")} AS action_args_and_paths,
  {join(tail(_RESS('evs', compact('e.res', 400)), 10))} AS result_summary_view FROM feat"""))
def view_five(spark, folder):
    ready = V.prepare(rows_of(spark, folder), "an")
    return ready.select("id", *[v.alias(k) for k, v in V.five_views().items()])


def _ent(k, v="1.0::DOUBLE"):
    return f"struct_pack(k := {k}, v := ({v})::DOUBLE)"


_PP = (
    r"(?i)[A-Za-z]:[\\/]|[./\\][\p{L}\p{N}_./\\-]+|"
    r"\b[\p{L}\p{N}_.-]+\.(?:py|js|ts|tsx|json|csv|md|txt|yaml|yml|ipynb)\b"
)
_SM = "flatten([[" + ", ".join([
    _ent("'user_tier=' || coalesce(user_tier, '')"), _ent("'language_pref=' || coalesce(language_pref, '')"),
    _ent("'last_ci_status=' || coalesce(ci, '')"), _ent("'git_dirty=' || CASE WHEN git_dirty THEN 'True' ELSE 'False' END"),
    _ent(f"'turn_bin=' || ({O.bin_floor('turn_index', 1)})"), _ent(f"'budget_bin=' || ({O.bin_floor('budget', 10000)})"),
    _ent(f"'elapsed_bin=' || ({O.bin_floor('elapsed', 60)})"), _ent(f"'loc_bin=' || ({O.bin_floor('loc', 5000)})"),
    _ent("'history_len'", "len(evs)"), _ent("'history_length_bin=' || (len(evs) // 2)"), _ent("'prompt_len_bin=' || (length(cur) // 40)"),
    _ent("'open_files_count'", "len(open_files)"), _ent("'has_failed_in_last_result'", "CASE WHEN contains(res_text, 'fail') THEN 1 ELSE 0 END"),
    _ent("'has_error_keyword'", "CASE WHEN " + has("(cur || ' ' || res_text)", ["error", "failed", "fail", "exception", "traceback", "오류", "실패", "에러"]) + " THEN 1 ELSE 0 END"),
    _ent("'has_path_in_prompt'", f"CASE WHEN regexp_matches(cur, {q(_PP)}) THEN 1 ELSE 0 END"),
    _ent("'has_code_block_in_prompt'", "CASE WHEN contains(cur, '```') THEN 1 ELSE 0 END"),
    _ent("'has_question_mark'", "CASE WHEN contains(cur, '?') OR contains(cur, '？') THEN 1 ELSE 0 END"),
    *[_ent(f"'count_{a}'", O.count_of("an", a)) for a in ("read_file", "grep_search", "edit_file", "run_tests")],
]) + "]," + ", ".join([
    "list_distinct(flatten(list_transform(open_files, lambda z: [" + ", ".join(
        [_ent("'open_file=' || z"), _ent("'open_ext=' || " + O.suffix("z")), _ent("'open_file_extension=' || " + O.suffix("z"))]) + "])))",
    "list_transform(list_slice(list_sort(list_transform(mix, lambda m, i: struct_pack(nv := -m.v, i := i, k := m.k))), 1, 2), lambda m, i: " + _ent("'workspace_language_top' || i || '=' || m.k") + ")",
    "list_distinct(list_transform(mix, lambda m: " + _ent("'lang_mix=' || m.k") + "))",
    "CASE WHEN len(an) = 0 THEN [" + _ent("'last_action=NONE'") + "] ELSE flatten([[" + _ent("'last_action=' || an[-1]") + ", " + _ent("'first_action=' || an[1]") + ", " + _ent("'action_count'", "len(an)") + "], "
    "CASE WHEN len(an) >= 2 THEN [" + _ent(f"'last2_actions=' || {join(tail('an', 2), '>')}") + "] ELSE [] END, "
    "CASE WHEN len(an) >= 3 THEN [" + _ent(f"'last3_actions=' || {join(tail('an', 3), '>')}") + "] ELSE [] END, "
    "list_transform(list_distinct(" + tail("an", 8) + "), lambda z: " + _ent("'recent_action=' || z", f"len(list_filter({tail('an', 8)}, lambda y: y = z))") + ")]) END",
]) + "])"
STATE_MAP = f"""
sm0 AS (SELECT *, {compact('current_prompt', 2200)} AS cur, lower({join(_RESS('evs', compact('e.res', 500)))}) AS res_text FROM feat),
sm1 AS (SELECT *, {_SM} AS kvs FROM sm0),
smap AS (SELECT id, action, e.k AS key, e.v AS value FROM (SELECT id, action, unnest(kvs) AS e FROM sm1))
"""


@query("feat_state_map", sql(SESS, O.FEAT, STATE_MAP, select="SELECT id, key, value FROM smap"))
def feat_state_map(spark, folder):
    ready = V.prepare(rows_of(spark, folder), "an")
    return ready.select("id", F.explode_outer(V.state_map()).alias("key", "value"))


_ST = "regexp_extract(id, '-step_([0-9]+)$', 1)::INTEGER"


@query("view_dispatch", sql(SESS, O.FEAT, V0, V_AU, select=f"""
SELECT id, CASE WHEN domain = 'au' THEN {_au(False)} ELSE {_SIM} END AS text, split_part(id, '-step_', 1) AS session_id, domain AS src, {_ST} AS step,
  CASE WHEN {_ST} <= 1 THEN 's1' WHEN {_ST} <= 3 THEN 's2_3' WHEN {_ST} <= 6 THEN 's4_6' WHEN {_ST} <= 10 THEN 's7_10' ELSE 's11p' END AS step_group,
  {O.nth_last('an', 1, 'none')} AS last_action, {O.nth_last('an', 2, 'none')} AS prev_action, len(an)::INTEGER AS history_len FROM au3"""))
def view_dispatch(spark, folder):
    rows = rows_of(spark, folder)
    step = keys.step_number(C("id"))
    an = C("an")
    return V.by_domain(rows).select(
        "id", "text", keys.root_session(C("id"), "first").alias("session_id"), keys.domain(C("id")).alias("src"),
        step.alias("step"), keys.step_band(step).alias("step_group"), V.E.nth_last(an, 1, "none").alias("last_action"),
        V.E.nth_last(an, 2, "none").alias("prev_action"), F.size(an).alias("history_len"),
    )


_W = {0: 1.0, 1: 0.7, 2: 0.5}
_WSQL = [_W.get(v, 1.0) for v in range(5)]


@query("augment_views_weighted", sql(SESS, O.FEAT, V0, f"av AS ({_variants_sql('sim')})", f"fv AS (SELECT id, {_FEATS} AS f FROM feat)",
       f"wv AS (SELECT av.*, ({arr(_WSQL)})[variant + 1] AS w FROM av)", select="""
SELECT id, variant, length(text) AS n_chars, round(list_sum(f), 4) AS feature_sum, round(w / avg(w) OVER (), 6) AS weight
FROM wv JOIN fv USING (id)"""))
def augment_views_weighted(spark, folder):
    rows = _nonneg_budget(rows_of(spark, folder))
    expanded = V.expand_views(rows, "sim", 4, V.variant_weights("0:1.0,1:0.7,2:0.5"))
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return expanded.select(
        "id", "variant", F.length("text").cast("long").alias("n_chars"), F.round(total, 4).alias("feature_sum"),
        rounded(C("weight")).alias("weight"),
    )
