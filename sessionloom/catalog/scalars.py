"""Scalar functions over session steps, documents, paraphrase pairs and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.catalog import oracle_events as O
from sessionloom.catalog.oracle import (
    SCORES, SESS, arr, collapse, compact, has, join, pairs_sql, q, softmax, sql, strip_output, words,
)
from sessionloom.catalog.registry import query
from sessionloom.functions import buckets as B
from sessionloom.functions import events as E
from sessionloom.functions import keywords as KW
from sessionloom.functions import probs as P
from sessionloom.functions import results as R
from sessionloom.functions import rewrite as RW
from sessionloom.functions import scalars as S
from sessionloom.functions import text as T
from sessionloom.operators.metrics import rounded
from sessionloom.schema import CI_STATES, LANG_PREFS, PRIMARY_LANGS, SHORT_NAME, TIERS, TRACE_LANG_PREFS, lookup
from sessionloom.sources import derived
from sessionloom.sources.tables import table


def _history():
    return F.col("history")


def _meta():
    return F.col("session_meta")


def _prompt():
    return F.col("current_prompt")


def _ws():
    return _meta()["workspace"]



def long(c):
    return c.cast("long")


_FLAT = r"regexp_replace(regexp_replace(text, '[\n\r]', ' ', 'g'), '^[\s\x0b\x1c-\x1f\x85\p{Z}]+|[\s\x0b\x1c-\x1f\x85\p{Z}]+$', '', 'g')"


@query("fn_compact", f"""
SELECT conv_id, turn, {compact('text', 500)} AS c500, {collapse('text')} AS whole, left({_FLAT}, 250) AS fast250 FROM conversations""")
def fn_compact(spark, folder):
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", T.compact(F.col("text"), 500).alias("c500"), T.collapse(F.col("text")).alias("whole"),
        T.fast_compact(F.col("text"), 250).alias("fast250"),
    )


@query("fn_word_count", f"SELECT doc_id, {words('text')} AS n_words FROM documents")
def fn_word_count(spark, folder):
    return table(spark, folder, "documents").select("doc_id", long(T.word_count(F.col("text"))).alias("n_words"))


@query("fn_buckets", sql(SESS, select=f"""
SELECT id, {O.band('turn_index', [2, 5, 10, 20])} AS step_band, {O.band_float('elapsed', [120, 300, 900, 1800])} AS elapsed_band,
  {O.band_float('budget', [1000, 5000, 10000, 30000], 'unknown')} AS budget_band,
  {O.band_float('mix[1].v', [0.05, 0.1, 0.25, 0.5, 0.75, 1.0], 'unknown', dots=False)} AS share_band,
  {O.bin_floor('budget', 10000)} AS budget_bin, {O.band('loc', [0, 1, 2, 5, 10, 25, 50, 100])} AS count_band,
  CASE WHEN turn_index <= 2 THEN 'early' WHEN turn_index <= 6 THEN 'mid' WHEN turn_index <= 12 THEN 'late' ELSE 'deep' END AS phase,
  CASE WHEN budget < 5000 THEN 1 ELSE 0 END AS critical, {O.band("TRY_CAST(language_pref AS DOUBLE)", [1])} AS not_a_number FROM sess"""))
def fn_buckets(spark, folder):
    share = F.get(F.map_values(_ws()["language_mix"]), F.lit(0))
    return derived.sessions(spark, folder).select(
        "id",
        B.band(_meta()["turn_index"], [2, 5, 10, 20]).alias("step_band"),
        B.band_float(_meta()["elapsed_session_sec"], [120, 300, 900, 1800]).alias("elapsed_band"),
        B.band_float(_meta()["budget_tokens_remaining"], [1000, 5000, 10000, 30000], missing="unknown").alias("budget_band"),
        B.band_unknown(share, [0.05, 0.1, 0.25, 0.5, 0.75, 1.0]).alias("share_band"),
        B.bin_floor(_meta()["budget_tokens_remaining"], 10000).alias("budget_bin"),
        B.band(_ws()["loc"], R.COUNT_CUTS).alias("count_band"),
        B.turn_phase(_meta()["turn_index"]).alias("phase"),
        B.budget_critical(_meta()["budget_tokens_remaining"]).alias("critical"),
        B.band(_meta()["language_pref"], [1]).alias("not_a_number"),
    )


@query("fn_prompt_band", sql(SESS, select=f"SELECT id, {O.prompt_band(words('current_prompt'))} AS band FROM sess"))
def fn_prompt_band(spark, folder):
    return derived.sessions(spark, folder).select("id", B.prompt_band(_prompt()).alias("band"))


_EVENTS = """
e1 AS (SELECT id, unnest(evs) AS e FROM sess),
e2 AS (SELECT id, coalesce(e.name, 'NONE') AS name, coalesce(e.res, e.content, '') AS res, lower(coalesce(e.res, e.content, '')) AS low FROM e1)
"""


def _event_rows(spark, folder):
    rows = derived.sessions(spark, folder).select("id", F.explode("history").alias("e"))
    return rows.select(
        "id", F.coalesce("e.name", F.lit("NONE")).alias("name"), F.coalesce("e.result_summary", "e.content", F.lit("")).alias("res")
    )


@query("fn_result_status", sql(SESS, _EVENTS, select=f"""
SELECT id, md5(res) AS res_key, {O.status('low')} AS base, {O.status_with_empty('low')} AS with_empty, {O.status_inspect('low')} AS inspect,
  {O.status_heads('low')} AS heads FROM e2"""))
def fn_result_status(spark, folder):
    r = F.col("res")
    return _event_rows(spark, folder).select(
        "id", F.md5("res").alias("res_key"), R.status(r).alias("base"), R.status_with_empty(r).alias("with_empty"),
        R.status_inspect(r).alias("inspect"), R.status_heads(r).alias("heads"),
    )


@query("fn_result_type", sql(SESS, _EVENTS, select=f"""
SELECT id, name, md5(res) AS res_key, {O.result_type('name', 'low')} AS base, {O.result_type('name', 'low', True)} AS inspect FROM e2"""))
def fn_result_type(spark, folder):
    return _event_rows(spark, folder).select(
        "id", "name", F.md5("res").alias("res_key"), R.result_type(F.col("name"), F.col("res")).alias("base"),
        R.result_type(F.col("name"), F.col("res"), inspect=True).alias("inspect"),
    )


_PAIR = r"([0-9]+)\s*(?:insertions?|added).{0,30}?([0-9]+)\s*(?:deletions?|removed)"
_CUTS = [0, 1, 2, 5, 10, 25, 50, 100]


def _diff_sql(group, rest):
    return O.band(
        f"(CASE WHEN regexp_matches(low, {q(_PAIR)}) THEN TRY_CAST(regexp_extract(low, {q(_PAIR)}, {group}) AS BIGINT) "
        f"ELSE {O.first_count('low', [rest])} END)", _CUTS)


@query("fn_extract_counts", sql(SESS, _EVENTS, select=f"""
SELECT id, md5(res) AS res_key, {', '.join(f"{O.first_count('low', R.COUNT_PATTERNS[k])} AS {k}" for k in R.COUNT_PATTERNS)},
  {_diff_sql(1, r'(\d+)\+')} AS added, {_diff_sql(2, r'(\d+)-')} AS removed,
  CASE WHEN contains(low, 'exit=0') OR contains(low, 'exit code 0') THEN '1' WHEN regexp_matches(low, {O.EXIT}) THEN '0' ELSE 'na' END AS exit_zero FROM e2"""))
def fn_extract_counts(spark, folder):
    r = F.col("res")
    added, removed = R.added_removed(r)
    return _event_rows(spark, folder).select(
        "id", F.md5("res").alias("res_key"), *[R.first_count(r, k).alias(k) for k in R.COUNT_PATTERNS],
        added.alias("added"), removed.alias("removed"), R.exit_zero(r).alias("exit_zero"),
    )


def _hot_sql(value, choices, other=False):
    fallback = "other" if (other or "other" in choices) else "unknown"
    v = f"lower(coalesce(nullif({value}, ''), 'unknown'))"
    known = f"CASE WHEN {v} IN ({', '.join(q(c) for c in choices)}) THEN {v} ELSE '{fallback}' END"
    return f"array_to_string(list_transform({arr(choices)}, lambda c: CASE WHEN c = {known} THEN 1 ELSE 0 END), '')"


@query("fn_onehot", sql(SESS, select=f"""
SELECT id, {_hot_sql('user_tier', TIERS)} AS tier, {_hot_sql('language_pref', LANG_PREFS)} AS pref, {_hot_sql('ci', CI_STATES)} AS ci,
  {_hot_sql('language_pref', TRACE_LANG_PREFS, True)} AS pref_other, {_hot_sql('user_tier', TIERS, True)} AS tier_other FROM sess"""))
def fn_onehot(spark, folder):
    digits = lambda v: F.array_join(v.cast("array<int>").cast("array<string>"), "")
    return derived.sessions(spark, folder).select(
        "id",
        digits(S.one_hot(_meta()["user_tier"], TIERS)).alias("tier"),
        digits(S.one_hot(_meta()["language_pref"], LANG_PREFS)).alias("pref"),
        digits(S.one_hot(_ws()["last_ci_status"], CI_STATES)).alias("ci"),
        digits(S.one_hot_other(_meta()["language_pref"], TRACE_LANG_PREFS)).alias("pref_other"),
        digits(S.one_hot_other(_meta()["user_tier"], TIERS)).alias("tier_other"),
    )


@query("fn_primary_language", sql(SESS, select=f"""
SELECT id, {O.primary_language(PRIMARY_LANGS)} AS known, {O.primary_language()} AS low, {O.primary_language(None, 'unknown', False)} AS exact FROM sess"""))
def fn_primary_language(spark, folder):
    mix = _ws()["language_mix"]
    return derived.sessions(spark, folder).select(
        "id", E.primary_language(mix, PRIMARY_LANGS).alias("known"), E.primary_language(mix).alias("low"),
        E.top_language(mix).alias("exact"),
    )


_ODD_PATHS = "[p, upper(p), replace(p, '/', chr(92)), ' ' || p || '/', '.env', 'src/.env', 'Makefile', 'a.tar.gz', p || '.']"


@query("fn_paths", sql(SESS, f"""
p1 AS (SELECT id, unnest(open_files) AS p FROM sess),
p2 AS (SELECT id, unnest({_ODD_PATHS}) AS path FROM p1)
""", select=f"SELECT id, path, {O.norm_path('path')} AS norm, {O.base_name('path')} AS name, {O.extension('path')} AS ext, {O.suffix('path')} AS suffix FROM p2"))
def fn_paths(spark, folder):
    p = F.col("p")
    odd = F.array(p, F.upper(p), F.replace(p, F.lit("/"), F.lit("\\")), F.concat(F.lit(" "), p, F.lit("/")), F.lit(".env"),
                  F.lit("src/.env"), F.lit("Makefile"), F.lit("a.tar.gz"), F.concat(p, F.lit(".")))
    rows = derived.sessions(spark, folder).select("id", F.explode(E.open_files(_meta())).alias("p"))
    path = F.col("path")
    return rows.select("id", F.explode_outer(odd).alias("path")).select(
        "id", "path", E.norm_path(path).alias("norm"), E.base_name(path).alias("name"), E.extension(path).alias("ext"),
        E.suffix(path).alias("suffix"),
    )


@query("fn_symbols", sql(SESS, select=f"""
SELECT id, {join(O.symbols('current_prompt', 12))} AS symbols12, {join(O.symbols('current_prompt', 1000))} AS symbols_all FROM sess"""))
def fn_symbols(spark, folder):
    return derived.sessions(spark, folder).select(
        "id", F.array_join(E.symbols(_prompt(), 12), " ").alias("symbols12"),
        F.array_join(E.symbols(_prompt(), 1000), " ").alias("symbols_all"),
    )


@query("fn_keyword_tokens", sql(SESS, select=f"""
SELECT id, array_to_string(list_filter([{', '.join(f"CASE WHEN {has('current_prompt', w)} THEN {q(n)} END" for n, w in KW.KEYWORD_GROUPS.items())}],
  lambda x: x IS NOT NULL), ' ') AS tokens FROM sess"""))
def fn_keyword_tokens(spark, folder):
    return derived.sessions(spark, folder).select("id", KW.keyword_tokens(_prompt()).alias("tokens"))


def _flag_sql(test):
    return f"CASE WHEN {test} THEN '1' ELSE '0' END"


HINT_CTE = f"""
hin AS (
  SELECT *, {compact('current_prompt', 1200)} || ' ' || lus AS ps, lower(lr) AS lrl, {O.tail("an", 16)} AS recent,
    {O.recent_paths(8, 'heads')} AS paths, {O.recent_patterns(6, 'heads')} AS pats,
    {O.arg_values(['cmd', 'command', 'script'], 6)} AS cmds, {O.arg_values(['target', 'scope', 'command', 'cmd', 'name'], 6)} AS targets FROM feat),
hin2 AS (
  SELECT *, {join('paths')} || ' ' || {join('pats')} || ' ' || {join('cmds')} || ' ' || {join('targets')} || ' ' || lr || ' ' || {join('recent')} AS cs,
    {O.result_type(O.nth_last('an', 1), 'lrl')} AS rtype FROM hin)
"""


def hints_sql():
    texts = {"prompt": "ps", "context": "cs", "all": "(ps || ' ' || cs)"}
    structural = {
        "path": "len(paths) > 0", "patt": "len(pats) > 0", "cmd": "len(cmds) > 0", "nof": "len(open_files) = 0",
        "hof": "len(open_files) > 0", "rr": "rtype = 'read'", "rg": "rtype = 'grep'", "rb": "rtype = 'glob'",
        "rl": "rtype = 'list'", "lp": "len(open_files) = 0",
    }
    parts = []
    for name in KW.HINT_ORDER:
        test = structural[name] if name in structural else has(texts[KW.HINTS[name][0]], KW.HINTS[name][1])
        if name == "mf":
            test = f"({test} OR len(paths) >= 2)"
        parts.append(f"'{name}=' || {_flag_sql(test)}")
    return " || ' ' || ".join(parts)


def heads_columns(rows):
    """Intermediate columns of the sectioned text: paths, patterns, commands, targets, signals."""
    rows = rows.withColumns({
        "an": E.action_names(_history()),
        "lr": E.last_result(_history()),
        "lus": E.last_user(_history(), need_content=True),
        "paths": E.recent_paths(_history(), _meta(), 8, "heads"),
        "pats": E.recent_patterns(_history(), _prompt(), 6, "heads"),
        "cmds": E.arg_values(_history(), ["cmd", "command", "script"], 6, 120, 160),
        "targets": E.arg_values(_history(), ["target", "scope", "command", "cmd", "name"], 6, 120, 160),
    })
    recent = F.array_join(E.last_items(F.col("an"), 16), " ")
    return rows.withColumns({
        "prompt_signal": F.concat_ws(" ", T.compact(_prompt(), 1200), "lus"),
        "context_signal": F.concat_ws(" ", *[F.array_join(c, " ") for c in ("paths", "pats", "cmds", "targets")], "lr", recent),
        "rtype": R.result_type(E.nth_last(F.col("an"), 1), F.col("lr")),
    })


def hints(rows_with_columns):
    n = lambda c: F.size(F.col(c))
    return KW.hint_flags(
        F.col("prompt_signal"), F.col("context_signal"), F.col("rtype"), n("paths"), n("pats"), n("cmds"),
        F.size(E.open_files(_meta())),
    )


@query("fn_hint_flags", sql(SESS, O.FEAT, HINT_CTE, select=f"SELECT id, {hints_sql()} AS hints FROM hin2"))
def fn_hint_flags(spark, folder):
    rows = heads_columns(derived.sessions(spark, folder))
    return rows.select("id", hints(rows).alias("hints"))


_HINT_RX = (
    r"(?i)(?:[A-Za-z]:[\\/]|[./\\][\p{L}\p{N}_./\\-]+|\b[\p{L}\p{N}_./\\-]+\."
    r"(?:py|js|ts|tsx|json|csv|md|txt|yaml|yml|ipynb|go|rs|java|kt|css|scss|html|toml|ini|cfg|lock)\b)"
)
_NEWEST_ARGS = (
    "coalesce(list_filter(list_transform(evs, lambda e: lower(coalesce(array_to_string(list_transform(coalesce(e.args, []), lambda a: a.k || '=' || "
    "left(CASE WHEN a.is_list THEN '[' || array_to_string(list_transform(a.vs, lambda x: '''' || x || ''''), ', ') || ']' ELSE a.v END, 250)), ' '), ''))), "
    "lambda t: t <> '')[-1], '')"
)
INSPECT_CTE = f"""
ins AS (
  SELECT *, lower({compact('current_prompt', 2200)}) AS low, len({O.found(compact('current_prompt', 2200), _HINT_RX)}) AS n_paths,
    {O.nth_last('an', 1)} AS last, lower(lr) AS result, {_NEWEST_ARGS} AS args_text FROM feat),
ins2 AS (
  SELECT *, contains(low, '*') AS wild, lower(last) || ' ' || result || ' ' || args_text AS ctx,
    {', '.join(f"{O.has('low', KW.INTENTS[k])} AS i_{k}" for k in ('read', 'search', 'list'))},
    contains(low, '*') OR {O.has('low', KW.INTENTS['glob'])} AS i_glob, {O.has('low', KW.DEICTIC)} AS deictic FROM ins),
ins3 AS (
  SELECT *, len({O.found('ctx', _HINT_RX)}) AS n_found,
    regexp_matches(result, '\\b\\d+\\s+(entries|items)\\b') OR contains(result, 'listed') AS r_listed,
    regexp_matches(result, '\\b\\d+\\s+(files?\\s+)?matched\\b') OR contains(result, 'files matched') AS r_globbed,
    regexp_matches(result, '\\b\\d+\\s+(matches|occurrences)\\b') OR contains(result, 'found ') AS r_grepped,
    contains(result, 'read ') OR contains(ctx, 'read_file') AS r_read FROM ins2),
ins4 AS (
  SELECT *, n_paths > 0 OR (deictic AND (last IN ('read_file', 'grep_search', 'glob_pattern', 'list_directory') OR n_found > 0
    OR r_listed OR r_globbed OR r_grepped OR r_read)) AS known FROM ins3),
ins5 AS (SELECT *, list_filter([
    CASE WHEN n_paths > 0 THEN 'inspect_prompt_has_path' END,
    CASE WHEN n_paths > 0 THEN 'inspect_prompt_path_count_' || {O.band_float('n_paths', [1, 2, 4])} END,
    CASE WHEN wild THEN 'inspect_prompt_has_wildcard' END,
    CASE WHEN i_read THEN 'inspect_intent_read' END, CASE WHEN i_search THEN 'inspect_intent_search' END,
    CASE WHEN i_list THEN 'inspect_intent_list' END, CASE WHEN i_glob THEN 'inspect_intent_glob' END,
    CASE WHEN deictic THEN 'inspect_deictic_target' END,
    CASE WHEN len(an) > 0 THEN 'inspect_last_action_' || last END,
    CASE WHEN n_found > 0 THEN 'inspect_recent_result_has_path' END,
    CASE WHEN n_found > 0 THEN 'inspect_recent_result_path_count_' || {O.band_float('n_found', [1, 2, 4, 8])} END,
    CASE WHEN r_listed THEN 'inspect_recent_result_listed' END, CASE WHEN r_globbed THEN 'inspect_recent_result_globbed' END,
    CASE WHEN r_grepped THEN 'inspect_recent_result_grepped' END, CASE WHEN r_read THEN 'inspect_recent_result_read' END,
    CASE WHEN known THEN 'inspect_target_known' END,
    CASE WHEN i_search AND NOT known THEN 'inspect_target_unknown_search' END,
    {', '.join(f"CASE WHEN i_{k} THEN 'inspect_combo_last_' || last || '_intent_{k}' END, CASE WHEN i_{k} AND known THEN 'inspect_combo_known_intent_{k}' END" for k in ('read', 'search', 'list', 'glob'))}
  ], lambda x: x IS NOT NULL) AS itokens FROM ins4),
ins6 AS (SELECT *, list_filter(flatten([
    ['tier_' || {compact('user_tier', 80)}, 'lang_' || {compact('language_pref', 80)}, 'ci_' || {compact('ci', 80)},
     'dirty_' || CASE WHEN git_dirty THEN 'True' ELSE 'False' END, 'turn_' || {O.bin_floor('turn_index', 1)},
     'budget_bin_' || {O.bin_floor('budget', 10000)}, 'elapsed_bin_' || {O.bin_floor('elapsed', 60)}, 'loc_bin_' || {O.bin_floor('loc', 5000)}],
    list_transform(open_files, lambda p: 'open_file_' || {compact('p', 120)}),
    list_transform(mix, lambda m: 'langmix_' || {compact('m.k', 40)}),
    itokens]), lambda t: t <> '' AND NOT ends_with(t, '_')) AS stokens FROM ins5)
"""


@query("fn_inspect_tokens", sql(SESS, O.FEAT, INSPECT_CTE, select=f"SELECT id, {join('itokens')} AS tokens FROM ins5"))
def fn_inspect_tokens(spark, folder):
    return derived.sessions(spark, folder).select("id", F.array_join(KW.inspect_tokens(_prompt(), _history()), " ").alias("tokens"))


@query("fn_state_tokens", sql(SESS, O.FEAT, INSPECT_CTE, select=f"SELECT id, {join('stokens')} AS tokens FROM ins6"))
def fn_state_tokens(spark, folder):
    return derived.sessions(spark, folder).select("id", F.array_join(KW.state_tokens(_prompt(), _history(), _meta()), " ").alias("tokens"))


@query("fn_compact_value", sql(SESS, select="""
SELECT id, i, array_to_string(list_transform(list_sort(e.args), lambda a: a.k || '=' || array_to_string(a.vs, ' ')), ' ') AS flat
FROM (SELECT id, unnest(evs) AS e, unnest(range(len(evs))) AS i FROM sess) WHERE e.args IS NOT NULL"""))
def fn_compact_value(spark, folder):
    rows = derived.sessions(spark, folder).select("id", F.posexplode("history").alias("i", "e"))
    return rows.where(F.col("e.args").isNotNull()).select("id", long(F.col("i")).alias("i"), E.flat_value(F.col("e.args")).alias("flat"))


@query("fn_count_band", sql(SESS, O.FEAT, select=f"""
SELECT id, {O.count_band('len(evs)')} AS history_band, {join('list_transform(an, lambda a: ' + O.GROUP_CASE('a') + ')')} AS groups,
  {join('list_transform(an, lambda a: ' + "CASE a " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in SHORT_NAME.items()) + " ELSE replace(a, '_', '') END)")} AS short_names FROM feat"""))
def fn_count_band(spark, folder):
    from sessionloom.operators.keys import action_group

    short = lambda a: F.coalesce(F.try_element_at(lookup(SHORT_NAME), a), F.replace(a, F.lit("_"), F.lit("")))
    an = E.action_names(_history())
    return derived.sessions(spark, folder).select(
        "id", B.count_band(F.size(_history())).alias("history_band"),
        F.array_join(F.transform(an, lambda a: action_group(a)), " ").alias("groups"),
        F.array_join(F.transform(an, short), " ").alias("short_names"),
    )


@query("fn_scaled_log", sql(SESS, select="""
SELECT id, round(ln(1.0::DOUBLE + loc) / 12.0::DOUBLE, 6) AS loc_log, round(ln(1.0::DOUBLE + turn_index) / 4.0::DOUBLE, 6) AS turn_log,
  round(least(1.0::DOUBLE, ln(1.0::DOUBLE + greatest(budget, 0.0::DOUBLE)) / ln(1.0::DOUBLE + 200000.0::DOUBLE)), 6) AS budget_clip,
  round(least(1.0::DOUBLE, ln(1.0::DOUBLE + loc) / ln(1.0::DOUBLE + 1000.0::DOUBLE)), 6) AS loc_clip FROM sess"""))
def fn_scaled_log(spark, folder):
    import math

    return derived.sessions(spark, folder).select(
        "id", rounded(B.scaled_log(_ws()["loc"], 12.0)).alias("loc_log"), rounded(B.scaled_log(_meta()["turn_index"], 4.0)).alias("turn_log"),
        rounded(B.scaled_log_clipped(_meta()["budget_tokens_remaining"], math.log1p(200000.0))).alias("budget_clip"),
        rounded(B.scaled_log_clipped(_ws()["loc"], math.log1p(1000.0))).alias("loc_clip"),
    )


_NOISY = """
noisy AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '- 1. "' || original || '"' WHEN 1 THEN '* ' || original || '  ' WHEN 2 THEN '''' || original || '''' ELSE '"' END AS raw, original, action FROM pairs)
"""


def _noisy(spark, folder):
    rows = derived.paraphrase_pairs(spark, folder)
    o = F.col("original")
    raw = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit('- 1. "'), o, F.lit('"')))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("* "), o, F.lit("  ")))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("'"), o, F.lit("'")))
        .otherwise('"')
    )
    return rows.select("doc_id", raw.alias("raw"))


@query("fn_strip_output", sql(pairs_sql(), _NOISY, select=f"SELECT doc_id, {strip_output('raw')} AS stripped FROM noisy"))
def fn_strip_output(spark, folder):
    return _noisy(spark, folder).select("doc_id", RW.strip_output(F.col("raw")).alias("stripped"))


def masked_sentences_sql(text):
    # No lookaround here: mask "digit dot digit" twice so that 1.2.3 is covered.
    m = f"regexp_replace(regexp_replace(coalesce({text}, ''), '(\\p{{Nd}})\\.(\\p{{Nd}})', '\\1<DOT>\\2', 'g'), '(\\p{{Nd}})\\.(\\p{{Nd}})', '\\1<DOT>\\2', 'g')"
    f = f"regexp_replace({m}, '[\\p{{L}}\\p{{N}}_./-]+\\.[A-Za-z]{{1,5}}', '<FILE>', 'g')"
    return f"len(list_filter(string_split_regex({f}, '[.!?。！？]+'), lambda p: regexp_replace(p, '[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]', '', 'g') <> ''))"


@query("fn_sentence_count", sql(pairs_sql(), select=f"""
SELECT id, {masked_sentences_sql('paraphrase')} AS masked FROM pairs
UNION ALL SELECT 'turn_' || conv_id || '_' || turn, {masked_sentences_sql('text')} FROM conversations"""))
def fn_sentence_count(spark, folder):
    pairs = derived.paraphrase_pairs(spark, folder).select("id", F.col("paraphrase").alias("t"))
    turns = table(spark, folder, "conversations").select(
        F.concat(F.lit("turn_"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("id"),
        F.col("text").alias("t"),
    )
    return pairs.unionByName(turns).select("id", long(S.sentences_masked(F.col("t"))).alias("masked"))


def protected_sentences_sql(text):
    """Sentences of collapsed text. No lookaround here: what stands around a dot is matched and put back, twice for runs.

    File tokens need no rule of their own: their last dot stands between a non-blank and a letter.
    """
    once = lambda t, before, after: f"regexp_replace({t}, '({before})\\.({after})', '\\1<DOT>\\2', 'g')"
    m = once(once(text, "\\p{Nd}", "\\p{Nd}"), "\\p{Nd}", "\\p{Nd}")
    m = f"regexp_replace({m}, '\\.([A-Za-z_][\\p{{L}}\\p{{N}}_]*\\()', '<DOT>\\1', 'g')"
    solid = "^|[^\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]"
    m = once(once(m, solid, "[A-Za-z_]"), solid, "[A-Za-z_]")
    return f"CASE WHEN {text} = '' THEN 0 ELSE greatest(1, len(list_filter(string_split_regex({m}, '[.!?。！？]+'), lambda s: trim(s) <> ''))) END"


@query("fn_sentence_count_protected", sql(pairs_sql(), select=f"""
SELECT id, ({protected_sentences_sql(collapse('paraphrase'))})::INTEGER AS protected FROM pairs"""))
def fn_sentence_count_protected(spark, folder):
    pairs = derived.paraphrase_pairs(spark, folder)
    return pairs.select("id", S.sentences_protected(F.col("paraphrase")).alias("protected"))


@query("fn_has_hangul", sql(SESS, select="SELECT id, regexp_matches(current_prompt, '[가-힣]') AS hangul FROM sess"))
def fn_has_hangul(spark, folder):
    return derived.sessions(spark, folder).select("id", T.has_hangul(_prompt()).alias("hangul"))


_FILE_RX = q(r"[\p{L}\p{N}_./-]+\.[A-Za-z]{1,5}")
_TICK_RX = q("`([^`]+)`")


def kept_sql(rx, group=0):
    return (
        f"len(list_filter(regexp_extract_all(original, {rx}, {group}), lambda t: NOT list_contains(regexp_extract_all(paraphrase, {rx}, {group}), t))) = 0"
    )


@query("fn_tokens_preserved", sql(pairs_sql(), select=f"""
SELECT id, {kept_sql(_FILE_RX)} AS files_kept, {kept_sql(_TICK_RX, 1)} AS ticks_kept,
  {join(f'list_filter({arr(S.DEIXIS)}, lambda t: contains(original, t))', ',')} AS deixis,
  {join(f'list_sort(list_distinct(regexp_extract_all(original, {_FILE_RX})))', ',')} AS files FROM pairs"""))
def fn_tokens_preserved(spark, folder):
    o, p = F.col("original"), F.col("paraphrase")
    return derived.paraphrase_pairs(spark, folder).select(
        "id", S.subset_kept(S.FILE_TOKEN, o, p).alias("files_kept"), S.subset_kept(S.BACKTICK, o, p, 1).alias("ticks_kept"),
        F.array_join(S.deixis_terms(o), ",").alias("deixis"), F.array_join(S.file_tokens(o), ",").alias("files"),
    )


def words_kept_sql(text="paraphrase"):
    return "CASE action " + " ".join(f"WHEN {q(a)} THEN {has(text, w)}" for a, w in S.ACTION_WORDS.items()) + " ELSE true END"


def pattern_kept_sql(text="paraphrase"):
    return "CASE action " + " ".join(
        f"WHEN {q(a)} THEN regexp_matches({text}, {q('(?i)' + p)})" for a, p in S.ACTION_PATTERNS.items()
    ) + " ELSE true END"


@query("fn_action_keywords", sql(pairs_sql(), select=f"SELECT id, {words_kept_sql()} AS words_kept, {pattern_kept_sql()} AS pattern_kept FROM pairs"))
def fn_action_keywords(spark, folder):
    a, p = F.col("action"), F.col("paraphrase")
    return derived.paraphrase_pairs(spark, folder).select(
        "id", S.action_words_kept(a, p).alias("words_kept"), S.action_pattern_kept(a, p).alias("pattern_kept")
    )


RATIO_SQL = "(length(paraphrase)::DOUBLE / greatest(length(original), 1))"
LEN_OK_SQL = f"CASE WHEN length(original) <= 12 THEN {RATIO_SQL} BETWEEN 0.4::DOUBLE AND 4.0::DOUBLE ELSE {RATIO_SQL} BETWEEN 0.5::DOUBLE AND 2.2::DOUBLE END"


@query("fn_len_ratio", sql(pairs_sql(), select=f"SELECT id, round({RATIO_SQL}, 6) AS ratio, {LEN_OK_SQL} AS kept FROM pairs"))
def fn_len_ratio(spark, folder):
    o, p = F.col("original"), F.col("paraphrase")
    return derived.paraphrase_pairs(spark, folder).select(
        "id", rounded(S.length_ratio(o, p)).alias("ratio"), S.length_kept(o, p).alias("kept")
    )


@query("fn_rule_rewrite", sql(pairs_sql(), select=f"SELECT id, {strip_output('drafted.draft')} AS rewrite FROM pairs JOIN drafted USING (doc_id)"))
def fn_rule_rewrite(spark, folder):
    return derived.paraphrase_pairs(spark, folder).select("id", RW.rule_rewrite(F.col("original")).alias("rewrite"))


SIGN_SQL = (
    "sha1('{' || array_to_string(list_filter(["
    "CASE WHEN e.args IS NOT NULL THEN '\"args\":' || " + O.args_json("e.args", ",", ":") + " END,"
    "CASE WHEN e.content IS NOT NULL THEN '\"content\":' || to_json(e.content)::VARCHAR END,"
    "CASE WHEN e.name IS NOT NULL THEN '\"name\":\"' || e.name || '\"' END,"
    "CASE WHEN e.res IS NOT NULL THEN '\"result_summary\":\"' || e.res || '\"' END,"
    "CASE WHEN e.role IS NOT NULL THEN '\"role\":\"' || e.role || '\"' END"
    "], lambda x: x IS NOT NULL), ',') || '}')"
)


@query("fn_event_signature", sql(SESS, select=f"""
SELECT id, i, {SIGN_SQL} AS signature, 'para_' || sha1(id) || '.json' AS cache_name
FROM (SELECT id, unnest(evs) AS e, unnest(range(len(evs))) AS i FROM sess)"""))
def fn_event_signature(spark, folder):
    rows = derived.sessions(spark, folder).select("id", F.posexplode("history").alias("i", "e"))
    return rows.select(
        "id", long(F.col("i")).alias("i"), E.event_signature(F.col("e")).alias("signature"),
        F.concat(F.lit("para_"), F.sha1("id"), F.lit(".json")).alias("cache_name"),
    )


@query("fn_softmax", sql(SCORES, select=f"""
SELECT id, i - 1 AS pos, round(s[i], 6) AS p FROM (SELECT id, {softmax('lc', 0.7)} AS s, unnest(range(1, 11)) AS i FROM
  (SELECT id, list_transform(c, lambda x: ln(x)) AS lc FROM sc))"""))
def fn_softmax(spark, folder):
    s = P.softmax(F.transform("c", lambda x: F.log(x)), 0.7)
    rows = derived.class_scores(spark, folder).select("id", F.posexplode_outer(s).alias("pos", "p"))
    return rows.select("id", long(F.col("pos")).alias("pos"), rounded(F.col("p")).alias("p"))


@query("fn_minmax", sql(SCORES, select="""
SELECT id, i - 1 AS pos, round((a[i] - list_min(a)) / greatest(list_max(a) - list_min(a), 1e-6::DOUBLE), 6) AS p
FROM (SELECT *, unnest(range(1, 11)) AS i FROM sc)"""))
def fn_minmax(spark, folder):
    rows = derived.class_scores(spark, folder).select("id", F.posexplode_outer(P.min_max(F.col("a"))).alias("pos", "p"))
    return rows.select("id", long(F.col("pos")).alias("pos"), rounded(F.col("p")).alias("p"))
