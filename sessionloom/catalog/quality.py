"""Paraphrase checks, history mining and content audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.catalog.oracle import AUDIT, LBL, SESS, arr, collapse, pairs_sql, sql
from sessionloom.catalog.registry import query
from sessionloom.catalog.scalars import (
    LEN_OK_SQL, RATIO_SQL, SIGN_SQL, _FILE_RX, _TICK_RX, kept_sql, masked_sentences_sql, pattern_kept_sql, protected_sentences_sql, words_kept_sql,
)
from sessionloom.functions import scalars as S
from sessionloom.operators import audit, mining, quality
from sessionloom.sources import derived
from sessionloom.sources.staging import stage

# --- paraphrase checks --------------------------------------------------------------

_V2 = f"""
q0 AS (
  SELECT *, len(list_filter({arr(S.DEIXIS)}, lambda t: contains(original, t) AND NOT contains(paraphrase, t))) = 0 AS deixis_kept,
    {kept_sql(_FILE_RX)} AS filetok_kept, {kept_sql(_TICK_RX, 1)} AS backtick_kept,
    regexp_matches(original, '[가-힣]') = regexp_matches(paraphrase, '[가-힣]') AS lang_kept, {pattern_kept_sql()} AS action_kept,
    {RATIO_SQL} AS len_ratio FROM pairs),
q1 AS (SELECT *, list_filter([
    CASE WHEN trim(regexp_replace(paraphrase, '\\s', '', 'g')) = '' THEN 'empty' END, CASE WHEN paraphrase = original THEN 'same_text' END,
    CASE WHEN regexp_matches(paraphrase, '[\\n\\r\\t]') THEN 'control_char' END, CASE WHEN NOT deixis_kept THEN 'deixis_lost' END,
    CASE WHEN NOT filetok_kept THEN 'filetok_lost' END, CASE WHEN NOT backtick_kept THEN 'backtick_lost' END,
    CASE WHEN NOT lang_kept THEN 'lang_mismatch' END, CASE WHEN NOT ({LEN_OK_SQL}) THEN 'len_ratio' END,
    CASE WHEN {masked_sentences_sql('paraphrase')} > 3 THEN 'too_many_sentences' END], lambda x: x IS NOT NULL) AS hard FROM q0),
q2 AS (SELECT *, CASE WHEN len(hard) = 0 THEN 'OK' ELSE 'REJECT' END AS qc,
    coalesce(nullif(array_to_string(list_concat(hard, CASE WHEN action_kept THEN []::VARCHAR[] ELSE ['action_risk'] END), '|'), ''), 'OK') AS qc_reason FROM q1)
"""


@query("qc_paraphrase_v2", sql(pairs_sql(), _V2, select="""
SELECT id, action, qc, qc_reason, round(len_ratio, 4) AS len_ratio, deixis_kept, filetok_kept, backtick_kept, lang_kept, action_kept FROM q2"""))
def qc_paraphrase_v2(spark, folder):
    return quality.check_v2(derived.paraphrase_pairs(spark, folder)).select(
        "id", "action", "qc", "qc_reason", F.round("len_ratio", 4).alias("len_ratio"), "deixis_kept", "filetok_kept",
        "backtick_kept", "lang_kept", "action_kept",
    )


_O, _P = collapse("original"), collapse("paraphrase")


def _lost(tokens):
    return f"list_filter({tokens}, lambda t: NOT contains(p, t))"


_V1 = f"""
r0 AS (SELECT id, action, {_O} AS o, {_P} AS p FROM pairs),
r1 AS (SELECT *, {_lost(f"list_filter({arr(S.DEIXIS)}, lambda t: contains(o, t))")} AS ld,
    {_lost(f"list_sort(list_distinct(regexp_extract_all(o, {_FILE_RX})))")} AS lf,
    {_lost(f"list_sort(list_distinct(regexp_extract_all(o, {_TICK_RX}, 1)))")} AS lt,
    {protected_sentences_sql('p')} AS ns,
    length(p)::DOUBLE / greatest(length(o), 1) AS ratio FROM r0),
r2 AS (SELECT *, {words_kept_sql('p')} AS ak, list_filter([
    CASE WHEN lower(o) = lower(p) THEN 'same_text' END,
    CASE WHEN NOT CASE WHEN length(o) <= 12 THEN ratio BETWEEN 0.4::DOUBLE AND 4.0::DOUBLE ELSE ratio BETWEEN 0.5::DOUBLE AND 2.2::DOUBLE END THEN 'len_ratio' END,
    CASE WHEN regexp_matches(o, '[가-힣]') <> regexp_matches(p, '[가-힣]') THEN 'language_mismatch' END,
    CASE WHEN len(ld) > 0 THEN 'missing_deixis:' || array_to_string(ld, '|') END,
    CASE WHEN len(lf) > 0 THEN 'missing_filetok:' || array_to_string(lf, '|') END,
    CASE WHEN len(lt) > 0 THEN 'missing_backtick:' || array_to_string(lt, '|') END,
    CASE WHEN ns > 3 THEN 'too_many_sentences' END], lambda x: x IS NOT NULL) AS hard FROM r1),
r3 AS (SELECT *, CASE WHEN p <> '' AND len(hard) = 0 THEN 'OK' ELSE 'FAIL' END AS qc, CASE WHEN p = '' THEN 'empty' ELSE
    coalesce(nullif(array_to_string(list_concat(hard, CASE WHEN ak THEN []::VARCHAR[] ELSE ['action_risk'] END), ';'), ''), 'OK') END AS qc_reason FROM r2)
"""


@query("qc_paraphrase_v1", sql(pairs_sql(), _V1, select="""
SELECT id, action, qc, qc_reason, round(CASE WHEN p = '' THEN 0.0::DOUBLE ELSE ratio END, 4) AS len_ratio, p <> '' AND len(ld) = 0 AS deixis_kept,
  p <> '' AND len(lf) = 0 AS filetok_kept, p <> '' AND len(lt) = 0 AS backtick_kept, p <> '' AND ak AS action_kept,
  (CASE WHEN p = '' THEN 0 ELSE ns END)::INTEGER AS sentence_count FROM r3"""))
def qc_paraphrase_v1(spark, folder):
    return quality.check_v1(derived.paraphrase_pairs(spark, folder)).select(
        "id", "action", "qc", "qc_reason", F.round("len_ratio", 4).alias("len_ratio"), "deixis_kept", "filetok_kept",
        "backtick_kept", "action_kept", "sentence_count",
    )


def _report_sql(cte, reasons):
    return f"""
SELECT 'all' AS section, 'generated' AS name, count(*) AS n FROM {cte}
UNION ALL SELECT 'all', CASE WHEN qc = 'OK' THEN 'accepted' ELSE 'rejected' END, count(*) FROM {cte} GROUP BY ALL
UNION ALL SELECT CASE WHEN qc = 'OK' THEN 'accepted_action' ELSE 'rejected_action' END, action, count(*) FROM {cte} GROUP BY ALL
UNION ALL SELECT 'reject_reason', r, count(*) FROM (SELECT unnest({reasons}) AS r FROM {cte} WHERE qc <> 'OK') GROUP BY ALL"""


@query("agg_qc_report", sql(pairs_sql(), _V2, select=_report_sql("q2", "hard")))
def agg_qc_report(spark, folder):
    return quality.report(quality.check_v2(derived.paraphrase_pairs(spark, folder)), whole_reason=False)


@query("agg_qc_report_whole", sql(pairs_sql(), _V1, select=_report_sql("r3", "[qc_reason]")))
def agg_qc_report_whole(spark, folder):
    return quality.report(quality.check_v1(derived.paraphrase_pairs(spark, folder)), whole_reason=True)


def _merge_inputs(spark, folder):
    """First run over even ids with the raw paraphrase, second run over the rest and every fourth id again."""
    pairs = derived.paraphrase_pairs(spark, folder).withColumn("row_no", F.col("doc_id"))
    first = quality.check_v2(pairs.where(F.col("doc_id") % 2 == 0))
    again = pairs.where((F.col("doc_id") % 2 == 1) | (F.col("doc_id") % 4 == 0)).withColumn(
        "paraphrase", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("please "), "original")).otherwise(F.col("paraphrase"))
    )
    return pairs, first, quality.check_v2(again)


_MERGE = f"""
p1 AS (SELECT * FROM pairs),
again AS (SELECT * REPLACE (CASE WHEN doc_id % 4 = 0 THEN 'please ' || original ELSE paraphrase END AS paraphrase) FROM p1)
"""


def _v2_on(src, prefix):
    return _V2.replace("FROM pairs", f"FROM {src}").replace("q0", f"{prefix}0").replace("q1", f"{prefix}1").replace("q2", f"{prefix}2")


@query("merge_resume_upsert", sql(pairs_sql(), _MERGE, _v2_on("p1", "fa"), _v2_on("again", "fb"), select="""
SELECT doc_id AS row_no, id, 'review' AS kind, qc, qc_reason FROM fa2 WHERE doc_id % 2 = 0 AND doc_id % 4 <> 0
UNION ALL SELECT doc_id, id, 'review', qc, qc_reason FROM fb2 WHERE doc_id % 2 = 1 OR doc_id % 4 = 0
UNION ALL SELECT doc_id, id, 'accepted', 'OK', paraphrase FROM fa2 WHERE doc_id % 2 = 0 AND doc_id % 4 <> 0 AND qc = 'OK'
UNION ALL SELECT doc_id, id, 'accepted', 'OK', paraphrase FROM fb2 WHERE (doc_id % 2 = 1 OR doc_id % 4 = 0) AND qc = 'OK'"""))
def merge_resume_upsert(spark, folder):
    source, first, second = _merge_inputs(spark, folder)
    # Reviews and accepted rows both read the checks, which cost far more than writing their outcome once.
    first, second = (stage(df.select("id", "qc", "qc_reason", "paraphrase"), "merge-checked") for df in (first, second))
    accepted = first.where(F.col("qc") == "OK").select("id", "paraphrase")
    review = first.select("id", "qc", "qc_reason", "paraphrase")
    kept, reviews = quality.merge_resume(accepted, review, second, source)
    return reviews.select("row_no", "id", F.lit("review").alias("kind"), "qc", "qc_reason").unionByName(
        kept.select("row_no", "id", F.lit("accepted").alias("kind"), F.lit("OK").alias("qc"), F.col("paraphrase").alias("qc_reason"))
    )


# --- history mining -----------------------------------------------------------------

_KNOWN = "known AS (SELECT id, action FROM sess WHERE action IS NOT NULL AND row_no // 1000000 % 3 = 0)"
# Every session also appears once more with its last event renamed, to raise conflicts on some roots.
_WALK = f"""
ms AS (
  SELECT id, root, row_no * 2 AS row_no, evs, user_tier, language_pref FROM sess
  UNION ALL
  SELECT id, root, row_no * 2 + 1, list_transform(evs, lambda e, i: CASE WHEN e.name IS NOT NULL AND i = len(evs) THEN struct_update(e, name := 'web_search') ELSE e END),
    user_tier, language_pref FROM sess WHERE row_no // 1000000 % 7 = 0),
fl AS (SELECT id, root, row_no, evs, len(evs) AS win, unnest(evs) AS e, unnest(range(len(evs))) AS i FROM ms),
mk AS (SELECT *, e.role = 'user' AND trim(coalesce(e.content, '')) <> '' AS speaks,
  NOT (e.role = 'user' AND trim(coalesce(e.content, '')) <> '') AND coalesce(list_contains({LBL}, e.name), false) AS acts FROM fl),
rn AS (SELECT *, count(*) FILTER (acts) OVER (PARTITION BY row_no ORDER BY i) AS step,
  max(CASE WHEN speaks THEN i END) OVER (PARTITION BY row_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lu,
  max(CASE WHEN acts THEN i END) OVER (PARTITION BY row_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS la FROM mk),
obs AS (SELECT id AS source_id, row_no, root, win, step, lu AS user_at, i AS "at", trim(evs[lu + 1].content) AS prompt, e.name AS action, {SIGN_SQL} AS sig
  FROM rn WHERE acts AND lu IS NOT NULL AND (la IS NULL OR lu > la))
"""


def _mining_rows(spark, folder):
    rows = derived.sessions(spark, folder)
    conv = F.floor(F.col("row_no") / 1000000)
    rows = rows.withColumn("row_no", F.col("row_no") * 2)
    renamed = F.transform(
        "history",
        lambda e, i: F.when(
            e["name"].isNotNull() & (i == F.size("history") - 1),
            F.struct(e["role"].alias("role"), e["content"].alias("content"), F.lit("web_search").alias("name"),
                     e["args"].alias("args"), e["result_summary"].alias("result_summary")),
        ).otherwise(e),
    )
    twins = derived.sessions(spark, folder).where(conv % 7 == 0).withColumn("history", renamed).withColumn(
        "row_no", F.col("row_no") * 2 + 1
    )
    return rows.unionByName(twins)


def _known(spark, folder):
    rows = derived.sessions(spark, folder)
    return rows.where(F.col("action").isNotNull() & (F.floor(F.col("row_no") / 1000000) % 3 == 0)).select("id", "action")


@query("seq_history_pairs", sql(SESS, _WALK, select="""
SELECT source_id, row_no, step::INTEGER AS step, user_at::INTEGER AS user_at, obs."at"::INTEGER AS source_event_index, prompt, action, sig AS signature FROM obs"""))
def seq_history_pairs(spark, folder):
    return mining.observations(_mining_rows(spark, folder)).select(
        "source_id", "row_no", "step", "user_at", "source_event_index", "prompt", "action",
        F.col("source_event_signature").alias("signature"),
    )


_CONS = """
gk AS (SELECT root, step, root || '-step_' || printf('%02d', step) AS id, count(*) AS observed, count(DISTINCT action) AS na, count(DISTINCT prompt) AS np,
  min(action) AS action, min(prompt) AS prompt FROM obs GROUP BY root, step),
bo AS (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY root, step ORDER BY win, row_no) = 1),
cons AS (SELECT gk.*, known.action AS known, CASE WHEN na > 1 OR np > 1 THEN 'conflict' WHEN known.action IS NULL THEN 'mined'
  WHEN known.action = gk.action THEN 'overlap' ELSE 'mismatch' END AS verdict FROM gk LEFT JOIN known USING (id))
"""


@query("agg_mined_pairs", sql(SESS, _KNOWN, _WALK, _CONS, select="""
SELECT id, step::INTEGER AS step, action, observed, known, verdict FROM cons"""))
def agg_mined_pairs(spark, folder):
    cons = mining.consolidate(mining.observations(_mining_rows(spark, folder)), _known(spark, folder))
    return cons.select("id", "step", "action", "observed", "known", "verdict")


_MREPORT = """
SELECT (SELECT count(*) FROM ms) AS source_rows, count(*) AS candidate_keys, count(*) FILTER (verdict = 'mined') AS mined_rows,
  count(*) FILTER (verdict IN ('conflict', 'mismatch')) AS conflict_keys, count(*) FILTER (verdict = 'conflict') AS label_or_prompt_conflicts,
  count(*) FILTER (verdict IN ('overlap', 'mismatch')) AS overlap_checked, count(*) FILTER (verdict = 'mismatch') AS overlap_mismatches FROM cons"""


@query("agg_mining_report", sql(SESS, _KNOWN, _WALK, _CONS, select=_MREPORT))
def agg_mining_report(spark, folder):
    rows = _mining_rows(spark, folder)
    return mining.mining_report(mining.consolidate(mining.observations(rows), _known(spark, folder)), rows)


@query("history_mining", sql(SESS, _KNOWN, _WALK, _CONS, select="""
SELECT cons.id, cons.prompt AS current_prompt, bo.user_at::INTEGER AS history_len, sess.user_tier, sess.language_pref, bo.source_id,
  bo."at"::INTEGER AS source_event_index, bo.sig AS signature, cons.action
FROM cons JOIN bo ON bo.root = cons.root AND bo.step = cons.step JOIN sess ON sess.id = bo.source_id WHERE verdict = 'mined'"""))
def history_mining(spark, folder):
    rows = _mining_rows(spark, folder)
    cons = mining.consolidate(mining.observations(rows), _known(spark, folder))
    return mining.mined_rows(cons, rows).select(
        "id", "current_prompt", F.size("history").alias("history_len"), "session_meta.user_tier", "session_meta.language_pref",
        "mining_meta.source_id", "mining_meta.source_event_index", F.col("mining_meta.source_event_signature").alias("signature"),
        "action",
    )


# --- content audit ------------------------------------------------------------------

MAX_BYTES = 20000


@query("audit_text_content", sql(AUDIT, r"""
hits AS (
  SELECT doc_id, unnest(list_filter([
    CASE WHEN octet_length(encode(text)) > 20000 THEN 'large file' END, CASE WHEN NOT json_valid(payload) THEN 'invalid JSON' END,
    CASE WHEN regexp_matches(text, '(?i)(?:[A-Za-z]:[\\/](?:Users|home)[\\/][^\\/\s]+|/home/[^/\s]+|/Users/[^/\s]+)') THEN 'personal absolute path' END,
    CASE WHEN regexp_matches(text, '(?:^|[^A-Za-z])[A-Za-z]:[\\/]') THEN 'machine-specific drive path' END,
    CASE WHEN regexp_matches(text, 'gh[opsu]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,}|AKIA[0-9A-Z]{16}') THEN 'possible secret token' END],
    lambda x: x IS NOT NULL)) AS problem FROM aud)
""", select="SELECT doc_id, problem FROM hits"))
def audit_text_content(spark, folder):
    return audit.audit(derived.audit_rows(spark, folder), MAX_BYTES)
