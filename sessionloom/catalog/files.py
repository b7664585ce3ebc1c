"""Sources and sinks: every query writes rows derived from the given tables and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.catalog import oracle_events as O
from sessionloom.catalog.oracle import LBL, SCORES, SESS, pairs_sql, sql
from sessionloom.catalog.quality import _V2
from sessionloom.catalog.registry import query
from sessionloom.functions import events as E
from sessionloom.functions.probs import argmax
from sessionloom.operators import keys, quality
from sessionloom.operators.metrics import rounded
from sessionloom.schema import CLASS_BIAS_AU, CLASS_BIAS_SIM, LABELS
from sessionloom.sources import derived, files
from sessionloom.sources.staging import fresh_path


def _history():
    return F.col("history")


@query("src_jsonl_roundtrip", sql(SESS, O.FEAT, select=f"""
SELECT id, md5(current_prompt) AS prompt_key, len(evs) AS history_len, {O.last_args(180)} AS last_args, lr AS last_result, user_tier, budget, len(mix) AS n_langs,
  len(open_files) AS n_open FROM feat"""))
def src_jsonl_roundtrip(spark, folder):
    path = fresh_path(spark, "sessions") + ".jsonl"
    files.write_sessions(derived.sessions(spark, folder).select("id", "current_prompt", "history", "session_meta"), path)
    ws = F.col("session_meta.workspace")
    return files.read_sessions(spark, path).select(
        "id", F.md5("current_prompt").alias("prompt_key"), F.size("history").cast("long").alias("history_len"),
        E.last_args(_history(), 180).alias("last_args"), E.last_result(_history()).alias("last_result"), "session_meta.user_tier",
        F.col("session_meta.budget_tokens_remaining").alias("budget"),
        F.coalesce(F.size(ws["language_mix"]), F.lit(0)).cast("long").alias("n_langs"),
        F.size(ws["open_files"]).cast("long").alias("n_open"),
    )


def _label_rows(spark, folder):
    rows = derived.sessions(spark, folder).where(F.col("action").isNotNull())
    return rows.select("id", F.when(F.col("row_no") % 41 == 0, "no_such_action").otherwise(F.col("action")).alias("action"))


@query("src_label_domain_check", sql(SESS, f"""
l AS (SELECT CASE WHEN row_no % 41 = 0 THEN 'no_such_action' ELSE action END AS action FROM sess WHERE action IS NOT NULL)
""", select=f"SELECT action, count(*) AS n, list_contains({LBL}, action) AS known FROM l GROUP BY action"))
def src_label_domain_check(spark, folder):
    path = fresh_path(spark, "labels") + ".csv"
    files.write_csv(_label_rows(spark, folder), path)
    return files.label_report(files.read_labels(spark, path, strict=False))


@query("src_infer_label_column", sql(SESS, select="SELECT id, action FROM sess WHERE action IS NOT NULL"))
def src_infer_label_column(spark, folder):
    path = fresh_path(spark, "labels") + ".csv"
    rows = derived.sessions(spark, folder).where(F.col("action").isNotNull())
    files.write_csv(rows.select(F.col("id").alias("sample_id"), F.col("action").alias("what_came_next")), path)
    return files.read_labels(spark, path)


@query("src_manifest_ids", sql(SESS, select="SELECT 'csv' AS kind, id FROM sess UNION ALL SELECT 'jsonl', id FROM sess"))
def src_manifest_ids(spark, folder):
    ids = derived.sessions(spark, folder).select("id")
    csv, jsonl = fresh_path(spark, "ids") + ".csv", fresh_path(spark, "ids") + ".jsonl"
    files.write_csv(ids, csv)
    ids.write.json(jsonl)
    parts = [files.read_ids(spark, p).select(F.lit(k).alias("kind"), "id") for k, p in (("csv", csv), ("jsonl", jsonl))]
    return parts[0].unionByName(parts[1])


BATCHES = 25


def _batches(spark, folder):
    """25 batches of pairs; batch 3n+1 has no second file, batches ending in 8 disagree in one row."""
    pairs = derived.paraphrase_pairs(spark, folder)
    rows = pairs.select(
        (F.col("doc_id") % BATCHES).cast("int").alias("batch"), F.floor(F.col("doc_id") / BATCHES).alias("idx"), "id", "action",
        "original", "paraphrase",
    )
    para = rows.where(F.col("batch") % 3 != 1).withColumn(
        "action", F.when((F.col("batch") % 10 == 8) & (F.col("idx") == 5), "ask_user").otherwise(F.col("action"))
    )
    path = fresh_path(spark, "batches")
    files.write_batches(rows.drop("paraphrase"), path)
    files.write_batches(para, path, "_para")
    return files.read_batches(spark, path)


_VALID = "bool_and(NOT (batch % 10 = 8 AND idx = 5 AND action <> 'ask_user'))"
_BATCH = f"""
bt AS (SELECT *, (doc_id % {BATCHES})::INTEGER AS batch, doc_id // {BATCHES} AS idx FROM pairs),
bv AS (SELECT batch, count(*) AS rows, count(*) FILTER (batch % 3 <> 1) AS para_rows, {_VALID} AS valid FROM bt GROUP BY batch)
"""


@query("src_batch_pairing", sql(pairs_sql(), _BATCH, select="SELECT batch, rows, para_rows, valid FROM bv WHERE para_rows > 0"))
def src_batch_pairing(spark, folder):
    base, para = _batches(spark, folder)
    return quality.batch_verdicts(base, para).where(F.col("para_rows") > 0).select("batch", "rows", "para_rows", "valid")


_ASM = f"""
tp AS (SELECT pairs.* REPLACE (trim(pairs.paraphrase) AS paraphrase) FROM pairs JOIN bt USING (doc_id) JOIN bv ON bv.batch = bt.batch WHERE valid AND para_rows > 0)
"""


@query("paraphrase_assembly", sql(pairs_sql(), _BATCH, _ASM, _V2.replace("FROM pairs", "FROM tp"), select=f"""
SELECT id, (doc_id % {BATCHES})::INTEGER AS batch, qc, qc_reason, CASE WHEN qc = 'OK' THEN paraphrase ELSE original END AS current_prompt FROM q2"""))
def paraphrase_assembly(spark, folder):
    base, para = _batches(spark, folder)
    pairs = derived.paraphrase_pairs(spark, folder)
    source = pairs.select("id", F.col("original").alias("source"))
    checked = quality.assemble(quality.valid_rows(base, para), pairs.select("id", "action"), source)
    return checked.select(
        "id", "batch", "qc", "qc_reason", F.when(F.col("qc") == "OK", F.col("paraphrase")).otherwise(F.col("source")).alias("current_prompt")
    )


def _oof_path(spark, folder):
    scores = derived.class_scores(spark, folder)
    parts = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("proba")) for m in ("a", "b")])
    rows = scores.select(
        "id", keys.root_session(F.col("id")).alias("session"), "fold", F.col("y").alias("y_true"), F.explode_outer(parts).alias("p")
    ).select("id", "session", "fold", "y_true", "p.*")
    path = fresh_path(spark, "oof")
    files.write_oof(rows, path)
    return path


@query("snk_oof_contract", sql(SCORES, select="""
SELECT m.model, fold, count(*) AS rows, count(DISTINCT regexp_replace(id, '-step_[0-9]+$', '')) AS sessions, 0::BIGINT AS duplicate_ids
FROM sc CROSS JOIN (SELECT unnest(['a', 'b']) AS model) m GROUP BY m.model, fold"""))
def snk_oof_contract(spark, folder):
    oof = files.read_oof(spark, _oof_path(spark, folder))
    twice = files.duplicate_ids(oof).groupBy("model").agg(F.count("*").alias("d"))
    shape = oof.groupBy("model", "fold").agg(F.count("*").alias("rows"), F.count_distinct("session").alias("sessions"))
    return shape.join(F.broadcast(twice), "model", "left").select(
        "model", "fold", "rows", "sessions", F.coalesce("d", F.lit(0)).cast("long").alias("duplicate_ids")
    )


@query("src_oof_shard_union", sql(SCORES, select="""
SELECT 'a' AS model, id, fold, y AS y_true, (list_position(a, list_max(a)) - 1)::INTEGER AS pred FROM sc
UNION ALL SELECT 'b', id, fold, y, (list_position(b, list_max(b)) - 1)::INTEGER FROM sc"""))
def src_oof_shard_union(spark, folder):
    oof = files.unique_rows(files.read_oof(spark, _oof_path(spark, folder)))
    return oof.select("model", "id", "fold", "y_true", argmax(F.col("proba")).alias("pred"))


@query("snk_report_json", sql(pairs_sql(), _V2, select="""
SELECT count(*) AS generated, count(*) FILTER (qc = 'OK') AS accepted, count(*) FILTER (qc <> 'OK') AS rejected, round(avg(len_ratio), 6) AS mean_ratio FROM q2"""))
def snk_report_json(spark, folder):
    checked = quality.check_v2(derived.paraphrase_pairs(spark, folder))
    report = checked.agg(
        F.count("*").alias("generated"), F.count_if(F.col("qc") == "OK").alias("accepted"),
        F.count_if(F.col("qc") != "OK").alias("rejected"), rounded(F.avg("len_ratio")).alias("mean_ratio"),
    )
    path = fresh_path(spark, "report")
    files.write_report(report, path)
    return spark.read.schema("generated long, accepted long, rejected long, mean_ratio double").json(path)


@query("src_bias_params", sql(SESS, f"""
b AS (SELECT unnest({LBL}) AS label, unnest([{', '.join(f'{v!r}::DOUBLE' for v in CLASS_BIAS_SIM)}]) AS bias_sim),
c AS (SELECT domain, action AS label, count(*) AS n FROM sess WHERE action IS NOT NULL GROUP BY ALL)
""", select="SELECT domain, label, n, round(CASE WHEN domain = 'sim' THEN bias_sim ELSE 0.0::DOUBLE END, 6) AS bias FROM c JOIN b USING (label)"))
def src_bias_params(spark, folder):
    path = fresh_path(spark, "bias")
    row = [(LABELS, [float(v) for v in CLASS_BIAS_SIM], [float(v) for v in CLASS_BIAS_AU])]
    spark.createDataFrame(row, "labels array<string>, bias_sim array<double>, bias_au array<double>").coalesce(1).write.json(path)
    params = files.read_parameters(spark, path)
    rows = derived.sessions(spark, folder).where(F.col("action").isNotNull())
    counts = rows.groupBy(keys.domain(F.col("id")).alias("domain"), F.col("action").alias("label")).agg(F.count("*").alias("n"))
    # One row per class: small by definition.
    return counts.join(F.broadcast(params), "label").select(
        "domain", "label", "n", rounded(F.when(F.col("domain") == "sim", F.col("bias_sim")).otherwise(F.col("bias_au"))).alias("bias")
    )
