"""Aggregations and metrics over the class scores and the session tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.catalog.oracle import BLEND, GROUP_CASE, LBL, SCORES, SESS, STEPS, TEXTS, arr, f1_ctes, sql
from sessionloom.catalog.registry import query
from sessionloom.functions.probs import argmax, mix, scale
from sessionloom.operators import aggregates, calibration, keys, metrics
from sessionloom.schema import LABELS, doubles, strings
from sessionloom.sources import derived
from sessionloom.sources.staging import stage

K = derived.CLASSES
# Class indexes 0..9 stand for the first ten actions; these are the inspect ones.
INSPECT = [i for i, label in enumerate(LABELS[:K]) if label in ("glob_pattern", "grep_search", "list_directory", "read_file")]
PAIRS = [("read_file", "grep_search"), ("grep_search", "read_file"),
         ("glob_pattern", "list_directory"), ("list_directory", "glob_pattern")]


def decided(spark, folder):
    return calibration.decide(derived.class_scores(spark, folder), K)


def classes_frame(spark, name="y", n=K):
    return spark.range(n).select(F.col("id").cast("int").alias(name))


_BAND = ("CASE WHEN step <= 1 THEN 's1' WHEN step <= 3 THEN 's2_3' WHEN step <= 6 THEN 's4_6' "
         "WHEN step <= 10 THEN 's7_10' ELSE 's11p' END")


@query("agg_label_counts", sql(SESS, select="""
SELECT domain, action AS label, count(*) AS n FROM sess WHERE action IS NOT NULL GROUP BY ALL"""))
def agg_label_counts(spark, folder):
    rows = derived.sessions(spark, folder).where(F.col("action").isNotNull())
    return aggregates.label_counts(
        rows.select(keys.domain(F.col("id")).alias("domain"), F.col("action").alias("label")), "domain", "label"
    )


@query("agg_confusion_matrix", sql(SCORES, BLEND, select=f"""
SELECT k.y, {', '.join(f"count(*) FILTER (bl.base = {i}) AS p{i}" for i in range(K))}
FROM (SELECT unnest(range({K}))::INTEGER AS y) k LEFT JOIN bl USING (y) GROUP BY k.y"""))
def agg_confusion_matrix(spark, folder):
    conf = metrics.confusion(decided(spark, folder), pred="base")
    return aggregates.confusion_table(conf, K, classes_frame(spark))


_CONF = "conf AS (SELECT y, base AS pred, count(*) AS n FROM bl GROUP BY ALL)"


@query("agg_class_report", sql(SCORES, BLEND, _CONF, f1_ctes("conf", []), f"""
per AS (
  SELECT k.label, coalesce(CASE WHEN np > 0 THEN tp / np END, 0.0::DOUBLE) AS precision,
    coalesce(CASE WHEN nt > 0 THEN tp / nt END, 0.0::DOUBLE) AS recall, coalesce(f, 0.0::DOUBLE) AS f1,
    coalesce(nt, 0)::BIGINT AS support, coalesce(tp, 0) AS tp
  FROM (SELECT unnest(range({K}))::INTEGER AS label) k LEFT JOIN f1 USING (label))
""", select="""
SELECT label::VARCHAR AS label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM per
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM per
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM per
UNION ALL SELECT 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), sum(support)::BIGINT FROM per"""))
def agg_class_report(spark, folder):
    conf = metrics.confusion(decided(spark, folder), pred="base")
    named = conf.select(F.col("y").cast("string").alias("y"), F.col("pred").cast("string").alias("pred"), "n")
    return metrics.class_report(named, classes_frame(spark, "label").select(F.col("label").cast("string").alias("label")))


_CONF_FS = "conf AS (SELECT fold, step, y, base AS pred, count(*) AS n FROM bl GROUP BY ALL)"


@query("agg_macro_f1_all", sql(SCORES, BLEND, _CONF_FS, f1_ctes("conf", ["fold", "step"]), select=f"""
SELECT fold, step, sum(nt)::BIGINT AS rows, round(sum(tp) / sum(nt), 6) AS accuracy, round(sum(f) / {K}.0::DOUBLE, 6) AS macro_f1
FROM f1 GROUP BY fold, step"""))
def agg_macro_f1_all(spark, folder):
    conf = metrics.confusion(decided(spark, folder), ["fold", "step"], pred="base")
    return metrics.scores(conf, ["fold", "step"], classes=K)


@query("agg_macro_f1_seen", sql(SCORES, BLEND, _CONF_FS, f1_ctes("conf", ["fold", "step"]), select="""
SELECT fold, step, sum(nt)::BIGINT AS rows, round(sum(tp) / sum(nt), 6) AS accuracy, round(avg(f), 6) AS macro_f1
FROM f1 GROUP BY fold, step"""))
def agg_macro_f1_seen(spark, folder):
    conf = metrics.confusion(decided(spark, folder), ["fold", "step"], pred="base")
    return metrics.scores(conf, ["fold", "step"])


@query("agg_accuracy", sql(SCORES, BLEND, select="""
SELECT domain, fold, round(avg(CASE WHEN y = base THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy FROM bl GROUP BY domain, fold"""))
def agg_accuracy(spark, folder):
    return decided(spark, folder).groupBy("domain", "fold").agg(
        metrics.rounded(F.avg((F.col("y") == F.col("base")).cast("double"))).alias("accuracy")
    )


@query("agg_subset_metrics", sql(SCORES, BLEND, f"""
named AS (
  SELECT y, base AS pred, unnest(['src=' || domain, 'step_group=' || ({_BAND}),
    CASE WHEN step <> 1 THEN 'step!=1' END, CASE WHEN y IN ({', '.join(map(str, INSPECT))}) THEN 'true_inspect4' END,
    CASE WHEN y IN ({', '.join(map(str, INSPECT))}) AND step BETWEEN 1 AND 6 THEN 'inspect_step=' || step END]) AS subset FROM bl),
conf AS (SELECT subset, y, pred, count(*) AS n FROM named WHERE subset IS NOT NULL GROUP BY ALL)
""", f1_ctes("conf", ["subset"]), select=f"""
SELECT subset, sum(nt)::BIGINT AS rows,
  round(sum(CASE WHEN NOT contains(subset, 'inspect') OR label IN ({', '.join(map(str, INSPECT))}) THEN f END)
    / CASE WHEN contains(subset, 'inspect') THEN {len(INSPECT)}.0::DOUBLE ELSE {K}.0::DOUBLE END, 6) AS macro_f1,
  round(sum(tp) / sum(nt), 6) AS accuracy
FROM f1 GROUP BY subset"""))
def agg_subset_metrics(spark, folder):
    rows = decided(spark, folder).select(
        "domain", "step", keys.step_band(F.col("step")).alias("step_group"), "y", F.col("base").alias("pred")
    )
    return aggregates.subset_metrics(rows, K, INSPECT)


def _pair_cols_sql():
    return ", ".join(
        f"count(*) FILTER (y = {LABELS.index(s)} AND base = {LABELS.index(d)}) AS {s}_to_{d}" for s, d in PAIRS
    )


@query("agg_confusion_pairs", sql(SCORES, BLEND, select=f"SELECT domain, {_pair_cols_sql()} FROM bl GROUP BY domain"))
def agg_confusion_pairs(spark, folder):
    return decided(spark, folder).groupBy("domain").agg(*[
        F.count_if((F.col("y") == LABELS.index(s)) & (F.col("base") == LABELS.index(d))).alias(f"{s}_to_{d}")
        for s, d in PAIRS
    ])


def _epoch_sql(e):
    w = e / 5
    return (f"SELECT fold, {e} AS epoch, y, (list_position(m, list_max(m)) - 1) AS pred FROM (SELECT fold, y, "
            f"list_transform(range(1, 11), lambda i: {1 - w!r}::DOUBLE * a[i] + {w!r}::DOUBLE * b[i]) AS m FROM sc)")


@query("agg_epoch_summary", sql(SCORES, f"""
runs AS ({' UNION ALL '.join(_epoch_sql(e) for e in range(1, 5))}),
conf AS (SELECT fold, epoch, y, pred, count(*) AS n FROM runs GROUP BY ALL)
""", f1_ctes("conf", ["fold", "epoch"]), f"""
pf AS (SELECT fold, epoch, sum(f) / {K}.0::DOUBLE AS score FROM f1 GROUP BY fold, epoch),
es AS (SELECT epoch, avg(score) AS mean, stddev_samp(score) AS std, min(score) AS low, max(score) AS high FROM pf GROUP BY epoch),
fb AS (SELECT avg(s) AS fm, stddev_pop(s) AS fs FROM (SELECT fold, max(score) AS s FROM pf GROUP BY fold))
""", select="""
SELECT epoch, round(mean, 6) AS mean, round(std, 6) AS std, round(low, 6) AS low, round(high, 6) AS high,
  epoch = (SELECT epoch FROM es ORDER BY mean DESC, epoch LIMIT 1) AS is_best,
  round(fm, 6) AS best_by_fold_mean, round(fs, 6) AS best_by_fold_std
FROM es CROSS JOIN fb"""))
def agg_epoch_summary(spark, folder):
    scores = derived.class_scores(spark, folder)
    preds = F.array(*[
        F.struct(F.lit(e).alias("epoch"), argmax(mix(F.col("a"), F.col("b"), 1 - e / 5, e / 5)).alias("pred"))
        for e in range(1, 5)
    ])
    runs = scores.select("fold", "y", F.explode_outer(preds).alias("p")).select("fold", "y", "p.*")
    per = metrics.per_class(metrics.confusion(runs, ["fold", "epoch"]), ["fold", "epoch"])
    per_fold = per.groupBy("fold", "epoch").agg((F.sum("f") / F.lit(float(K))).alias("score"))
    return aggregates.epoch_summary(per_fold)


SHRINKS = [0.0, 0.5, 1.0]


def _shrink_sql(s):
    return (f"SELECT fold, {s!r}::DOUBLE AS shrink, y, (list_position(m, list_max(m)) - 1) AS pred FROM (SELECT fold, y, "
            f"list_transform(raw, lambda x, i: ln(least(greatest(x, 1e-9::DOUBLE), 1.0::DOUBLE)) + {s!r}::DOUBLE * ({arr(derived_bias())})[i]) AS m FROM bl)")


def derived_bias():
    from sessionloom.schema import CLASS_BIAS_SIM

    return CLASS_BIAS_SIM[:K]


def delta_sql(conf, base, params):
    """Scores against a baseline per parameter: the SQL twin of fold_deltas."""
    p = ", ".join(params)
    return (
        f1_ctes(conf, [*params, "fold"], "pf1") + ",\n" + f1_ctes(base, ["fold"], "bf1") + f""",
{conf}_all AS (SELECT {p}, y, pred, sum(n) AS n FROM {conf} GROUP BY ALL),
{base}_all AS (SELECT y, pred, sum(n) AS n FROM {base} GROUP BY ALL),
""" + f1_ctes(f"{conf}_all", params, "pall") + ",\n" + f1_ctes(f"{base}_all", [], "ball") + f""",
sfold AS (SELECT {p}, fold, avg(f) AS s FROM pf1 GROUP BY ALL),
sbase AS (SELECT fold, avg(f) AS b FROM bf1 GROUP BY fold),
dl AS (SELECT {p}, count(*) FILTER (s - b > 1e-12::DOUBLE) AS positive_folds, round(avg(s - b), 6) AS mean_fold_delta,
         round(min(s - b), 6) AS min_fold_delta FROM sfold JOIN sbase USING (fold) GROUP BY {p}),
ov AS (SELECT {p}, avg(f) AS m, sum(tp) / sum(nt) AS acc FROM pall GROUP BY {p}),
res AS (SELECT {', '.join('ov.' + x for x in params)}, round(m, 6) AS macro_f1, round(m - (SELECT avg(f) FROM ball), 6) AS delta_macro_f1,
          round(acc, 6) AS accuracy, positive_folds, mean_fold_delta, min_fold_delta FROM ov JOIN dl USING ({p}))
""")


@query("agg_fold_delta", sql(SCORES, BLEND, f"""
runs AS ({' UNION ALL '.join(_shrink_sql(s) for s in SHRINKS)}),
cf AS (SELECT shrink, fold, y, pred, count(*) AS n FROM runs GROUP BY ALL),
bs AS (SELECT fold, y, pr AS pred, count(*) AS n FROM bl GROUP BY ALL)
""", delta_sql("cf", "bs", ["shrink"]), select="SELECT * FROM res"))
def agg_fold_delta(spark, folder):
    rows = decided(spark, folder)
    bias = doubles(derived_bias())
    preds = F.array(*[
        F.struct(
            F.lit(s).alias("shrink"),
            argmax(calibration.biased(F.col("raw"), scale(bias, s))).alias("pred"),
        )
        for s in SHRINKS
    ])
    runs = rows.select("fold", "y", F.explode_outer(preds).alias("p")).select("fold", "y", "p.*")
    return calibration.fold_deltas(
        metrics.confusion(runs, ["shrink", "fold"]), ["shrink"], metrics.confusion(rows, ["fold"], pred="pr")
    )


@query("agg_majority_baseline", sql(STEPS, """
c AS (SELECT fold, action AS y, count(*) AS n FROM ev GROUP BY ALL),
held AS (SELECT f.fold, k.y, coalesce(sum(c.n), 0) AS m FROM (SELECT DISTINCT fold FROM c) f CROSS JOIN (SELECT DISTINCT y FROM c) k
  LEFT JOIN c ON c.y = k.y AND c.fold <> f.fold GROUP BY ALL),
mj AS (SELECT fold, y AS pred FROM held QUALIFY row_number() OVER (PARTITION BY fold ORDER BY m DESC, y) = 1),
conf AS (SELECT c.fold, c.y, mj.pred, c.n FROM c JOIN mj USING (fold))
""", f1_ctes("conf", ["fold"]), select="""
SELECT f1.fold, any_value(mj.pred) AS majority, sum(nt)::BIGINT AS rows, round(avg(f), 6) AS valid_macro_majority
FROM f1 JOIN mj ON mj.fold = f1.fold GROUP BY f1.fold"""))
def agg_majority_baseline(spark, folder):
    return aggregates.majority_baseline(derived.event_steps(spark, folder).withColumnRenamed("action", "label"))


@query("agg_fold_balance", sql(STEPS, """
t AS (SELECT count(*) AS r, count(DISTINCT root) AS s FROM ev)
""", select="""
SELECT fold, any_value(t.r) - count(*) AS train_rows, count(*) AS valid_rows,
  any_value(t.s) - count(DISTINCT root) AS train_sessions, count(DISTINCT root) AS valid_sessions
FROM ev CROSS JOIN t GROUP BY fold"""))
def agg_fold_balance(spark, folder):
    return aggregates.fold_balance(derived.event_steps(spark, folder))


_GRP10 = f"(list_transform({LBL}, lambda l: {GROUP_CASE('l')}))"


@query("agg_group_metrics", sql(SCORES, BLEND, f"""
g AS (SELECT {_GRP10}[y + 1] AS y, {_GRP10}[base + 1] AS pred, {LBL}[y + 1] AS ly, {LBL}[base + 1] AS lp FROM bl),
conf AS (
  SELECT 'groups' AS stage, y, pred, count(*) AS n FROM g GROUP BY ALL
  UNION ALL
  SELECT 'respond', CASE WHEN ly = 'respond_only' THEN ly ELSE 'not_respond_only' END,
    CASE WHEN lp = 'respond_only' THEN lp ELSE 'not_respond_only' END, count(*) FROM g WHERE y = 'reason' GROUP BY ALL)
""", f1_ctes("conf", ["stage"]), select="""
SELECT stage, sum(nt)::BIGINT AS rows, round(sum(tp) / sum(nt), 6) AS accuracy, round(avg(f), 6) AS macro_f1 FROM f1 GROUP BY stage"""))
def agg_group_metrics(spark, folder):
    conf = stage(metrics.confusion(decided(spark, folder), pred="base"), "confusion").select(
        keys.decode_label(F.col("y")).alias("ly"), keys.decode_label(F.col("pred")).alias("lp"), "n"
    )
    group = keys.action_group
    respond = lambda c: F.when(c == "respond_only", c).otherwise("not_respond_only")
    groups = conf.select(F.lit("groups").alias("stage"), group(F.col("ly")).alias("y"), group(F.col("lp")).alias("pred"), "n")
    reason = conf.where(group(F.col("ly")) == "reason").select(
        F.lit("respond").alias("stage"), respond(F.col("ly")).alias("y"), respond(F.col("lp")).alias("pred"), "n"
    )
    both = groups.unionByName(reason).groupBy("stage", "y", "pred").agg(F.sum("n").alias("n"))
    return metrics.scores(both, ["stage"])


@query("agg_changed_rows", sql(SCORES, BLEND, select="""
SELECT domain, count(*) AS rows, count(*) FILTER (base <> pr) AS changed_by_bias, count(*) FILTER (pa <> pb) AS disagree FROM bl GROUP BY domain"""))
def agg_changed_rows(spark, folder):
    return decided(spark, folder).groupBy("domain").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("base") != F.col("pr")).alias("changed_by_bias"),
        F.count_if(F.col("pa") != F.col("pb")).alias("disagree"),
    )


@query("agg_class_weights", sql(SESS, f"""
k AS (SELECT unnest({LBL}) AS label),
c AS (SELECT action AS label, count(*) AS n FROM sess WHERE action IS NOT NULL GROUP BY ALL),
j AS (SELECT label, coalesce(n, 0) AS n FROM k LEFT JOIN c USING (label)),
w AS (SELECT label, n, sum(n) OVER () / greatest(n, 1)::DOUBLE / 14.0::DOUBLE AS w FROM j)
""", select="""
SELECT 'clip_0.6_2.0' AS rule, label, n, round(least(greatest(w, 0.6::DOUBLE), 2.0::DOUBLE), 6) AS weight FROM w
UNION ALL SELECT 'clip_1/3_3', label, n, round(least(greatest(w, 1.0::DOUBLE / 3.0::DOUBLE), 3.0::DOUBLE), 6) FROM w"""))
def agg_class_weights(spark, folder):
    rows = derived.sessions(spark, folder).where(F.col("action").isNotNull()).select(F.col("action").alias("label"))
    labels = spark.range(1).select(F.explode_outer(strings(LABELS)).alias("label"))
    fixed = aggregates.class_weights(rows, labels, 0.6, 2.0).withColumn("rule", F.lit("clip_0.6_2.0"))
    ratio = aggregates.class_weights(rows, labels, 1.0 / 3.0, 3.0).withColumn("rule", F.lit("clip_1/3_3"))
    return fixed.unionByName(ratio)


@query("audit_root_single_fold", sql(TEXTS, """
r AS (SELECT root, min(fold) AS a, max(fold) AS b, min(doc_id % 5) AS c, max(doc_id % 5) AS d FROM txt GROUP BY root)
""", select="""
SELECT 'by_root' AS assignment, count(*) AS roots, count(*) FILTER (a <> b) AS split_roots FROM r
UNION ALL SELECT 'by_row', count(*), count(*) FILTER (c <> d) FROM r"""))
def audit_root_single_fold(spark, folder):
    rows = derived.text_rows(spark, folder).withColumn("row_fold", F.col("doc_id") % 5)
    good = aggregates.split_roots(rows, "fold").withColumn("assignment", F.lit("by_root"))
    return good.unionByName(aggregates.split_roots(rows, "row_fold").withColumn("assignment", F.lit("by_row")))


@query("agg_run_manifest", sql(STEPS, """
c AS (SELECT action AS label, count(*) AS n FROM ev GROUP BY ALL)
""", select="""
SELECT (SELECT count(*) FROM ev) AS n_rows, (SELECT count(DISTINCT root) FROM ev) AS n_sessions, (SELECT count(DISTINCT fold) FROM ev) AS n_folds,
  count(*) AS n_classes, 'user_mod' AS splitter, string_agg(label, ',' ORDER BY label) AS classes,
  string_agg(label || ':' || n, ',' ORDER BY label) AS label_counts FROM c"""))
def agg_run_manifest(spark, folder):
    return aggregates.manifest(derived.event_steps(spark, folder).withColumnRenamed("action", "label"), "user_mod")


@query("topk_margin", sql(SCORES, BLEND, select="SELECT id, round(mg, 6) AS margin FROM bl"))
def topk_margin(spark, folder):
    return decided(spark, folder).select("id", metrics.rounded(F.col("mg")).alias("margin"))


@query("topk_argmax", sql(SCORES, BLEND, select=f"""
SELECT id, pr::INTEGER AS pred, {LBL}[pr + 1] AS action, round(list_max(raw), 6) AS p FROM bl"""))
def topk_argmax(spark, folder):
    return decided(spark, folder).select(
        "id", F.col("pr").alias("pred"), keys.decode_label(F.col("pr")).alias("action"),
        metrics.rounded(F.array_max("raw")).alias("p"),
    )


@query("topk_per_class_sample", sql(STEPS, select="""
SELECT id, action, row_number() OVER (PARTITION BY action ORDER BY md5(id || '42'), id)::INTEGER AS rank FROM ev
QUALIFY row_number() OVER (PARTITION BY action ORDER BY md5(id || '42'), id) <= 50"""))
def topk_per_class_sample(spark, folder):
    steps = derived.event_steps(spark, folder).select("id", "action")
    return aggregates.per_class_cap(steps, "action", "id", 50, "42")
