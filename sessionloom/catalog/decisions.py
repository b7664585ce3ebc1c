"""Probability arithmetic, calibration, arbitration and their sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.catalog.metrics import INSPECT, K, decided, delta_sql, derived_bias
from sessionloom.catalog.oracle import (
    BIAS10,
    BLEND,
    LBL,
    SCORES,
    arr,
    argmax as amax,
    f1_ctes,
    margin as mgn,
    mixed,
    softmax as smax,
    sql,
    zip2,
)
from sessionloom.catalog.registry import query
from sessionloom.functions.probs import argmax, margin, mix, normalise
from sessionloom.operators import aggregates, bias_search, calibration, hierarchy, metrics, sweeps
from sessionloom.operators.metrics import rounded
from sessionloom.schema import GROUP_OF, GROUPS, LABELS, doubles
from sessionloom.sources import derived

CLASSES = LABELS[:K]
D = lambda v: f"{float(v)!r}::DOUBLE"
DARR = lambda vs: "[" + ", ".join(D(v) for v in vs) + "]"
MEMBERS = {g: hierarchy.members(CLASSES, g) for g in GROUPS}
APART = {g: hierarchy.members(CLASSES, g, True) for g in GROUPS}


def long_probs(df, col):
    out = df.select("id", F.posexplode_outer(col).alias("pos", "p"))
    return out.select("id", F.col("pos").cast("long").alias("pos"), rounded(F.col("p")).alias("p"))


def _mass(p, idx):
    return "(0.0::DOUBLE + " + " + ".join(f"{p}[{i + 1}]" for i in idx) + ")" if idx else "0.0::DOUBLE"


def _inside(p, i, idx):
    return f"({p}[{i + 1}] / greatest({_mass(p, idx)}, 1e-12::DOUBLE))"


_HIER = "[" + ", ".join(f"greatest({_mass('a', MEMBERS[GROUP_OF[c]])} * {_inside('b', i, MEMBERS[GROUP_OF[c]])}, 1e-12::DOUBLE)" for i, c in enumerate(CLASSES)) + "]"
_UNNEST = lambda src: f"SELECT id, i - 1 AS pos, round(p[i], 6) AS p FROM (SELECT id, p, unnest(range(1, {K + 1})) AS i FROM {src})"


def _hier_inputs(df):
    group = hierarchy.group_mass(F.col("a"), CLASSES)
    return group, {g: hierarchy.inside(F.col("b"), MEMBERS[g]) for g in GROUPS}


@query("prob_hierarchical", sql(SCORES, f"h0 AS (SELECT id, {_HIER} AS h FROM sc)", "h1 AS (SELECT id, list_transform(h, lambda x: x / list_sum(h)) AS p FROM h0)", select=_UNNEST("h1")))
def prob_hierarchical(spark, folder):
    df = derived.class_scores(spark, folder)
    group, special = _hier_inputs(df)
    return long_probs(df.select("id", hierarchy.hierarchical(group, special, CLASSES).alias("p")), "p")


_RESP_I = CLASSES.index("respond_only")


def _head_cell(i, c, b):
    g = GROUP_OF[c]
    m = _mass("a", MEMBERS[g])
    yes = f"c[{_RESP_I + 1}]"
    if c == "respond_only":
        cell = f"{m} * {yes}"
    elif g == "reason":
        cell = f"{m} * (1.0::DOUBLE - {yes}) * {_inside('b', i, APART[g])}"
    else:
        cell = f"{m} * {_inside('b', i, APART[g])}"
    return f"{D(1 - b)} * ({cell}) + {D(b)} * c[{i + 1}]"


def _head(b):
    return "[" + ", ".join(_head_cell(i, c, b) for i, c in enumerate(CLASSES)) + "]"


def _heads(df, blend):
    group = hierarchy.group_mass(F.col("a"), CLASSES)
    special = {g: hierarchy.inside(F.col("b"), APART[g]) for g in GROUPS}
    yes = F.get("c", F.lit(_RESP_I))
    return hierarchy.with_respond_head(group, special, F.array(1.0 - yes, yes), F.col("c"), CLASSES, blend)


@query("prob_respond_head", sql(SCORES, f"h1 AS (SELECT id, {_head(0.45)} AS p FROM sc)", select=_UNNEST("h1")))
def prob_respond_head(spark, folder):
    df = derived.class_scores(spark, folder)
    return long_probs(df.select("id", _heads(df, 0.45).alias("p")), "p")


BLENDS = sorted({round(0.05 * i, 10) for i in range(17)})


@query("sweep_global_blend", sql(SCORES, f"""
h1 AS (SELECT y, {_head(0.0)} AS h, c FROM sc),
w AS (SELECT unnest({DARR(BLENDS)}) AS global_blend),
r AS (SELECT global_blend, y, {zip2('h', 'c', '(1.0::DOUBLE - global_blend) * {x} + global_blend * {z}')} AS m FROM h1 CROSS JOIN w),
conf AS (SELECT global_blend, y, {amax('m')} AS pred, count(*) AS n FROM r GROUP BY ALL)
""", f1_ctes("conf", ["global_blend"]), select=f"""
SELECT global_blend, sum(nt)::BIGINT AS rows, round(sum(tp) / sum(nt), 6) AS accuracy, round(sum(f) / {D(K)}, 6) AS macro_f1 FROM f1 GROUP BY global_blend"""))
def sweep_global_blend(spark, folder):
    df = derived.class_scores(spark, folder)
    return sweeps.blend_weights(df.select("y", _heads(df, 0.0).alias("h"), "c"), "h", "c", BLENDS, K)


@query("prob_blend", sql(SCORES, BLEND, select="SELECT id, i - 1 AS pos, round(raw[i], 6) AS p FROM (SELECT id, raw, unnest(range(1, 11)) AS i FROM bl)"))
def prob_blend(spark, folder):
    return long_probs(decided(spark, folder), "raw")


GRID = sweeps.ensemble_candidates(["a", "b", "c"], 500)


@query("ensemble_weight_search", sql(SCORES, f"""
w AS (SELECT unnest({arr([n for n, _ in GRID])}) AS candidate, unnest({DARR([v[0] for _, v in GRID])}) AS wa,
  unnest({DARR([v[1] for _, v in GRID])}) AS wb, unnest({DARR([v[2] for _, v in GRID])}) AS wc),
r AS (SELECT candidate, wa, wb, wc, y, list_transform(range(1, 11), lambda i: wa * a[i] + wb * b[i] + wc * c[i]) AS m FROM sc CROSS JOIN w),
conf AS (SELECT candidate, wa, wb, wc, y, {amax('m')} AS pred, count(*) AS n FROM r GROUP BY ALL)
""", f1_ctes("conf", ["candidate", "wa", "wb", "wc"]), select=sweeps.rank_sql("""
SELECT candidate, round(wa, 6) AS w_a, round(wb, 6) AS w_b, round(wc, 6) AS w_c, round(avg(f), 6) AS macro_f1 FROM f1 GROUP BY candidate, wa, wb, wc""", "macro_f1", ["candidate"])))
def ensemble_weight_search(spark, folder):
    return sweeps.ranked(sweeps.ensemble_scores(derived.class_scores(spark, folder), ["a", "b", "c"], GRID), "macro_f1", ["candidate"])


@query("bias_apply", sql(SCORES, BLEND, f"ba AS (SELECT *, {smax('lp')} AS adj FROM bl)", select="""
SELECT id, pr::INTEGER AS before, base::INTEGER AS after, pr <> base AS changed, round(list_max(adj), 6) AS p_after FROM ba"""))
def bias_apply(spark, folder):
    from sessionloom.functions.probs import softmax

    return decided(spark, folder).select(
        "id", F.col("pr").alias("before"), F.col("base").alias("after"), (F.col("pr") != F.col("base")).alias("changed"),
        rounded(F.array_max(softmax(F.col("lp")))).alias("p_after"),
    )


STEP_CLASS = 3
VALUES = bias_search.absolute_grid()
_LOGRAW = "list_transform(raw, lambda x: ln(least(greatest(x, 1e-9::DOUBLE), 1.0::DOUBLE)))"


@query("bias_grid_step", sql(SCORES, BLEND, f"""
v AS (SELECT unnest({DARR(VALUES)}) AS value),
r AS (SELECT value, y, list_transform({_LOGRAW}, lambda x, i: CASE WHEN i = {STEP_CLASS + 1} THEN x + value ELSE x END) AS m FROM bl CROSS JOIN v),
conf AS (SELECT value, y, {amax('m')} AS pred, count(*) AS n FROM r GROUP BY ALL)
""", f1_ctes("conf", ["value"]), select=f"SELECT value, round(sum(f) / {D(K)}, 6) AS macro_f1 FROM f1 GROUP BY value"))
def bias_grid_step(spark, folder):
    lp = decided(spark, folder).select("y", calibration.log_clipped(F.col("raw")).alias("logp"))
    counts = bias_search.step_counts(lp, [], F.lit(STEP_CLASS), doubles(VALUES), doubles([0.0] * K))
    # Apply every value to the count table.
    grid = F.explode_outer(F.array(*[F.struct(F.lit(i).alias("vi"), F.lit(v).alias("value")) for i, v in enumerate(VALUES)]))
    conf = (
        counts.select("*", grid.alias("g"))
        .select("g.value", "y", F.when(F.col("g.vi") >= F.col("lost"), STEP_CLASS).otherwise(F.col("other")).alias("pred"), "n")
        .groupBy("value", "y", "pred").agg(F.sum("n").alias("n"))
    )
    return metrics.scores(conf, ["value"], classes=K).select("value", "macro_f1")


def _fit_table(spark, folder, per_fold):
    df = decided(spark, folder)
    folds = F.array(*[F.lit(f) for f in range(5)])
    fit = F.filter(folds, lambda f: f != F.col("fold")) if per_fold else F.array(F.lit(-1))
    return bias_search.log_table(df.withColumn("fit", fit), "raw", ["fit", "fold"])


@query("bias_coordinate_fit")
def bias_coordinate_fit(spark, folder):
    fits = bias_search.coordinate_fit(_fit_table(spark, folder, per_fold=True), list(range(5)), K)
    rows = [(f, CLASSES[i], float(b), float(s)) for f, (bias, s) in fits.items() for i, b in enumerate(bias)]
    return spark.createDataFrame(rows, "held_out_fold int, label string, bias double, in_sample_macro_f1 double").select(
        "held_out_fold", "label", rounded(F.col("bias")).alias("bias"), rounded(F.col("in_sample_macro_f1")).alias("in_sample_macro_f1")
    )


@query("bias_grid_search")
def bias_grid_search(spark, folder):
    bias, score = bias_search.grid_search(_fit_table(spark, folder, per_fold=False), K)
    rows = [(CLASSES[i], float(b), float(score)) for i, b in enumerate(bias)]
    return spark.createDataFrame(rows, "label string, bias double, macro_f1 double")


# One bias vector per held-out fold, given as an input of the sweep.
FOLD_BIAS = [[round(v * (0.4 + 0.2 * f), 10) for v in derived_bias()] for f in range(5)]


def shrink_runs(df, proba, fold_bias):
    """(fold, shrink, y, pred) for every shrink factor, each row with its fold's bias."""
    table = F.array(*[doubles(b) for b in fold_bias])
    bias = F.get(table, F.col("fold"))
    log_p = calibration.log_clipped(normalise(F.col(proba)))
    preds = F.transform(
        doubles(bias_search.SHRINKS),
        lambda s: F.struct(
            s.alias("shrink"), argmax(F.zip_with(log_p, bias, lambda x, b: x + s * b)).alias("pred")
        ),
    )
    return df.select("fold", "y", F.explode_outer(preds).alias("r")).select("fold", "y", "r.*")


_SHRINK_CTE = f"""
w AS (SELECT unnest({DARR(bias_search.SHRINKS)}) AS shrink),
r AS (SELECT shrink, fold, y, list_transform(raw, lambda x, i: ln(least(greatest(x / list_sum(raw), 1e-9::DOUBLE), 1.0::DOUBLE)) + shrink * ([{', '.join(DARR(b) for b in FOLD_BIAS)}])[fold + 1][i]) AS m FROM bl CROSS JOIN w),
cf AS (SELECT shrink, fold, y, {amax('m')} AS pred, count(*) AS n FROM r GROUP BY ALL),
bs AS (SELECT fold, y, pr AS pred, count(*) AS n FROM bl GROUP BY ALL)
"""


@query("bias_shrink_sweep", sql(SCORES, BLEND, _SHRINK_CTE, delta_sql("cf", "bs", ["shrink"]), select="""
SELECT *, shrink = coalesce((SELECT shrink FROM res WHERE delta_macro_f1 > 0 AND positive_folds >= 4 AND min_fold_delta >= -0.0005
  ORDER BY positive_folds DESC, mean_fold_delta DESC, min_fold_delta DESC, shrink LIMIT 1), 0) AS selected FROM res"""))
def bias_shrink_sweep(spark, folder):
    df = decided(spark, folder)
    runs = shrink_runs(df, "raw", FOLD_BIAS)
    table = calibration.fold_deltas(metrics.confusion(runs, ["shrink", "fold"]), ["shrink"], metrics.confusion(df, ["fold"], pred="pr"))
    return with_selection(table)


def with_selection(table, by=()):
    """Mark the shrink that the acceptance rule picks."""
    from pyspark.sql import Window

    fit = (F.col("delta_macro_f1") > 0) & (F.col("positive_folds") >= 4) & (F.col("min_fold_delta") >= -0.0005)
    # At most one row per shrink factor (and domain): a handful of rows per window.
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(
        F.when(fit, 0).when(F.col("shrink") == 0.0, 1).otherwise(2), F.desc("positive_folds"), F.desc("mean_fold_delta"),
        F.desc("min_fold_delta"), "shrink",
    )
    return table.withColumn("selected", F.row_number().over(w) == 1)


_GATE = """
gate AS (SELECT *, domain = 'sim' AND pa <> pb AND mg < 0.08::DOUBLE AS candidate FROM bl),
gated AS (SELECT *, candidate AND (pc = pa OR pc = pb) AND cc >= 0.55::DOUBLE AS accepted FROM gate),
fin AS (SELECT *, CASE WHEN accepted THEN pc ELSE base END AS final FROM gated)
"""


@query("gate_tiebreak", sql(SCORES, BLEND, _GATE, select="SELECT id, candidate, accepted, base::INTEGER AS base, final::INTEGER AS final FROM fin"))
def gate_tiebreak(spark, folder):
    return calibration.tie_break(decided(spark, folder)).select("id", "candidate", "accepted", "base", "final")


def report_sql(conf, base, params):
    """SQL twin of param_report: conf(<params>, fold, y, base, pred, n), base(fold, y, pred, n)."""
    p = ", ".join(params)
    return (
        f"{conf}_c AS (SELECT {p}, fold, y, pred, sum(n) AS n FROM {conf} GROUP BY ALL),\n"
        + f1_ctes(f"{conf}_c", [*params, "fold"], "pf1").strip() + ",\n" + f1_ctes(base, ["fold"], "bf1").strip()
        + f",\n{conf}_a AS (SELECT {p}, y, pred, sum(n) AS n FROM {conf} GROUP BY ALL),\n{base}_a AS (SELECT y, pred, sum(n) AS n FROM {base} GROUP BY ALL),\n"
        + f1_ctes(f"{conf}_a", params, "pall").strip() + ",\n" + f1_ctes(f"{base}_a", [], "ball").strip()
        + f""",
ch AS (SELECT {p}, (sum(n) FILTER (pred <> base))::BIGINT AS changed FROM {conf} GROUP BY {p}),
sf AS (SELECT {p}, fold, avg(f) AS s FROM pf1 GROUP BY ALL), sb AS (SELECT fold, avg(f) AS b FROM bf1 GROUP BY fold),
dd AS (SELECT {p}, max(CASE WHEN fold = 0 THEN s - b END) AS d0, max(CASE WHEN fold = 1 THEN s - b END) AS d1 FROM sf JOIN sb USING (fold) GROUP BY {p}),
rep AS (SELECT {', '.join('pall.' + x for x in params)}, avg(f) AS score FROM pall GROUP BY {', '.join('pall.' + x for x in params)}),
res AS (SELECT {', '.join('rep.' + x for x in params)}, coalesce(changed, 0) AS changed, round(score, 6) AS score, round(score - (SELECT avg(f) FROM ball), 6) AS delta,
  round(d0, 6) AS fold0_delta, round(d1, 6) AS fold1_delta, d0 > 1e-12::DOUBLE AND d1 > 1e-12::DOUBLE AS both_positive FROM rep JOIN dd USING ({p}) JOIN ch USING ({p}))
""")


_BASE = "bs AS (SELECT fold, y, base AS pred, count(*) AS n FROM bl GROUP BY ALL)"
_MS, _CS, _BS = (DARR(x) for x in (sweeps.MARGINS, sweeps.CONFIDENCES, sweeps.BETAS))


@query("sweep_margin_conf", sql(SCORES, BLEND, _BASE, f"""
m AS (SELECT unnest({_MS}) AS margin), k AS (SELECT unnest({_CS}) AS conf),
cf AS (SELECT margin, conf, fold, y, base, CASE WHEN domain = 'sim' AND pa <> pb AND mg < margin AND (pc = pa OR pc = pb) AND cc >= conf THEN pc ELSE base END AS pred,
  count(*) AS n FROM bl CROSS JOIN m CROSS JOIN k GROUP BY ALL)
""", report_sql("cf", "bs", ["margin", "conf"]), select=sweeps.rank_sql("SELECT * FROM res", "score", ["margin", "conf"])))
def sweep_margin_conf(spark, folder):
    return sweeps.ranked(sweeps.margin_confidence(decided(spark, folder)), "score", ["margin", "conf"])


_FUSED = f"""
m AS (SELECT unnest({_MS}) AS margin), k AS (SELECT unnest({_BS}) AS beta), md AS (SELECT unnest({arr(sweeps.FUSION_MODES)}) AS mode),
lg AS (SELECT fold, y, base, pa, pb, mg, raw, c, {_LOGRAW} AS lr, list_transform(c, lambda x: ln(least(greatest(x, 1e-9::DOUBLE), 1.0::DOUBLE))) AS lt FROM bl),
fz AS (SELECT *, list_transform(range(1, 11), lambda i: raw[i] + beta * c[i]) AS fsum FROM lg CROSS JOIN k),
pp AS (SELECT mode, beta, fold, y, base, pa, pb, mg, CASE mode
    WHEN 'pair_prob' THEN CASE WHEN fsum[pa + 1] >= fsum[pb + 1] THEN pa ELSE pb END
    WHEN 'pair_log' THEN CASE WHEN lr[pa + 1] + beta * lt[pa + 1] >= lr[pb + 1] + beta * lt[pb + 1] THEN pa ELSE pb END
    WHEN 'soft_all_prob' THEN {amax("list_transform(fsum, lambda x, i: ln(least(greatest(x / list_sum(fsum), 1e-9::DOUBLE), 1.0::DOUBLE)) + " + BIAS10 + "[i])")}
    ELSE {amax("list_transform(range(1, 11), lambda i: lr[i] + beta * lt[i] + " + BIAS10 + "[i])")} END AS fused FROM fz CROSS JOIN md),
cf AS (SELECT mode, margin, beta, fold, y, base, CASE WHEN pa <> pb AND mg < margin THEN fused ELSE base END AS pred, count(*) AS n FROM pp CROSS JOIN m GROUP BY ALL)
"""


@query("sweep_pairwise_fusion", sql(SCORES, BLEND, _BASE, _FUSED, report_sql("cf", "bs", ["mode", "margin", "beta"]), select=sweeps.rank_sql("SELECT * FROM res", "score", ["mode", "margin", "beta"])))
def sweep_pairwise_fusion(spark, folder):
    table = sweeps.pairwise_fusion(decided(spark, folder), doubles(derived_bias()))
    return sweeps.ranked(table, "score", ["mode", "margin", "beta"])


@query("rerank_inspect", sql(SCORES, BLEND, f"""
rr AS (SELECT id, raw, {_mass('raw', INSPECT)} AS bm, {_mass('c', INSPECT)} AS om, c, pr, {_mass('raw', INSPECT)} >= 0.45::DOUBLE OR pr IN ({', '.join(map(str, INSPECT))}) AS gated FROM bl),
ro AS (SELECT id, gated, unnest(range(1, 11)) AS i, CASE WHEN gated THEN list_transform(range(1, 11), lambda i: CASE WHEN i - 1 IN ({', '.join(map(str, INSPECT))}) THEN
   (0.7::DOUBLE * (raw[i] / greatest(bm, 1e-8::DOUBLE)) + 0.3::DOUBLE * (c[i] / greatest(om, 1e-8::DOUBLE))) * bm ELSE raw[i] END) ELSE raw END AS p FROM rr)
""", select="SELECT id, gated, i - 1 AS pos, round(p[i], 6) AS p FROM ro"))
def rerank_inspect(spark, folder):
    df = decided(spark, folder)
    gate = sweeps.rerank_mask(F.col("raw"), INSPECT, 0.45)
    new = F.when(gate, sweeps.rerank_inside(F.col("raw"), F.col("c"), INSPECT, F.lit(0.7), K)).otherwise(F.col("raw"))
    rows = df.select("id", gate.alias("gated"), F.posexplode_outer(new).alias("pos", "p"))
    return rows.select("id", "gated", F.col("pos").cast("long").alias("pos"), rounded(F.col("p")).alias("p"))


_TW = sweeps.tta_weights()


@query("sweep_multiview_gate", sql(SCORES, f"""
mv AS (SELECT y, a, b, c, {mixed('b', 0.5, 'c', 0.5)} AS p3, {mixed('a', 0.6, 'b', 0.4)} AS base_p FROM sc),
mv2 AS (SELECT *, {amax('base_p')} AS base, {mgn('base_p')} AS mg FROM mv),
w AS (SELECT unnest({DARR([x[0] for x in _TW])}) AS w0, unnest({DARR([x[1] for x in _TW])}) AS w1, unnest({DARR([x[2] for x in _TW])}) AS w3),
t AS (SELECT unnest({DARR(sweeps.TTA_THRESHOLDS)}) AS threshold),
r AS (SELECT *, list_transform(range(1, 11), lambda i: 0.6::DOUBLE * a[i] + 0.4::DOUBLE * (w0 * b[i] + w1 * c[i] + w3 * p3[i])) AS m FROM mv2 CROSS JOIN w),
r2 AS (SELECT *, {amax('m')} AS new FROM r),
cf AS (SELECT threshold, w0, w1, w3, y, CASE WHEN mg < threshold THEN new ELSE base END AS pred, count(*) AS n, count(*) FILTER (mg < threshold) AS g FROM r2 CROSS JOIN t GROUP BY ALL)
""", f1_ctes("cf", ["threshold", "w0", "w1", "w3"]), """
gg AS (SELECT threshold, w0, w1, w3, sum(g)::BIGINT AS gate_rows, sum(n) AS rows FROM cf GROUP BY ALL)
""", select=sweeps.rank_sql(f"""
SELECT f1.threshold, any_value(gate_rows) AS gate_rows, round(any_value(gate_rows) / any_value(rows), 6) AS gate_rate, round(f1.w0, 6) AS w0, round(f1.w1, 6) AS w1, round(f1.w3, 6) AS w3,
  round(sum(f) / {D(K)}, 6) AS macro_f1, round(sum(tp) / sum(nt), 6) AS accuracy
FROM f1 JOIN gg ON gg.threshold = f1.threshold AND gg.w0 = f1.w0 AND gg.w1 = f1.w1 AND gg.w3 = f1.w3 GROUP BY f1.threshold, f1.w0, f1.w1, f1.w3""", "macro_f1", ["threshold", "w0", "w1", "w3"])))
def sweep_multiview_gate(spark, folder):
    df = derived.class_scores(spark, folder).select(
        "y", F.col("a").alias("pa"), F.col("b").alias("p0"), F.col("c").alias("p1"),
        mix(F.col("b"), F.col("c"), 0.5, 0.5).alias("p3"), mix(F.col("a"), F.col("b"), 0.6, 0.4).alias("base_p"),
    )
    df = df.withColumns({"base": argmax(F.col("base_p")), "mg": margin(F.col("base_p"))})
    return sweeps.ranked(sweeps.multiview_gate(df, K), "macro_f1", ["threshold", "w0", "w1", "w3"])


_CG = ["top1_inspect", *[f"inspect_mass_ge_{t:.2f}" for t in sweeps.CANDIDATE_GATES]]
_IN = "(" + ", ".join(map(str, INSPECT)) + ")"


@query("sweep_candidate_blend", sql(SCORES, BLEND, f"""
cb AS (SELECT y, raw, pr, {_mass('raw', INSPECT)} AS bm, {_mass('c', INSPECT)} AS om, c FROM bl),
al AS (SELECT unnest({DARR(sweeps.CANDIDATE_ALPHAS)}) AS alpha),
g AS (SELECT unnest({arr(_CG)}) AS gate, unnest({DARR([0.0, *sweeps.CANDIDATE_GATES])}) AS t),
r AS (SELECT y, pr, bm, alpha, list_transform(range(1, 11), lambda i: CASE WHEN i - 1 IN {_IN} THEN bm * ((1.0::DOUBLE - alpha) * (raw[i] / greatest(bm, 1e-8::DOUBLE)) + alpha * (c[i] / greatest(om, 1e-12::DOUBLE))) ELSE raw[i] END) AS m FROM cb CROSS JOIN al),
r2 AS (SELECT *, {amax('m')} AS new FROM r),
cf AS (SELECT gate, alpha, y, pr, CASE WHEN (gate = 'top1_inspect' AND pr IN {_IN}) OR (gate <> 'top1_inspect' AND bm >= t) THEN new ELSE pr END AS pred,
   (gate = 'top1_inspect' AND pr IN {_IN}) OR (gate <> 'top1_inspect' AND bm >= t) AS on_, count(*) AS n FROM r2 CROSS JOIN g GROUP BY ALL),
cc2 AS (SELECT gate, alpha, y, pred, sum(n) AS n FROM cf GROUP BY ALL),
b0 AS (SELECT y, pr AS pred, count(*) AS n FROM bl GROUP BY ALL)
""", f1_ctes("cc2", ["gate", "alpha"]), f1_ctes("b0", [], "fb"), f"""
ff AS (SELECT gate, alpha, (coalesce(sum(n) FILTER (on_), 0))::BIGINT AS gated_rows, (coalesce(sum(n) FILTER (pred <> pr), 0))::BIGINT AS changed_predictions FROM cf GROUP BY ALL),
bb AS (SELECT sum(f) / {D(K)} AS bm, sum(tp) / sum(nt) AS ba FROM fb)
""", select=sweeps.rank_sql(f"""
SELECT f1.gate, f1.alpha, any_value(gated_rows) AS gated_rows, round(sum(f) / {D(K)}, 6) AS macro_f1, round(sum(f) / {D(K)} - any_value(bb.bm), 6) AS macro_delta,
  round(sum(tp) / sum(nt), 6) AS accuracy, round(sum(tp) / sum(nt) - any_value(bb.ba), 6) AS accuracy_delta, any_value(changed_predictions) AS changed_predictions
FROM f1 JOIN ff ON ff.gate = f1.gate AND ff.alpha = f1.alpha CROSS JOIN bb GROUP BY f1.gate, f1.alpha""", "macro_f1", ["gate", "alpha"])))
def sweep_candidate_blend(spark, folder):
    df = decided(spark, folder).select("y", "raw", hierarchy.inside(F.col("c"), INSPECT).alias("rank"))
    return sweeps.ranked(sweeps.candidate_blend(df, INSPECT, K), "macro_f1", ["gate", "alpha"])


_INNER_LABEL = f"list_position({arr(INSPECT)}, y) - 1"


@query("candidate_step_metrics", sql(SCORES, BLEND, f"""
ci AS (SELECT step, {_INNER_LABEL} AS y, {amax('[' + ', '.join(f"raw[{i + 1}]" for i in INSPECT) + ']')} AS base, {amax('[' + ', '.join(f"c[{i + 1}]" for i in INSPECT) + ']')} AS ranker
  FROM bl WHERE y IN {_IN} AND step BETWEEN 1 AND 6),
cm AS (SELECT step, 'base' AS model, y, base AS pred, count(*) AS n FROM ci GROUP BY ALL UNION ALL SELECT step, 'ranker', y, ranker, count(*) FROM ci GROUP BY ALL)
""", f1_ctes("cm", ["step", "model"]), f"""
sm AS (SELECT step, model, sum(nt)::BIGINT AS rows, round(sum(f) / {D(len(INSPECT))}, 6) AS f, round(sum(tp) / sum(nt), 6) AS a FROM f1 GROUP BY step, model)
""", select="""
SELECT step, max(rows) AS rows, max(f) FILTER (model = 'base') AS base_internal_macro_f1, max(f) FILTER (model = 'ranker') AS ranker_macro_f1,
  max(a) FILTER (model = 'base') AS base_internal_acc, max(a) FILTER (model = 'ranker') AS ranker_acc FROM sm GROUP BY step"""))
def candidate_step_metrics(spark, folder):
    """Base and ranker among the inspect classes, true inspect rows by step."""
    df = decided(spark, folder).select(
        "step", "y", hierarchy.inside(F.col("raw"), INSPECT).alias("inner"), hierarchy.inside(F.col("c"), INSPECT).alias("rank"))
    return aggregates.inspect_step_metrics(df, INSPECT)


@query("decision_stack", sql(SCORES, BLEND, _GATE, select=f"""
SELECT id, domain, {LBL}[final + 1] AS action, vec_id AS row_no FROM fin"""))
def decision_stack(spark, folder):
    from sessionloom.plans.decision import decide_batch

    scores = derived.class_scores(spark, folder)
    template = scores.select("id", F.col("vec_id").alias("row_no"))
    return decide_batch(scores, template, K).select("id", "domain", "action", "row_no")


@query("join_submission_by_id", sql(SCORES, select=f"SELECT id, vec_id AS row_no, {LBL}[{amax('a')} + 1] AS action FROM sc"))
def join_submission_by_id(spark, folder):
    from sessionloom.operators.keys import decode_label
    from sessionloom.plans.decision import fill_template

    scores = derived.class_scores(spark, folder)
    predicted = scores.select("id", decode_label(argmax(F.col("a"))).alias("action"))
    return fill_template(scores.select("id", F.col("vec_id").alias("row_no")), predicted)


@query("report_given_bias", sql(SCORES, BLEND, f"""
w AS (SELECT unnest({DARR(bias_search.SHRINKS)}) AS shrink),
r AS (SELECT domain, shrink, fold, y, list_transform(raw, lambda x, i: ln(least(greatest(x / list_sum(raw), 1e-9::DOUBLE), 1.0::DOUBLE)) + shrink * ([{', '.join(DARR(b) for b in FOLD_BIAS)}])[fold + 1][i]) AS m FROM bl CROSS JOIN w),
pr2 AS (SELECT domain, shrink, fold, y, {amax('m')} AS pred FROM r),
cf AS (SELECT domain, shrink, y, pred, count(*) AS n FROM pr2 GROUP BY ALL UNION ALL SELECT 'all', shrink, y, pred, count(*) FROM pr2 GROUP BY ALL),
b0 AS (SELECT domain, y, pr AS pred, count(*) AS n FROM bl GROUP BY ALL UNION ALL SELECT 'all', y, pr, count(*) FROM bl GROUP BY ALL)
""", f1_ctes("cf", ["domain", "shrink"]), f1_ctes("b0", ["domain"], "fb"), """
bb AS (SELECT domain, avg(f) AS b FROM fb GROUP BY domain)
""", select="""
SELECT f1.domain, f1.shrink, sum(nt)::BIGINT AS rows, round(any_value(b), 6) AS anchor_macro_f1, round(avg(f), 6) AS macro_f1, round(avg(f) - any_value(b), 6) AS delta,
  round(sum(tp) / sum(nt), 6) AS accuracy FROM f1 JOIN bb ON bb.domain = f1.domain GROUP BY f1.domain, f1.shrink"""))
def report_given_bias(spark, folder):
    """Scores of given bias vectors, one for each held-out fold, by domain and shrink factor."""
    from sessionloom.plans.decision import calibration_report

    df = decided(spark, folder)
    table = F.array(*[doubles(b) for b in FOLD_BIAS])
    return calibration_report(df, "raw", F.get(table, F.col("fold")), bias_search.SHRINKS)


@query("report_calibration")
def report_calibration(spark, folder):
    """Fitted calibration by domain: each shrink factor over held-out folds, and the biases to be used over all rows."""
    from sessionloom.plans.decision import calibrate_domains

    return calibrate_domains(decided(spark, folder), "raw", K).report


@query("bias_cross_fit")
def bias_cross_fit(spark, folder):
    """Shrink sweep over biases fitted without each row's fold, the accepted shrink, and rows changed."""
    from sessionloom.plans.decision import cross_fit_bias

    table, _ = cross_fit_bias(decided(spark, folder), "raw", K)
    return table


@query("bias_final")
def bias_final(spark, folder):
    """The bias to use: fitted on all rows, scaled by the shrink that the cross-fit accepts."""
    from sessionloom.plans.decision import cross_fit_bias

    _, bias = cross_fit_bias(decided(spark, folder), "raw", K)
    return spark.createDataFrame([(c, round(float(b), 6)) for c, b in zip(CLASSES, bias, strict=True)], "label string, bias double")
