"""Nearest-neighbour and prototype queries over the vector table."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.catalog.decisions import DARR, _IN, _mass
from sessionloom.catalog.metrics import INSPECT, K, classes_frame
from sessionloom.catalog.oracle import SCORES, argmax as amax, f1_ctes, sql
from sessionloom.catalog.registry import query
from sessionloom.functions.probs import min_max, softmax
from sessionloom.operators import knn, sweeps
from sessionloom.operators.metrics import rounded
from sessionloom.sources import derived

DIM = derived.VECTOR_DIM
TOP = max(sweeps.KNN_KS)


def NN(k):
    return f"""
vec AS (SELECT vec_id AS id, label AS y, ((vec_id // 4) % 5)::INTEGER AS fold, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
sims AS (
  SELECT a.id, b.id AS nid, b.y AS ny, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 9) AS sim
  FROM vec a JOIN vec b ON a.fold <> b.fold),
nn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, nid) AS rank FROM sims QUALIFY row_number() OVER (PARTITION BY id ORDER BY sim DESC, nid) <= {k})
"""


@query("knn_topk_join", sql(NN(10), select="SELECT id, rank::INTEGER AS rank, nid, ny, round(sim, 6) AS sim FROM nn"))
def knn_topk_join(spark, folder):
    nn = knn.topk_other_folds(derived.vectors(spark, folder), 10)
    return nn.select("id", "rank", "nid", "ny", rounded(F.col("sim")).alias("sim"))


_POST = f"""
w AS (SELECT id, ny, exp((sim - max(sim) OVER (PARTITION BY id)) / 0.1::DOUBLE) AS w FROM nn WHERE rank <= 16),
t AS (SELECT id, ny, sum(w) AS s FROM w GROUP BY ALL),
z AS (SELECT id, greatest(sum(s), 1e-8::DOUBLE) AS z FROM t GROUP BY id)
"""


@query("knn_posterior", sql(NN(16), _POST, select=f"""
SELECT z.id, c.pos, round(coalesce(t.s, 0.0::DOUBLE) / z.z, 6) AS p FROM z CROSS JOIN (SELECT unnest(range({K})) AS pos) c LEFT JOIN t ON t.id = z.id AND t.ny = c.pos"""))
def knn_posterior(spark, folder):
    lists = knn.neighbour_lists(derived.vectors(spark, folder), 16)
    p = knn.posterior(F.col("nn"), F.lit(16), F.lit(0.1), K)
    rows = lists.select("id", F.posexplode_outer(p).alias("pos", "p"))
    return rows.select("id", F.col("pos").cast("long").alias("pos"), rounded(F.col("p")).alias("p"))


def rerank_sql(carry, base, other, alphas, thresholds, src):
    """Alone, blended and reranked predictions of `other` against `base` for every parameter."""
    cols = "".join(f"{c}, " for c in carry)
    local = (
        f"list_transform(range(1, {K + 1}), lambda i: CASE WHEN i - 1 IN {_IN} THEN (alpha * ({base}[i] / greatest(bm, 1e-8::DOUBLE)) + (1.0::DOUBLE - alpha) * "
        f"({other}[i] / greatest(om, 1e-8::DOUBLE))) * bm ELSE {base}[i] END)"
    )
    return f"""
al AS (SELECT unnest({DARR(alphas)}) AS alpha), th AS (SELECT unnest({DARR(thresholds)}) AS threshold),
s0 AS (SELECT *, {_mass(base, INSPECT)} AS bm, {_mass(other, INSPECT)} AS om, {amax(base)} AS kept FROM {src}),
s1 AS (SELECT {cols}y, kept, bm, alpha, {amax(f"list_transform(range(1, {K + 1}), lambda i: alpha * {base}[i] + (1.0::DOUBLE - alpha) * {other}[i])")} AS pf, {amax(local)} AS pl FROM s0 CROSS JOIN al),
runs AS (
  SELECT {cols}'alone' AS mode, NULL::DOUBLE AS alpha, NULL::DOUBLE AS threshold, y, kept, {amax(other)} AS pred, 0 AS g FROM s0
  UNION ALL SELECT {cols}'full_blend', alpha, NULL, y, kept, pf, 0 FROM s1
  UNION ALL SELECT {cols}'inspect_rerank', alpha, threshold, y, kept, CASE WHEN bm >= threshold OR kept IN {_IN} THEN pl ELSE kept END,
    CASE WHEN bm >= threshold OR kept IN {_IN} THEN 1 ELSE 0 END FROM s1 CROSS JOIN th),
keyed AS (SELECT *, concat_ws('|', {', '.join(f"coalesce({c}::VARCHAR, '-')" for c in [*carry, 'mode', 'alpha', 'threshold'])}) AS key FROM runs),
conf AS (SELECT key, y, pred, count(*) AS n FROM keyed GROUP BY ALL),
facts AS (SELECT key, {', '.join(f'any_value({c}) AS {c}' for c in [*carry, 'mode', 'alpha', 'threshold'])}, (sum(g))::BIGINT AS rerank_rows, count(*) FILTER (pred <> kept) AS changed FROM keyed GROUP BY key)
""" + "," + f1_ctes("conf", ["key"])


def rerank_select(carry):
    cols = "".join(f"any_value(facts.{c}) AS {c}, " for c in [*carry, "mode", "alpha", "threshold"])
    return (
        f"SELECT {cols}round(sum(f) / {float(K)!r}::DOUBLE, 6) AS macro_f1, round(sum(tp) / sum(nt), 6) AS accuracy, any_value(changed) AS changed, "
        "any_value(rerank_rows) AS rerank_rows FROM f1 JOIN facts ON facts.key = f1.key GROUP BY f1.key"
    )


_KT = f"""
ks AS (SELECT unnest([{', '.join(map(str, sweeps.KNN_KS))}]) AS k), ts AS (SELECT unnest({DARR(sweeps.KNN_TEMPS)}) AS temp),
w AS (SELECT id, k, temp, ny, exp((sim - max(sim) OVER (PARTITION BY id, k, temp)) / temp) AS w FROM nn CROSS JOIN ks CROSS JOIN ts WHERE rank <= k),
t AS (SELECT id, k, temp, ny, sum(w) AS s FROM w GROUP BY ALL),
zz AS (SELECT id, k, temp, greatest(sum(s), 1e-8::DOUBLE) AS z, map_from_entries(list((ny, s))) AS m FROM t GROUP BY id, k, temp),
pk AS (SELECT sc.y, sc.a, k, temp, list_transform(range(0, {K}), lambda c: coalesce(m[c], 0.0::DOUBLE) / z) AS p FROM zz JOIN sc ON sc.vec_id = zz.id)
"""


@query("sweep_knn_blend", sql(SCORES, NN(TOP), _KT, rerank_sql(["k", "temp"], "a", "p", sweeps.KNN_ALPHAS, sweeps.KNN_THRESHOLDS, "pk"),
                              select=sweeps.rank_sql(rerank_select(["k", "temp"]), "macro_f1", ["k", "temp", "mode", "alpha", "threshold"])))
def sweep_knn_blend(spark, folder):
    lists = knn.neighbour_lists(derived.vectors(spark, folder), TOP)
    scores = derived.class_scores(spark, folder).select(F.col("vec_id").alias("id"), "y", "a")
    grid = F.explode_outer(F.array(*[
        F.struct(F.lit(k).alias("k"), F.lit(t).alias("temp")) for k in sweeps.KNN_KS for t in sweeps.KNN_TEMPS
    ]))
    rows = scores.join(lists, "id").select("y", "a", "nn", grid.alias("g"))
    scored = rows.select(
        "g.k", "g.temp", "y", "a", knn.posterior(F.col("nn"), F.col("g.k"), F.col("g.temp"), K).alias("p")
    )
    table = sweeps.blend_and_rerank(
        scored, ["k", "temp"], "a", "p", sweeps.KNN_ALPHAS, sweeps.KNN_THRESHOLDS, INSPECT, K
    )
    return sweeps.ranked(table, "macro_f1", ["k", "temp", "mode", "alpha", "threshold"])


_MEAN = ", ".join(f"avg(embedding[{i}]::DOUBLE)" for i in range(1, DIM + 1))


@query("agg_class_prototypes", f"""
WITH m AS (SELECT label AS y, count(*) AS n, [{_MEAN}] AS v FROM embeddings GROUP BY label),
o AS (SELECT [{_MEAN}] AS v FROM embeddings),
k AS (SELECT unnest(range({K + 1}))::INTEGER AS y),
j AS (SELECT k.y, coalesce(m.n, 0) AS n, coalesce(m.v, o.v) AS v FROM k LEFT JOIN m USING (y) CROSS JOIN o)
SELECT y, n, i - 1 AS pos, round(v[i] / sqrt(list_dot_product(v, v)), 6) AS value FROM (SELECT *, unnest(range(1, {DIM + 1})) AS i FROM j)""")
def agg_class_prototypes(spark, folder):
    protos = knn.class_prototypes(derived.vectors(spark, folder), classes_frame(spark, "y", K + 1), DIM)
    rows = protos.select("y", "n", F.posexplode_outer("proto").alias("pos", "value"))
    return rows.select("y", "n", F.col("pos").cast("long").alias("pos"), rounded(F.col("value")).alias("value"))


_PROTO = f"""
vec AS (SELECT vec_id AS id, label AS y, ((vec_id // 4) % 5)::INTEGER AS fold, embedding, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
pm AS (SELECT y, fold, [{_MEAN}] AS m FROM vec GROUP BY y, fold),
ps AS (SELECT vec.id, pm.y AS c, max(list_dot_product(vec.v, pm.m) / sqrt(list_dot_product(pm.m, pm.m))) AS s FROM vec JOIN pm ON pm.fold <> vec.fold GROUP BY vec.id, pm.y),
pl AS (SELECT id, list(s ORDER BY c) AS s FROM ps GROUP BY id)
"""


@query("proto_scores", sql(_PROTO, select="SELECT id, c AS label, round(s, 6) AS score FROM ps"))
def proto_scores(spark, folder):
    scored = knn.prototype_scores(derived.vectors(spark, folder), K, DIM)
    rows = scored.select("id", F.posexplode_outer("scores").alias("label", "score"))
    return rows.select("id", "label", rounded(F.col("score")).alias("score"))


_NORMS = " UNION ALL ".join(
    [f"SELECT 'softmax' AS normalizer, {float(t)!r}::DOUBLE AS temperature, sc.y, sc.a, list_transform(s, lambda x: exp((x - list_max(s)) / {float(t)!r}::DOUBLE)) AS e FROM pl JOIN sc ON sc.vec_id = pl.id"
     for t in sweeps.PROTO_TEMPS]
    + ["SELECT 'minmax', NULL, sc.y, sc.a, list_transform(s, lambda x: (x - list_min(s)) / greatest(list_max(s) - list_min(s), 1e-6::DOUBLE)) FROM pl JOIN sc ON sc.vec_id = pl.id"]
)


@query("sweep_proto_blend", sql(SCORES, _PROTO, f"""
nz AS ({_NORMS}),
pk AS (SELECT normalizer, temperature, y, a, CASE WHEN normalizer = 'softmax' THEN list_transform(e, lambda x: x / list_sum(e)) ELSE e END AS p FROM nz)
""", rerank_sql(["normalizer", "temperature"], "a", "p", sweeps.PROTO_ALPHAS, sweeps.PROTO_THRESHOLDS, "pk"), select=sweeps.rank_sql(rerank_select(["normalizer", "temperature"]), "macro_f1", ["normalizer", "temperature", "mode", "alpha", "threshold"])))
def sweep_proto_blend(spark, folder):
    protos = knn.prototype_scores(derived.vectors(spark, folder), K, DIM).select("id", "scores")
    scores = derived.class_scores(spark, folder).select(F.col("vec_id").alias("id"), "y", "a")
    shapes = F.array(
        *[
            F.struct(F.lit("softmax").alias("normalizer"), F.lit(t).alias("temperature"), softmax(F.col("scores"), t).alias("p"))
            for t in sweeps.PROTO_TEMPS
        ],
        F.struct(F.lit("minmax").alias("normalizer"), F.lit(None).cast("double").alias("temperature"), min_max(F.col("scores")).alias("p")),
    )
    rows = scores.join(protos, "id").select("y", "a", F.explode_outer(shapes).alias("n")).select("y", "a", "n.*")
    table = sweeps.blend_and_rerank(
        rows, ["normalizer", "temperature"], "a", "p", sweeps.PROTO_ALPHAS, sweeps.PROTO_THRESHOLDS, INSPECT, K
    )
    return sweeps.ranked(table, "macro_f1", ["normalizer", "temperature", "mode", "alpha", "threshold"])
