"""Keys, joins, audits, folds and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.catalog.oracle import (
    GROUP_CASE, LBL, SCORES, SESS, STEPS, arr, collapse, compact, q, sql,
)
from sessionloom.catalog.registry import query
from sessionloom.functions.probs import align, argmax
from sessionloom.functions.text import compact as compact_text
from sessionloom.operators import joins, keys, metrics, splits
from sessionloom.schema import INSPECT_MEANING, LABELS
from sessionloom.sources import derived

K = derived.CLASSES
INSPECT = ["read_file", "grep_search", "glob_pattern", "list_directory"]


def _sessions(spark, folder):
    rows = derived.sessions(spark, folder)
    return rows.withColumn("root", keys.root_session(F.col("id"))).withColumn("domain", keys.domain(F.col("id")))


@query("route_domain", sql(SESS, select="SELECT id, domain FROM sess"))
def route_domain(spark, folder):
    return derived.sessions(spark, folder).select("id", keys.domain(F.col("id")).alias("domain"))


_ODD = """
odd AS (SELECT id || CASE row_no % 4 WHEN 0 THEN '' WHEN 1 THEN '-step_07' WHEN 2 THEN '-extra' ELSE '-step_x' END AS id FROM sess)
"""


@query("key_root_session", sql(SESS, _ODD, select=r"""
SELECT id, split_part(id, '-step_', 1) AS first_part,
  regexp_replace(id, '^(.*)-step_.*$', '\1') AS last_part,
  CASE WHEN regexp_matches(id, '^.+-step_[0-9]+$') THEN regexp_extract(id, '^(.+)-step_[0-9]+$', 1) ELSE id END AS strict_part,
  regexp_replace(id, '-step_[0-9]+$', '') AS stripped
FROM odd"""))
def key_root_session(spark, folder):
    suffix = derived.pick(["", "-step_07", "-extra", "-step_x"], F.col("row_no") % 4)
    odd = derived.sessions(spark, folder).select(F.concat("id", suffix).alias("id"))
    name = {"first": "first_part", "last": "last_part", "strict": "strict_part", "strip": "stripped"}
    return odd.select("id", *[keys.root_session(F.col("id"), v).alias(n) for v, n in name.items()])


@query("key_step_group", sql(SESS, _ODD, """
n AS (SELECT id, coalesce(TRY_CAST(regexp_extract(id, '-step_([0-9]+)$', 1) AS INTEGER), -1) AS step FROM odd)
""", select="""
SELECT id, step, CASE WHEN step <= 1 THEN 's1' WHEN step <= 3 THEN 's2_3' WHEN step <= 6 THEN 's4_6' WHEN step <= 10 THEN 's7_10' ELSE 's11p' END AS step_group FROM n"""))
def key_step_group(spark, folder):
    suffix = derived.pick(["", "-step_07", "-extra", "-step_x"], F.col("row_no") % 4)
    odd = derived.sessions(spark, folder).select(F.concat("id", suffix).alias("id"))
    step = keys.step_number(F.col("id"))
    return odd.select("id", step.alias("step"), keys.step_band(step).alias("step_group"))


@query("filter_first_n_sessions", sql(SESS, """
f AS (SELECT root, min(row_no) AS p FROM sess GROUP BY root ORDER BY p LIMIT 25)
""", select="SELECT id, root FROM sess WHERE root IN (SELECT root FROM f)"))
def filter_first_n_sessions(spark, folder):
    return keys.first_sessions(_sessions(spark, folder).select("id", "root", "row_no"), "root", "row_no", 25).select("id", "root")


@query("limit_offset_slice", sql(SESS, select="""
SELECT id, row_no FROM sess WHERE starts_with(id, 'sess_au') ORDER BY row_no LIMIT 30 OFFSET 10"""))
def limit_offset_slice(spark, folder):
    rows = derived.sessions(spark, folder).where(F.col("id").startswith("sess_au")).select("id", "row_no")
    return keys.page(rows, "row_no", 10, 30)


@query("meta_stable_projection", sql(SESS, select="SELECT id, language_pref, user_tier FROM sess"))
def meta_stable_projection(spark, folder):
    return derived.sessions(spark, folder).select("id", keys.stable_meta(F.col("session_meta")).alias("m")).select("id", "m.*")


@query("map_action_group", sql(SESS, select=f"""
SELECT id, coalesce(action, 'unlabelled') AS label, {GROUP_CASE("coalesce(action, 'unlabelled')")} AS grp,
  CASE WHEN action = 'respond_only' THEN 'reason:respond' ELSE {GROUP_CASE("coalesce(action, 'unlabelled')")} END AS head FROM sess"""))
def map_action_group(spark, folder):
    label = F.coalesce("action", F.lit("unlabelled"))
    return derived.sessions(spark, folder).select(
        "id", label.alias("label"), keys.action_group(label).alias("grp"), keys.action_group(label, True).alias("head")
    )


@query("encode_labels", sql(SESS, f"""
t AS (SELECT id, CASE WHEN row_no % 2 = 0 THEN action ELSE (list_position({LBL}, action) - 1)::VARCHAR END AS truth FROM sess WHERE action IS NOT NULL)
""", select=f"""
SELECT id, truth, coalesce(list_position({LBL}, truth) - 1, TRY_CAST(truth AS INTEGER))::INTEGER AS idx,
  {LBL}[coalesce(list_position({LBL}, truth) - 1, TRY_CAST(truth AS INTEGER)) + 1] AS name FROM t"""))
def encode_labels(spark, folder):
    rows = derived.sessions(spark, folder).where(F.col("action").isNotNull())
    as_index = keys.encode_label(F.col("action")).cast("string")
    truth = F.when(F.col("row_no") % 2 == 0, F.col("action")).otherwise(as_index)
    coded = rows.select("id", truth.alias("truth"))
    index = keys.encode_label(F.col("truth"))
    return coded.select("id", "truth", index.alias("idx"), keys.decode_label(index).alias("name"))


def _labels(spark, folder):
    return derived.sessions(spark, folder).where(F.col("action").isNotNull()).select("id", "action")


@query("join_labels_strict", sql(SESS, select=f"""
SELECT id, action, length({collapse('current_prompt')}) AS n_chars FROM sess WHERE action IS NOT NULL"""))
def join_labels_strict(spark, folder):
    rows = derived.sessions(spark, folder).where(F.col("action").isNotNull()).select("id", "current_prompt")
    joined = joins.join_strict(rows, _labels(spark, folder), "id", "action", "missing label")
    return joined.select("id", "action", F.length(compact_text(F.col("current_prompt"), 1 << 30)).alias("n_chars"))


@query("join_labels_lenient", sql(SESS, select=f"""
SELECT id, action FROM sess WHERE starts_with(id, 'sess_sim') AND action IN ({', '.join(q(a) for a in INSPECT)})"""))
def join_labels_lenient(spark, folder):
    rows = derived.sessions(spark, folder).select("id")
    return joins.join_lenient(rows, _labels(spark, folder), "id", "action", "sess_sim", INSPECT)


def _long_models(spark, folder):
    scores = derived.class_scores(spark, folder)
    parts = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("proba")) for m in ("a", "b", "c")])
    return scores.select("id", "vec_id", "y", F.explode_outer(parts).alias("p")).select("id", "vec_id", "y", "p.*")


@query("join_oof_alignment", sql(SCORES, select="""
SELECT id, y, (list_position(a, list_max(a)) - 1)::INTEGER AS pred_a, (list_position(b, list_max(b)) - 1)::INTEGER AS pred_b,
  (list_position(c, list_max(c)) - 1)::INTEGER AS pred_c FROM sc"""))
def join_oof_alignment(spark, folder):
    models = ["a", "b", "c"]
    aligned = joins.strict_alignment(joins.align_models(_long_models(spark, folder), models), models)
    return aligned.select("id", "y", *[argmax(F.col(m)).alias(f"pred_{m}") for m in models])


@query("audit_oof_alignment", sql(SCORES, select="""
SELECT count(*) AS rows, 0::BIGINT AS missing_a, count(*) FILTER (vec_id % 7 = 0) AS missing_b,
  count(*) FILTER (vec_id % 50 = 3 AND vec_id % 7 <> 0) AS truth_mismatch FROM sc"""))
def audit_oof_alignment(spark, folder):
    long = _long_models(spark, folder).where(F.col("model") != "c")
    dropped = long.where(~((F.col("model") == "b") & (F.col("vec_id") % 7 == 0)))
    wrong = (F.col("model") == "a") & (F.col("vec_id") % 50 == 3)
    # Model a carries a wrong truth on some ids; where model b has no row only one truth is seen.
    spoiled = dropped.withColumn("y", F.when(wrong & (F.col("vec_id") % 7 != 0), F.col("y") + 100).otherwise(F.col("y")))
    return joins.alignment_report(joins.align_models(spoiled, ["a", "b"]), ["a", "b"])


_SRC = LABELS[:K][::-1]
_DST = LABELS[:4] + ["web_search"] + LABELS[4:8]


@query("align_class_axis", sql(SCORES, select=f"""
SELECT id, i - 1 AS pos, ({arr(_DST)})[i] AS label,
  round(coalesce(a[list_position({arr(_SRC)}, ({arr(_DST)})[i])], 0.0::DOUBLE), 6) AS p
FROM (SELECT *, unnest(range(1, {len(_DST) + 1})) AS i FROM sc)"""))
def align_class_axis(spark, folder):
    aligned = align(F.col("a"), _SRC, _DST, strict=False)
    rows = derived.class_scores(spark, folder).select("id", F.posexplode_outer(aligned).alias("pos", "p"))
    return rows.select("id", F.col("pos").cast("long").alias("pos"), keys.decode_label(F.col("pos"), _DST).alias("label"),
                       metrics.rounded(F.col("p")).alias("p"))


@query("join_fold_map", sql(SESS, """
fm AS (SELECT id, (('0x' || left(md5(root || '42'), 7))::BIGINT % 5)::INTEGER AS fold FROM sess)
""", select="SELECT sess.id, fm.fold FROM sess JOIN fm USING (id)"))
def join_fold_map(spark, folder):
    rows = _sessions(spark, folder)
    folds = rows.select("id", splits.hash_fold(F.col("root"), 5).alias("fold"))
    return joins.join_strict(rows.select("id"), folds, "id", "fold", "id without fold")


@query("audit_fold_leakage", sql(SESS, """
tr AS (SELECT DISTINCT id, root FROM sess WHERE row_no // 1000000 % 5 <> 0),
va AS (SELECT DISTINCT id, root FROM sess WHERE row_no // 1000000 % 5 = 0 OR (row_no // 1000000 % 5 = 1 AND step > 1)),
au AS (SELECT id AS base_id FROM sess WHERE row_no // 1000000 % 5 IN (1, 2))
""", select="""
SELECT (SELECT count(*) FROM tr) AS train_rows, (SELECT count(*) FROM va) AS valid_rows,
  (SELECT count(*) FROM tr JOIN va USING (id)) AS id_overlap,
  (SELECT count(*) FROM (SELECT DISTINCT root FROM tr) a JOIN (SELECT DISTINCT root FROM va) b USING (root)) AS session_overlap,
  2 * (SELECT count(*) FROM au) AS augmented_rows, (SELECT count(*) FROM (SELECT DISTINCT base_id FROM au) JOIN va ON base_id = id) AS valid_ids_as_base"""))
def audit_fold_leakage(spark, folder):
    rows = derived.sessions(spark, folder).select("id", F.floor(F.col("row_no") / 1000000).alias("conv"))
    step = keys.step_number(F.col("id"))
    train = rows.where(F.col("conv") % 5 != 0).select("id")
    valid = rows.where((F.col("conv") % 5 == 0) | ((F.col("conv") % 5 == 1) & (step > 1))).select("id")
    augmented = rows.where((F.col("conv") % 5).isin(1, 2)).select(
        F.col("id").alias("base_id"), F.explode_outer(F.array(F.lit(1), F.lit(2))).alias("variant")
    )
    report = joins.overlap_report(train, valid, keys.root_session(F.col("id"), "strip"))
    leaks = joins.augmentation_leaks(augmented, valid)
    one = F.lit(1).alias("_one")
    return report.select("*", one).join(leaks.select("*", one), "_one").drop("_one")


@query("join_mined_fold_safe", sql(SESS, """
orig AS (SELECT DISTINCT root, (('0x' || left(md5(root || '42'), 7))::BIGINT % 5)::INTEGER AS fold FROM sess WHERE domain = 'sim'),
m AS (SELECT sess.id || 'm' AS id, sess.root, coalesce(orig.fold, -1) AS fold, orig.fold IS NOT NULL AS root_in_original FROM sess LEFT JOIN orig USING (root))
""", select="""
SELECT id, root, fold, root_in_original,
  CASE WHEN fold >= 0 THEN array_to_string(list_filter([0, 1, 2, 3, 4], lambda f: f <> fold), ',') ELSE '' END AS train_folds FROM m"""))
def join_mined_fold_safe(spark, folder):
    rows = _sessions(spark, folder)
    fold_of_root = rows.where(F.col("domain") == "sim").select("root").distinct().select(
        "root", splits.hash_fold(F.col("root"), 5).alias("fold")
    )
    mined = rows.select(F.concat("id", F.lit("m")).alias("id"), "root")
    placed = joins.place_mined(mined, fold_of_root)
    return placed.withColumn("train_folds", F.array_join(joins.train_folds(F.col("fold"), 5).cast("array<string>"), ","))


@query("cross_candidates", sql(SESS, f"""
c AS (SELECT unnest({arr(INSPECT_MEANING)}) AS candidate, unnest({arr(INSPECT_MEANING.values())}) AS meaning)
""", select=f"""
SELECT id, candidate, 'query: score this candidate for the next inspection action' || chr(10) || '[CANDIDATE]' || chr(10) || 'action=' || candidate
  || chr(10) || 'meaning=' || meaning || chr(10) || '[WORKFLOW_STATE]' || chr(10) || {compact('current_prompt', 650)} AS text
FROM sess CROSS JOIN c"""))
def cross_candidates(spark, folder):
    rows = derived.sessions(spark, folder)
    return joins.with_candidates(rows, INSPECT_MEANING, compact_text(F.col("current_prompt"), 650))


@query("set_union_augmented", sql(SESS, select="""
SELECT id, action AS label, NULL AS variant FROM sess WHERE action IS NOT NULL
UNION ALL SELECT id, action, 1 FROM sess WHERE action IS NOT NULL AND domain = 'au'"""))
def set_union_augmented(spark, folder):
    rows = _sessions(spark, folder).where(F.col("action").isNotNull()).select("id", "domain", F.col("action").alias("label"))
    extra = rows.where(F.col("domain") == "au").select("id", "label", F.lit(1).alias("variant"))
    return joins.append_rows(rows.select("id", "label"), extra)


_SETS = """
t AS (SELECT root FROM sess WHERE row_no // 1000000 % 3 <> 0),
v AS (SELECT root FROM sess WHERE row_no // 1000000 % 2 = 0)
"""


@query("set_intersect_sessions", sql(SESS, _SETS, select="""
SELECT 'both' AS side, root FROM (SELECT root FROM t INTERSECT SELECT root FROM v)
UNION ALL SELECT 'train only', root FROM (SELECT root FROM t EXCEPT SELECT root FROM v)"""))
def set_intersect_sessions(spark, folder):
    rows = _sessions(spark, folder).select("root", F.floor(F.col("row_no") / 1000000).alias("conv"))
    train = rows.where(F.col("conv") % 3 != 0).select("root")
    valid = rows.where(F.col("conv") % 2 == 0).select("root")
    both = train.intersect(valid).select(F.lit("both").alias("side"), "root")
    return both.unionByName(train.subtract(valid).select(F.lit("train only").alias("side"), "root"))


_SNAKE = "CASE WHEN p % 10 < 5 THEN p % 10 ELSE 9 - p % 10 END::INTEGER"


@query("split_group_kfold", sql(SESS, f"""
g AS (SELECT root, count(*) AS size, ('0x' || left(md5(root), 6))::INTEGER % 256 AS salt FROM sess GROUP BY root),
r AS (SELECT *, row_number() OVER (ORDER BY size DESC, salt, root) - 1 AS p FROM g)
""", select=f"""
SELECT root, size, {_SNAKE} AS fold, (('0x' || left(md5(root || '42'), 7))::BIGINT % 5)::INTEGER AS hash_fold FROM r"""))
def split_group_kfold(spark, folder):
    folds = splits.group_kfold(_sessions(spark, folder), 5)
    return folds.withColumn("hash_fold", splits.hash_fold(F.col("root"), 5))


@query("split_stratified_group", sql(STEPS, f"""
c AS (SELECT root, action, count(*) AS n FROM ev GROUP BY ALL),
d AS (SELECT root, sum(n)::BIGINT AS size, arg_min(action, struct_pack(k := -n, a := action)) AS dominant FROM c GROUP BY root),
r AS (SELECT *, row_number() OVER (PARTITION BY dominant ORDER BY size DESC, ('0x' || left(md5(root), 6))::INTEGER % 256, root) - 1 AS p FROM d)
""", select=f"SELECT root, size, dominant, {_SNAKE} AS fold FROM r"))
def split_stratified_group(spark, folder):
    return splits.stratified_group_kfold(
        derived.event_steps(spark, folder).withColumnRenamed("action", "label"), 5
    )


@query("split_stratified_greedy")
def split_stratified_greedy(spark, folder):
    """Folds that balance every label, not only the dominant one of a session."""
    return splits.stratified_group_greedy(
        derived.event_steps(spark, folder).withColumnRenamed("action", "label"), 5, LABELS)
