"""Label, fold and model-output joins, leakage audits and candidate expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sessionloom.schema import lookup, strings


def require(value: Column, message: str, key: Column) -> Column:
    """value, or an error naming the key when it is null; checked in the same pass."""
    return F.coalesce(value, F.raise_error(F.concat(F.lit(message + ": "), key.cast("string"))))


def join_strict(rows: DataFrame, labels: DataFrame, key: str, value: str, message: str) -> DataFrame:
    """Left join in which every row must find its value."""
    joined = rows.join(labels.select(key, F.col(value).alias("_v")), key, "left")
    return joined.withColumn(value, require(F.col("_v"), message, F.col(key))).drop("_v")


def join_lenient(
    rows: DataFrame, labels: DataFrame, key: str, value: str, prefix: str | None = None, keep: list[str] | None = None
) -> DataFrame:
    """Inner join; rows without a label, outside the id prefix or the kept labels are dropped.

    The filters are put below the join on both sides.
    """
    if prefix:
        rows = rows.where(F.col(key).startswith(prefix))
        labels = labels.where(F.col(key).startswith(prefix))
    if keep:
        labels = labels.where(F.col(value).isin(*keep))
    return rows.join(labels.select(key, value), key)


def align_models(long: DataFrame, models: list[str]) -> DataFrame:
    """One row per id with each model's vector, from a long (id, model, y, proba) table.

    A single grouped pass replaces one join per model. `truths` counts distinct y values
    seen for the id and must be 1; a missing model leaves null.
    """
    return long.groupBy("id").agg(
        F.min("y").alias("y"),
        F.max("y").alias("_y_hi"),
        *[F.max(F.when(F.col("model") == m, F.col("proba"))).alias(m) for m in models],
    )


def strict_alignment(aligned: DataFrame, models: list[str]) -> DataFrame:
    """Fail on a missing model row or on truth that differs between models."""
    out = aligned.withColumn(
        "y",
        F.when(F.col("y") == F.col("_y_hi"), F.col("y")).otherwise(
            F.raise_error(F.concat(F.lit("truth differs: "), "id"))
        ),
    )
    for m in models:
        out = out.withColumn(m, require(F.col(m), f"model {m} misses id", F.col("id")))
    return out.drop("_y_hi")


def alignment_report(aligned: DataFrame, models: list[str]) -> DataFrame:
    return aligned.agg(
        F.count("*").alias("rows"),
        *[F.count_if(F.col(m).isNull()).alias(f"missing_{m}") for m in models],
        F.count_if(F.col("y") != F.col("_y_hi")).alias("truth_mismatch"),
    )


def overlap_report(train: DataFrame, valid: DataFrame, root: Column) -> DataFrame:
    """Distinct ids and sessions of both sides and how many they share.

    train and valid: one column `id`. One grouped pass for ids, one for sessions.
    """
    sides = train.select("id", F.lit(1).alias("t"), F.lit(0).alias("v")).unionByName(
        valid.select("id", F.lit(0).alias("t"), F.lit(1).alias("v"))
    )
    ids = sides.groupBy("id").agg(F.max("t").alias("t"), F.max("v").alias("v"))
    roots = ids.groupBy(root.alias("root")).agg(F.max("t").alias("t"), F.max("v").alias("v"))
    both = F.sum(F.col("t") * F.col("v"))
    one = F.lit(1).alias("_one")
    return (
        ids.agg(F.sum("t").alias("train_rows"), F.sum("v").alias("valid_rows"), both.alias("id_overlap"), one)
        .join(roots.agg(both.alias("session_overlap"), one), "_one")
        .drop("_one")
    )


def augmentation_leaks(augmented: DataFrame, valid: DataFrame) -> DataFrame:
    """Augmented rows and validation ids used as an augmentation base."""
    base = augmented.groupBy("base_id").agg(F.count("*").alias("n"))
    hit = valid.select(F.col("id").alias("base_id")).distinct().withColumn("hit", F.lit(1))
    return base.join(hit, "base_id", "left").agg(
        F.sum("n").alias("augmented_rows"), F.sum(F.coalesce("hit", F.lit(0))).alias("valid_ids_as_base")
    )


def place_mined(mined: DataFrame, fold_of_root: DataFrame) -> DataFrame:
    """Give each mined row the fold of its root in the original data, -1 when unknown."""
    return mined.join(fold_of_root, "root", "left").select(
        "id", "root",
        F.coalesce("fold", F.lit(-1)).alias("fold"),
        F.col("fold").isNotNull().alias("root_in_original"),
    )


def train_folds(fold: Column, folds: int) -> Column:
    """Folds a mined row may train: all but its own, none when its root is unknown."""
    every = F.sequence(F.lit(0), F.lit(folds - 1))
    return F.when(fold >= 0, F.filter(every, lambda f: f != fold)).otherwise(F.array().cast("array<int>"))


def with_candidates(rows: DataFrame, candidates: dict[str, str], state: Column) -> DataFrame:
    """Each row once per candidate, with the text to score. The list is a literal: no join."""
    expanded = rows.select("id", state.alias("_state"), F.explode_outer(strings(candidates)).alias("candidate"))
    text = F.concat_ws(
        "\n",
        F.lit("query: score this candidate for the next inspection action"),
        F.lit("[CANDIDATE]"),
        F.concat(F.lit("action="), "candidate"),
        F.concat(F.lit("meaning="), F.element_at(lookup(candidates), F.col("candidate"))),
        F.lit("[WORKFLOW_STATE]"),
        F.col("_state"),
    )
    return expanded.select("id", "candidate", text.alias("text"))


def append_rows(original: DataFrame, extra: DataFrame) -> DataFrame:
    """Originals followed by mined or augmented rows; absent columns become null."""
    return original.unionByName(extra, allowMissingColumns=True)
