"""Counts, fold summaries, class weights and audits over labelled rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from sessionloom.functions.probs import argmax
from sessionloom.operators import metrics
from sessionloom.sources.staging import stage

# Steps that inspect rows are reported for.
INSPECT_STEPS = 6


def label_counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def confusion_table(conf: DataFrame, classes: int, labels: DataFrame) -> DataFrame:
    """One row per true class, one column per predicted class, zero-filled.

    labels: one-column frame (y) with every class.
    """
    wide = conf.groupBy("y").pivot("pred", list(range(classes))).agg(F.sum("n")).select(
        "y", *[F.col(str(i)).alias(f"p{i}") for i in range(classes)]
    )
    return labels.join(F.broadcast(wide), "y", "left").fillna(0)


def subset_metrics(df: DataFrame, classes: int, inspect: Sequence[int]) -> DataFrame:
    """The same metrics for each source, each step band, rows after step 1, true inspect rows and these by step 1..6.

    df: domain, step_group, step, y, pred. One count over the table, then count-table work.
    """
    early = F.when(F.col("step").between(1, INSPECT_STEPS), F.col("step")).alias("early")
    conf = df.groupBy("domain", "step_group", (F.col("step") != 1).alias("later"), early, "y", "pred").agg(
        F.count("*").alias("n")
    )
    is_inspect = F.col("y").isin(*inspect)
    names = F.array_compact(
        F.array(
            F.concat(F.lit("src="), "domain"),
            F.concat(F.lit("step_group="), "step_group"),
            F.when(F.col("later"), "step!=1"),
            F.when(is_inspect, "true_inspect4"),
            F.when(is_inspect, F.concat(F.lit("inspect_step="), F.col("early").cast("string"))),
        )
    )
    sliced = conf.select(F.explode_outer(names).alias("subset"), "y", "pred", "n").groupBy("subset", "y", "pred").agg(
        F.sum("n").alias("n")
    )
    per = metrics.per_class(sliced, ["subset"])
    # The inspect slices average over their own labels; the others over all classes.
    own = (F.col("subset") == "true_inspect4") | F.col("subset").startswith("inspect_step=")
    counted = F.when(~own, F.col("f")).when(F.col("label").isin(*inspect), F.col("f"))
    size = F.when(own, len(inspect)).otherwise(classes).cast("double")
    return per.groupBy("subset").agg(
        F.sum("nt").alias("rows"),
        metrics.rounded(F.sum(counted) / F.max(size)).alias("macro_f1"),
        metrics.rounded(F.sum("tp") / F.sum("nt")).alias("accuracy"),
    )


def inspect_step_metrics(df: DataFrame, inspect: Sequence[int]) -> DataFrame:
    """(step, rows, macro-F1 and accuracy of base and ranker) of true inspect rows for each step 1..6.

    df: step, y, base and ranker vectors over the inspect classes (`inner`, `rank`). Both choose among the inspect
    classes alone. One count over (step, y, both choices), then count-table work; steps without rows are left out.
    """
    label = F.array_position(F.array(*[F.lit(int(i)) for i in inspect]), F.col("y")).cast("int") - 1
    rows = df.where(F.col("y").isin(*inspect) & F.col("step").between(1, INSPECT_STEPS))
    counts = stage(
        rows.groupBy("step", label.alias("y"), argmax(F.col("inner")).alias("base"), argmax(F.col("rank")).alias("ranker"))
        .agg(F.count("*").alias("n")), "inspect-steps")
    models = F.explode_outer(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("pred")) for m in ("base", "ranker")]))
    conf = counts.select("step", "y", models.alias("m"), "n").groupBy("step", "m.model", "y", "m.pred").agg(F.sum("n").alias("n"))
    per = metrics.per_class(conf, ["step", "model"]).groupBy("step", "model").agg(
        F.sum("nt").alias("rows"), (F.sum("f") / F.lit(float(len(inspect)))).alias("f"), (F.sum("tp") / F.sum("nt")).alias("a"))
    pick = lambda m, c: metrics.rounded(F.max(F.when(F.col("model") == m, F.col(c))))
    return per.groupBy("step").agg(
        F.max("rows").alias("rows"), pick("base", "f").alias("base_internal_macro_f1"), pick("ranker", "f").alias("ranker_macro_f1"),
        pick("base", "a").alias("base_internal_acc"), pick("ranker", "a").alias("ranker_acc"))


def epoch_summary(per_fold: DataFrame) -> DataFrame:
    """Mean, sample std, min, max per epoch, the best epoch, and mean / population std of fold bests.

    per_fold: fold, epoch, score (one row per fold and epoch).
    """
    per_fold = stage(per_fold, "epochs")
    epochs = per_fold.groupBy("epoch").agg(
        F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"),
        F.min("score").alias("low"), F.max("score").alias("high"),
    )
    best = epochs.agg(F.max(F.struct("mean", (-F.col("epoch")).alias("e"))).alias("b")).select((-F.col("b.e")).alias("best"))
    folds = per_fold.groupBy("fold").agg(F.max("score").alias("s")).agg(
        F.avg("s").alias("fold_mean"), F.stddev_pop("s").alias("fold_std")
    )
    one = F.lit(1).alias("_one")
    return (
        epochs.select("*", one)
        .join(F.broadcast(best.select("*", one)), "_one")
        .join(F.broadcast(folds.select("*", one)), "_one")
        .select(
            "epoch",
            *[metrics.rounded(F.col(c)).alias(c) for c in ("mean", "std", "low", "high")],
            (F.col("epoch") == F.col("best")).alias("is_best"),
            metrics.rounded(F.col("fold_mean")).alias("best_by_fold_mean"),
            metrics.rounded(F.col("fold_std")).alias("best_by_fold_std"),
        )
    )


def majority_baseline(df: DataFrame, y: str = "label") -> DataFrame:
    """Per held-out fold: the majority class of the other folds and its macro-F1 there."""
    counts = stage(df.groupBy("fold", F.col(y).alias("y")).agg(F.count("*").alias("n")), "fold-counts")
    folds = counts.select("fold").distinct()
    # Count table only: every (fold, class) pair, also where a fold lacks the class.
    held = (
        counts.groupBy("y").agg(F.sum("n").alias("total"))
        .select("y", "total", F.lit(1).alias("_one"))
        .join(F.broadcast(folds.withColumn("_one", F.lit(1))), "_one")
        .join(counts, ["fold", "y"], "left")
        .select("fold", "y", (F.col("total") - F.coalesce("n", F.lit(0))).alias("m"))
    )
    major = held.groupBy("fold").agg(F.min(F.struct((-F.col("m")).alias("k"), "y")).alias("b")).select(
        "fold", F.col("b.y").alias("pred")
    )
    conf = counts.join(F.broadcast(major), "fold").select("fold", "y", "pred", "n")
    return metrics.scores(conf, ["fold"]).join(major, "fold").select(
        "fold", F.col("pred").alias("majority"), "rows", F.col("macro_f1").alias("valid_macro_majority")
    )


def fold_balance(df: DataFrame) -> DataFrame:
    """Train and validation rows and sessions per fold (root lies in one fold only)."""
    per_root = df.groupBy("fold", "root").agg(F.count("*").alias("n"))
    per_fold = stage(
        per_root.groupBy("fold").agg(F.sum("n").alias("valid_rows"), F.count("*").alias("valid_sessions")), "fold-balance"
    )
    totals = per_fold.agg(F.sum("valid_rows").alias("r"), F.sum("valid_sessions").alias("s")).withColumn("_one", F.lit(1))
    return per_fold.withColumn("_one", F.lit(1)).join(F.broadcast(totals), "_one").select(
        "fold",
        (F.col("r") - F.col("valid_rows")).alias("train_rows"), "valid_rows",
        (F.col("s") - F.col("valid_sessions")).alias("train_sessions"), "valid_sessions",
    )


def class_weights(df: DataFrame, classes: DataFrame, low: float, high: float) -> DataFrame:
    """n / (K * count), held to [low, high]; classes: one column `label` with every class."""
    counts = stage(df.groupBy("label").agg(F.count("*").alias("n")), "label-counts")
    k = F.lit(float(classes.count()))
    joined = classes.join(F.broadcast(counts), "label", "left").fillna(0, ["n"])
    total = joined.agg(F.sum("n").alias("total")).withColumn("_one", F.lit(1))
    weight = F.col("total") / F.greatest(F.col("n"), F.lit(1)) / k
    return joined.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").select(
        "label", "n",
        metrics.rounded(F.least(F.greatest(weight, F.lit(low)), F.lit(high))).alias("weight"),
    )


def split_roots(df: DataFrame, fold: str = "fold") -> DataFrame:
    """Counts of roots and of roots that lie in more than one fold."""
    per_root = df.groupBy("root").agg(F.min(fold).alias("lo"), F.max(fold).alias("hi"))
    return per_root.agg(
        F.count("*").alias("roots"),
        F.sum(F.when(F.col("lo") != F.col("hi"), 1).otherwise(0)).alias("split_roots"),
    )


def per_class_cap(df: DataFrame, label: str, row_id: str, n: int, seed: str) -> DataFrame:
    """At most n rows per class, chosen by a hash of id and seed (no replacement).

    The rank filter becomes a per-partition group limit before the shuffle, so only
    n rows per class and partition travel.
    """
    order = F.md5(F.concat(F.col(row_id), F.lit(seed)))
    ranked = df.withColumn("_h", order).withColumn(
        "rank", F.row_number().over(Window.partitionBy(label).orderBy("_h", row_id))
    )
    return ranked.where(F.col("rank") <= n).drop("_h")


def manifest(df: DataFrame, splitter: str) -> DataFrame:
    """One row: rows, sessions, folds, classes in order and label counts."""
    counts = df.groupBy("label").agg(F.count("*").alias("n"))
    labels = counts.agg(
        F.sum("n").alias("n_rows"),
        F.count("*").alias("n_classes"),
        F.sort_array(F.collect_list(F.struct("label", "n"))).alias("c"),
    )
    rows = df.agg(F.count_distinct("root").alias("n_sessions"), F.count_distinct("fold").alias("n_folds"))
    one = F.lit(1).alias("_one")
    return labels.select("*", one).join(rows.select("*", one), "_one").select(
        "n_rows", "n_sessions", "n_folds", "n_classes", F.lit(splitter).alias("splitter"),
        F.array_join(F.transform("c", lambda x: x["label"]), ",").alias("classes"),
        F.array_join(F.transform("c", lambda x: F.concat(x["label"], F.lit(":"), x["n"].cast("string"))), ",").alias(
            "label_counts"
        ),
    )
