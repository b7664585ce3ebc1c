"""Classification metrics from one confusion aggregate (slices, y, pred) -> n.

The full table is read once, by a map-side combined count; everything after it works on
at most slices x K x K rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sessionloom.sources.staging import stage

PLACES = 6


def rounded(value: Column) -> Column:
    return F.round(value, PLACES)


def confusion(df: DataFrame, by: list[str] = (), y: str = "y", pred: str = "pred") -> DataFrame:
    return df.groupBy(*by, F.col(y).alias("y"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def per_class(conf: DataFrame, by: list[str] = ()) -> DataFrame:
    """True count nt, predicted count np, hits tp and F1 per class seen in y or pred."""
    sides = conf.select(
        *by,
        F.explode_outer(
            F.array(
                F.struct(
                    F.col("y").alias("label"), F.col("n").alias("nt"), F.lit(0).cast("long").alias("np"),
                    F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"),
                ),
                F.struct(
                    F.col("pred").alias("label"), F.lit(0).cast("long").alias("nt"), F.col("n").alias("np"),
                    F.lit(0).cast("long").alias("tp"),
                ),
            )
        ).alias("s"),
    ).select(*by, "s.*")
    totals = sides.groupBy(*by, "label").agg(F.sum("nt").alias("nt"), F.sum("np").alias("np"), F.sum("tp").alias("tp"))
    return totals.withColumn("f", 2.0 * F.col("tp") / (F.col("nt") + F.col("np")))


def scores(conf: DataFrame, by: list[str] = (), classes: int | None = None) -> DataFrame:
    """rows, accuracy and macro-F1 per slice.

    classes given: mean over that many listed classes, absent ones count 0.
    classes None:  mean over the classes seen in y or pred.
    """
    f1 = F.sum("f") / F.lit(float(classes)) if classes else F.avg("f")
    return per_class(conf, by).groupBy(*by).agg(
        F.sum("nt").alias("rows"),
        rounded(F.sum("tp") / F.sum("nt")).alias("accuracy"),
        rounded(f1).alias("macro_f1"),
    )


def with_grouping_sets(conf: DataFrame, sets: list[list[str]], columns: list[str]) -> DataFrame:
    """Confusion counts for each grouping set; columns outside a set hold 'all'."""
    aliased = conf
    for c in columns:
        aliased = aliased.withColumn(c, F.col(c).cast("string"))
    expand = F.explode_outer(
        F.array(*[
            F.struct(*[(F.col(c) if c in s else F.lit("all")).alias(c) for c in columns]) for s in sets
        ])
    ).alias("_s")
    flat = aliased.select(expand, "y", "pred", "n").select(*[F.col(f"_s.{c}").alias(c) for c in columns], "y", "pred", "n")
    return flat.groupBy(*columns, "y", "pred").agg(F.sum("n").alias("n"))


def class_report(conf: DataFrame, labels: DataFrame) -> DataFrame:
    """Precision, recall, F1, support per listed class plus accuracy and averages."""
    stats = stage(labels.join(F.broadcast(per_class(conf)), "label", "left").fillna(0), "class-report")
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    per = stats.select(
        "label",
        ratio(F.col("tp"), F.col("np")).alias("precision"),
        ratio(F.col("tp"), F.col("nt")).alias("recall"),
        ratio(2.0 * F.col("tp"), F.col("nt") + F.col("np")).alias("f1"),
        F.col("nt").alias("support"),
        "tp",
    )
    cols = ["precision", "recall", "f1"]
    rows = per.select("label", *cols, "support")
    macro = per.agg(*[F.avg(c).alias(c) for c in cols], F.sum("support").alias("support")).withColumn(
        "label", F.lit("macro avg")
    )
    weighted = per.agg(
        *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in cols],
        F.sum("support").alias("support"),
    ).withColumn("label", F.lit("weighted avg"))
    accuracy = per.agg(
        *[(F.sum("tp") / F.sum("support")).alias(c) for c in cols], F.sum("support").alias("support")
    ).withColumn("label", F.lit("accuracy"))
    out = rows.unionByName(macro).unionByName(weighted).unionByName(accuracy)
    return out.select("label", *[rounded(F.col(c)).alias(c) for c in cols], "support")
