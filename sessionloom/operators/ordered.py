"""Ordered per-key history that does not put one heavy key into one task.

A plain window over a key sorts all its rows in one task, so a key holding a third
of the table is a third of the table in one task. Keys with many rows are therefore cut
into time buckets: their rows are numbered inside (key, bucket), and each bucket hands its
row count and its last k values to the later ones through a table with one row per
(key, bucket), bounded by the number of buckets, not by the rows. All other keys keep a
single bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sessionloom.sources.staging import small, stage

# Keys with more rows than this are cut into buckets.
HEAVY_ROWS = 1_000_000


def numbered(df: DataFrame, order: list, name: str = "position") -> DataFrame:
    """0-based position of each row in the given order, without gathering the rows in one task.

    Rows are dealt into sorted ranges; only the number of rows in each range is summed up in one place.
    """
    ranges = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    staged = stage(ranges, "numbered")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = staged.groupBy("_range").agg(F.count("*").alias("_rows")).select(
        "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("_range").orderBy(*order)
    placed = staged.withColumn("_place", F.row_number().over(inner) - 1).join(F.broadcast(offsets), "_range")
    return placed.withColumn(name, F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")


def last_items(values: Column, k: int) -> Column:
    """The last k array elements (slice with a negative start loses short arrays)."""
    return F.slice(values, F.greatest(F.size(values) - k, F.lit(0)) + 1, F.lit(k))


def with_ordered_history(
    df: DataFrame,
    key: str,
    order: list[str],
    bucket: Column,
    value: str,
    k: int,
    step: str = "step",
    history: str = "actions",
    first: str = "first_action",
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Add the 1-based position of each row in its key, its previous k values and the key's first earlier value.

    bucket: a never-null integer that grows with the order, such as the hour of the event.
    """
    heavy = stage(
        df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > heavy_rows).select(key, F.lit(True).alias("_heavy")),
        "heavy-keys",
    )
    if heavy.isEmpty():
        whole = Window.partitionBy(key).orderBy(*order)
        return df.withColumn(step, F.row_number().over(whole)).withColumn(
            history, F.collect_list(value).over(whole.rowsBetween(-k, -1))
        ).withColumn(first, F.first(value, ignorenulls=True).over(whole.rowsBetween(Window.unboundedPreceding, -1)))
    marked = df.join(small(heavy), key, "left")
    # Light keys share the bucket -1, so only heavy ones reach the hand-over with many rows.
    return _handed_over(
        marked.withColumn("_bucket", F.when(F.col("_heavy"), bucket).otherwise(-1)).drop("_heavy"),
        key, order, value, k, step, history, first,
    )


def _handed_over(
    rows: DataFrame, key: str, order: list[str], value: str, k: int, step: str, history: str, first: str
) -> DataFrame:
    inner = Window.partitionBy(key, "_bucket").orderBy(*order)
    rows = rows.withColumn("_rn", F.row_number().over(inner)).withColumn(
        "_prev", F.collect_list(value).over(inner.rowsBetween(-k, -1))
    ).withColumn("_early", F.first(value, ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, -1)))
    tails = rows.groupBy(key, "_bucket").agg(
        F.max("_rn").alias("_n"),
        F.max_by(last_items(F.concat("_prev", F.when(F.col(value).isNull(), F.array().cast("array<string>")).otherwise(F.array(value))), k), "_rn").alias("_tail"),
        F.max_by(F.coalesce("_early", value), "_rn").alias("_begin"),
    )
    across = Window.partitionBy(key).orderBy("_bucket")
    carried = tails.select(
        key,
        "_bucket",
        F.coalesce(F.sum("_n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.flatten(F.collect_list("_tail").over(across.rowsBetween(-k, -1))).alias("_carried"),
        F.first("_begin", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_first"),
    )
    return (
        rows.join(carried, [key, "_bucket"])
        .withColumn(step, F.col("_before") + F.col("_rn"))
        .withColumn(history, last_items(F.concat("_carried", "_prev"), k))
        .withColumn(first, F.coalesce("_first", "_early"))
        .drop("_bucket", "_rn", "_prev", "_early", "_before", "_carried", "_first")
    )
