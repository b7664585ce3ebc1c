"""What a row needs to know of all earlier rows of its key, without a copy of them.

A history that is copied to every row grows with the square of a key's length. Most sequence functions read only sums
over it, its newest row of some kind, or its last few rows of some kind; these are running values, and a table of
them grows with the rows. A key with very many rows is cut into buckets, each of which hands its sums, newest rows and
tails to the later ones through a table with one row for each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sessionloom.operators.ordered import HEAVY_ROWS, last_items
from sessionloom.sources.staging import small, stage


def running(
    df: DataFrame, key: str, order: list[str], bucket: Column, sums: dict[str, Column] | None = None,
    newest: dict[str, tuple[Column, Column]] | None = None, tails: dict[str, tuple[Column, Column, int]] | None = None,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Adds to each row running values over the rows of its key before it in the given order.

    sums: name -> number added up (null counts as 0). newest: name -> (test, value), the value of the newest row that
    passes, null without one. tails: name -> (test, value, k), the values of the last k rows that pass, oldest first; a row
    whose test is null does not pass. bucket: a never-null integer that grows with the order; only keys with
    more than heavy_rows rows use it. Rows equal in the whole order are interchangeable. A null key is a key.
    """
    sums, newest, tails = sums or {}, newest or {}, tails or {}
    place = F.struct(*[F.col(o) for o in order])
    heavy = stage(
        df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > heavy_rows).select(F.col(key).alias("_k"), F.lit(True).alias("_heavy")),
        "heavy-keys")
    split = not heavy.isEmpty()
    marked = df
    if split:
        marked = df.join(small(heavy), F.col(key).eqNullSafe(F.col("_k")), "left").withColumn(
            "_bucket", F.when(F.col("_heavy"), bucket).otherwise(F.lit(-1))).drop("_k", "_heavy")
    part = [key, "_bucket"] if split else [key]
    # The tail that ends with each passing row, within the passing rows of its part.
    for name, (test, value, k) in tails.items():
        own = Window.partitionBy(*part, f"_is_{name}").orderBy(*order)
        marked = marked.withColumn(f"_is_{name}", F.coalesce(test, F.lit(False))).withColumn(
            f"_to_{name}", F.when(F.col(f"_is_{name}"), F.collect_list(F.struct(value.alias("v"))).over(own.rowsBetween(1 - k, 0))))
    upto = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    cells = {f"_s_{n}": F.coalesce(F.sum(v).over(upto), F.lit(0)) for n, v in sums.items()}
    cells |= {f"_l_{n}": F.last(F.when(t, F.struct(v.alias("v"))), ignorenulls=True).over(upto) for n, (t, v) in newest.items()}
    cells |= {f"_t_{n}": F.last(f"_to_{n}", ignorenulls=True).over(upto) for n in tails}
    rows = marked.withColumns(cells)
    drop = [*cells, *[f"_is_{n}" for n in tails], *[f"_to_{n}" for n in tails]]
    if not split:
        made = {n: F.col(f"_s_{n}") for n in sums} | {n: F.col(f"_l_{n}.v") for n in newest}
        made |= {n: _values(F.col(f"_t_{n}")) for n in tails}
        return rows.withColumns(made).drop(*drop)
    rows = stage(rows, "running")
    facts = [F.sum(v).alias(f"_s_{n}") for n, v in sums.items()]
    facts += [F.max_by(F.struct(v.alias("v")), F.when(t, place)).alias(f"_l_{n}") for n, (t, v) in newest.items()]
    facts += [F.max_by(f"_to_{n}", F.when(F.col(f"_is_{n}"), place)).alias(f"_t_{n}") for n in tails]
    totals = rows.groupBy(key, "_bucket").agg(F.count("*").alias("_rows"), *facts)
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    handed = totals.select(
        F.col(key).alias("_k"), F.col("_bucket").alias("_b"),
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_bs_{n}") for n in sums],
        *[F.last(f"_l_{n}", ignorenulls=True).over(before).alias(f"_bl_{n}") for n in newest],
        *[last_items(F.flatten(F.collect_list(f"_t_{n}").over(before)), k).alias(f"_bt_{n}") for n, (*_, k) in tails.items()])
    joined = rows.join(handed, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_bucket") == F.col("_b")))
    made = {n: F.col(f"_bs_{n}") + F.col(f"_s_{n}") for n in sums}
    made |= {n: F.coalesce(f"_l_{n}", f"_bl_{n}")["v"] for n in newest}
    made |= {n: _values(last_items(F.concat(f"_bt_{n}", F.coalesce(f"_t_{n}", F.slice(f"_bt_{n}", 1, 0))), k)) for n, (*_, k) in tails.items()}
    inner = [c for n in sums for c in (f"_bs_{n}",)] + [f"_bl_{n}" for n in newest] + [f"_bt_{n}" for n in tails]
    return joined.withColumns(made).drop(*drop, *inner, "_k", "_b", "_bucket")


def _values(tail: Column) -> Column:
    """Values of a tail; an empty array where there is none."""
    return F.coalesce(F.transform(tail, lambda t: t["v"]), F.array())
