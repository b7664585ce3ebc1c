"""Small helpers of the operators in this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sessionloom.sources.staging import stage

__all__ = ["components", "connected", "drawn", "numbered", "stage", "with_uid"]


def with_uid(df: DataFrame, label: str, name: str = "_uid") -> DataFrame:
    """The staged rows with a number of their own each; ids of the given tables may repeat or be null."""
    return stage(df.withColumn(name, F.monotonically_increasing_id()), label)


def drawn(df: DataFrame, key: list, n: int) -> DataFrame:
    """About n rows, all if there are no more, by a hash of the key columns; at most 2 n where keys repeat.

    The share to draw comes from the count, so no rows are sorted or gathered.
    """
    total = df.count()
    if total <= n:
        return df
    mark = F.pmod(F.xxhash64(*key, F.lit(17)), F.lit(2**40))
    return df.where(mark < int(2**40 * (n / total))).limit(2 * n)


def numbered(df: DataFrame, order: list, name: str = "position") -> DataFrame:
    """0-based position of each row in the given order, without gathering the rows in one task.

    Rows are dealt into sorted ranges; only the number of rows in each range (one row a partition) is
    summed up in one place.
    """
    ranges = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    staged = stage(ranges, "numbered")
    from pyspark.sql import Window

    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        staged.groupBy("_range").agg(F.count("*").alias("_rows"))
        .select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )
    inner = Window.partitionBy("_range").orderBy(*order)
    return (
        staged.withColumn("_place", F.row_number().over(inner) - 1)
        .join(F.broadcast(offsets), "_range")
        .withColumn(name, F.col("_before") + F.col("_place"))
        .drop("_range", "_place", "_before")
    )


def connected(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root): the smallest node of each component of the undirected edges (a, b).

    Alternates large-star and small-star steps (every node links its larger, then its smaller
    neighbours to the smallest one) until nothing changes; the number of rounds grows with the
    logarithm of the longest chain. A star's centre would gather all its links in one group, so each
    step only needs the smallest neighbour, which is found by an aggregate with partial sums.
    """
    links = stage(edges.where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    for _ in range(rounds):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: larger neighbours go to the smallest one.
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        down = stage(down, "large-star")
        # Small star: smaller neighbours and the node itself go to the smallest one.
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b"), F.col("m")).union(least.select(F.col("a").alias("b"), "m"))
        after = stage(
            small.where("b <> m").select(F.col("m").alias("a"), F.col("b").alias("b")).distinct(), "small-star")
        # A forest of stars: every node has one link, and no centre is itself linked.
        unsettled = after.join(after.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count()
        many = after.groupBy("b").count().where("count > 1").limit(1).count()
        links = after
        if not unsettled and not many:
            break
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component of the undirected edges (a, b); nodes without edges are left out.

    Contracts the graph round by round: every node takes its smallest neighbour, if that is smaller than itself,
    chains of such choices are followed to their ends, and the edges are rewritten to the ends they join; equal ones
    become one. A node that has a smaller neighbour is gone after the round, so the graph shrinks until no edge is left.
    Only the smallest neighbour is ever needed, which is an aggregate with partial results, so a node with very many
    edges is no group; joins put one row of a node table beside its edges.
    """
    left = stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    named = stage(left.select(F.col("a").alias("node")).union(left.select("b")).distinct().withColumn("root", F.col("node")), "nodes")
    while left.limit(1).count():
        # Every larger end has a smaller neighbour; b -> the smallest one.
        up = stage(left.groupBy("b").agg(F.min("a").alias("to")).select(F.col("b").alias("node"), "to"), "parents")
        while True:
            # Pointer jumping: the length of all chains halves each time.
            ahead = up.select(F.col("node").alias("to"), F.col("to").alias("next"))
            up = stage(up.join(ahead, "to", "left").select("node", F.coalesce("next", "to").alias("to")), "parents")
            if not up.join(up.select(F.col("node").alias("to")), "to", "left_semi").limit(1).count():
                break
        named = stage(named.join(up.select(F.col("node").alias("root"), "to"), "root", "left").select(
            "node", F.coalesce("to", "root").alias("root")), "nodes")
        a, b = (up.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in "ab")
        moved = left.join(a, "a", "left").join(b, "b", "left").select(
            F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b")).where("a <> b")
        left = stage(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return named
