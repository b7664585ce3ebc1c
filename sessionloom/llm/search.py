"""Exact top-k inner products by a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it. Sorted by that key, the vectors are cut into
cells (annuli of one pivot) of bounded size, stored as matrices. By the triangle inequality a query's distance to
all vectors of a cell is at least what its own distance to the pivot lies outside the annulus, which bounds the inner
product from above. A first round searches each query's most promising cells; the second all cells whose bound
reaches the k-th score found so far. Nothing else can hold a better vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sessionloom.llm.common import drawn, stage

# Vectors of a cell and queries of a group: bounds the memory of a product.
CELL, GROUP = 2048, 512
# Rows for each pivot, and about the most pivots: vectors drawn by a hash of their id, a bounded sample.
PER_PIVOT, PIVOTS = 4096, 512
# Cells whose summaries (a few numbers each) are weighed in one pass; more cells take more passes.
SUMMARY_ROWS = 50_000
# Cells searched in the first round by each query.
FIRST = 1


def quantised(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    """floor(scale * x) of each component; vectors that are null or not finite throughout are left out."""
    for batch in batches:
        uid, ids, query, vectors = batch.columns
        out = []
        for v in vectors.to_pylist():
            ok = v is not None and all(x is not None for x in v)
            a = np.floor(scale * np.array(v, dtype=np.float64)) if ok else None
            out.append(a.tobytes() if ok and np.isfinite(a).all() else None)
        packed = pa.array(out, pa.binary())
        keep = packed.is_valid()
        yield pa.RecordBatch.from_arrays(
            [c.filter(keep) for c in (uid, ids, query, packed)], names=["_uid", "_id", "_query", "v"])


def matrix(rows: list[bytes], width: int) -> np.ndarray:
    """Rows as one matrix; shorter vectors are padded with zeros, which add nothing to a product."""
    if all(len(r) == 8 * width for r in rows):
        return np.frombuffer(b"".join(rows), dtype=np.float64).reshape(len(rows), width)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r) // 8] = np.frombuffer(r, dtype=np.float64)
    return out


def keyed(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """Adds the nearest pivot and the distance to it."""
    for batch in batches:
        x = matrix(batch.column(3).to_pylist(), width)
        near, dist = np.zeros(len(x), dtype=np.int32), np.zeros(len(x))
        for lo in range(0, len(x), 4096):
            part = x[lo : lo + 4096]
            square = (part**2).sum(1)[:, None] - 2 * part @ pivots.T + (pivots**2).sum(1)[None, :]
            near[lo : lo + 4096] = square.argmin(1)
            dist[lo : lo + 4096] = np.sqrt(((part - pivots[near[lo : lo + 4096]]) ** 2).sum(1))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(near), pa.array(dist)], names=[*batch.schema.names, "pivot", "dist"])


PACK = "block string, pivot int, low double, high double, norm double, n int, ids binary, uids binary, rows binary"


def _packed(chunk: pd.DataFrame, width: int, name: str) -> dict:
    x = matrix(chunk["v"].tolist(), width)
    return {
        "block": name, "pivot": int(chunk["pivot"].iloc[0]), "low": chunk["dist"].min(), "high": chunk["dist"].max(),
        "norm": float((x**2).sum(1).max()), "n": len(chunk), "ids": chunk["_id"].to_numpy(np.int64).tobytes(),
        "uids": chunk["_uid"].to_numpy(np.int64).tobytes(), "rows": x.tobytes(),
    }


def pack(width: int, size: int, by_pivot: bool):
    """Cuts a sorted partition into blocks of at most `size` rows, of one pivot each if `by_pivot`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, number, rest = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            out = []
            while len(rest):
                end = min(size, len(rest))
                if by_pivot:
                    other = np.flatnonzero(rest["pivot"].to_numpy()[:end] != rest["pivot"].iloc[0])
                    end = int(other[0]) if len(other) else end
                if end == len(rest) and end < size:
                    break  # may go on in the next batch
                out.append(_packed(rest.iloc[:end], width, f"{part}-{number}"))
                rest, number = rest.iloc[end:], number + 1
            if out:
                yield pd.DataFrame(out)
        if rest is not None and len(rest):
            yield pd.DataFrame([_packed(rest, width, f"{part}-{number}")])

    return run


def bounds(q: np.ndarray, pivots: np.ndarray, cells: dict[str, np.ndarray]) -> np.ndarray:
    """Largest possible inner product of each query with each cell."""
    square = (q**2).sum(1)
    to_pivot = np.sqrt(np.maximum(0, square[:, None] - 2 * q @ pivots.T + (pivots**2).sum(1)[None, :]))
    d = to_pivot[:, cells["pivot"]]
    gap = np.maximum(0, np.maximum(d - cells["high"], cells["low"] - d) - 1e-6 * (1 + d))
    by_triangle = (square[:, None] + cells["norm"] - gap**2) / 2
    by_length = np.sqrt(square[:, None] * cells["norm"])
    return np.minimum(by_triangle, by_length) + 1e-6 * (1 + np.sqrt(square)[:, None])


def route(pivots: np.ndarray, cells: dict[str, np.ndarray], width: int, first: bool):
    """(group, cell) pairs to search: each query's best cells, or all that reach its k-th score."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                q = np.frombuffer(row.rows, dtype=np.float64).reshape(-1, width)
                limit = bounds(q, pivots, cells)
                if first:
                    best = np.argsort(-limit, axis=1, kind="stable")[:, :FIRST]
                    chosen = np.unique(best)
                else:
                    reached = np.frombuffer(row.kth, dtype=np.float64)
                    chosen = np.flatnonzero((limit >= reached[:, None]).any(axis=0))
                yield pd.DataFrame({"grp": row.block, "cell": cells["block"][chosen]})

    return run


def top(scores: np.ndarray, own: np.ndarray, ids: np.ndarray, uids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, place) of each query's k best, ties by id, then by row; `own` marks cells that don't count."""
    lowest = -np.inf if scores.dtype.kind == "f" else np.iinfo(scores.dtype).min
    held = np.where(own, lowest, scores)
    at = max(0, held.shape[1] - k)
    kth = np.partition(held, at, axis=1)[:, at]
    row, col = np.nonzero((held >= kth[:, None]) & ~own)
    # Whole numbers are ranked as such: beyond 2**53 neighbours would be one double. ~x turns their order round.
    down = ~held[row, col] if held.dtype.kind == "i" else -held[row, col]
    order = np.lexsort((uids[col], ids[col], down, row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def products(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ranks, values): exact inner products of whole numbers, and numbers in the same order that arrays can compare.

    Doubles where all sums are below 2**53, 64-bit integers below 2**63, Python's own integers beyond.
    """
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if largest < 2**53:
        scores = q @ x.T
        return scores, scores
    if largest < 2**62:
        scores = q.astype(np.int64) @ x.T.astype(np.int64)
        return scores, scores
    whole = lambda m: np.array([[int(v) for v in r] for r in m], dtype=object).reshape(m.shape)
    scores = whole(q).dot(whole(x).T)
    order = {v: i for i, v in enumerate(sorted(set(scores.ravel())))}
    return np.array([order[v] for v in scores.ravel()], dtype=np.int64).reshape(scores.shape), scores


def search(width: int, k: int):
    """Products of a query group with a cell: the k best of each query."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                q = np.frombuffer(r.q_rows, dtype=np.float64).reshape(-1, width)
                x = np.frombuffer(r.rows, dtype=np.float64).reshape(-1, width)
                ranks, exact = products(q, x)
                q_ids, q_uids = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.q_uids, np.int64)
                ids, uids = np.frombuffer(r.ids, np.int64), np.frombuffer(r.uids, np.int64)
                row, col = top(ranks, q_uids[:, None] == uids[None, :], ids, uids, k)
                yield pd.DataFrame({
                    "grp": r.grp, "query_uid": q_uids[row], "query_id": q_ids[row], "vec_id": ids[col],
                    "uid": uids[col], "score": [_long(v) for v in exact[row, col].tolist()],
                })

    return run


def _long(score) -> int:
    if not -(2**63) <= score < 2**63:
        raise OverflowError("a score among the best does not fit in 64 bits")
    return int(score)


FOUND = "grp string, query_uid long, query_id long, vec_id long, uid long, score long"


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query row's k largest integer inner products.

    Components become floor(scale * x). `is_query` marks the query rows; candidates are all rows but the
    query's own. Ties go to the smaller id. Vectors that are null, or hold null or non-finite components,
    and rows without an id take no part; vectors of unequal length meet as if padded with zeros. Repeated
    ids are rows of their own. An empty table, or one without queries, gives no rows. Scores are exact; one among the
    best that a long can't hold is an error. Vectors whose scaled components leave the range of doubles take no part.
    """
    spark = vectors.sparkSession
    kind = vectors.select(F.col(id_col).cast("long").alias("_id"), is_query.alias("_query"),
                          F.col(vector_col).cast("array<double>").alias("v")).where("_id is not null")
    numbered = kind.select(F.monotonically_increasing_id().alias("_uid"), "*")
    flat = stage(
        numbered.mapInArrow(lambda b: quantised(b, scale), "_uid long, _id long, _query boolean, v binary"), "vectors")
    sums = flat.agg(F.count("*").alias("n"), F.max(F.length("v")).alias("w")).first()
    result = "query_id long, rank int, vec_id long, score long"
    if not sums["n"]:
        return spark.createDataFrame([], result)
    width = max(1, sums["w"] // 8)
    wanted = max(1, min(PIVOTS, sums["n"] // PER_PIVOT))
    chosen = drawn(flat.select("_id", "_uid", "v"), ["_id", "_uid"], wanted).limit(2 * wanted).select("v").collect()
    chosen = chosen or flat.select("v").limit(1).collect()
    pivots = matrix([bytes(r["v"]) for r in chosen], width)
    sent = spark.sparkContext.broadcast(pivots)
    with_key = stage(
        flat.mapInArrow(lambda b: keyed(b, sent.value, width),
                        "_uid long, _id long, _query boolean, v binary, pivot int, dist double"), "keyed")
    order = ["pivot", "dist", "_id", "_uid"]
    cells = stage(
        with_key.repartitionByRange(*order).sortWithinPartitions(*order)
        .mapInPandas(pack(width, CELL, True), PACK), "cells")
    groups = stage(
        with_key.where("_query").repartitionByRange(*order).sortWithinPartitions(*order)
        .mapInPandas(pack(width, GROUP, False), PACK), "groups")

    def pairs(rows: DataFrame, first: bool) -> DataFrame:
        """Routes the groups against all cell summaries, a bounded number of summaries at a time."""
        summary = cells.select("block", "pivot", "low", "high", "norm")
        n = cells.count()
        slices = -(-n // SUMMARY_ROWS)
        out = None
        for i in range(slices):
            part = summary.where(F.pmod(F.xxhash64("block"), F.lit(slices)) == i).toPandas()
            held = spark.sparkContext.broadcast({c: part[c].to_numpy() for c in part.columns})
            routed = rows.mapInPandas(
                lambda b, held=held: route(sent.value, held.value, width, first)(b), "grp string, cell string")
            out = routed if out is None else out.union(routed)
        return stage(out, "pairs")

    def searched(todo: DataFrame) -> DataFrame:
        queries = groups.select(F.col("block").alias("grp"), F.col("rows").alias("q_rows"),
                                F.col("ids").alias("q_ids"), F.col("uids").alias("q_uids"))
        data = cells.select(F.col("block").alias("cell"), "rows", "ids", "uids")
        met = todo.join(data, "cell").join(queries, "grp")
        return stage(_best(met.mapInPandas(search(width, k), FOUND), k).drop("rank"), "found")

    if not groups.limit(1).count():
        return spark.createDataFrame([], result)
    begun = pairs(groups.select("block", "rows"), True)
    near = searched(begun)
    # The k-th score of each query so far, packed in the order of its group; -inf where fewer were found.
    last = near.groupBy("query_uid").agg(F.count("*").alias("c"), F.min("score").alias("s"))
    place = groups.select("block", "uids").mapInPandas(_places, "block string, at long, query_uid long")
    reached = place.join(last.where(F.col("c") >= k), "query_uid", "left").groupBy("block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("s").cast("double").alias("s")))),
                    lambda x: F.coalesce(x["s"], F.lit(float("-inf")))).alias("kth"))
    more = groups.select("block", "rows").join(
        reached.mapInPandas(_pack_doubles, "block string, kth binary"), "block")
    rest = pairs(more, False).join(begun, ["grp", "cell"], "left_anti")
    best = _best(near.union(searched(rest)), k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(block, at, query_uid) of the rows of packed groups."""
    for b in batches:
        for r in b.itertuples():
            uids = np.frombuffer(r.uids, np.int64)
            yield pd.DataFrame({"block": r.block, "at": np.arange(len(uids)), "query_uid": uids})


def _pack_doubles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"block": b["block"], "kth": [np.asarray(x, dtype=np.float64).tobytes() for x in b["kth"]]})
