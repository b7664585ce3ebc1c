"""Mixing sources to target weights by pivotal dependent rounding.

A source's documents share one real number of copies, target / size. Its whole part is taken as it is. The
fractions are rounded in pairs: mass moves at random from one document to the other, weighed by their sizes so
that the words taken stay the same, until one fraction is 0 or 1. Each chunk of a source leaves one unrounded
document; those meet in the next level of a reduction tree, down to one for each source.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sessionloom.llm.common import numbered, stage
from sessionloom.sources.staging import small

# Documents of a source that one task rounds, and residuals that meet at each level of the tree.
CHUNK = 1024
# Most copies of a document.
CAP = 3
# Weights of the sources in turn.
WEIGHTS = (5, 2, 1)

def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, cap: int = CAP
) -> DataFrame:
    """(source, n, source_size, weight, target): words to take from each source.

    `sizes` has (source, size). Sources by code point, null last, weigh `weights` in turn and share
    `share` of all words; targets stop at `cap` times a source's size and the excess goes to the others
    by weight, until none is above. Only two sums a round reach the driver.
    """
    sources = sizes.groupBy("source").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    placed = numbered(sources, [F.col("source").isNull(), F.col("source")])
    table = F.array(*[F.lit(w) for w in weights])
    placed = stage(placed.select(
        "source", "n", "source_size",
        F.element_at(table, (F.col("position") % len(weights) + 1).cast("int")).alias("weight")), "sources")
    total = (placed.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = 0.0, -1
    while total:
        above = F.col("weight") * F.lit(level) > F.col("source_size") * cap
        row = placed.agg(
            F.sum(F.when(above, F.col("source_size"))).alias("full"), F.count(F.when(above, 1)).alias("n"),
            F.sum(F.when(~above, F.col("weight"))).alias("open")).first()
        if row["n"] == capped or not row["open"]:
            break
        capped = row["n"]
        level = (total - (row["full"] or 0) * cap) / row["open"]
    return placed.withColumn("target", F.least(
        F.col("weight") * F.lit(float(level)), (F.col("source_size") * cap).cast("double")))


def _pivot(rows: pd.DataFrame, seed: int, last: bool) -> pd.DataFrame:
    """Rounds the fractions of one chunk; at most one stays open, none if `last`."""
    rows = rows.sort_values(["_row"], kind="stable").reset_index(drop=True)
    if not len(rows):
        return rows
    rng = np.random.default_rng([seed & 0x7FFFFFFF, len(rows), int(rows["_row"].iloc[0]) & 0x7FFFFFFFFFFFFFFF])
    p, w, draws = rows["_p"].to_numpy().copy(), rows["size"].to_numpy(), rng.random(len(rows) + 1)
    near, j = 1e-9, -1
    for i in np.flatnonzero((p > 0) & (p < 1)):
        if j < 0:
            j = i
            continue
        ratio = w[i] / w[j]
        up = min(1 - p[i], p[j] / ratio)
        down = min(p[i], (1 - p[j]) / ratio)
        if draws[i] * (up + down) < down:
            p[i], p[j] = p[i] + up, p[j] - up * ratio
        else:
            p[i], p[j] = p[i] - down, p[j] + down * ratio
        for x in (i, j):
            p[x] = 0.0 if p[x] < near else 1.0 if p[x] > 1 - near else p[x]
        if 0 < p[i] < 1:
            j = i
        elif not 0 < p[j] < 1:
            j = -1
    if last and j >= 0:
        p[j] = 1.0 if draws[-1] < p[j] else 0.0
    rows["_p"] = p
    return rows


def _rounder(seed: int, last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return _pivot(rows, seed, last)

    return run


def _spread(rows: DataFrame) -> DataFrame:
    """Adds _chunk, by a hash of _row (that of id and size) and, for rows that repeat it, of their number among these.

    Equal rows are interchangeable, so which of them gets which number changes nothing; numbered, they go to as many
    chunks as other rows do. They are numbered without gathering them in one task.
    """
    held = stage(rows.withColumn("_uid", F.monotonically_increasing_id()), "mix-rows")
    again = stage(held.groupBy("_row").agg(F.count("*").alias("_n")).where("_n > 1").select("_row"), "mix-repeats")
    if not again.limit(1).count():
        return held.drop("_uid").withColumn("_chunk", F.pmod(F.xxhash64("_row"), F.col("_chunks")))
    placed = stage(numbered(held.select("_row", "_uid").join(small(again), "_row"), [F.col("_row"), F.col("_uid")], "_at"), "mix-places")
    first = placed.groupBy("_row").agg(F.min("_at").alias("_first"))
    salts = placed.join(first, "_row").select("_uid", (F.col("_at") - F.col("_first")).alias("_salt"))
    key = F.when(F.col("_salt") > 0, F.xxhash64("_row", "_salt")).otherwise(F.xxhash64("_row"))
    return held.join(salts, "_uid", "left").withColumn("_chunk", F.pmod(key, F.col("_chunks"))).drop("_uid", "_salt")


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, seed: int = 7, carry: tuple[str, ...] = (),
) -> DataFrame:
    """(id, source, *carry, size, source_size, target, copies, taken) for each row.

    The size of a document is its number of space-separated words, 0 for a null text. Every row takes
    part by itself, also those with null or repeated ids; equal rows are interchangeable. Documents
    without words are taken once or not at all and count nothing. Draws depend on ids, sizes and the
    seed alone, so reruns agree however the table is dealt out. A null source is a source of its own. Texts
    are read once and not shuffled (unless carried); `carry` names columns to keep.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    narrow = stage(docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"),
        *[F.col(c).alias(f"_carry_{c}") for c in carry]), "sizes")
    targets = stage(source_targets(narrow.select("source", "size"), weights, share), "targets")
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(CAP)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    known = targets.withColumn("_rate", rate).withColumn("_chunks", F.ceil(F.col("n") / CHUNK))
    same = narrow["source"].eqNullSafe(known["source"])
    # One row a source; Spark broadcasts it where its size allows.
    joined = narrow.join(known, same).drop(known["source"])
    hashed = F.xxhash64(F.col("_id").cast("string"), F.col("size"), F.lit(seed))
    start = stage(
        _spread(joined.withColumn("_row", hashed))
        .withColumn("copies", F.floor("_rate").cast("long"))
        .withColumn("_p", F.when(F.col("size") > 0, F.col("_rate") - F.col("copies")).otherwise(0.0)),
        "chunks",
    )
    plain = ["_id", "source", *[f"_carry_{c}" for c in carry], "size", "source_size", "target", "copies"]
    shape = start.select(*plain, "_row", "_chunk", "_p")
    chunks = max(1, start.agg(F.max("_chunks")).first()[0] or 1)
    # Rows taken a whole number of times need no rounding.
    part = "_p > 0 and _p < 1"
    done, rows = [shape.where(f"not ({part})")], shape.where(part)
    while True:
        last = chunks == 1
        rounded = stage(
            rows.groupBy("source", "_chunk").applyInPandas(_rounder(seed, last), rows.schema),
            "rounded")
        done.append(rounded.where(f"not ({part})"))
        if last:
            break
        rows = rounded.where(part).withColumn("_chunk", F.floor(F.col("_chunk") / CHUNK).cast("long"))
        chunks = -(-chunks // CHUNK)
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    copies = (F.col("copies") + F.col("_p").cast("long")).alias("copies")
    return out.select(
        F.col("_id").alias(id_col), "source", *[F.col(f"_carry_{c}").alias(c) for c in carry], "size", "source_size",
        F.col("target").cast("double").alias("target"), copies,
    ).withColumn("taken", F.col("copies") * F.col("size"))
