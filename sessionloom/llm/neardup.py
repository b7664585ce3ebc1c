"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by the ordered list of its nearest pivots. It is posted under every set of SHARED pivots out of
its NEAREST ones, so two vectors meet in a list exactly if they share that many near pivots. Vectors with the same two
nearest pivots stand together in a bucket, cut into blocks of bounded size: lists hold buckets, and a pair of blocks is
verified once by one product of matrices, which gives the number of links of each row and a forest of the links. So the
members of a dense group cost products, but no list of all their pairs is ever written.

Vectors that are equal in all components (and label) stand as one with a count. Links are only lost where two vectors
share fewer near pivots; the tests measure how many of the links survive.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sessionloom.llm.common import components, drawn, stage
from sessionloom.sources.staging import small

# Pivots: about PER_ROOT times the cube root of the rows, so that chance meetings stay in proportion; a sample
# of at most PIVOTS rows drawn by a hash of their id.
PIVOTS, PER_ROOT = 2048, 14
# Near pivots of a vector, and how many of these two vectors have to share.
NEAREST, SHARED = 8, 3
# Vectors of a block: bounds the memory of a product.
BLOCK = 512


def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of doubles; null where they are null, zero, or hold null or non-finite components."""
    for batch in batches:
        *rest, vectors = batch.columns
        offsets = vectors.offsets.to_numpy()
        flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
        valid = vectors.is_valid().to_numpy(zero_copy_only=False)
        out: list[bytes | None] = []
        for i, ok in enumerate(valid.tolist()):
            v = flat[offsets[i] : offsets[i + 1]]
            most = np.abs(v).max() if ok and len(v) else 0.0
            if np.isfinite(most) and (most > 1e100 or 0 < most < 1e-100):
                v = v / most  # its square would leave the range of doubles; the direction is all that counts
            out.append(v.tobytes() if np.isfinite(most) and most > 0 else None)
        yield pa.RecordBatch.from_arrays([*rest, pa.array(out, pa.binary())], names=[*batch.schema.names[:-1], "v"])


def unit(rows: list[bytes], width: int) -> np.ndarray:
    """Rows as unit vectors of one width; shorter ones are padded with zeros, which change no product."""
    x = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        x[i, : len(r) // 8] = np.frombuffer(r)
    return x / np.sqrt((x**2).sum(1))[:, None]


def described(pivots: np.ndarray, width: int):
    """Adds the bucket (numbers of the two nearest pivots) and the codes of all sets of shared pivots."""
    nearest = min(NEAREST, len(pivots))
    sets = np.array(list(combinations(range(nearest), min(SHARED, nearest))), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(batch.column(2).to_pylist(), width)
            near = np.zeros((len(x), nearest), dtype=np.int64)
            for lo in range(0, len(x), 2048):
                near[lo : lo + 2048] = np.argsort(-(x[lo : lo + 2048] @ pivots.T), axis=1, kind="stable")[:, :nearest]
            two = np.sort(near[:, :2], axis=1)
            bucket = two[:, 0] * len(pivots) + two[:, -1]
            ordered = np.sort(near, axis=1)
            code = np.zeros((len(x), len(sets)), dtype=np.int64)
            for place in range(sets.shape[1]):
                code = code * len(pivots) + ordered[:, sets[:, place]]
            offsets = np.arange(len(x) + 1, dtype=np.int32) * len(sets)
            codes = pa.ListArray.from_arrays(pa.array(offsets), pa.array(code.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(bucket), codes], names=[*batch.schema.names, "bucket", "codes"])

    return run


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by label, bucket and block become one row a block."""
    held: list[pa.RecordBatch] = []

    def made(rows: pa.Table) -> pa.RecordBatch:
        label, bucket, block = (rows[c].to_numpy() for c in ("label", "bucket", "block"))
        change = (label[1:] != label[:-1]) | (bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1])
        begin = np.concatenate(([0], np.flatnonzero(change) + 1))
        end = np.concatenate((begin[1:], [len(label)]))
        uid, n, v = rows["uid"].to_numpy(), rows["copies"].to_numpy(), rows["v"].to_pylist()
        return pa.RecordBatch.from_arrays([
            pa.array(label[begin]), pa.array(bucket[begin]), pa.array(block[begin]),
            pa.array([uid[a:b].tobytes() for a, b in zip(begin, end, strict=True)], pa.binary()),
            pa.array([n[a:b].tobytes() for a, b in zip(begin, end, strict=True)], pa.binary()),
            pa.array([[len(x) // 8 for x in v[a:b]] for a, b in zip(begin, end, strict=True)], pa.list_(pa.int32())),
            pa.array([b"".join(v[a:b]) for a, b in zip(begin, end, strict=True)], pa.binary()),
        ], names=["label", "bucket", "block", "uids", "copies", "widths", "rows"])

    for batch in batches:
        held.append(batch)
        rows = pa.Table.from_batches(held)
        # The last block may go on in the next batch; a block has about BLOCK rows.
        last = [rows[c][-1].as_py() for c in ("label", "bucket", "block")]
        same = np.ones(len(rows), dtype=bool)
        for c, x in zip(("label", "bucket", "block"), last, strict=True):
            same &= rows[c].to_numpy() == x
        cut = int(np.argmax(same))
        if cut:
            yield made(rows.slice(0, cut))
        held = rows.slice(cut).combine_chunks().to_batches()
    if held:
        yield made(pa.Table.from_batches(held))


def _matrix(rows: bytes, widths: np.ndarray, width: int) -> np.ndarray:
    flat = np.frombuffer(rows)
    if (widths == width).all():
        x = flat.reshape(len(widths), width)
    else:
        x = np.zeros((len(widths), width))
        x[np.arange(width)[None, :] < widths[:, None]] = flat
    return x / np.sqrt((x**2).sum(1))[:, None]


def forest(linked: np.ndarray) -> np.ndarray:
    """For each row, then each column, of a boolean matrix the smallest place that it reaches through true cells."""
    rows, columns = linked.shape
    label = np.arange(rows + columns)
    while True:
        # Each row takes the smallest label of its columns, and the other way round.
        down = np.where(linked, label[None, rows:], rows + columns).min(1, initial=rows + columns)
        label[:rows] = np.minimum(label[:rows], down)
        across = np.where(linked, label[:rows, None], rows + columns).min(0, initial=rows + columns)
        fresh = np.minimum(label[rows:], across)
        if (fresh == label[rows:]).all():
            return label
        label[rows:] = fresh


def verified(width: int, threshold: float):
    """Rows (uid, n, root) of each pair of blocks: links of a row, and its place in the forest of links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, counts, roots = [], [], []
            columns = [batch.column(i) for i in range(9)]
            for r in range(batch.num_rows):
                same, xu, xn, xw, xr, yu, yn, yw, yr = (c[r].as_py() for c in columns)
                xu, xn, yu, yn = (np.frombuffer(b, dtype=np.int64) for b in (xu, xn, yu, yn))
                x, y = _matrix(xr, np.array(xw), width), _matrix(yr, np.array(yw), width)
                linked = x @ y.T >= threshold
                if same:
                    np.fill_diagonal(linked, False)
                if not linked.any():
                    continue
                label = forest(linked)
                both = np.concatenate((xu, yu))
                # In one block the columns are the rows once more; its links are counted on the rows.
                links = np.concatenate((linked @ yn, 0 * yn if same else xn @ linked))
                some = np.concatenate((linked.any(1), linked.any(0)))
                uids.append(both[some])
                counts.append(links[some])
                roots.append(both[label[some]])
            flat = [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (uids, counts, roots)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in flat], names=["uid", "n", "root"])

    return run


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Two rows are linked if their labels are equal and not null and the cosine of their vectors, in double precision,
    reaches the threshold. n_links counts the linked rows, copies included; component_id is the smallest id among
    the rows reachable by links; kept marks rows whose own id is that. Vectors that are null, empty, zero, or hold null
    or non-finite components link with nothing. Vectors of unequal length meet as if padded with zeros. Repeated ids are
    rows of their own; a null id is passed over as component_id unless the component has no other, and such a row
    is not kept. An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    kind, mark = vectors.schema[id_col].dataType.simpleString(), vectors.schema[label_col].dataType.simpleString()
    plain = vectors.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(label_col).alias("label"),
        F.col(vector_col).cast("array<double>").alias("v"))
    rows = stage(plain.mapInArrow(usable, f"uid long, id {kind}, label {mark}, v binary"), "vectors")
    able = rows.where(F.col("v").isNotNull() & F.col("label").isNotNull()).withColumn("key", F.unhex(F.sha2("v", 256)))
    result = f"`{id_col}` {kind}, n_links long, component_id {kind}, kept boolean"
    # Equal vectors as one: the first of them, with their number. Labels get numbers, as they may be of any type.
    single = stage(able.groupBy("label", "key").agg(
        F.min("uid").alias("uid"), F.count("*").alias("copies"), F.first("v").alias("v")), "distinct-vectors")
    facts = single.agg(F.count("*").alias("n"), F.max(F.length("v")).alias("w")).first()
    if not facts["n"]:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"),
                           F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    width = facts["w"] // 8
    wanted = max(2, min(PIVOTS, round(PER_ROOT * facts["n"] ** (1 / 3)), facts["n"]))
    chosen = drawn(single.select("uid", "v"), ["uid"], wanted).limit(2 * wanted).select("v").collect()
    pivots = unit([bytes(r["v"]) for r in chosen or single.select("v").limit(1).collect()], width)
    sent = spark.sparkContext.broadcast(pivots)
    coded = single.select("uid", F.xxhash64("label").alias("label"), "v", "copies")
    index = stage(
        coded.mapInArrow(lambda b: described(sent.value, width)(b),
                         "uid long, label long, v binary, copies long, bucket long, codes array<bigint>"), "permutations")
    # Inverted lists: buckets under each set of pivots. A bucket's members are counted as one before the shuffle.
    lists = index.select("label", "bucket", F.explode_outer("codes").alias("code")).distinct()
    held = stage(lists, "pivot-lists")
    left, right = held.select("label", "code", F.col("bucket").alias("x")), held.select("label", "code", F.col("bucket").alias("y"))
    met = left.join(right, ["label", "code"]).where("x < y").select("label", "x", "y").distinct()
    # Buckets of more than one block are few; the others are block 0 without a look-up.
    large = stage(index.groupBy("label", "bucket").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks")).where("blocks > 1"),
                  "large-buckets")
    placed = index.drop("codes").join(small(large), ["label", "bucket"], "left").withColumn(
        "block", F.pmod(F.xxhash64("uid"), F.coalesce("blocks", F.lit(1))).cast("int")).drop("blocks")
    key = ["label", "bucket", "block"]
    blocks = stage(
        placed.select(*key, "uid", "copies", "v").repartition(*key).sortWithinPartitions(*key).mapInArrow(
            packed, "label long, bucket long, block int, uids binary, copies binary, widths array<int>, rows binary"), "blocks")

    def counted(pairs: DataFrame, side: str) -> DataFrame:
        sizes = large.select("label", F.col("bucket").alias(side), F.col("blocks").alias("_n"))
        return pairs.join(small(sizes), ["label", side], "left").withColumn(
            f"{side}_block", F.explode_outer(F.sequence(F.lit(0), F.coalesce(F.col("_n"), F.lit(1)).cast("int") - 1))).drop("_n")

    # Pairs of blocks: of buckets that met, and each bucket with itself.
    across = counted(counted(met, "x"), "y")
    own = blocks.select("label", F.col("bucket").alias("x"), F.col("bucket").alias("y"), F.col("block").alias("x_block"))
    inside = counted(own, "y").where("x_block <= y_block")
    alone = (F.col("x") == F.col("y")) & (F.col("x_block") == F.col("y_block"))
    # A block of one row has no pairs of its own.
    pairs = stage(across.unionByName(inside).withColumn("same", alone), "block-pairs")

    def side(name: str) -> DataFrame:
        return blocks.select("label", F.col("bucket").alias(name), F.col("block").alias(f"{name}_block"),
                             *[F.col(c).alias(f"{name}_{c}") for c in ("uids", "copies", "widths", "rows")])

    full = pairs.join(side("x"), ["label", "x", "x_block"]).where(~F.col("same") | (F.length("x_uids") > 8)).join(
        side("y"), ["label", "y", "y_block"])
    fields = ["same", *[f"{s}_{c}" for s in "xy" for c in ("uids", "copies", "widths", "rows")]]
    found = stage(full.select(*fields).mapInArrow(verified(width, threshold), "uid long, n long, root long"), "links")
    counts = found.groupBy("uid").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("uid").alias("a"), F.col("root").alias("b")))
    # Back to the rows: every row has the number of its first equal one.
    labelled = (
        single.select("label", "key", F.col("uid").alias("rep"), "copies")
        .join(counts.withColumnRenamed("uid", "rep"), "rep", "left")
        .join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "key", F.coalesce("root", "rep").alias("root"),
                (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    named = stage(able.select("uid", "id", "label", "key").join(labelled, ["label", "key"]).select("uid", "id", "root", "n_links"),
                  "linked-rows")
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    linked = named.where("n_links > 0").join(least, "root").select("id", "n_links", "component_id")
    lone = rows.select("uid", "id").join(named.where("n_links > 0").select("uid"), "uid", "left_anti").select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(lone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id",
                      F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
