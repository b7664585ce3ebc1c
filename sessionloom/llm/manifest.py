"""Merkle manifest of a table and octopus multiproofs of all its rows.

Rows are leaves. The leaves of one source form a tree in which every run of three consecutive nodes (the last run may
be shorter) becomes one node, and the tops of these trees, in order of source, form a tree of the same shape. Leaves
in global order are cut into units of bounded size, which are pieces of one source, many whole sources, or both.

* Building: a unit hashes every node that lies wholly in it and keeps the largest ones. Nodes that span units are
  made from these in rounds of a few levels, each group holding what lies under one node.
* Proving: a unit walks up from its own leaves and lists the nodes it can't derive (the minimal union over all its
  leaves), fetches them once, derives the inner nodes its leaves share, and expands the proof of each leaf locally.

A proof is a list of (left, right), one for each level: the siblings before and after the node in its run. Folding
it over a leaf is a plain column expression (`folded`), so a receiver needs none of this module's Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sessionloom.llm.common import numbered, stage
from sessionloom.sources.staging import small

ARITY = 3
# Leaves of a unit, and levels that one round of building climbs.
UNIT, SPAN = 4096, 5
# Units that may ask for one copy of a node; what more of them ask for is kept in more copies.
ASKERS = 4096
# The tree of the sources' tops.
TOP = -1

NODE = "tree long, level int, idx long, hash string"


def fingerprint(*columns: Column) -> Column:
    """sha256 of the fields: `-` for null, else the byte count of the value as text, a colon, the value."""

    def field(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def proof_text(proof: Column) -> Column:
    """All siblings of a proof, from the leaf to the root, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def height(n: Column) -> Column:
    """Levels above the leaves of a tree of n leaves."""
    powers = [ARITY**k for k in range(40) if ARITY**k < 2**63]
    return sum(((n > F.lit(p)).cast("int") for p in powers), F.lit(0))


def parent(children: list[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def missing(known: np.ndarray, n: int) -> list[np.ndarray]:
    """For each level the sorted places of the nodes that the known leaves (sorted, distinct) can't give.

    Walks up once: the parents of known nodes become known when the other children of their runs are fetched.
    """
    out, size = [], n
    while size > 1:
        runs = np.unique(known // ARITY)
        children = (runs[:, None] * ARITY + np.arange(ARITY)).ravel()
        children = children[children < size]
        out.append(np.setdiff1d(children, known, assume_unique=True))
        known, size = runs, -(-size // ARITY)
    return out


def derive(leaves: dict[int, str], n: int, fetched: dict[tuple[int, int], str]) -> list[dict[int, str]]:
    """Nodes by level, each level by place, that known leaves and fetched nodes give; the last level is the top."""
    levels, size = [dict(leaves)], n
    while size > 1:
        here, above = levels[-1], {}
        for place in missing_runs(here, size):
            if place not in here:
                here[place] = fetched[len(levels) - 1, place]
        for run in sorted({p // ARITY for p in here}):
            above[run] = parent([here[p] for p in range(ARITY * run, min(ARITY * run + ARITY, size))])
        levels.append(above)
        size = -(-size // ARITY)
    return levels


def missing_runs(here: dict[int, str], size: int) -> list[int]:
    """Places of all children of the runs that known nodes touch."""
    runs = {p // ARITY for p in here}
    return [p for r in runs for p in range(ARITY * r, min(ARITY * r + ARITY, size))]


def whole(here: dict[int, str], size: int) -> dict[int, str]:
    """Parents of the runs that are whole; none above the top."""
    above = {}
    for run in {p // ARITY for p in here} if size > 1 else ():
        children = range(ARITY * run, min(ARITY * run + ARITY, size))
        if all(p in here for p in children):
            above[run] = parent([here[p] for p in children])
    return above


def derived(leaves: dict[int, str], n: int, every: bool) -> Iterator[tuple[int, int, str]]:
    """(level, place, hash) of the nodes that the leaves give; if not every one, those whose own run is not whole."""
    here, level, size = dict(leaves), 0, n
    while here:
        above = whole(here, size)
        for place, value in here.items():
            if every or place // ARITY not in above:
                yield level, place, value
        here, level, size = above, level + 1, -(-size // ARITY)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the range's number, the place in it, and the place among the range's rows of one source (sorted input)."""
    from pyspark import TaskContext

    part, seen, run, last = TaskContext.get().partitionId(), 0, 0, None
    for batch in batches:
        sources = batch.column(0)
        n = len(sources)
        if not n:
            continue
        codes = sources.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        change = np.concatenate(([True], codes[1:] != codes[:-1]))
        begin = np.flatnonzero(change)
        place = np.arange(n) - begin[np.cumsum(change) - 1]
        first = (sources[0].as_py(),)
        if last == first:
            place[: begin[1] if len(begin) > 1 else n] += run
        run, last = int(place[-1]) + 1, (sources[n - 1].as_py(),)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, part, dtype=np.int32)), pa.array(seen + np.arange(n)), pa.array(place)],
            names=[*batch.schema.names, "_range", "_in_range", "_in_run"])
        seen += n


@dataclass
class Manifest:
    """The staged leaves in order, the nodes that units may ask for, the sources' tops, and the root."""

    leaves: DataFrame
    nodes: DataFrame
    sources: DataFrame
    root: str | None


def _fringe(every: bool):
    """The largest nodes of each tree's leaves in one unit, or every node that these leaves give."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (tree, n), part in pdf.groupby(["tree", "n"], sort=False):
            leaves = dict(zip(part["idx"].tolist(), part["hash"].tolist(), strict=True))
            out += [(tree, *node) for node in derived(leaves, n, every)]
        return pd.DataFrame(out, columns=["tree", "level", "idx", "hash"])

    return run


def _climb(low: int, stop: int):
    """Nodes above level `low`, up to `stop`, made of all that lies under one node."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, tree, out = int(pdf["n"].iloc[0]), int(pdf["tree"].iloc[0]), []
        size, here = n, {}
        for _ in range(low):
            size = -(-size // ARITY)
        given = {level: dict(zip(p["idx"].tolist(), p["hash"].tolist(), strict=True)) for level, p in pdf.groupby("level")}
        for level in range(low, stop):
            above = whole(here | given.get(level, {}), size)
            out += [(tree, level + 1, place, value) for place, value in above.items()]
            here, size = above, -(-size // ARITY)
        return pd.DataFrame(out, columns=["tree", "level", "idx", "hash"])

    return run


def _forest(leaves: DataFrame, sizes: DataFrame, tallest: int, every: bool = False) -> DataFrame:
    """All nodes that some unit can't derive alone, and every tree's top; if asked for, every node.

    leaves: tree, n, idx, hash, unit. sizes: tree, n.
    """
    found = stage(leaves.groupBy("unit").applyInPandas(_fringe(every), NODE), "merkle-fringe")
    parts = [found]
    for low in range(0, tallest, SPAN):
        stop = low + SPAN
        power = F.pow(F.lit(float(ARITY)), F.lit(stop) - F.col("level")).cast("long")
        source = found.where((F.col("level") >= low) & (F.col("level") < stop))
        if low:
            source = source.unionByName(parts[-1].where(F.col("level") == low))
        under = (
            source.join(small(sizes), "tree").where(F.col("level") < height(F.col("n")))
            .withColumn("_under", F.floor(F.col("idx") / power).cast("long"))
        )
        made = under.groupBy("tree", "_under").applyInPandas(_climb(low, stop), NODE)
        # Where every node was kept, a round makes some of them anew.
        made = made.join(found, ["tree", "level", "idx"], "left_anti").select("tree", "level", "idx", "hash") if every else made
        parts.append(stage(made, "merkle-nodes"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def build(rows: DataFrame, source: str = "source", order: str = "doc_id", leaf: str = "leaf") -> Manifest:
    """Manifest of rows that hold a source, an order column and a leaf hash; other columns are carried along.

    Leaves of a source go by `order` (null first), then by leaf; rows equal in both are interchangeable. Sources go
    null first, then bytewise. An empty table has no root. Names beginning with an underscore, and tree, idx,
    n, hash and unit, are reserved for this module.
    """
    spark = rows.sparkSession
    others = [c for c in rows.columns if c not in (source, order, leaf)]
    key = [F.col(c).asc_nulls_first() for c in (source, order, leaf)] + [F.col("_tie")]
    held = stage(rows.select(source, order, leaf, *others).withColumn("_tie", F.monotonically_increasing_id()), "merkle-rows")
    fields = held.schema.simpleString()[len("struct<"):-1]
    ordered = stage(
        held.repartitionByRange(*key).sortWithinPartitions(*key)
        .mapInArrow(_number, f"{fields},_range int,_in_range long,_in_run long"), "merkle-ordered")
    runs = stage(ordered.groupBy("_range", source).agg(F.count("*").alias("_rows")), "merkle-runs")
    sizes = runs.groupBy(source).agg(F.sum("_rows").alias("n"))
    trees = stage(numbered(sizes, [F.col(source).asc_nulls_first()], "tree"), "merkle-trees")
    before = Window.partitionBy(source).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.groupBy("_range").agg(F.sum("_rows").alias("_all")).select(
        "_range", F.coalesce(F.sum("_all").over(ranges), F.lit(0)).alias("_global"))
    named = trees.select(F.col(source).alias("_source"), "tree", "n")
    run_table = stage(
        runs.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .join(offsets, "_range").join(named, F.col(source).eqNullSafe(F.col("_source")))
        .select(F.col("_range").alias("_r"), "_source", "_before", "_global", "tree", "n"), "merkle-offsets")
    leaves = stage(
        ordered.join(small(run_table), (F.col("_range") == F.col("_r")) & F.col(source).eqNullSafe(F.col("_source")))
        .select(source, order, leaf, *others, "tree", "n", (F.col("_before") + F.col("_in_run")).alias("idx"),
                F.floor((F.col("_global") + F.col("_in_range")) / UNIT).cast("long").alias("unit")),
        "merkle-leaves")
    facts = trees.agg(F.max("n").alias("most"), F.count("*").alias("trees")).first()
    if not facts["trees"]:
        return Manifest(leaves, spark.createDataFrame([], NODE), trees.withColumn("subroot", F.lit("")), None)
    nodes = stage(_forest(
        leaves.select("tree", "n", "idx", F.col(leaf).alias("hash"), "unit"), trees.select("tree", "n"),
        _height(facts["most"])), "merkle-tree-nodes")
    tops = stage(
        trees.join(nodes.withColumnRenamed("tree", "_t"), (F.col("_t") == F.col("tree")) & (F.col("level") == height(F.col("n"))))
        .select(source, "tree", "n", F.col("hash").alias("subroot")), "merkle-tops")
    above = tops.select(
        F.lit(TOP).cast("long").alias("tree"), F.lit(facts["trees"]).alias("n"), F.col("tree").alias("idx"),
        F.col("subroot").alias("hash"), F.floor(F.col("tree") / UNIT).cast("long").alias("unit"))
    one = spark.range(1).select(F.lit(TOP).cast("long").alias("tree"), F.lit(facts["trees"]).alias("n"))
    top_nodes = stage(_forest(above, stage(one, "merkle-top"), _height(facts["trees"]), every=True), "merkle-top-nodes")
    root = top_nodes.where(F.col("level") == _height(facts["trees"])).first()["hash"]
    return Manifest(leaves, nodes.unionByName(top_nodes), tops, root)


def _height(n: int) -> int:
    h = 0
    while n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


def _requests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Coordinates of the nodes that a unit's run of neighbouring leaves can't derive."""
    for batch in batches:
        out = []
        for r in batch.itertuples():
            for level, places in enumerate(missing(np.arange(r.low, r.high + 1), r.n)):
                out += [(r.unit, r.tree, level, p) for p in places.tolist()]
        yield pd.DataFrame(out, columns=["unit", "tree", "level", "idx"])


def _expand(trees: int, fields: list[str]):
    """Proofs of all leaves of a unit from its leaves and the nodes it fetched."""

    def steps(levels: list[dict[int, str]], places: np.ndarray, n: int, values: list, at: list) -> None:
        """Adds for each level the (left, right) of the runs touched, and which of these each place needs."""
        size = n
        for here in levels[:-1]:
            index = {}
            for p in sorted(here):
                run = range(p - p % ARITY, min(p - p % ARITY + ARITY, size))
                index[p] = len(values)
                values.append(("".join(here[q] for q in run if q < p), "".join(here[q] for q in run if q > p)))
            at.append(np.array([index[p] for p in places.tolist()], dtype=np.int64))
            places, size = places // ARITY, -(-size // ARITY)

    def run(leaves: pa.Table, fetched: pa.Table) -> pa.Table:
        got = {}
        for t, lv, i, h in zip(*(fetched[c].to_pylist() for c in ("tree", "level", "idx", "hash")), strict=True):
            got.setdefault(t, {})[lv, i] = h
        leaves = leaves.sort_by([("tree", "ascending"), ("idx", "ascending")])
        tree = leaves["tree"].to_numpy()
        begin = np.concatenate(([0], np.flatnonzero(np.diff(tree)) + 1, [len(tree)])) if len(tree) else np.zeros(1, int)
        parts, tops = [], {}
        hashes, places, sizes = leaves["_leaf"].to_pylist(), leaves["idx"].to_numpy(), leaves["n"].to_numpy()
        for lo, hi in zip(begin[:-1], begin[1:], strict=True):
            t, n = int(tree[lo]), int(sizes[lo])
            levels = derive(dict(zip(places[lo:hi].tolist(), hashes[lo:hi], strict=True)), n, got.get(t, {}))
            tops[t] = levels[-1][0]
            parts.append((lo, hi, t, n, levels))
        above = derive(tops, trees, got.get(TOP, {}))
        values, count, index, subroots = [], [], [], []
        for lo, hi, t, n, levels in parts:
            at: list[np.ndarray] = []
            steps(levels, places[lo:hi], n, values, at)
            inner = len(at)
            top_at: list[np.ndarray] = []
            if trees > 1:
                steps(above, np.array([t]), trees, values, top_at)
            at += [np.repeat(a, hi - lo) for a in top_at]
            count += [inner + len(top_at)] * (hi - lo)
            index.append(np.stack(at, axis=1).ravel() if at else np.zeros(0, dtype=np.int64))
            subroots += [tops[t]] * (hi - lo)
        flat = pa.array(np.concatenate(index) if index else np.zeros(0, dtype=np.int64))
        sides = [pa.array([v[s] for v in values], pa.string()).take(flat) for s in (0, 1)]
        offsets = pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32))
        proofs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(sides, names=["left", "right"]))
        kept = leaves.select(fields)
        return kept.append_column("subroot", pa.array(subroots, pa.string())).append_column("proof", proofs)

    return run


def prove(manifest: Manifest, leaf: str = "leaf") -> DataFrame:
    """Every leaf row with its source's top and its proof up to the root: array<struct<left, right>>."""
    rows, spark = manifest.leaves, manifest.leaves.sparkSession
    given = [c for c in rows.columns if c not in ("tree", "n", "idx", "unit")]
    fields = rows.select(given).schema.simpleString()[len("struct<"):-1]
    schema = f"{fields},subroot string,proof array<struct<left:string,right:string>>"
    if manifest.root is None:
        return spark.createDataFrame([], schema)
    trees = manifest.sources.count()
    spans = stage(
        rows.groupBy("unit", "tree", "n").agg(F.min("idx").alias("low"), F.max("idx").alias("high")), "merkle-spans")
    over = spans.groupBy("unit").agg(F.min("tree").alias("low"), F.max("tree").alias("high")).select(
        "unit", F.lit(TOP).cast("long").alias("tree"), F.lit(trees).cast("long").alias("n"), "low", "high")
    coordinate = ["tree", "level", "idx"]
    asked = stage(spans.unionByName(over).mapInPandas(_requests, "unit long, tree long, level int, idx long"), "merkle-asked")
    # Nodes near the root are asked for by very many units: these few are kept in as many copies as that takes.
    common = stage(asked.groupBy(*coordinate).agg(F.ceil(F.count("*") / F.lit(ASKERS)).alias("_copies")).where("_copies > 1"),
                   "merkle-common")
    copies = F.coalesce("_copies", F.lit(1))
    asked = asked.join(small(common), coordinate, "left").withColumn("_copy", F.pmod("unit", copies)).drop("_copies")
    held = manifest.nodes.join(small(common), coordinate, "left").withColumn(
        "_copy", F.explode_outer(F.sequence(F.lit(0).cast("long"), copies - 1))).drop("_copies")
    fetched = stage(asked.join(held, [*coordinate, "_copy"]).select("unit", *coordinate, "hash"), "merkle-fetched")
    left = rows.withColumn("_leaf", F.col(leaf)).groupBy("unit")
    return left.cogroup(fetched.groupBy("unit")).applyInArrow(_expand(trees, given), schema)


def document_manifest(docs: DataFrame) -> Manifest:
    """Manifest of a documents table; `tampered` is the leaf of the row whose text lost its line breaks.

    Only rows that the sample tampering touches have a `tampered` leaf: those whose crc32 of doc_id is even. Other
    columns of the table are not read; nulls are fields of their own, empty texts hash as such, repeated rows are
    leaves of their own.
    """
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    return build(docs.select(
        "source", "doc_id", fingerprint(*rest, F.col("text")).alias("leaf"),
        F.when(touched, fingerprint(*rest, changed)).alias("tampered")))
