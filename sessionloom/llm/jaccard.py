"""Exact n-gram Jaccard join and its connected components, by equal parts of sets.

Rows whose similarity reaches the threshold differ in few shingles, by a bound that follows from the smaller one's size:

* Equal sets are one row (node).
* Sets of a range of sizes are cut into parts by the shingles' hashes, more parts than linked sets can differ in. So linked
  sets have a part in common as a whole; a part's hash is a column. Such a column is shared by hardly any rows but near
  copies, however frequent its shingles are, so columns stay short as the corpus grows.
* Parts without shingles (at high thresholds: with one) are no columns. Each set has a bounded number of parts to spare for them; sets that
  have more such parts are cut once more by another hash, and the last cut takes all parts.
* Rows with the same first column form blocks, mostly copies of one text, which are compared first, as products of
  bounded size. Then only rows of different components that share a column meet: neighbours in a column, then all.
* Before the texts of a pair travel, their sketches (a set's shingles counted by bits of their hashes) bound what they can share:
  first narrow ones, beside the entries of columns, then ones about as wide as the sets are large.

Every pair that may be linked is either compared or already connected, so components are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sessionloom.llm.common import connected
from sessionloom.llm.words import SPACED, mix, ngrams, word_slices
from sessionloom.sources.staging import small, stage_and_release as stage

# From this percentage on parts are so large that a column has two shingles at least (below: one).
LARGE_PARTS = 85
# Cuts of a set with many parts that are no columns.
CUTS = 8
# Rows of a block of the product, and columns that are multiplied at once.
BLOCK, STRIP = 128, 4096
# Counts of a sketch, two in a byte; rows whose sketches are compared at once.
SKETCH, ROWS = 256, 4096
# Bits of the filter that tells which texts are read again.
FILTER_BITS = 2**26


def shingles(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, owner, hash) of all k-word shingles; a text of fewer words has one of all its words."""
    for lo, hi, words in word_slices(texts, SPACED):
        sizes = np.diff(words.offsets)
        grams = ngrams(words.hashes, k)
        owner = np.repeat(np.arange(hi - lo), np.maximum(0, sizes - k + 1))
        begin = np.repeat(words.offsets[:-1], np.maximum(0, sizes - k + 1))
        step = np.arange(len(owner)) - np.repeat(np.cumsum(np.maximum(0, sizes - k + 1)) - np.maximum(0, sizes - k + 1),
                                                 np.maximum(0, sizes - k + 1))
        hashes = [grams[begin + step]]
        owners = [owner]
        for n in range(1, k):
            short = np.flatnonzero(sizes == n)
            if len(short):
                hashes.append(ngrams(words.hashes, n)[words.offsets[short]])
                owners.append(short)
        yield lo, hi, np.concatenate(owners), np.concatenate(hashes)


def sets_of(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, bounds, sorted distinct shingle hashes) of a slice."""
    for lo, hi, owner, hashes in shingles(texts, k):
        order = np.lexsort((hashes, owner))
        owner, hashes = owner[order], hashes[order]
        first = np.ones(len(hashes), dtype=bool)
        first[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
        owner, hashes = owner[first], hashes[first]
        yield lo, hi, np.searchsorted(owner, np.arange(hi - lo + 1)), hashes


def set_hash(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each whole set: the sum of its members' hashes, modulo 2**64. Used together with its size."""
    total = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(mix(hashes), out=total[1:])
    return (total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)


def differing(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Shingles that a set of n and a linked one of no fewer shingles differ in, at most.

    Of sizes x >= n, at least percent * (x + n) / (100 + percent) are shared, and x is at most 100 * n / percent.
    """
    return n * (100 - percent) // percent


class Cuts:
    """Ranges of sizes: the least size, how many parts may be no columns (`spare`) and the number of parts (0: no links).

    A pair belongs to the range of its smaller set. A set of n takes part with the first differing(n) + 1 + spare parts of its own
    range, and with all parts of the range below where a set of that range can be linked with it.
    """

    def __init__(self, percent: int, largest: int):
        self.percent, self.least, self.spare, self.parts = percent, [1], [0], [0]
        self.fewest, grow = (2, 1.5) if percent >= LARGE_PARTS else (1, 2)
        while self.least[-1] <= largest:
            low = self.least[-1]
            high = int(low * grow) + 1  # two ranges up nothing can be linked
            most, spare = differing(high - 1, percent), 0
            while most and spare < most + 1:
                parts = most + 1 + spare
                mean = low / parts
                poor = (differing(low, percent) + 1 + spare) * np.exp(-mean) * (1 + mean if self.fewest > 1 else 1)
                if spare >= poor + 2 * poor**0.5:
                    break
                spare += 1
            self.spare[-1], self.parts[-1] = spare, most + 1 + spare if most else 0
            self.least.append(high)
            self.spare.append(0)
            self.parts.append(0)
        self.least, self.spare, self.parts = (np.array(x, dtype=np.int64) for x in (self.least, self.spare, self.parts))

    def columns(self, bounds: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owner, column) of the sets hashes[bounds[i]:bounds[i + 1]], by owner."""
        n = np.diff(bounds)
        own = np.searchsorted(self.least, n, side="right") - 1
        differ = differing(n, self.percent)
        taken = np.where(differ > 0, differ + 1 + self.spare[own], 0)
        below = np.maximum(own - 1, 0)
        lower = (own > 0) & (100 * (self.least[own] - 1) >= self.percent * n)
        who = np.concatenate((np.flatnonzero(taken), np.flatnonzero(lower)))
        of = np.concatenate((own[taken > 0], below[lower]))
        upto = np.concatenate((taken[taken > 0], self.parts[below[lower]]))
        who, of, upto = who[upto > 0], of[upto > 0], upto[upto > 0]
        owners, columns = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for cut in range(CUTS):
            if not len(who):
                break
            length, first = n[who], np.cumsum(upto) - upto
            ahead = np.cumsum(length) - length
            at = np.arange(length.sum()) + np.repeat(bounds[who] - ahead, length)
            place = mix(hashes[at] + np.uint64(cut + 1))
            part = ((place >> np.uint64(32)).astype(np.int64) * np.repeat(self.parts[of], length)) >> 32
            held = part < np.repeat(upto, length)
            slot = (np.repeat(first, length) + part)[held]
            size = np.bincount(slot, minlength=upto.sum())
            # Sums modulo 2**64, by halves that doubles hold exactly.
            halves = [np.bincount(slot, (x & np.uint64(2**32 - 1)).astype(float), minlength=upto.sum()).astype(np.uint64)
                      for x in (place[held], place[held] >> np.uint64(32))]
            total = halves[0] + (halves[1] << np.uint64(32))
            number = np.arange(upto.sum()) - np.repeat(first, upto)
            name = (np.repeat(of, upto) * CUTS + cut).astype(np.uint64) << np.uint64(32) | number.astype(np.uint64)
            few = np.add.reduceat((size < self.fewest).astype(np.int64), first)
            settled = few <= self.spare[of]
            last = cut == CUTS - 1
            kept = (size >= self.fewest) | last
            owners.append(np.repeat(who, upto)[kept])
            columns.append(mix(mix(total + size.astype(np.uint64)) + mix(name))[kept])
            who, of, upto = who[~settled], of[~settled], upto[~settled]
        owner, column = np.concatenate(owners), np.concatenate(columns)
        order = np.argsort(owner, kind="stable")
        return owner[order], column[order].view(np.int64)


def signatures(batches: Iterator[pa.RecordBatch], k: int, percent: int, id_col: str) -> Iterator[pa.RecordBatch]:
    """(id, n, node, columns) of each text; `node` is a hash of the whole set.

    Copies in one task give their columns once, so that a text repeated any number of times does not fill a column.
    """
    told: set[int] = set()
    cuts = Cuts(percent, 1)
    for batch in batches:
        sizes, nodes, columns = [], [], []
        for lo, hi, bounds, hashes in sets_of(batch.column(1), k):
            n = np.diff(bounds)
            if n.max(initial=0) >= cuts.least[-1]:
                cuts = Cuts(percent, int(n.max()))
            node = set_hash(hashes, bounds)
            nodes.append(node)
            sizes.append(n)
            new = np.array([x not in told and not told.add(x) for x in node.tolist()], dtype=bool)
            member = np.repeat(new, n)
            owner, column = cuts.columns(np.concatenate(([0], np.cumsum(np.where(new, n, 0)))), hashes[member])
            columns.append(pa.ListArray.from_arrays(
                pa.array(np.searchsorted(owner, np.arange(hi - lo + 1)), pa.int32()), pa.array(column, pa.int64())))
        flat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        lists = pa.concat_arrays(columns) if columns else pa.array([], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), flat(sizes), flat(nodes), lists], names=[id_col, "n", "node", "columns"])


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of columns with at least two rows, each with the row before it in its column; repeated entries once.

    Runs over one sorted range of the table. A column that touches the range's border is kept, as in sorted ranges it may
    go on in the next one; its first entry there has no row before it.
    """
    held, told, begun = None, False, False
    for batch in batches:
        if not len(batch):
            continue
        s, node, n = (np.asarray(c).astype(np.int64) for c in batch.columns[:3])
        if held is not None:
            s, node, n = (np.concatenate(([h], x)) for h, x in zip(held, (s, node, n), strict=True))
        new = np.concatenate(([True], (s[1:] != s[:-1]) | (node[1:] != node[:-1])))
        s, node, n = s[new], node[new], n[new]
        if held is not None and len(s) == 1:
            continue
        same = np.concatenate(([False], s[1:] == s[:-1]))
        emit = same.copy()
        emit[:-1] |= same[1:]
        if not begun:
            emit[s == s[0]] = begun = True
        last = bool(emit[-1])
        if told:
            emit[0] = False
        before, size = np.concatenate(([0], node[:-1])), np.concatenate(([0], n[:-1]))
        none = ~same[emit]
        yield pa.RecordBatch.from_arrays(
            [pa.array(s[emit]), pa.array(node[emit]), pa.array(n[emit]), pa.array(before[emit], mask=none), pa.array(size[emit], mask=none)],
            names=NEIGHBOUR_NAMES)
        held, told = (s[-1], node[-1], n[-1]), last
    if held is not None and not told:
        none = pa.array([None], pa.int64())
        yield pa.RecordBatch.from_arrays([*(pa.array([int(x)], pa.int64()) for x in held), none, none], names=NEIGHBOUR_NAMES)


NEIGHBOUR_NAMES = ["s", "node", "n", "prev", "prev_n"]


def with_neighbours(entries: DataFrame) -> DataFrame:
    """Entries in the order of their column and size, each with the row before it."""
    order = ["s", "n", "node"]
    return entries.select("s", "node", "n").repartition("s").sortWithinPartitions(*order).mapInArrow(
        neighbours, "s long, node long, n long, prev long, prev_n long")


def sketches(bounds: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """SKETCH counts of each set hashes[bounds[i]:bounds[i + 1]] by bits of the hashes, modulo 16, two in a byte."""
    out = np.zeros((len(bounds) - 1, SKETCH // 2), dtype=np.uint8)
    for lo in range(0, len(out), ROWS):
        part = bounds[lo : lo + ROWS + 1]
        spot = (mix(hashes[part[0] : part[-1]] + np.uint64(1000)) % np.uint64(SKETCH)).astype(np.int64)
        owner = np.repeat(np.arange(len(part) - 1), np.diff(part))
        count = np.bincount(owner * SKETCH + spot, minlength=(len(part) - 1) * SKETCH).reshape(-1, SKETCH) & 15
        out[lo : lo + ROWS] = count[:, ::2] << 4 | count[:, 1::2]
    return out


def wide_sketch(hashes: np.ndarray) -> bytes:
    """The same of one set, with about as many counts as it has members."""
    width = max(SKETCH, 1 << (len(hashes).bit_length() - 1))
    spot = (mix(hashes + np.uint64(1000)) % np.uint64(width)).astype(np.int64)
    count = (np.bincount(spot, minlength=width) & 15).astype(np.uint8)
    return (count[::2] << 4 | count[1::2]).tobytes()


def fewest_apart(x: bytes, y: bytes) -> int:
    """A bound from below of how many members two sets differ in, from their wide sketches; the wider one is folded."""
    counts = []
    for packed in (x, y):
        held = np.frombuffer(packed, np.uint8)
        counts.append(np.stack((held >> 4, held & 15), axis=1).reshape(-1, 2 * min(len(x), len(y))).sum(axis=0))
    apart = (counts[0] - counts[1]) & 15
    return int(np.minimum(apart, 16 - apart).sum())


def sifted(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b) of the pairs that may be linked. Rows (group, node, n, wide) come sorted by the first two; a node may come twice."""
    last: tuple | None = None
    for batch in batches:
        a, b = [], []
        for row in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
            if last is not None and last[0] == row[0] and last[1] != row[1]:
                both = (last[2] + row[2] - fewest_apart(last[3].as_py(), row[3].as_py())) // 2
                if both > 0 and 100 * both >= percent * (last[2] + row[2] - both):
                    a.append(last[1])
                    b.append(row[1])
            last = row
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def may_link(n: tuple[np.ndarray, np.ndarray], x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """False for pairs of sets, of sizes n, whose sketches show that they are not linked.

    Counts differ by at least as much as they do modulo 16, and sets by at least as much as their counts.
    """
    out = np.zeros(len(x), dtype=bool)
    for lo in range(0, len(x), ROWS):
        some = slice(lo, lo + ROWS)
        # Counts in the upper half of a byte wrap as they should.
        apart = np.concatenate(((x[some] & 240) - (y[some] & 240), (x[some] << 4) - (y[some] << 4)), axis=1)
        apart = np.minimum(apart, np.negative(apart)).sum(axis=1, dtype=np.int64) >> 4
        total = n[0][some] + n[1][some]
        both = (total - apart) // 2
        out[some] = (both > 0) & (100 * both >= percent * (total - both))
    return out


def alike(batches: Iterator[pa.RecordBatch], percent: int, near: bool) -> Iterator[pa.RecordBatch]:
    """(a, b): pairs of different blocks and components that share a column and may be linked; `near`: only neighbours in a column.

    Rows (column, size, node, block, root, sketch) come sorted by the first three. Columns are handled side by side: each row meets
    the next one of its column, then the one after, until sizes differ too much, so no column takes more room than its rows.
    """
    kept: list[np.ndarray] | None = None

    def pairs(rows: list[np.ndarray]) -> pa.RecordBatch:
        s, n, node, block, root, sketch = rows
        a, b, at, step = [], [], np.arange(len(s)), 1
        while len(at):
            at = at[at + step < len(s)]
            to = at + step
            at = at[(s[at] == s[to]) & (100 * n[at] >= percent * n[to])]
            one = at[(root[at] != root[at + step]) & (block[at] != block[at + step])]
            for lo in range(0, len(one), ROWS):
                x = one[lo : lo + ROWS]
                y = x + step
                good = may_link((n[x], n[y]), sketch[x], sketch[y], percent)
                a.append(np.minimum(node[x], node[y])[good])
                b.append(np.maximum(node[x], node[y])[good])
            if near:
                break
            step += 1
        flat = lambda x: pa.array(np.concatenate([np.zeros(0, np.int64), *x]))
        return pa.RecordBatch.from_arrays([flat(a), flat(b)], names=["a", "b"])

    for batch in batches:
        if not len(batch):
            continue
        fixed = batch.column(5).cast(pa.binary(SKETCH // 2))
        held = np.frombuffer(fixed.buffers()[1], np.uint8).reshape(-1, SKETCH // 2)[fixed.offset : fixed.offset + len(batch)]
        rows = [*(np.asarray(c).astype(np.int64) for c in batch.columns[:5]), held]
        if kept is not None:
            rows = [np.concatenate(x) for x in zip(kept, rows, strict=True)]
        # The last column may go on.
        end = int(np.searchsorted(rows[0], rows[0][-1]))
        kept = [x[end:].copy() for x in rows]
        if end:
            yield pairs([x[:end] for x in rows])
    if kept is not None:
        yield pairs(kept)


def bitmap(rows: pd.DataFrame) -> pd.DataFrame:
    bits = np.zeros(2**16, dtype=bool)
    bits[rows["bit"].to_numpy()] = True
    return pd.DataFrame({"part": rows["part"].iloc[:1], "bits": [np.packbits(bits).tobytes()]})


def wanted_texts(batches: Iterator[pa.RecordBatch], k: int, wanted) -> Iterator[pa.RecordBatch]:
    """(node, n, sketch, wide, text) of the texts that the filter lets through, each set once a task."""
    held, met = wanted.value, set()
    for batch in batches:
        spot = np.asarray(batch.column(2)).astype(np.int64)
        chosen = batch.filter(pa.array((held[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8)) & 1 == 1))
        nodes, sizes, new, wide, drawn = [], [], [], [], [np.zeros((0, SKETCH // 2), np.uint8)]
        for lo, _, bounds, hashes in sets_of(chosen.column(1), k):
            nodes += set_hash(hashes, bounds).tolist()
            sizes += np.diff(bounds).tolist()
            # What is left of repeated rows only repeats pairs.
            told = [i for i, x in enumerate(nodes[lo:]) if x not in met and not met.add(x)]
            new += [lo + i for i in told]
            wide += [wide_sketch(hashes[bounds[i] : bounds[i + 1]]) for i in told]
            drawn.append(sketches(bounds, hashes)[told])
        new = pa.array(new, pa.int64())
        sketch = np.concatenate(drawn)
        ends = np.arange(len(new) + 1, dtype=np.int32) * (SKETCH // 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.int64()).take(new), pa.array(sizes, pa.int64()).take(new),
             pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(ends), pa.py_buffer(sketch)]), pa.array(wide, pa.binary()),
             chosen.column(1).take(new)], names=["node", "n", "sketch", "wide", "text"])


def compared(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b): each row of a group that is linked within it, directly or over others, with the smallest such row.

    Rows (group, node, text) come sorted by group; only the sets of a group that goes on are held.
    """
    held: tuple[int | None, list, list] = (None, [], [])
    for batch in batches:
        group, node = (np.asarray(c).astype(np.int64) for c in batch.columns[:2])
        a, b = [], []
        for lo, hi, bounds, hashes in sets_of(batch.column(2), k):
            own = group[lo:hi]
            cuts = np.flatnonzero(np.diff(own)) + 1
            for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), hi - lo], strict=True):
                if own[x] != held[0]:
                    _close(held, percent, a, b)
                    held = (own[x], [], [])
                held[1].extend(node[lo + x : lo + y].tolist())
                # A copy, so that a group does not keep the whole slice.
                held[2].extend(hashes[bounds[i] : bounds[i + 1]].copy() for i in range(x, y))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    a, b = [], []
    _close(held, percent, a, b)
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _close(held: tuple[int | None, list, list], percent: int, a: list, b: list) -> None:
    """Adds a group's links, a star for each component."""
    _, nodes, sets = held
    if len(nodes) < 2:
        return
    size, overlap = overlaps(sets)
    linked = (100 * overlap >= percent * (size[:, None] + size[None] - overlap)) & (overlap > 0)
    name = np.array(nodes, dtype=np.int64)
    root = name.copy()
    while True:
        least = np.where(linked, root[None], np.iinfo(np.int64).max).min(axis=1)
        least = np.minimum(root, least)
        if (least == root).all():
            break
        root = least
    star = root != name
    a.extend(root[star].tolist())
    b.extend(name[star].tolist())


def overlaps(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(set sizes, overlap counts) of all sets with each other, strip by strip."""
    size = np.array([len(x) for x in sets], dtype=np.int64)
    if len(sets) == 2:
        x, y = sets if len(sets[0]) >= len(sets[1]) else sets[::-1]
        at = np.searchsorted(x, y)
        both = int((x[np.minimum(at, len(x) - 1)] == y).sum()) if len(x) else 0
        return size, np.array([[size[0], both], [both, size[1]]])
    owner = np.repeat(np.arange(len(sets)), size)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), dtype=np.int64)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, STRIP):
        at = slice(*np.searchsorted(column, [low, low + STRIP]))
        strip = np.zeros((len(sets), min(STRIP, int(column[-1]) + 1 - low)), dtype=np.float32)
        strip[owner[at], column[at] - low] = 1
        total += np.rint(strip @ strip.T).astype(np.int64)
    return size, total


def jaccard_components(
    docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, n_shingles, component_id) for each row: distinct k-word shingles and the smallest id reachable by links.

    Two texts link when 100 * intersection >= percent * union of their sets. A text of fewer than k words is one
    shingle; empty and null texts have none and link with nothing. Rows of equal texts are one node; rows with
    a null id take part but are never the smallest; a null id without partners has a null component.
    Other columns are not read. Texts are read twice; what travels is columns (about a seventh as many as shingles
    at 90 percent) and the texts of rows that share a column with another row.
    """
    if not 60 <= percent <= 100:
        raise ValueError("bounds hold from 60 percent on")
    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("_id"), text_col)
    rows = stage(read.mapInArrow(
        lambda b: signatures(b, k, percent, "_id"), f"_id {kind}, n long, node long, columns array<long>"), "rows")
    # Equal sets are one node, named by its hash and size.
    nodes = stage(rows.where("n > 0").groupBy("node", "n").agg(F.min("_id").alias("low")), "nodes")
    # Entries of columns with several rows.
    columns = stage(with_neighbours(rows.select(F.explode("columns").alias("s"), "node", "n")), "columns")
    pairs = columns.where(F.col("prev").isNotNull())
    shared = pairs.select("s", "node", "n").union(pairs.select("s", "prev", "prev_n"))
    # Rows with the same first column form a block (several, if they are many): mostly copies of one text.
    homes = stage(shared.groupBy("node", "n").agg(F.min("s").alias("home")), "homes")
    parts = homes.groupBy("home").agg(F.count("*").alias("size"), F.ceil(F.count("*") / BLOCK).alias("parts"))
    blocks = stage(homes.join(parts, "home").select(
        "node", "n", (F.col("size") / F.col("parts")).alias("size"),
        F.xxhash64("home", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("block")), "blocks")
    texts = _texts(docs, nodes, blocks, k, id_col, text_col)

    def links(members: DataFrame, label: str) -> DataFrame:
        """Links within groups (group, node) of bounded size, by whole sets; only texts that a group names travel."""
        met = texts.join(small(stage(members, "members")), "node").select("group", "node", "text")
        return stage(met.repartition("group").sortWithinPartitions("group").mapInArrow(
            lambda b: compared(b, k, percent), "a long, b long"), label)

    # A row is in one block only, so the stars of blocks are components of their own.
    within = links(blocks.where("size > 1").select(F.col("block").alias("group"), "node"), "within")
    star = within.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
    rooted = stage(blocks.join(star, "node", "left").select("node", "block", F.coalesce("root", "node").alias("root")), "rooted")

    # A task may have told a set again; either sketch will do.
    drawn = stage(texts.select("node", "sketch").dropDuplicates(["node"]), "sketches")

    def candidates(rooted: DataFrame, label: str, near: bool) -> DataFrame:
        """(a, b) of different blocks and components, that share a column and may be linked."""
        found = stage(columns.select("s", "node", "n").join(small(rooted), "node"), "labelled")
        mixed = found.groupBy("s").agg(
            F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("block").alias("b1"), F.max("block").alias("b2"))
        mixed = stage(mixed.where("lo <> hi and b1 <> b2").select("s"), "mixed")
        apart = found.join(small(mixed), "s", "left_semi").join(drawn, "node")
        order = ["s", "n", "node"]
        rows = apart.select(*order, "block", "root", "sketch").repartition("s").sortWithinPartitions(*order)
        return stage(rows.mapInArrow(lambda b: alike(b, percent, near), "a long, b long").distinct(), label)

    def linked(pairs: DataFrame, label: str) -> DataFrame:
        """Links among pairs; only texts of those travel that wide sketches leave."""

        def members(pairs: DataFrame) -> DataFrame:
            pairs = pairs.withColumn("group", F.xxhash64("a", "b"))
            return pairs.select("group", F.col("a").alias("node")).union(pairs.select("group", F.col("b").alias("node")))

        met = texts.join(small(stage(members(pairs), "members")), "node").select("group", "node", "n", "wide")
        left = stage(met.repartition("group").sortWithinPartitions("group", "node").mapInArrow(
            lambda b: sifted(b, percent), "a long, b long"), f"{label}-pairs")
        return links(members(left), label)

    # Neighbours in a column first: this joins blocks of large groups with few comparisons.
    beside = linked(candidates(rooted, "near", True), "beside")
    roots = stage(connected(within.union(beside)), "roots")
    rooted = stage(rooted.drop("root").join(roots, "node", "left").select("node", "block", F.coalesce("root", "node").alias("root")), "rooted")
    across = linked(candidates(rooted, "far", False), "across")
    roots = stage(connected(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).union(across)), "roots")
    low = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = stage(low.groupBy("root").agg(F.min("low").alias("component_id")), "components")
    named = low.select("node", "n", "root").join(names, "root").select("node", "n", "component_id")
    return rows.select("_id", "n", "node").join(named, ["node", "n"], "left").select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id")).alias("component_id"))


def _texts(docs: DataFrame, nodes: DataFrame, members: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(node, n, sketch, wide, text) of the member rows. They are read again behind a bit filter of fixed size."""
    spark = docs.sparkSession
    spot = F.pmod(F.xxhash64("_id"), F.lit(FILTER_BITS)).cast("long")
    wanted = stage(nodes.join(members.select("node"), "node", "left_semi").select(F.col("low").alias("_id")), "wanted")
    bits = wanted.select(F.floor(spot / 2**16).cast("int").alias("part"), (spot % 2**16).cast("int").alias("bit")).distinct()
    held = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for row in bits.groupBy("part").applyInPandas(bitmap, "part int, bits binary").toLocalIterator():
        held[row["part"] * 2**13 : (row["part"] + 1) * 2**13] = np.frombuffer(row["bits"], np.uint8)
    sent = spark.sparkContext.broadcast(held)
    read = docs.select(F.col(id_col).alias("_id"), text_col).withColumn("spot", spot)
    # Texts that the filter lets through by chance are named by no group and fall out in the joins to come.
    return stage(read.mapInArrow(lambda b: wanted_texts(b, k, sent), "node long, n long, sketch binary, wide binary, text string"), "texts")
