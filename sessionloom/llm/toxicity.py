"""Toxicity by nearest labelled examples: exact cosine of weighted TF-IDF vectors over a block-max inverted index.

Terms are all words and word beginnings of 4 and 5 bytes of a bounded sample of labelled rows, none is cut. A term's
inverse document frequency is multiplied by how far the sample ties the term to the label, so that terms that say
nothing weigh little. Labelled examples with equal vectors are one point with its tally. A text's nearest points vote,
weighed by similarity and tally; a logistic curve fitted on left-out votes turns votes into probabilities.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from sessionloom.llm.common import drawn, stage
from sessionloom.llm.words import ALNUM, Words, mix, prefix_hashes, word_slices

# Labelled rows that examples and terms are learned from, drawn by a hash of their id.
EXAMPLES = 20_000
# Weight of a term whose label share is that of all texts; a standard deviation from it adds 1.
NEUTRAL = 0.1
# Points that vote, and what an unsure vote leans on the base rate with.
NEIGHBOURS, LEAN = 16, 1.0
# Most frequent terms, multiplied as a dense matrix for so many texts together; postings of the others added up before
# the first test whether the nearest points are settled; points scored in full then; postings added up at a time.
HEAD, TOGETHER, FIRST, FULL, CHUNK = 1024, 128, 1 << 16, 64, 1 << 15
# Points of a block; each term has a largest weight for each block that holds it.
BLOCK = 1024
# Blocks are skipped where no more than this share of them is asked for.
SPARSE = 0.5
# Weights are held as whole numbers of this part; two sums of n of them, times weights of length 1 at most, are wrong by
# sqrt(n) / STEPS together. Single precision adds less than 1e-4.
STEPS = 65535

PREFIXES = (4, 5)


def terms_of(words: Words) -> list[np.ndarray]:
    """Hashes of the words and of their first 4 and 5 bytes, in the order of the words."""
    out = [words.hashes]
    for k in PREFIXES:
        out.append(mix(prefix_hashes(words, k) + np.uint64(1000 + k)))
    return out


def distinct_terms(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) of a slice."""
    owner = np.repeat(np.arange(len(words.offsets) - 1), np.diff(words.offsets))
    who, what = np.tile(owner, 1 + len(PREFIXES)), np.concatenate(terms_of(words))
    order = np.lexsort((what, who))
    who, what = who[order], what[order]
    first = np.ones(len(who), dtype=bool)
    first[1:] = (who[1:] != who[:-1]) | (what[1:] != what[:-1])
    at = np.flatnonzero(first)
    return who[at], what[at], np.diff(np.append(at, len(who)))


def term_tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial (term, texts, marked texts) of labelled texts."""
    for batch in batches:
        marked = np.asarray(batch.column(1)).astype(np.int64)
        for lo, hi, words in word_slices(batch.column(0), ALNUM):
            who, what, _ = distinct_terms(words)
            terms, at = np.unique(what, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms.view(np.int64)), pa.array(np.bincount(at, minlength=len(terms))),
                 pa.array(np.bincount(at, marked[lo:hi][who], minlength=len(terms)).astype(np.int64))],
                names=["term", "n", "pos"])


class Vocabulary:
    """Sorted term hashes, with the first place of each range of leading bits."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        bits = min(22, max(8, len(terms).bit_length()))
        self.shift = np.uint64(64 - bits)
        lead = (terms >> self.shift).astype(np.int64)
        self.starts = np.searchsorted(lead, np.arange(2**bits + 1))

    def __reduce__(self):
        return Vocabulary, (self.terms,)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 where it is no term."""
        lead = (hashes >> self.shift).astype(np.int64)
        at, end = self.starts[lead], self.starts[lead + 1]
        out = np.full(len(hashes), -1, dtype=np.int64)
        live = np.flatnonzero(at < end)
        while len(live):
            same = self.terms[at[live]] == hashes[live]
            out[live[same]] = at[live[same]]
            live = live[~same]
            at[live] += 1
            live = live[at[live] < end[live]]
        return out

    def vectors(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(terms, counts) of each text: places in the vocabulary, ascending, and how often each occurs."""
        for lo, hi, words in word_slices(texts, ALNUM):
            owner = np.repeat(np.arange(hi - lo), np.diff(words.offsets))
            pairs = []
            for h in terms_of(words):
                at = self.places(h)
                good = at >= 0
                pairs.append((owner[good] << 32) + at[good])
            pair, n = np.unique(np.concatenate(pairs), return_counts=True)
            bounds = np.searchsorted(pair >> 32, np.arange(hi - lo + 1))
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                yield pair[a:b] & (2**32 - 1), n[a:b]


def ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin[i], .., begin[i] + length[i] - 1 of each i, one after the other."""
    ahead = np.cumsum(length) - length
    return np.arange(length.sum()) + np.repeat(begin - ahead, length)


def pack(x: np.ndarray) -> bytes:
    """32-bit integers, compressed by byte planes."""
    x = np.ascontiguousarray(x, dtype=np.int32)
    return zlib.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T), 1)


def pack_all(x: np.ndarray, entries: int = 1 << 20) -> list[bytes]:
    """A long array in pieces, so that packing needs no second copy of it."""
    return [pack(x[lo : lo + entries]) for lo in range(0, len(x), entries)]


def opened_all(pieces: list[bytes], n: int, dtype: str) -> np.ndarray:
    out, lo = np.zeros(n, dtype=dtype), 0
    for x in map(opened, pieces):
        out[lo : lo + len(x)] = x
        lo += len(x)
    return out


def steps(terms: np.ndarray) -> np.ndarray:
    """Differences of ascending places, which pack better."""
    return np.diff(np.asarray(terms), prepend=0)


def opened(x: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(x), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.int32).ravel()


@dataclass
class Index:
    """Points (distinct example vectors) by row, and each term's points.

    Only the points travel, packed; weights and each term's points are made where they are first asked for.
    """

    idf: np.ndarray  # weight of each term
    row: np.ndarray  # bounds of each point's entries
    term: np.ndarray
    count: np.ndarray
    n: np.ndarray
    pos: np.ndarray
    example: np.ndarray  # an id for each point, as evidence

    @classmethod
    def build(cls, points: pd.DataFrame, idf: np.ndarray) -> Index:
        """Points in the order of their examples."""
        packed = {c: pa.array([pack(steps(x) if c == "terms" else np.asarray(x)) for x in points[c]], pa.binary())
                  for c in ("terms", "counts")}
        numbers = {c: pa.array(points[c].to_numpy(dtype=np.int64) if len(points) else [], pa.int64()) for c in ("n", "pos", "example")}
        return cls.unpacked(pa.table(packed | numbers | {"size": pa.array([len(t) for t in points["terms"]], pa.int32())}), idf)

    @classmethod
    def unpacked(cls, points: pa.Table, idf: np.ndarray) -> Index:
        """The same of points whose steps from term to term and counts came packed, with their `size`.

        Points are ordered by their heaviest term, then by example, so that points of a block are alike.
        """
        column = lambda c: points[c].to_numpy().astype(np.int64)
        heaviest = np.zeros(len(points), dtype=np.int64)
        for i, (t, n) in enumerate(zip(points["terms"], points["counts"], strict=True)):
            at = np.cumsum(opened(t.as_py()))
            heaviest[i] = at[np.argmax((1 + np.log(opened(n.as_py()))) * idf[at])]
        points = points.take(pa.array(np.lexsort((column("example"), heaviest))))
        row = np.concatenate(([0], np.cumsum(points["size"].to_numpy()))).astype(np.int64)
        flat = {c: np.zeros(row[-1], dtype=np.int32) for c in ("terms", "counts")}
        for c, out in flat.items():
            for i, x in enumerate(points[c]):
                out[row[i] : row[i + 1]] = opened(x.as_py()) if c == "counts" else np.cumsum(opened(x.as_py()))
        return cls(idf, row, flat["terms"], flat["counts"], column("n"), column("pos"), column("example"))

    def __getattr__(self, name: str):
        """`damped`, 1 + log of each small count; `norm`, each point's length before it is made 1; `place` (row of a
        frequent term in `dense`, -1: none) and `dense` (terms x points, in steps).

        The other terms have postings, `point` and `posted` (its weight in steps), by term and then by block of points. `postings`
        bounds each term's blocks among `block`, `bound` (where its postings begin; one more at the end) and `most` (the
        largest weight in the block). `loose` is each point's length without frequent terms.
        """
        if name == "weight" and "example" in self.__dict__:
            return self.weights(0, len(self.n))
        made = ("damped", "norm", "place", "dense", "postings", "block", "bound", "most", "point", "posted", "loose")
        if name not in made or "example" not in self.__dict__:
            raise AttributeError(name)
        length, terms, points = np.diff(self.row), len(self.idf), len(self.n)
        self.damped = np.append(0.0, 1 + np.log(np.arange(1, 1 << 16)))
        self.norm, lo = np.zeros(points), 0
        # A bounded number of entries at a time, as double precision takes several times the room.
        while lo < points:
            hi = max(lo + 1, int(np.searchsorted(self.row, self.row[lo] + (1 << 18), side="right")) - 1)
            own = slice(self.row[lo], self.row[hi])
            part = self.damp(self.count[own]) * self.idf[self.term[own]]
            self.norm[lo:hi] = np.sqrt(np.add.reduceat(part**2, self.row[lo:hi] - self.row[lo]))
            lo = hi
        size = np.zeros(terms, dtype=np.int64)
        for lo in range(0, len(self.term), 1 << 20):
            size += np.bincount(self.term[lo : lo + (1 << 20)], minlength=terms)
        often = np.argsort(-size, kind="stable")[:HEAD]
        self.place = np.full(terms, -1, dtype=np.int32)
        self.place[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), points), dtype=np.uint16)
        size[often] = 0
        blocks = range(0, points, BLOCK)
        met = np.zeros(terms, dtype=np.int64)
        for lo in blocks:
            held = np.zeros(terms, dtype=bool)
            held[self.term[self.row[lo] : self.row[min(points, lo + BLOCK)]]] = True
            met += held
        met[often] = 0
        self.postings = np.concatenate(([0], np.cumsum(met)))
        self.block, self.most = np.zeros(self.postings[-1], dtype=np.uint16), np.zeros(self.postings[-1], dtype=np.float32)
        self.bound = np.zeros(self.postings[-1] + 1, dtype=np.int32)  # entries are fewer than 2**31
        self.point = np.zeros(size.sum(), dtype=np.uint16 if points <= 1 << 16 else np.int32)
        self.posted, self.loose = np.zeros(len(self.point), dtype=np.uint16), np.zeros(points)
        next_pair, next_posting = self.postings[:-1].copy(), np.cumsum(size) - size
        for number, lo in enumerate(blocks):
            hi = min(points, lo + BLOCK)
            own = slice(self.row[lo], self.row[hi])
            t, w, p = self.term[own], self.weights(lo, hi), np.repeat(np.arange(lo, hi, dtype=np.int32), length[lo:hi])
            at = self.place[t]
            self.dense[at[at >= 0], p[at >= 0]] = np.rint(np.minimum(w[at >= 0], 1) * STEPS)
            t, w, p = t[at < 0], w[at < 0], p[at < 0]
            if not len(t):
                continue
            self.loose[lo:hi] = np.sqrt(np.bincount(p - lo, w.astype(float) ** 2, minlength=hi - lo))
            order = np.argsort(t, kind="stable")
            t, w, p = t[order], w[order], p[order]
            first = np.flatnonzero(np.diff(t, prepend=-1))
            each, n = t[first], np.diff(np.append(first, len(t)))
            at = ranges(next_posting[each], n)
            self.point[at], self.posted[at] = p, np.rint(np.minimum(w, 1) * STEPS)
            pair = next_pair[each]
            self.block[pair], self.most[pair], self.bound[pair + 1] = number, np.maximum.reduceat(w, first), n
            next_pair[each] += 1
            next_posting[each] += n
        np.cumsum(self.bound, out=self.bound)
        return self.__dict__[name]

    def weights(self, lo: int, hi: int) -> np.ndarray:
        """Weight of each entry of the points lo, .., hi - 1, a vector of length 1 for each."""
        return self.weights_at(slice(self.row[lo], self.row[hi]), np.repeat(np.arange(lo, hi), np.diff(self.row[lo : hi + 1])))

    def damp(self, counts: np.ndarray) -> np.ndarray:
        out = self.damped.take(counts, mode="clip")
        large = np.flatnonzero(counts >= len(self.damped))
        out[large] = 1 + np.log(counts[large], dtype=float)
        return out

    def weights_at(self, entries: np.ndarray | slice, points: np.ndarray) -> np.ndarray:
        part = self.damp(self.count[entries]) * self.idf[self.term[entries]]
        return (part / self.norm[points]).astype(np.float32)

    def __getstate__(self) -> dict:
        base = {k: self.__dict__[k] for k in ("idf", "row", "n", "pos", "example")}
        narrow = np.min_scalar_type(int(self.count.max(initial=0)))
        return base | {"term": pack_all(self.term), "count": pack_all(self.count), "narrow": narrow.str}

    def __setstate__(self, state: dict) -> None:
        n = int(state["row"][-1])
        kinds = {"term": "int32", "count": state.pop("narrow")}
        self.__dict__ |= state | {c: opened_all(state.pop(c), n, kinds[c]) for c in kinds}

    def nearest(self, terms: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(points, cosines) of the k nearest, by cosine, then by the points' order; only cosines above 0."""
        return self.nearest_weighted(terms, unit(terms, counts, self.idf), k)

    def nearest_weighted(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.nearest_many([(terms, weights)], k)[0]

    def nearest_many(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """`nearest_weighted` of each query."""
        place, dense = self.place, self.dense
        share = np.zeros((len(queries), len(dense)), dtype=np.float32)
        for i, (terms, weights) in enumerate(queries):
            at = place[terms]
            share[i, at[at >= 0]] = weights[at >= 0] / STEPS
        begun = np.zeros((len(queries), dense.shape[1]), dtype=np.float32)
        for lo in range(0, dense.shape[1], 2 * BLOCK):
            begun[:, lo : lo + 2 * BLOCK] = share @ dense[:, lo : lo + 2 * BLOCK].astype(np.float32)
        return [self.settled(t, w, k, begun[i].astype(float), place[t] < 0) for i, (t, w) in enumerate(queries)]

    def settled(
        self, terms: np.ndarray, weights: np.ndarray, k: int, scores: np.ndarray, left: np.ndarray,
    ) -> tuple[np.ndarray, np.ndarray]:
        """Adds the postings of the `left` terms to the scores, those that can add most first.

        What the terms not yet read can add to a point is bounded by their largest weights in the point's block, and by
        the lengths of what is left of the query and of the point. Blocks in which no point can still be among the k
        nearest are not read on. Reading ends once few points can; these are scored in full.
        """
        if not len(terms) or not len(scores):
            return np.zeros(0, np.int64), np.zeros(0)
        t, w = terms[left], weights[left].astype(float)
        slack = 1e-4 + len(terms) ** 0.5 / STEPS
        begin, pairs = self.postings[t], self.postings[t + 1] - self.postings[t]
        # Each term's blocks, terms that can add most first.
        gain = w * np.maximum.reduceat(self.most[ranges(begin, pairs)], np.cumsum(pairs) - pairs) if len(t) else w
        order = np.argsort(-gain, kind="stable")
        w, begin, pairs = w[order], begin[order], pairs[order]
        at = ranges(begin, pairs)
        ahead = np.append(0, np.cumsum(pairs))
        block, share = self.block[at], np.repeat(w, pairs)
        gain = share * self.most[at]
        count = -(-len(scores) // BLOCK)
        rest = np.bincount(block, gain, minlength=count)
        length = np.sqrt(np.append(np.cumsum((w * w)[::-1])[::-1], 0.0))
        first, end = self.bound[begin], self.bound[begin + pairs]
        ends = np.cumsum(end - first)
        starts, every = np.arange(0, len(scores), BLOCK), np.arange(len(scores)) // BLOCK
        last, done, step = max(0, len(scores) - k), 0, FIRST
        live = np.ones(count, dtype=bool)
        while True:
            least = np.partition(scores, last)[last]
            able = scores + np.minimum(rest[every], length[done] * self.loose) >= least - slack
            if least > 0:
                live &= np.logical_or.reduceat(able, starts)
            if done == len(w) or (least > 0 and np.count_nonzero(able) <= max(FULL, 2 * k)):
                break
            upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + step, side="right")))
            some = slice(ahead[done], ahead[upto])
            rest -= np.bincount(block[some], gain[some], minlength=count)
            keep = live[block[some]]
            if np.count_nonzero(keep) > SPARSE * len(keep):  # whole terms are read faster than their blocks
                self.add(first[done:upto], end[done:upto], w[done:upto], scores)
            else:
                read = at[some][keep]
                self.add(self.bound[read], self.bound[read + 1], share[some][keep], scores)
            done, step = upto, step * 4
        points = np.flatnonzero(able & live[every] & ((scores > 0) | (done < len(w))))
        if "_query" not in self.__dict__:
            self._query = np.zeros(len(self.idf))
        self._query[terms] = weights
        length = self.row[points + 1] - self.row[points]
        at = ranges(self.row[points], length)
        part = self._query[self.term[at]] * self.weights_at(at, np.repeat(points, length))
        self._query[terms] = 0.0
        scores = np.bincount(np.repeat(np.arange(len(points)), length), part, minlength=len(points))
        # Sums of equal vectors may differ in their last bits.
        chosen = np.lexsort((points, -np.round(scores, 12)))[:k]
        chosen = chosen[scores[chosen] > 1e-12]
        return points[chosen], scores[chosen]

    def add(self, begin: np.ndarray, end: np.ndarray, weights: np.ndarray, scores: np.ndarray) -> None:
        """Adds the postings begin[i], .., end[i] - 1, times weights[i], to the scores; about CHUNK of them at a time, which stay in cache."""
        size = end - begin
        runs = list(map(slice, begin.tolist(), end.tolist()))
        weights = weights / STEPS
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // CHUNK, prepend=0)).tolist()
        for lo, hi in zip([0, *cuts], [*cuts, len(runs)], strict=True):
            if lo == hi:
                continue
            point = np.concatenate([self.point[r] for r in runs[lo:hi]], dtype=np.intp, casting="unsafe")
            part = np.concatenate([self.posted[r] for r in runs[lo:hi]], dtype=np.float64, casting="unsafe")
            part *= np.repeat(weights[lo:hi], size[lo:hi])
            scores += np.bincount(point, part, minlength=len(scores))

    def vote(self, points: np.ndarray, scores: np.ndarray, base: float, without: tuple[int, int, int] | None = None) -> float:
        """Share of marked texts among the nearest, weighed by squared cosine and tally.

        `without` = (point, 1, mark) leaves one text of a point out.
        """
        n, pos = self.n[points].astype(float), self.pos[points].astype(float)
        if without is not None:
            own = points == without[0]
            n[own] -= without[1]
            pos[own] -= without[2]
        w = scores**2
        return float(((w * pos).sum() + LEAN * base) / ((w * n).sum() + LEAN))


def unit(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of length 1."""
    w = (1 + np.log(counts)) * idf[terms]
    return w / np.sqrt((w**2).sum()) if len(w) else w


def fit_curve(votes: np.ndarray, marks: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from the log-odds of votes to labels.

    Labels count as (n + 1) / (n + 2) and 1 / (n + 2) of their class, so that the curve stays finite where votes
    separate the classes.
    """
    n_pos, n_neg = weights[marks == 1].sum(), weights[marks == 0].sum()
    marks = np.where(marks == 1, (n_pos + 1) / (n_pos + 2), 1 / (n_neg + 2))
    x, slope, offset = np.log(votes / (1 - votes)), 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
        g = np.array([(weights * (p - marks) * x).sum() + 1e-2 * (slope - 1), (weights * (p - marks)).sum() + 1e-2 * offset])
        v = weights * np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(v * x * x).sum() + 1e-2, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-2]])
        move = np.linalg.solve(h, g)
        slope, offset = slope - np.clip(move[0], -1, 1), offset - np.clip(move[1], -1, 1)
        if np.abs(move).max() < 1e-9:
            break
    return max(slope, 1e-3), offset


def taught(id_: Column) -> Column:
    """Rows whose labels may be learned; the rest is held out."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit(""))) % 5 != 0


@dataclass
class Model:
    """All that scoring needs; its size is that of the texts of about EXAMPLES labelled rows."""

    vocabulary: Vocabulary
    index: Index
    base: float
    bare: float  # vote of texts without terms
    slope: float
    offset: float

    def calibrated(self, vote: float) -> float:
        vote = min(max(vote, 1e-6), 1 - 1e-6)
        return float(1 / (1 + np.exp(-(self.slope * np.log(vote / (1 - vote)) + self.offset))))

    def judge(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Score of each vector, its voters (points) and their cosines."""
        at, out = self.index, []
        for near, cos in at.nearest_many([(t, unit(t, c, at.idf)) for t, c in vectors], NEIGHBOURS):
            out.append((self.calibrated(at.vote(near, cos, self.base) if len(near) else self.bare), near, cos))
        return out


def train(
    docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
    learn: Column | None = None, examples: int = EXAMPLES,
) -> Model:
    """Model from labelled texts.

    `learn` tells which labelled ids may be learned from (default: all). About `examples` labelled rows are
    taken, by a hash of their id; document frequencies are of all documents. Conflicting labels of an id count
    as the larger; rows with a null id or label do not count. Without usable labels every text gets one score.
    """
    spark = docs.sparkSession
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if learn is not None:
        chosen = chosen.where(learn)
    chosen = chosen.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_mark"))
    chosen = stage(drawn(stage(chosen, "marks"), ["_id"], examples), "examples")
    sample = F.broadcast(chosen)  # about `examples` rows of two numbers
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    sampled = stage(texts.join(sample, "_id"), "sampled")
    size = sampled.agg(F.count("*"), F.sum("_mark")).first()
    n, pos = size[0], size[1] or 0
    base = (pos + 0.5) / (n + 1)
    z = F.abs(F.col("pos") / F.col("n") - base) * F.sqrt("n") / np.sqrt(base * (1 - base))
    tallies = sampled.select("_text", "_mark").mapInArrow(term_tallies, "term long, n long, pos long")
    held = (
        tallies.groupBy("term").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).select("term", z.alias("z")).toArrow())
    terms = held["term"].to_numpy().view(np.uint64)
    order = np.argsort(terms)
    vocabulary, tied = Vocabulary(terms[order]), held["z"].to_numpy()[order]
    del held, terms, order  # the driver keeps what the model needs
    sent = spark.sparkContext.broadcast(vocabulary)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts seen and texts with each term, one row a term and task; the row of term -1 counts the texts."""
        words = sent.value
        found, texts_seen = np.zeros(len(words.terms), dtype=np.int64), 0
        for batch in batches:
            for at, _ in words.vectors(batch.column(0)):
                found[at] += 1
            texts_seen += len(batch)
        held = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(held, -1)), pa.array(np.append(found[held], texts_seen))], names=["t", "n"])

    seen = docs.select(text_col).mapInArrow(frequencies, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    place, texts_with = seen["t"].to_numpy(), seen["n"].to_numpy()
    idf, total = np.zeros(len(vocabulary.terms)), texts_with[place < 0].sum()
    idf[place[place >= 0]] = texts_with[place >= 0]
    idf = (np.log((1 + total) / (1 + idf)) + 1) * (NEUTRAL + tied)
    del seen, place, texts_with, tied

    def to_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Packed, as all points go to the driver once.
            rows = [(pack(steps(t)), pack(n), len(t)) for t, n in sent.value.vectors(batch.column(1))]
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.binary(), pa.binary(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *made], names=["_id", "_mark", "terms", "counts", "size"])

    points = (
        sampled.select(F.col("_id").cast("long").alias("_id"), "_text", "_mark")
        .mapInArrow(to_vectors, "_id long, _mark int, terms binary, counts binary, size int").groupBy("terms", "counts", "size")
        .agg(F.count("*").alias("n"), F.sum("_mark").alias("pos"), F.min("_id").alias("example")).toArrow())
    empty = pc.equal(points["size"], 0)
    bare_n, bare_pos = (float(pc.sum(points[c].filter(empty)).as_py() or 0) for c in ("n", "pos"))
    index = Index.unpacked(points.filter(pc.invert(empty)), idf)
    bare_rate = (bare_pos + LEAN * base) / (bare_n + LEAN)
    del points
    with_index = spark.sparkContext.broadcast(index)

    def left_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Votes on each point's texts, one of them left out."""
        at = with_index.value
        for batch in batches:
            rows, ids = [], batch["id"].to_numpy()
            for lo in range(0, len(ids), TOGETHER):
                some = ids[lo : lo + TOGETHER]
                found = at.nearest_many([(at.term[at.row[i] : at.row[i + 1]], at.weights(i, i + 1)) for i in some], NEIGHBOURS)
                for i, (near, cos) in zip(some, found, strict=True):
                    for mark, count in ((1, at.pos[i]), (0, at.n[i] - at.pos[i])):
                        if count:
                            rows.append((at.vote(near, cos, base, (i, 1, mark)), mark, int(count)))
            yield pd.DataFrame(rows, columns=["vote", "mark", "n"])

    held = spark.range(len(index.n)).mapInPandas(left_out, "vote double, mark int, n long").toPandas()
    with_index.destroy()
    votes = np.append(held["vote"].to_numpy(dtype=float), [bare_rate, bare_rate])
    marks = np.append(held["mark"].to_numpy(dtype=float), [1.0, 0.0])
    weights = np.append(held["n"].to_numpy(dtype=float), [bare_pos, bare_n - bare_pos])
    slope, offset = fit_curve(np.clip(votes, 1e-6, 1 - 1e-6), marks, weights)
    return Model(vocabulary, index, base, bare_rate, slope, offset)


def scored(docs: DataFrame, model: Model, text_col: str = "text", name: str = "toxicity") -> DataFrame:
    """The rows with a struct column (score, evidence) added; `evidence` lists (example, similarity, texts, marked).

    Row by row over whole texts, no shuffle. Texts without any term of the model, empty and null ones included,
    get the calibrated share of such examples and no evidence.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("score double, evidence array<struct<example:long,similarity:double,texts:long,marked:long>>")
    def judge(texts: pa.Array) -> pa.Array:
        known, keys, waiting = {}, [], {}
        for terms, counts in sent.value.vocabulary.vectors(texts):
            keys.append(blake2b(terms.tobytes() + counts.tobytes(), digest_size=16).digest())
            if keys[-1] not in known:
                waiting[keys[-1]] = (terms, counts)
            if len(waiting) == TOGETHER:
                known |= zip(waiting, sent.value.judge(list(waiting.values())), strict=True)
                waiting = {}
        if waiting:
            known |= zip(waiting, sent.value.judge(list(waiting.values())), strict=True)
        out, at = [known[k] for k in keys], sent.value.index
        ends = np.cumsum([0, *(len(near) for _, near, _ in out)])
        near = np.concatenate([np.zeros(0, np.int64), *(x[1] for x in out)])
        cos = np.concatenate([np.zeros(0), *(x[2] for x in out)])
        # Columns, not an object for each voter.
        voters = pa.StructArray.from_arrays(
            [pa.array(at.example[near]), pa.array(cos), pa.array(at.n[near]), pa.array(at.pos[near])],
            names=["example", "similarity", "texts", "marked"])
        evidence = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), voters)
        return pa.StructArray.from_arrays(
            [pa.array([x[0] for x in out], pa.float64()), evidence], names=["score", "evidence"])

    return docs.withColumn(name, judge(F.col(text_col)))


def toxicity(
    docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
    learn: Column | None = None, examples: int = EXAMPLES,
) -> DataFrame:
    """(id, score, evidence) for each row; see `train` and `scored`. Ids may be null or repeated; other columns are not read."""
    model = train(docs, labels, label_col, id_col, text_col, learn, examples)
    out = scored(docs.select(F.col(id_col), F.col(text_col)), model, text_col, "_toxicity")
    return out.select(id_col, F.col("_toxicity.score").alias("score"), F.col("_toxicity.evidence").alias("evidence"))
