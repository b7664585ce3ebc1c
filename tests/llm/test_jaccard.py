"""Jaccard components against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import brute
from tests.llm.cases import TEXTS, frame


def components(rows, k, percent):
    sets = []
    for _, t in rows:
        w = brute.spaced(t)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(sets[i]), low.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed=1):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    line = " ".join(draw.choices(vocabulary, k=15))
    rows, n = [], 100
    for _ in range(40):
        words = draw.choices(vocabulary, k=draw.choice([1, 2, 5, 9, 10, 11, 12, 30, 60, 120]))
        if draw.random() < 0.5:
            words += line.split()  # a very common line
        for _ in range(draw.choice([1, 1, 2, 4, 9])):
            copy = list(words)
            for _ in range(draw.choice([0, 1, 1, 2, 3, 6])):
                at = draw.randrange(len(copy))
                copy[at : at + 1] = draw.choice([[], [draw.choice(vocabulary)], [copy[at], "plus"]])
                copy = copy or ["x"]
            rows.append((n, " ".join(copy)))
            n += 1
    base = draw.choices(vocabulary, k=80)
    for _ in range(60):  # a star of near copies around one text
        copy = list(base)
        copy[draw.randrange(80)] = draw.choice(vocabulary)
        rows.append((n, " ".join(copy)))
        n += 1
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_components_against_all_pairs(spark, k, percent):
    from sessionloom.llm.jaccard import jaccard_components

    rows = [*TEXTS, *corpus()]
    out = jaccard_components(frame(spark, rows).repartition(3), k=k, percent=percent)
    got = sorted((tuple(r) for r in out.collect()), key=str)
    want = components(rows, k, percent)
    assert got == want
    assert len({c for _, _, c in want}) < len(want) - 40


def test_empty(spark):
    from sessionloom.llm.jaccard import jaccard_components

    assert jaccard_components(frame(spark, [])).count() == 0
    assert [tuple(r) for r in jaccard_components(frame(spark, [(1, None), ])).collect()] == [(1, 0, 1)]


def test_neighbours_over_batches_and_ranges():
    from sessionloom.llm.jaccard import neighbours

    draw = np.random.default_rng(2)
    s = np.sort(draw.integers(0, 40, 120))
    node = np.arange(120)
    for cuts in ([], [60], [1, 2, 3, 50, 51, 119]):
        parts = np.split(np.arange(120), cuts)
        batches = [pa.RecordBatch.from_arrays([pa.array(x[p]) for x in (s, node, node)], names=["s", "node", "n"]) for p in parts]
        out = [r for b in neighbours(iter(batches)) for r in b.to_pylist()]
        got = {r["node"]: r["prev"] for r in out}
        assert len(got) == len(out)
        for i in range(120):
            shared = (s == s[i]).sum() > 1
            if shared or i in (0, 119):
                assert got[i] == (i - 1 if i and s[i - 1] == s[i] else None)
            else:
                assert i not in got


@pytest.mark.parametrize("percent", [60, 80, 90, 95])
def test_linked_sets_share_a_column(percent):
    from sessionloom.llm.jaccard import Cuts

    draw, cuts = np.random.default_rng(3), Cuts(percent, 400)
    for y in [*range(1, 40), 60, 100, 150, 300] * 8:
        x = int(draw.integers(y, 100 * y // percent + 1))
        both = -(-percent * (x + y) // (100 + percent))
        if both > y or x == y == both:
            continue
        every = draw.integers(0, 2**63, x + y - both, dtype=np.uint64)
        a, b = np.sort(every[:x]), np.sort(every[x - both :])
        owner, column = cuts.columns(np.array([0, x, x + y]), np.concatenate((a, b)))
        assert len(np.intersect1d(column[owner == 0], column[owner == 1]))


def test_a_common_passage_makes_no_common_column():
    from sessionloom.llm.jaccard import Cuts

    draw = np.random.default_rng(4)
    passage = draw.integers(0, 2**63, 20, dtype=np.uint64)
    sets = [np.sort(np.concatenate((passage, draw.integers(0, 2**63, 180, dtype=np.uint64)))) for _ in range(200)]
    owner, column = Cuts(90, 400).columns(np.arange(201) * 200, np.concatenate(sets))
    assert np.unique(column, return_counts=True)[1].max() < 10 and len(np.unique(owner)) == 200


@pytest.mark.parametrize("percent", [60, 80, 95])
def test_sketches_never_part_linked_sets(percent):
    from sessionloom.llm.jaccard import fewest_apart, may_link, sketches, wide_sketch

    draw = np.random.default_rng(6)
    for y in [1, 2, 5, 9, 40, 300, 700, 5000] * 4:
        x = int(draw.integers(y, 100 * y // percent + 1))
        both = -(-percent * (x + y) // (100 + percent))
        if both > y:
            continue
        every = draw.integers(0, 2**63, x + y - both, dtype=np.uint64)
        a, b = np.sort(every[:x]), np.sort(every[x - both :])
        narrow = sketches(np.array([0, x, x + y]), np.concatenate((a, b)))
        assert may_link((np.array([x]), np.array([y])), narrow[:1], narrow[1:], percent).all()
        assert fewest_apart(wide_sketch(a), wide_sketch(b)) <= x + y - 2 * both
    other = draw.integers(0, 2**63, 5000, dtype=np.uint64)
    assert fewest_apart(wide_sketch(every), wide_sketch(other)) > 0.5 * len(other)


def column_rows(s, n, node, root, sets):
    from sessionloom.llm.jaccard import sketches

    bounds = np.cumsum([0, *map(len, sets)])
    packed = [x.tobytes() for x in sketches(bounds, np.concatenate(sets))]
    return [*(pa.array(np.asarray(x, dtype=np.int64)) for x in (s, n, node, node, root)), pa.array(packed, pa.binary())]


def test_unlike_rows_of_a_common_column_are_no_pairs():
    """A column of many unlike texts leaves the linked ones only, over any batches; before, all their texts travelled."""
    from sessionloom.llm.jaccard import alike

    draw = np.random.default_rng(7)
    sets = [draw.integers(0, 2**63, 200, dtype=np.uint64) for _ in range(300)]
    sets[7] = np.concatenate((sets[200][:190], sets[7][:10]))
    rows = column_rows([1] * 250 + [2] * 50, [200] * 300, range(300), range(300), sets)
    names = ["s", "n", "node", "block", "root", "sketch"]
    for cuts in ([], [100], [1, 249, 250, 251]):
        batches = [pa.RecordBatch.from_arrays([x[int(p[0]) : int(p[-1]) + 1] for x in rows], names=names) for p in np.split(np.arange(300), cuts)]
        got = [tuple(r.values()) for b in alike(iter(batches), 80, False) for r in b.to_pylist()]
        assert got == [(7, 200)]
        assert not any(len(b) for b in alike(iter(batches), 80, True))


def test_pairs_are_sifted_by_wide_sketches():
    from sessionloom.llm.jaccard import sifted, wide_sketch

    draw = np.random.default_rng(8)
    a, b = (draw.integers(0, 2**63, 3000, dtype=np.uint64) for _ in range(2))
    near = np.concatenate((a[:2700], b[:300]))
    rows = [(1, 10, a), (1, 11, b), (2, 10, a), (2, 10, a), (2, 12, near), (3, 11, b)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([3000] * 6),
         pa.array([wide_sketch(r[2]) for r in rows], pa.binary())], names=["group", "node", "n", "wide"])
    assert [tuple(r.values()) for x in sifted(iter([batch]), 80) for r in x.to_pylist()] == [(10, 12)]


def test_staging_releases_its_shuffle_files(spark):
    from sessionloom.sources.staging import RELEASE, stage_and_release

    def files():
        return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()

    before, kept = files(), spark.conf.get(RELEASE, None)
    out = stage_and_release(spark.range(5000).selectExpr("id % 700 as k").groupBy("k").count())
    assert files() <= before and out.count() == 700 and spark.conf.get(RELEASE, None) == kept
