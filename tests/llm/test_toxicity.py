"""Nearest labelled examples against all cosines, held-out accuracy, awkward rows."""

import numpy as np
import pandas as pd
import pytest

from tests.llm.cases import TEXTS, frame


def points(rng, n, terms):
    rows = []
    for i in range(n):
        t = np.sort(rng.choice(terms, size=rng.integers(1, 6), replace=False))
        c = rng.integers(1, 4, len(t))
        rows.append({"terms": t.tolist(), "counts": c.tolist(), "n": int(rng.integers(1, 4)), "pos": 0, "example": i})
    frame = pd.DataFrame(rows)
    frame["pos"] = frame["n"] // 2
    return frame[~frame[["terms", "counts"]].map(tuple).duplicated()].reset_index(drop=True)


def test_block_max_search_equals_all_cosines():
    from sessionloom.llm.toxicity import Index, unit

    rng = np.random.default_rng(5)
    idf = rng.uniform(1, 4, 40)
    index = Index.build(points(rng, 900, 40), idf)
    dense = np.zeros((len(index.n), 40))
    for i in range(len(dense)):
        own = slice(index.row[i], index.row[i + 1])
        dense[i, index.term[own]] = index.weight[own]
    for _ in range(100):
        t = np.sort(rng.choice(40, size=rng.integers(1, 6), replace=False))
        c = rng.integers(1, 4, len(t))
        q = np.zeros(40)
        q[t] = unit(t, c, idf)
        cos = np.round(dense @ q, 12)
        want = [p for p in np.lexsort((np.arange(len(cos)), -cos))[:16] if cos[p] > 1e-12]
        near, scores = index.nearest(t, c, 16)
        assert near.tolist() == want
        assert scores == pytest.approx(cos[want])


def corpus(spark, n=600):
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(80)]
    docs, labels = [], []
    for i in range(n):
        text = list(rng.choice(words, 30))
        toxic = i % 5 == 0
        if toxic:
            text[3:3] = [str(rng.choice(["insulta", "insultb", "vilex"]))]
        docs.append((i, " ".join(text)))
        if i % 4:
            labels.append((i, int(toxic), 1, "x"))
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int, score int, terms string")


def test_held_out_accuracy(spark):
    from pyspark.sql import functions as F

    from sessionloom.llm.toxicity import taught, toxicity

    docs, labels = corpus(spark)
    out = toxicity(frame(spark, docs), labels, learn=taught(F.col("doc_id"))).toPandas()
    assert ((out["score"] >= 0.5) == (out["doc_id"] % 5 == 0)).mean() > 0.99
    assert out["score"].between(0, 1).all() and out["evidence"].map(len).max() > 0


def test_awkward_rows(spark):
    from sessionloom.llm.toxicity import toxicity

    docs, labels = corpus(spark)
    extra = [(1000 + (i or 0), t) if i is not None else (i, t) for i, t in TEXTS]
    out = toxicity(frame(spark, docs + extra), labels).toPandas()
    assert len(out) == len(docs) + len(extra) and out["score"].between(0, 1).all()
    same = out[out["doc_id"].isin([1002, 1003])]["score"]
    assert same.nunique() == 1 and same.iloc[0] < 0.5
    alone = toxicity(frame(spark), labels.limit(0)).toPandas()
    assert len(alone) == len(TEXTS) and alone["score"].nunique() == 1
    assert toxicity(frame(spark, []), labels).count() == 0


def test_rare_terms_and_few_labels_have_neighbours(spark):
    """Terms of one or two labelled texts count, and texts without a telling word have neighbours too."""
    from sessionloom.llm.toxicity import toxicity

    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(40)]
    docs = [(i, " ".join([*rng.choice(words, 12), *(["zvilexq"] if i in (0, 7) else [])])) for i in range(30)]
    labels = spark.createDataFrame([(i, int(i in (0, 7))) for i in range(30)], "doc_id long, toxic int")
    asked = [(100, "zvilexq"), (101, " ".join(words[:8]))]
    out = {r["doc_id"]: r for r in toxicity(frame(spark, docs + asked), labels).collect()}
    assert {v["example"] for v in out[100]["evidence"]} == {0, 7} and len(out[101]["evidence"]) == 16
    assert out[100]["score"] > out[101]["score"]


def test_search_settles_early_with_the_same_points(monkeypatch):
    from sessionloom.llm import toxicity

    rng = np.random.default_rng(8)
    idf = rng.uniform(0.1, 9, 300) ** 2
    index = toxicity.Index.build(points(rng, 3000, 300), idf)
    asked = [np.sort(rng.choice(300, size=8, replace=False)) for _ in range(50)]
    whole = [index.nearest(t, np.ones(8, int), 16) for t in asked]
    monkeypatch.setattr(toxicity, "FIRST", 8)
    for t, (near, cos) in zip(asked, whole, strict=True):
        again = index.nearest(t, np.ones(8, int), 16)
        assert again[0].tolist() == near.tolist() and again[1] == pytest.approx(cos)


def test_index_travels_whole():
    import pickle

    from sessionloom.llm.toxicity import Index

    index = Index.build(points(np.random.default_rng(2), 200, 50), np.linspace(1, 3, 50))
    again = pickle.loads(pickle.dumps(index))
    for name in ("idf", "row", "term", "count", "n", "pos", "example", "weight", "postings", "point", "posted", "most"):
        assert np.array_equal(getattr(index, name), getattr(again, name))


@pytest.mark.parametrize(("head", "block", "first"), [(0, 16, 8), (4, 16, 8), (4, 64, 1 << 16), (40, 1, 1)])
def test_blocks_are_skipped_with_the_same_points(monkeypatch, head, block, first):
    """Postings of rare terms, blocks of one to many points, against all cosines, ties and rows of one term included."""
    from sessionloom.llm import toxicity

    for name, value in (("HEAD", head), ("BLOCK", block), ("FIRST", first), ("FULL", 4)):
        monkeypatch.setattr(toxicity, name, value)
    rng = np.random.default_rng(12)
    idf = rng.uniform(0.1, 9, 200) ** 2
    index = toxicity.Index.build(points(rng, 1500, 200), idf)
    dense = np.zeros((len(index.n), 200))
    for i in range(len(dense)):
        own = slice(index.row[i], index.row[i + 1])
        dense[i, index.term[own]] = index.weight[own]
    for size in (1, 2, 8, 60):
        for _ in range(10):
            t = np.sort(rng.choice(np.unique(index.term), size=size, replace=False))
            c = rng.integers(1, 4, size)
            q = np.zeros(200)
            q[t] = toxicity.unit(t, c, idf)
            cos = np.round(dense @ q, 12)
            want = [p for p in np.lexsort((np.arange(len(cos)), -cos))[:3] if cos[p] > 1e-12]
            near, scores = index.nearest(t, c, 3)
            assert near.tolist() == want
            assert scores == pytest.approx(cos[want])


def test_very_frequent_words_in_a_text():
    import pickle

    from sessionloom.llm.toxicity import Index, unit

    rows = pd.DataFrame({"terms": [[0, 1], [1, 2]], "counts": [[70_000, 1], [300, 2]], "n": [1, 1], "pos": [0, 1], "example": [0, 1]})
    idf = np.array([1.0, 2.0, 3.0])
    index = pickle.loads(pickle.dumps(Index.build(rows, idf)))
    want = {e: unit(np.array(t), np.array(c), idf) for e, t, c in zip(rows["example"], rows["terms"], rows["counts"], strict=True)}
    for i, e in enumerate(index.example):
        assert index.weights(i, i + 1) == pytest.approx(want[e])


def test_postings_are_narrow_and_added_in_bounded_pieces(monkeypatch):
    """A worker's memory: two bytes a weight, and no copy of all of a query's postings."""
    from sessionloom.llm import toxicity

    monkeypatch.setattr(toxicity, "HEAD", 0)
    monkeypatch.setattr(toxicity, "CHUNK", 64)
    rng = np.random.default_rng(4)
    idf = rng.uniform(1, 4, 60)
    index = toxicity.Index.build(points(rng, 2000, 60), idf)
    assert index.posted.dtype.itemsize == 2
    sizes, concatenate = [], np.concatenate

    def seen(parts, *args, **kwargs):
        out = concatenate(parts, *args, **kwargs)
        if kwargs.get("dtype") is np.intp:
            sizes.append(len(out))
        return out

    monkeypatch.setattr(toxicity.np, "concatenate", seen)
    index.nearest(np.arange(60), np.ones(60, int), 16)
    longest = np.bincount(index.term).max()
    assert sum(sizes) >= len(index.term) // 2 and max(sizes) < 64 + longest
