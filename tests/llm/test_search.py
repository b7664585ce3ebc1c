"""Exact top-k against all products."""

import numpy as np
import pytest

from tests.llm.test_texts import rows


def brute(data, k=5):
    kept = []
    for i, v in data:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        kept.append((i, np.floor(256 * np.array(v, dtype=float)).astype(int)))
    out = []
    for n, (i, q) in enumerate(kept):
        if i % 50 == 0:
            m = lambda a, b: int(np.dot(a[: len(b)], b[: len(a)]))
            found = sorted((-m(q, v), j, o) for o, (j, v) in enumerate(kept) if o != n)
            out += [(i, r + 1, j, -s) for r, (s, j, _) in enumerate(found[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("cell", [7, 2048])
def test_top_k_against_all_products(spark, monkeypatch, cell):
    from pyspark.sql import functions as F

    from sessionloom.llm import search

    monkeypatch.setattr(search, "CELL", cell)
    monkeypatch.setattr(search, "GROUP", 3)
    monkeypatch.setattr(search, "PER_PIVOT", 40)
    monkeypatch.setattr(search, "SUMMARY_ROWS", 16)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    data = [(i, (centres[i % 6] + 0.1 * rng.normal(size=8)).tolist()) for i in range(500)]
    data += [(i, [0.5] * 8) for i in range(500, 560)]  # one very common vector
    data += [(600, None), (601, [None] * 8), (650, [float("nan")] * 8), (651, [float("inf")] + [0.0] * 7), (None, [1.0] * 8),
             (50, [0.25] * 8), (700, [0.0] * 8), (750, [1.0, 2.0]), (751, [])]
    df = spark.createDataFrame([(*r, "z") for r in data], "vec_id long, embedding array<double>, score string")
    out = search.exact_top_k(df, F.col("vec_id") % 50 == 0)
    assert rows(out.select("query_id", "rank", "vec_id", "score")) == brute(data)


def test_few_rows(spark):
    from pyspark.sql import functions as F

    from sessionloom.llm.search import exact_top_k

    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, -1.0])], "vec_id long, embedding array<double>")
    assert rows(exact_top_k(df, F.col("vec_id") % 50 == 0)) == [(0, 1, 1, 32768), (0, 2, 2, 0)]
    assert exact_top_k(df, F.col("vec_id") > 50).count() == 0
    assert exact_top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_scores_beyond_whole_doubles(spark):
    """Neighbouring scores above 2**53 are told apart, and sums are exact above 2**63 as long as the results fit."""
    from pyspark.sql import functions as F

    from sessionloom.llm.search import exact_top_k, products

    rows_ = [(0, [2.0**29, 1.0])] + [(i, [2.0**29, float(i % 10)]) for i in range(1, 11)]
    df = spark.createDataFrame(rows_, "vec_id long, embedding array<double>")
    found = exact_top_k(df, F.col("vec_id") == 0, k=5, scale=1.0).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in found) == [(n + 1, 9 - n, 2**58 + 9 - n) for n in range(5)]
    far = [(0, [2.0**40, 2.0**40, 1.0]), (1, [2.0**40, -(2.0**40), 3.0]), (2, [2.0**40, -(2.0**40), 4.0]), (3, [-(2.0**40), 2.0**40, 5.0])]
    df = spark.createDataFrame(far, "vec_id long, embedding array<double>")
    found = exact_top_k(df, F.col("vec_id") == 0, k=2, scale=1.0).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in found) == [(1, 3, 5), (2, 2, 4)]
    import numpy as np

    ranks, exact = products(np.array([[2.0**40]]), np.array([[2.0**40], [1.0], [-(2.0**40)]]))
    assert exact.tolist() == [[2**80, 2**40, -(2**80)]] and ranks.tolist() == [[2, 1, 0]]
