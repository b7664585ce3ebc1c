"""Near-duplicate vectors against all cosines."""

import numpy as np
import pytest


def brute(data, threshold=0.93):
    """data: (id, vector, label) -> rows (id, n_links, component, kept)."""
    n = len(data)
    unit = []
    for _, v, label in data:
        ok = label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        scaled = np.array(v, dtype=float) / max(map(abs, v)) if ok else None
        unit.append(scaled / np.linalg.norm(scaled) if ok else None)
    link = np.zeros((n, n), dtype=bool)
    for i in range(n):
        for j in range(n):
            if i != j and unit[i] is not None and unit[j] is not None and data[i][2] == data[j][2]:
                m = min(len(unit[i]), len(unit[j]))
                link[i, j] = unit[i][:m] @ unit[j][:m] >= threshold
    root = np.arange(n)
    while True:
        after = np.minimum(root, np.where(link, root[None, :], n).min(1))
        if (after == root).all():
            break
        root = after
    out = []
    for i in range(n):
        ids = [data[j][0] for j in np.flatnonzero(root == root[i]) if data[j][0] is not None]
        least = min(ids) if ids else None
        out.append((data[i][0], int(link[i].sum()), least, least is not None and data[i][0] == least))
    return sorted(out, key=str)


def frame(spark, data):
    return spark.createDataFrame(
        [(i, v, y, "a", 1, 2) for i, v, y in data],
        "vec_id long, embedding array<double>, label int, root string, bucket int, copies int")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def noisy(rng, centre, cos):
    """A unit vector at the given cosine to the centre."""
    w = rng.normal(size=centre.shape)
    w -= (w @ centre) * centre
    return cos * centre + np.sqrt(1 - cos**2) * w / np.linalg.norm(w)


def data_of(rng, width=16):
    centres = rng.normal(size=(5, width))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    data = [(i, noisy(rng, centres[i % 5], 0.985).tolist(), i % 5 % 2) for i in range(120)]
    data += [(i, rng.normal(size=width).tolist(), i % 3) for i in range(200, 260)]
    data += [(i, (3 * centres[0]).tolist(), 0) for i in range(300, 340)]  # equal ones, longer than the others
    data += [(400, None, 1), (401, [0.0] * width, 1), (402, [None] * width, 1), (403, [float("nan")] * width, 1),
             (404, [float("inf")] * width, 1), (405, [], 1), (406, centres[0].tolist(), None), (None, centres[1].tolist(), 1),
             (7, centres[2].tolist(), 0), (None, rng.normal(size=width).tolist(), 2), (407, [1.0, 2.0], 2), (408, [1.0, 2.0], 2),
             (409, (1e200 * centres[3]).tolist(), 1), (410, [None, 1.0], 1),
             (411, (1e-200 * centres[3]).tolist(), 1)]
    return data


@pytest.mark.parametrize("block", [4, 512])
def test_links_against_all_cosines(spark, monkeypatch, block):
    from sessionloom.llm import neardup

    monkeypatch.setattr(neardup, "BLOCK", block)
    data = data_of(np.random.default_rng(5))
    assert rows(neardup.near_duplicates(frame(spark, data))) == brute(data)


def test_given_vectors(spark, folder):
    from sessionloom.llm.queries import op13

    given = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert rows(op13(spark, folder)) == brute(given)


def test_recall(spark):
    """Pairs at every cosine from the threshold on, in 64 dimensions among unrelated vectors, with a dense group."""
    from sessionloom.llm import neardup

    rng = np.random.default_rng(6)
    base = rng.normal(size=(1500, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    data = [(i, v.tolist(), i % 2) for i, v in enumerate(base)]
    data += [(5000 + i, noisy(rng, base[i], rng.uniform(0.931, 0.99)).tolist(), i % 2) for i in range(1000)]
    data += [(9000 + i, noisy(rng, base[0], 0.975).tolist(), 0) for i in range(300)]
    expected = {r[0]: r for r in brute(data)}
    found = {r[0]: r for r in rows(neardup.near_duplicates(frame(spark, data)))}
    links = sum(r[1] for r in expected.values())
    assert all(found[i][1] <= expected[i][1] for i in expected)
    assert sum(r[1] for r in found.values()) >= 0.97 * links
    pairs = [i for i in expected if 5000 <= i < 9000]
    assert sum(found[i][1] for i in pairs) >= 0.95 * sum(expected[i][1] for i in pairs)


def test_empty_and_unusable_tables(spark):
    from sessionloom.llm.neardup import near_duplicates

    df = frame(spark, [(1, None, 1), (2, [1.0, 0.0], None), (None, [0.0], 1)])
    assert rows(near_duplicates(df)) == [(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, False)]
    assert near_duplicates(df.limit(0)).count() == 0


def test_components_of_chains_stars_and_rings(spark):
    from sessionloom.llm.common import components

    rng = np.random.default_rng(8)
    chain = rng.permutation(200).tolist()
    edges = list(zip(chain[:-1], chain[1:], strict=True))
    edges += [(9999, i) for i in range(1000, 1300)] + [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)] + [(5, 5), (3000, 3001)] * 2
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    expected = {i: 0 for i in range(200)} | {i: 1000 for i in [*range(1000, 1300), 9999]}
    expected |= {2000 + i: 2000 for i in range(50)} | {3000: 3000, 3001: 3000}
    assert found == expected
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
