"""The pipeline's stages against plain versions and planted cases."""

import random

import pytest

import corpus_pipeline as pipeline
from tests.llm import brute
from tests.llm.test_jaccard import components
from tests.llm.test_private import base

SMALL = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of the smallest table with planted cases, nulls and repeats."""
    draw = random.Random(6)
    words = [f"k{i}" for i in range(300)]
    item = " ".join(draw.choices(words, k=20))
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select(*[c.split()[0] for c in COLUMNS.split(", ")]).collect()]
    labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()]
    n = 10_000

    def add(text, source="s"):
        nonlocal n
        docs.append((n, text, "en", source, len(text or "")))
        n += 1
        return n - 1

    for i in range(200):
        doc = add(" ".join([*draw.choices(words, k=30), "vileword"] if i % 4 == 0 else draw.choices(words, k=30)))
        labels.append((doc, int(i % 4 == 0)))
    planted = {"toxic": add(" ".join([*draw.choices(words, k=20), "vileword"])), "leak": add("x y " + item + " z")}
    text = " ".join(draw.choices(words, k=60))
    planted["near"] = [add(text), add(text + " tail"), add(text)]
    planted["private"] = add("write to joe.x@mail.org or +1 (555) 010-9999 " + " ".join(draw.choices(words, k=9)))
    docs += [(None, text, None, None, None), (None, None, None, None, None), (n, None, "en", None, 0), (n, None, "en", None, 0),
             (n + 1, "same row twice here", "en", "s", 3), (n + 1, "same row twice here", "en", "s", 3)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, planted


def key(r):
    return str(tuple(r))


def test_stages(spark, folder, tmp_path):
    path, planted = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, step in pipeline.STAGES:
        before = docs.collect()
        step(spark, docs, path).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
        if name == "near_duplicates":
            # Plain version: one row for each component, of the smallest id.
            rows = [(r["doc_id"] if r["doc_id"] is not None else 10**12, r["text"]) for r in before]
            parts = components(rows, 5, 80)
            assert len(kept[name]) == len({c for _, n, c in parts if n}) + sum(n == 0 for _, n, _ in parts)
            ids = {r["doc_id"] for r in kept[name] if brute.spaced(r["text"])}
            assert ids == {None if c == 10**12 else c for _, n, c in parts if n}
        if name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
            hits = brute.contamination([(i, r["text"]) for i, r in enumerate(before)], items)
            assert sorted(map(key, kept[name])) == sorted(key(before[i]) for i, _, n, _, _ in hits if not n)
        if name == "private_data":
            assert len(kept[name]) == len(before)
            assert not [b for r in kept[name] for b in base(r["text"])]
            same = {r["doc_id"]: r for r in before}
            for r in kept[name]:
                if r["doc_id"] is not None and not base(same[r["doc_id"]]["text"]) and "<SECRET>" not in (r["text"] or ""):
                    assert r["text"] == same[r["doc_id"]]["text"]
        if name != "mixing":
            assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    ids = {name: {r["doc_id"] for r in rows} for name, rows in kept.items()}
    assert planted["toxic"] not in ids["toxicity"] and planted["leak"] in ids["near_duplicates"]
    assert planted["leak"] not in ids["decontamination"]
    assert [i in ids["near_duplicates"] for i in planted["near"]] == [True, False, False]
    text = {r["doc_id"]: r["text"] for r in kept["private_data"]}[planted["private"]]
    assert text.startswith("write to <EMAIL> or <PHONE> k")
    sizes = {}
    for r in kept["private_data"]:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(brute.spaced(r["text"]))
    want, taken = brute.targets(sizes), {}
    for r in kept["mixing"]:
        assert 1 <= r["copies"] <= 3
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * len(brute.spaced(r["text"]))
    longest = max(len(brute.spaced(r["text"])) for r in kept["private_data"])
    for s, t in want.items():
        assert abs(taken.get(s, 0) - t) <= longest


def test_run_equals_the_stages_and_takes_an_empty_table(spark, folder, tmp_path):
    path, _ = folder
    once = pipeline.run(spark, path)
    assert sorted(map(key, once.collect())) == sorted(map(key, pipeline.run(spark, path).collect()))
    for name, columns in (("documents", COLUMNS), ("labels", "doc_id long, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], columns).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_with_inner_names_are_carried(spark, folder, tmp_path):
    """Extra columns whose names the stages use themselves stay as they are; `copies` is the last stage's own."""
    from pyspark.sql import functions as F

    path, _ = folder
    extra = ["base", "found", "_key", "_judged", "_row", "_rest", "_text", "_uid", "size", "a.b"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    docs = docs.select("*", *[F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in extra],
                       F.lit("given").alias("copies"))
    names = docs.columns
    for name, step in pipeline.STAGES:
        step(spark, docs, path).write.parquet(f"{tmp_path}/{name}-wide")
        docs = spark.read.parquet(f"{tmp_path}/{name}-wide")
        assert sorted(docs.columns) == sorted(names)
    rows = docs.collect()
    assert rows and all(r["copies"] >= 1 for r in rows)
    assert all(r[c] == f"{c}-{'-' if r['doc_id'] is None else r['doc_id']}" for r in rows for c in extra)
