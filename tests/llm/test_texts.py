"""Token counts, license scan, decontamination and mixing against plain Python versions."""

import pyarrow.parquet as pq
import pytest

from tests.llm import brute
from tests.llm.cases import TEXTS, frame

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    t = pq.read_table(f"{SMALL}/documents.parquet").to_pylist()
    return [(r["doc_id"], r["text"]) for r in t]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_token_counts_equal_the_library(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    from sessionloom.llm.tokens import token_counts

    path = public_tokenizers.path("byte_bpe_50k.json")
    cases = [*TEXTS, *docs, (11, "ab" * 3000), (12, "  \n\n \t x"), (13, "don't I'll 12345 🎉🎉é́")]
    library = Tokenizer.from_file(path)
    expected = []
    for i, t in cases:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        expected.append((i, len((t or "").encode()), n, n > 1024))
    assert rows(token_counts(frame(spark, cases), path)) == sorted(expected, key=str)
    assert token_counts(frame(spark, []), path).count() == 0


def test_license_phrases_and_templates(spark, docs):
    from sessionloom.llm.licenses import scan_licenses

    cases = [*TEXTS, *docs]
    out = scan_licenses(frame(spark, cases))
    got = rows(out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"))
    assert got == sorted(((i, *brute.licenses_base(t)) for i, t in cases), key=str)
    labels = {r["doc_id"]: r["labels"] for r in scan_licenses(frame(spark)).collect()}
    assert labels[1] == "cc-by,mit,reserved"
    assert labels[6] == "gpl,gpl-3.0"
    assert labels[8] == "apache-2.0,cc-by,cc-by-nc-4.0"
    assert labels[9] == "copyright,reserved"
    assert labels[2] == labels[3] == ""
    assert scan_licenses(frame(spark, [])).count() == 0


def test_template_markup():
    from sessionloom.llm.licenses import Automaton
    from sessionloom.llm.words import ALNUM, hash_text

    machine = Automaton("x", "alpha beta [gamma delta] {1-2} omega")

    def end(text):
        words = hash_text(text, ALNUM)
        return machine.match(words, 0, len(words))

    assert end("alpha beta x omega") == 4
    assert end("alpha beta gamma delta x y omega tail") == 7
    assert end("alpha beta omega") == -1
    assert end("alpha beta x y z omega") == -1
    assert end("alpha x beta y omega") == -1
    assert machine.mandatory == 3


def test_contamination_against_all_windows(spark, docs, monkeypatch):
    from sessionloom.llm import contamination as module

    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SMALL}/benchmark.parquet").to_pylist()]
    passage = " ".join(f"w{i}" for i in range(30))
    items += [(900, passage), (900, passage), (901, "only three words"), (902, ""), (903, None), (None, "x y z a b c d e f g h")]
    cases = [*TEXTS, *docs, (20, f"before {passage} after"), (21, "w1 w2 w3 w4 w5 w6 w7 w8 w9"),
             (22, "x " + " ".join(f"w{i}" for i in range(5, 15))), (23, "has only three words twice: only three words"),
             (24, " ".join(["k"] * 40)), (25, "x y z a b c d e f g h"), (26, f"{passage} {passage} w0 w1")]
    items.append((904, " ".join(["k"] * 12)))
    expected = sorted(brute.contamination(cases, items), key=str)
    bench = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id long, text string, n_words string")

    def got():
        from pyspark.sql import functions as F

        out = module.contamination(frame(spark, cases), bench)
        return rows(out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256)))

    assert got() == expected
    monkeypatch.setattr(module, "FILTER_ROWS", 0)  # the shuffle join
    assert got() == expected
    none = module.contamination(frame(spark, cases), bench.limit(0))
    assert none.agg({"n_hit": "sum"}).first()[0] == 0
    assert module.contamination(frame(spark, []), bench).count() == 0


def test_mixing_meets_targets_and_reruns_agree(spark, monkeypatch):
    from sessionloom.llm import mixing

    monkeypatch.setattr(mixing, "CHUNK", 8)  # several levels of the tree
    made = [(i, " ".join(["w"] * (1 + i * 7 % 13)), ["a", "b", "c", None, "Z"][0 if i % 3 else i % 5]) for i in range(600)]
    made += [(600, None, "a"), (601, "", "b"), (5, "w w", "a"), (5, "w w", "a"), (None, "w w w", None)]
    df = spark.createDataFrame([(*r, 1) for r in made], "doc_id long, text string, source string, target int")
    out = mixing.mix_sources(df)
    got = out.collect()
    assert len(got) == len(made)
    sizes = {}
    for _, t, s in made:
        sizes[s] = sizes.get(s, 0) + len(brute.spaced(t))
    want = brute.targets(sizes)
    taken = {}
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["source_size"] == sizes[r["source"]]
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 13  # one document
    again = mixing.mix_sources(df.repartition(5, "text"))
    key = lambda r: str((r["doc_id"], r["source"], r["size"], r["copies"]))
    assert sorted(map(key, got)) == sorted(map(key, again.collect()))
    assert mixing.mix_sources(df.limit(0)).count() == 0
    empty = mixing.mix_sources(df.where("text is null")).collect()
    assert [r["taken"] for r in empty] == [0]


def test_mixing_deals_equal_rows_to_many_chunks(spark, monkeypatch):
    """Rows that agree in id and size are spread like others, and the result does not depend on their order."""
    from pyspark.sql import functions as F

    from sessionloom.llm import mixing

    monkeypatch.setattr(mixing, "CHUNK", 50)
    rows_ = [(None, "a b c", "s")] * 250 + [(i, "a b", "s") for i in range(100)] + [(i, "x y z w", "t") for i in range(200)]
    df = spark.createDataFrame(rows_, "doc_id long, text string, source string")
    shape = df.select(F.lit("s").alias("source"), F.lit(3).alias("size"), F.lit(7).alias("_chunks"), F.lit(5).alias("_row"))
    spread = mixing._spread(shape).groupBy("_chunk").count().collect()
    assert len(spread) == 7 and max(r["count"] for r in spread) < 2 * len(rows_) / 7
    out = mixing.mix_sources(df)
    for r in out.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect():
        assert abs(r["t"] - r["g"]) <= 4
    key = lambda o: sorted(map(str, o.select("doc_id", "source", "copies").collect()))
    assert key(out) == key(mixing.mix_sources(df.repartition(7)))
