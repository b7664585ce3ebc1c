"""Personal data: base spans against Python's matcher, bootstrapping against a plain version."""

import hashlib
import re

import pyarrow.parquet as pq

from tests.llm.cases import TEXTS, frame

SMALL = "/root/testdata/sf0.001"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {
        "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")),
        "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15,
    }[kind]


def base(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


CASES = [
    (100, "a@b.com_foo@x.y and a..b@x-1.co.uk. ä日 c@d.e @ x@y"), (101, "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.003.255 1.2.3"),
    (102, "4111 1111 1111 1111 and 4111-1111-1111-1111, 4111  1111 1111 1111 1111 x4111111111111111"),
    (103, "call +1 (555) 010-9999. or +44 20 7946 0958+1 555 010 9999 +12 +1-"), (104, "9" * 30000), (105, "1 " * 20000),
    (106, "a." * 20000 + "@b" + ".c" * 20000), (107, "日本 " * 30 + "4111111111111111 é x@y.zz"), (108, "+" * 500 + "1" + "-" * 500),
    (109, "1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6-7-8 4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1"),
]


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_base_spans_equal_the_plain_patterns(spark):
    from pyspark.sql import functions as F

    from sessionloom.llm.private import joined, private_spans

    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()]
    cases = [*TEXTS, *CASES, *docs]
    rows, _ = private_spans(frame(spark, cases))
    got = sorted(((r[0], r[1]) for r in rows.select("doc_id", F.sha2(joined(F.col("base")), 256)).collect()), key=str)
    assert got == sorted(((i, digest(base(t))) for i, t in cases), key=str)
    assert private_spans(frame(spark, []))[0].count() == 0


def test_sure_patterns_find_unseen_strings(spark):
    from pyspark.sql import functions as F

    from sessionloom.llm.private import all_spans, joined, masked, private_spans

    texts = [(i, f"lorem reach me at: joe{i}@mail{i}.org today, thanks") for i in range(6)]
    texts += [(10 + i, f'set token = "{i}{"ab12cd34" * 5}" here') for i in range(8)]
    texts += [(20, "reach me at: joe-at-42mail today"), (21, 'the token = "Zq9-hidden1" there'), (22, "clean words only 123456x in prose"),
              (23, "seen 123456y at noon"), (24, None), (25, "")]
    rows, known = private_spans(frame(spark, texts), carry=("text",))
    out = rows.select("doc_id", joined(all_spans(F.col("base"), F.col("found"))).alias("s"),
                      masked(F.coalesce("text", F.lit("")), all_spans(F.col("base"), F.col("found"))).alias("m")).collect()
    spans, text = {r["doc_id"]: r["s"] for r in out}, {r["doc_id"]: r["m"] for r in out}
    assert spans[20] == "email:13:26" and text[20] == "reach me at: <EMAIL> today"
    assert text[21] == 'the token = "<SECRET>" there'
    assert spans[22] == spans[23] == spans[24] == "" and text[22] == dict(texts)[22]
    assert text[3] == "lorem reach me at: <EMAIL> today, thanks"
    assert {r["kind"] for r in known.collect()} == {"email", "secret"}


def test_confidences_against_a_plain_graph(spark):
    import random

    from sessionloom.llm import private

    draw = random.Random(4)
    edges = {(f"p{draw.randrange(12)}", draw.randrange(60)): None for _ in range(300)}
    kinds = {i: draw.choice(["email", "phone", None, "email"]) for i in range(60)}
    rows = [(p, i, kinds[i]) for p, i in edges for _ in range(2)]
    old = private.SURE
    private.SURE = 0.5
    try:
        got = {r["pattern"]: (r["kind"], round(r["confidence"], 9)) for r in private.patterns(
            spark.createDataFrame(rows, "pattern string, instance long, kind string")).collect()}
        of = {}
        for p, i in edges:
            of.setdefault(p, set()).add(i)
        voters = {(p, i): (kinds[i], 1.0) for p, i in edges if kinds[i]}
        of = {p: s for p, s in of.items() if any(
            sum(kinds[i] == k for i in s) >= private.SUPPORT for k in ("email", "phone"))}
        for _ in range(private.ROUNDS):
            sure = {}
            for p, s in of.items():
                for k in ("email", "phone"):
                    have = [voters[p, i][1] for i in s if voters.get((p, i), ("", 0))[0] == k]
                    c = sum(have) / (len(s) + private.DOUBT)
                    if sum(x >= private.SURE for x in have) >= private.SUPPORT and c >= private.SURE:
                        sure[p] = max(sure.get(p, (0.0, "")), (c, k))
            for i in kinds:
                best = max((sure[p] for p in sure if i in of[p]), default=None)
                if not kinds[i] and best:
                    for p in of:
                        if i in of[p]:
                            voters[p, i] = (best[1], best[0])
        assert got == {p: (k, round(c, 9)) for p, (c, k) in sure.items()} and got
    finally:
        private.SURE = old


def test_learned_instances_induce_new_patterns_until_nothing_changes(spark):
    """A chain: p0 has the seeds, each next pattern only instances that the one before teaches."""
    from sessionloom.llm import private

    rows = [("p0", i, "email") for i in range(60)]
    for k in range(5):
        rows += [(f"p{k}", 100 + 10 * k + j, None) for j in range(3)] + [(f"p{k + 1}", 100 + 10 * k + j, None) for j in range(3)]
    rows += [("q", 200 + j, None) for j in range(9)] + [("q", 100, None)]
    old, private.SURE, private.DOUBT = (private.SURE, private.DOUBT), 0.4, 0.1
    try:
        got = {r["pattern"]: r["kind"] for r in private.patterns(
            spark.createDataFrame(rows, "pattern string, instance long, kind string")).collect()}
    finally:
        private.SURE, private.DOUBT = old
    assert got == {f"p{k}": "email" for k in range(6)}


def test_groups_and_short_strings_within_sure_patterns(spark):
    from pyspark.sql import functions as F

    from sessionloom.llm.private import all_spans, joined, masked, private_spans

    texts = [(i, f"call me at +1 (555) 010-99{i:02d} today") for i in range(30)]
    texts += [(100, "call me at 020 7946 0958 today"), (101, "call me at (020) 7946 0958."), (102, "call me at 4711 today"),
              (103, "call me at GB29 NWBK 6016 1331 9268 19 today"), (104, "we saw 12 3rd rows of 2019 at noon"), (105, "1 " * 20000)]
    rows, _ = private_spans(frame(spark, texts), carry=("text",))
    spans = all_spans(F.col("base"), F.col("found"))
    out = {r["doc_id"]: r for r in rows.select("doc_id", joined(spans).alias("s"), masked(F.col("text"), spans).alias("m")).collect()}
    assert out[100]["m"] == out[102]["m"] == out[103]["m"] == "call me at <PHONE> today"
    assert out[101]["m"] == "call me at <PHONE>."
    assert out[104]["s"] == out[105]["s"] == ""
