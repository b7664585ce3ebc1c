"""URL filter against plain Python rules, segmentation and naive Bayes."""

import math
import re

import pytest

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]

URLS = [
    (1, "http://greenapple.example.com/en/1"), (2, "https://WWW.Example.com/en/2?x=1"), (3, "http://redapple.net/es/3"),
    (4, "http://badcasino.net/fr/3#t"), (5, "https://badcasino.org/fr/9"), (6, "https://greenapple.org/shop/12"),
    (7, None), (8, "no scheme"), (9, ""), (10, "ftp://x.net?q=/es/"), (11, "http://a.com"), (12, "a://b.net/es/://c.com/"),
    (5, "https://badcasino.org/fr/9"), (None, "http://xnet/es/1"), (13, "http://" + "longname" * 500 + ".org/" + "p/" * 2000),
    (14, "http://com/"), (15, "http://NET/fr/ÄÖ"),
]
TEXT = "green apple and red apple or bad casino " * 5 + "apple green"


def reference(urls):
    out = []
    for i, u in urls:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
        best = None
        for h, p, v in RULES:
            if (host == h or host.endswith("." + h)) and path.startswith(p) and (not best or len(h + p) > len(best[0])):
                best = (h + p, v)
        out.append((i, host, path, best))
    return out


def test_filter_against_plain_python(spark):
    from pyspark.sql import functions as F

    from sessionloom.llm.urls import best_split, url_filter

    df = spark.createDataFrame([(i, u, 1, "h", "r") for i, u in URLS], "page_id long, url string, _uid int, host string, rule string")
    texts = spark.createDataFrame([(TEXT,), (None,), ("",)], "html string")
    got = url_filter(df, texts, F.split("html", " ")).collect()
    ref = reference(URLS)
    key = lambda r: str(r)
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"]) for r in got), key=key) == sorted(
        ((i, h, p, b and b[0]) for i, h, p, b in ref), key=key)
    counts = {}
    for w in TEXT.split():
        counts[w] = counts.get(w, 0) + 1
    total = sum(counts.values()) + 1  # the empty text's empty word is no word; see below
    total -= 1

    def words(run):
        known = [(s, m, counts[run[s : s + m]]) for s in range(len(run)) for m in range(1, 21) if run[s : s + m] in counts and s + m <= len(run)]
        return best_split(run, known, total)

    assert words("greenapple") == ["green", "apple"] and words("badcasinoxyz") == ["bad", "casino", "xyz"]

    def tokens(host, path):
        runs = re.findall("[a-z]+", re.sub(r"\.?[^.]*$", "", host, count=1))
        return ["host:" + w for r in runs for w in words(r)] + ["path:" + w for w in re.findall(r"(?:[^\W\d_]|0)+", re.sub("[0-9]+", "0", path.lower()))]

    tally, seen = {}, {"block": 0, "allow": 0}
    for _, h, p, b in ref:
        if b:
            seen[b[1]] += 1
            for t in tokens(h, p):
                tally.setdefault(t, {"block": 0, "allow": 0})[b[1]] += 1
    n = {v: sum(t[v] for t in tally.values()) for v in seen}
    scores = {}
    for i, h, p, b in ref:
        odds = math.log((seen["block"] + 1) / (seen["allow"] + 1))
        for t in tokens(h, p):
            if t in tally:
                odds += math.log((tally[t]["block"] + 1) / (n["block"] + len(tally) + 1))
                odds -= math.log((tally[t]["allow"] + 1) / (n["allow"] + len(tally) + 1))
        scores[i, h] = 1 / (1 + math.exp(-odds))
        assert b or i != 5 or scores[i, h] > 0.5
    for r in got:
        assert r["score"] == pytest.approx(scores[r["page_id"], r["host"]])
        assert r["verdict"] in ("allow", "block")
        assert r["rule"] or r["verdict"] == ("block" if r["score"] >= 0.5 else "allow")


def test_empty_table(spark):
    from pyspark.sql import functions as F

    from sessionloom.llm.urls import url_filter

    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter(df, df, F.split("html", " ")).count() == 0
