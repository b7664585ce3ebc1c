"""Merkle manifest and octopus multiproofs against a plain tree."""

import hashlib
import zlib

import numpy as np
import pytest

from tests.llm.cases import LONG


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(hashes):
    """Root and, for each leaf, its (left, right) siblings by level."""
    proofs, at, level = [[] for _ in hashes], list(range(len(hashes))), hashes
    while len(level) > 1:
        for i, p in enumerate(at):
            lo = p // 3 * 3
            run = level[lo : lo + 3]
            proofs[i].append(("".join(run[: p - lo]), "".join(run[p - lo + 1 :])))
        level = [h(*level[i : i + 3]) for i in range(0, len(level), 3)]
        at = [p // 3 for p in at]
    return level[0], proofs


def brute(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    by = {}
    for i, text, lang, source, n in rows:
        leaf = h(*map(field, (i, source, lang, n, text)))
        other = leaf
        if i is not None and zlib.crc32(str(i).encode()) % 2 == 0:
            other = h(*map(field, (i, source, lang, n, None if text is None else text.replace("\n", ""))))
        by.setdefault(source, []).append(((i is not None, i or 0), leaf, other, i))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in order:
        by[s].sort()
        made[s] = tree([r[1] for r in by[s]])
    root, above = tree([made[s][0] for s in order])
    out = []
    for at, s in enumerate(order):
        for (_, leaf, other, i), proof in zip(by[s], made[s][1], strict=True):
            proof, acc = proof + above[at], other
            for left, right in proof:
                acc = h(left, acc, right)
            out.append((i, leaf, made[s][0], root, h(*(x for p in proof for x in p)), acc, acc == root))
    return sorted(out, key=str)


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n int, hash string, leaf string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], COLUMNS)


def result(df):
    from pyspark.sql import functions as F

    from sessionloom.llm.manifest import document_manifest, folded, proof_text, prove

    made = document_manifest(df)
    rows = prove(made).select(
        "doc_id", "leaf", "subroot", F.lit(made.root).alias("root"), F.sha2(proof_text(F.col("proof")), 256),
        folded(F.coalesce("tampered", "leaf"), F.col("proof")).alias("f")).withColumn("v", F.col("f") == F.lit(made.root))
    return sorted(map(tuple, rows.collect()), key=str)


@pytest.mark.parametrize("unit", [5, 4096])
def test_manifest_against_plain_tree(spark, monkeypatch, unit):
    from sessionloom.llm import manifest

    monkeypatch.setattr(manifest, "UNIT", unit)
    monkeypatch.setattr(manifest, "SPAN", 2)
    monkeypatch.setattr(manifest, "ASKERS", 2)
    rows = [(i, f"line {i}\nmore\n" if i % 3 else "one line", "en" if i % 5 else None, "hot", i) for i in range(90)]
    rows += [(1000 + i, f"t\n{i}", "de", f"s{i % 7}", 3) for i in range(20)]
    rows += [(2000, "only\none", "de", "lone", 3), (2001, None, None, None, None), (None, "no\nid", "x", None, 1),
             (None, None, None, None, None), (5, "", "en", "ü\n", 0), (6, LONG, "en", "Z", None), (7, "日本\n語", "ja", "a", 2)]
    rows += [(3000, "same\nrow", "en", "same", 8)] * 40 + [(None, None, None, "none", None)] * 30
    assert result(frame(spark, rows)) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10])
def test_small_trees(spark, n):
    rows = [(i, "a\nb", "en", "s", 3) for i in range(n)]
    assert result(frame(spark, rows)) == brute(rows)


def test_empty_table(spark):
    assert result(frame(spark, [(1, "a", "b", "c", 1)]).limit(0)) == []


def test_missing_is_the_least_union():
    """Every set of known leaves, with what `missing` lists, gives the root, and with less it does not."""
    from sessionloom.llm.manifest import derive, missing

    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 27, 40):
        leaves = [h(str(i)) for i in range(n)]
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
        for size in {1, n, max(1, n // 3)}:
            known = np.sort(rng.choice(n, size, replace=False))
            wanted = missing(known, n)
            fetched = {(level, p): levels[level][p] for level, places in enumerate(wanted) for p in places.tolist()}
            given = {int(p): leaves[p] for p in known}
            assert derive(given, n, fetched)[-1] == {0: levels[-1][0]}
            for gone in fetched:
                with pytest.raises(KeyError):
                    derive(given, n, {k: v for k, v in fetched.items() if k != gone})
