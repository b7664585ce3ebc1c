"""Alignment of two tokenizers against the libraries and plain loops."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.cases import LONG, TEXTS, frame

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def library(texts):
    """(A ids, B ids, A bytes, B bytes) by the libraries themselves."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(A))
    t.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(B))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in shown}
    back.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)})
    out = []
    for text in texts:
        if not text:
            out.append(([], [], [], []))
            continue
        a = t.encode(" " + text, add_special_tokens=False).ids
        b = model.encode(text)
        raw_a = [bytes(back[c] for c in t.id_to_token(i)) for i in a]
        raw_b = [bytes([int(p[3:-1], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
                 for i, p in ((i, model.id_to_piece(i)) for i in b)]
        whole = (" " + text).encode()
        same = b"".join(raw_a) == whole and b"".join(raw_b) == whole
        out.append((a, b, raw_a, raw_b) if same else ([], [], [], []))
    return out


def brute(rows):
    tokens = library([t for _, t in rows])
    linked, shown = [], []
    for a, b, raw_a, raw_b in tokens:
        end_a = {int(e): i for i, e in enumerate(np.cumsum([len(x) for x in raw_a]))}
        end_b = {int(e): i for i, e in enumerate(np.cumsum([len(x) for x in raw_b]))}
        cuts = [(end_a[e], end_b[e]) for e in sorted(end_a.keys() & end_b.keys())]
        linked.append([(a[i], b[j]) for i, j in cuts])
        groups, last = [], (0, 0)
        for i, j in cuts:
            groups.append(",".join(map(str, a[last[0] : i + 1])) + "|" + ",".join(map(str, b[last[1] : j + 1])))
            last = (i + 1, j + 1)
        shown.append(";".join(groups))
    count = Counter(p for links in linked for p in links)
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for (doc, _), (a, b, _, _), links, text in zip(rows, tokens, linked, shown, strict=True):
        out.append((doc, len(a), len(b), len(links), len(links), sum(count[p] == best[p[1]] for p in links),
                    sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out, key=str)


HARD = [
    *TEXTS, (20, "▁ piece mark"), (21, "<s> </s> <unk> <0x41> plain"), (22, "\x00\x01 control ​ zero"),
    (23, "👩‍👩‍👧 emoji ﬁ ﬀ ligatures"), (24, " leading  double   spaces "), (25, "word " * 3000), (26, "x" * 5000), (27, " "),
]


@pytest.mark.parametrize("lane", [3, 512])
def test_alignment_against_the_libraries(spark, monkeypatch, lane):
    from sessionloom.llm import alignment

    monkeypatch.setattr(alignment, "MERGE_BYTES", 9000)
    monkeypatch.setattr(alignment, "LANE", lane)
    out = alignment.aligned_documents(frame(spark, HARD), public_tokenizers.path(A), public_tokenizers.path(B))
    assert sorted(map(tuple, out.collect()), key=str) == brute(HARD)


def test_given_documents(spark, folder):
    from sessionloom.llm.queries import op12

    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op12(spark, folder).collect()), key=str) == brute(rows)


def test_lanes_give_what_one_lane_gives(monkeypatch):
    from sessionloom.llm import alignment

    rng = np.random.default_rng(2)
    for seed in range(20):
        n = 3000
        a, b = (np.unique(np.append(rng.integers(1, n, n // 3), n)) for _ in range(2))
        zero = np.zeros(1, dtype=np.int64)
        whole = alignment.merge(a, b, zero, zero, np.array([len(a)]))
        monkeypatch.setattr(alignment, "LANE", 7 + seed)
        left, right = alignment.lanes(a, b)
        parts = alignment.merge(a, b, left[:-1], right[:-1], left[1:])
        assert len(left) > 10 and all(np.array_equal(x, y) for x, y in zip(whole, parts, strict=True))
        assert a[whole[0]].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_real_outputs(spark):
    """Ids and cuts of every text, and the table of corresponding ids."""
    from sessionloom.llm import alignment

    pairing = alignment.Pairing(public_tokenizers.path(A), public_tokenizers.path(B))
    rows = [(1, "some words, and more words"), (2, LONG[:5000]), (3, "")]
    made = alignment.align(frame(spark, rows), pairing)
    found = {r["doc_id"]: r for r in made.collect()}
    for (doc, _), (a, b, raw_a, raw_b) in zip(rows, library([t for _, t in rows]), strict=True):
        r = found[doc]
        assert (r["a_ids"], r["b_ids"]) == (a, b)
        for i, j in zip(r["a_cuts"], r["b_cuts"], strict=True):
            assert b"".join(raw_a[:i]) == b"".join(raw_b[:j])
    a_id, b_id, count, best = alignment.correspondence(alignment.link_counts(made, len(pairing.codes)), pairing)
    assert count.sum() == sum(len(r["pairs"]) for r in found.values()) and best.any()
    for i in np.flatnonzero(count)[:50]:
        x, y = pairing.a.bytes[a_id[i]], pairing.b.bytes[b_id[i]]
        assert x.endswith(y) or y.endswith(x)


def test_empty_table(spark):
    from sessionloom.llm.alignment import aligned_documents

    assert aligned_documents(frame(spark).limit(0), public_tokenizers.path(A), public_tokenizers.path(B)).count() == 0


def test_long_runs_take_seconds():
    """One megabyte of one character, or of white space, takes time in proportion to its length."""
    import time

    from sessionloom.llm.alignment import Aligner, Pairing

    aligner = Aligner(Pairing(public_tokenizers.path(A), public_tokenizers.path(B)))
    begun = time.time()
    for c in ("a", " ", "\n"):
        found = aligner.run([c * 1_000_000])[0]
        assert len(found["a_ids"]) > 0 or c == "\n"
    assert time.time() - begun < 60
