"""Alignment of two tokenizers' tokens by merging their byte offsets in lockstep.

Both tokenizers' tokens of a text cover the same bytes. One state vector holds a pair of pointers for each text of a
batch; every step compares the two ends, moves the pointer that is behind (both, where the ends agree, which is a
link and a cut), and leaves finished texts out of the vector. Long texts enter as several lanes, parted at ends
that both tokenizers share, so the number of steps is bounded by the lane and not by the longest text.

A and B tokens that end together are suffixes of each other, so the pairs that can ever be linked follow from the two
vocabularies: their number bounds all tables of pair counts, however large the corpus is.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from sessionloom.llm.common import stage
from sessionloom.llm.tokens import PATTERN, _byte_symbols

# Text bytes merged at once, tokens of a lane, and tokens looked at to find a lane's shared end.
MERGE_BYTES, LANE, WINDOW = 1_000_000, 512, 64
# Links of a batch that are counted or looked up at once.
LINKS = 500_000


class ByteLevel:
    """A byte-level BPE file: token ids, and the bytes of each.

    The library named for such files encodes; where the vocabulary has the plain byte-level settings and its ids follow
    the order of merges, the same merges run through tiktoken, if that is installed, at several times the speed.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = {c: b for b, c in _byte_symbols().items()}
        model, added = spec["model"], spec.get("added_tokens", [])
        special = {t["content"] for t in added}
        size = max([*model["vocab"].values(), *(t["id"] for t in added)], default=-1) + 1
        self.bytes: list[bytes | None] = [None] * size
        for token, i in model["vocab"].items():
            if token not in special:
                self.bytes[i] = bytes(symbols[c] for c in token)
        pre = spec.get("pre_tokenizer") or {}
        joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        made, known = [model["vocab"][t] for t in joined], set(joined)
        self.plain = (
            pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and spec.get("normalizer") is None and not model.get("ignore_merges") and not model.get("dropout")
            and made == sorted(set(made)) and all(
                len(t) == 1 or t in known for t, i in model["vocab"].items() if self.bytes[i] is not None)
        )
        self.path, self._library, self._fast = path, None, None

    def __getstate__(self):
        return self.__dict__ | {"_library": None, "_fast": None}

    def ids(self, text: str) -> np.ndarray:
        # Beyond this length tiktoken's pattern engine may give up on long runs of white space.
        if self.plain and len(text) <= 200_000:
            self._fast = self._fast or self._merges()
            if self._fast:
                return self._fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        self._library = self._library or self._load()
        return np.array(self._library.encode(text, add_special_tokens=False).ids, dtype=np.int64)

    def _merges(self):
        try:
            import tiktoken
        except ImportError:
            self.plain = False
            return None
        ranks = {b: i for i, b in enumerate(self.bytes) if b is not None}
        return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _load(self):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(self.path)
        library.encode_special_tokens = True
        return library


class Pieces:
    """A sentencepiece model: token ids, and the bytes of each piece."""

    def __init__(self, path: str):
        self.path, self._model = path, None
        model = self._load()
        self.bytes: list[bytes | None] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes.append(bytes([int(piece[3:-1], 16)]))
            elif model.is_control(i) or model.is_unused(i):
                self.bytes.append(None)
            else:
                self.bytes.append(piece.replace("▁", " ").encode())

    def __getstate__(self):
        return {"path": self.path, "bytes": self.bytes, "_model": None}

    def _load(self):
        if self._model is None:
            import sentencepiece

            self._model = sentencepiece.SentencePieceProcessor(model_file=self.path)
        return self._model

    def ids(self, text: str) -> np.ndarray:
        return np.array(self._load().encode(text, num_threads=1), dtype=np.int64)


def vocabulary(path: str) -> ByteLevel | Pieces:
    """The vocabulary in a .json (byte-level BPE) or .model (sentencepiece) file."""
    found = ByteLevel(path) if path.endswith(".json") else Pieces(path)
    if b"" in found.bytes:
        raise ValueError("a vocabulary with an empty entry can't be aligned")
    return found


def possible_pairs(a: list[bytes | None], b: list[bytes | None]) -> np.ndarray:
    """Sorted codes a_id * len(b) + b_id of all pairs of which one's bytes end with the other's."""
    by_bytes: list[dict[bytes, list[int]]] = []
    for side in (a, b):
        held: dict[bytes, list[int]] = {}
        for i, entry in enumerate(side):
            if entry is not None:
                held.setdefault(entry, []).append(i)
        by_bytes.append(held)
    codes = set()
    for entry, ids in by_bytes[0].items():
        for cut in range(len(entry)):
            codes.update(i * len(b) + j for j in by_bytes[1].get(entry[cut:], ()) for i in ids)
    for entry, ids in by_bytes[1].items():
        for cut in range(1, len(entry)):
            codes.update(i * len(b) + j for i in by_bytes[0].get(entry[cut:], ()) for j in ids)
    return np.array(sorted(codes), dtype=np.int64)


class Pairing:
    """Two vocabularies and the codes of the pairs that can be linked."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = vocabulary(a_path), vocabulary(b_path)
        self.codes = possible_pairs(self.a.bytes, self.b.bytes)


def lanes(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A tokens, B tokens) before each place where one text is cut into lanes, from 0 to all."""
    n = len(a_end)
    if n <= 2 * LANE:
        return np.array([0, n]), np.array([0, len(b_end)])
    at = np.arange(LANE, n - LANE, LANE)[:, None] + np.arange(WINDOW)[None, :]
    at = np.minimum(at, n - 1)
    to = np.minimum(np.searchsorted(b_end, a_end[at]), len(b_end) - 1)
    shared = b_end[to] == a_end[at]
    first, some = shared.argmax(1), shared.any(1)
    row = np.flatnonzero(some)
    left, once = np.unique(at[row, first[row]] + 1, return_index=True)
    right = (to[row, first[row]] + 1)[once]
    return np.concatenate(([0], left[left < n], [n])), np.concatenate(([0], right[left < n], [len(b_end)]))


def merge(
    a_end: np.ndarray, b_end: np.ndarray, a_at: np.ndarray, b_at: np.ndarray, a_stop: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Places of the A and B tokens that end together, in order, over all lanes.

    a_at, b_at: where each lane starts in the ends; a_stop: where its A tokens stop. A lane's last ends are shared.
    """
    a_at, b_at, a_stop = a_at.copy(), b_at.copy(), a_stop.copy()
    from_a, from_b = [], []
    while len(a_at):
        x, y = a_end[a_at], b_end[b_at]
        both = x == y
        from_a.append(a_at[both])
        from_b.append(b_at[both])
        a_at += x <= y
        b_at += y <= x
        open_ = a_at < a_stop
        if not open_.all():
            a_at, b_at, a_stop = a_at[open_], b_at[open_], a_stop[open_]
    if not from_a:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    # Both grow together, so sorting each gives the pairs in the order of the texts.
    return np.sort(np.concatenate(from_a)), np.sort(np.concatenate(from_b))


class Aligner:
    """Aligns batches of texts; made once a task."""

    def __init__(self, pairing: Pairing):
        self.a, self.b, self.codes = pairing.a, pairing.b, pairing.codes
        self.size = [np.array([len(e or b"") for e in v.bytes], dtype=np.int64) for v in (self.a, self.b)]
        self.shown = [[np.array([f"{i}{end}" for i in range(len(v.bytes))], dtype=object) for end in ends]
                      for v, ends in ((self.a, ",|"), (self.b, ",;"))]

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Both tokenizers' ids; none if the text is null or empty or some token's bytes differ from it."""
        none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if not text:
            return none
        whole = b" " + text.encode()
        out = []
        for v, given in ((self.a, " " + text), (self.b, text)):
            ids = v.ids(given)
            entries = [v.bytes[i] for i in ids.tolist()]
            if None in entries or b"".join(entries) != whole:
                return none
            out.append(ids)
        return out[0], out[1]

    def run(self, texts: list[str | None]) -> list[dict]:
        """One dict for each text: ids and cuts of both sides, pair numbers, digest of the groups."""
        found = [self.tokens(t) for t in texts]
        ids = [np.concatenate([f[s] for f in found]) if found else np.zeros(0, np.int64) for s in (0, 1)]
        counts = [np.array([len(f[s]) for f in found], dtype=np.int64) for s in (0, 1)]
        first = [np.concatenate(([0], np.cumsum(c))) for c in counts]
        # Ends count on over the whole batch; every text has the same number of bytes on both sides.
        ends = [np.cumsum(self.size[s][ids[s]]) for s in (0, 1)]
        begins: tuple[list, list, list] = ([], [], [])
        for i in np.flatnonzero(counts[0]).tolist():
            (lo_a, hi_a), (lo_b, hi_b) = first[0][i : i + 2], first[1][i : i + 2]
            left, right = lanes(ends[0][lo_a:hi_a], ends[1][lo_b:hi_b])
            begins[0].append(left[:-1] + lo_a)
            begins[1].append(right[:-1] + lo_b)
            begins[2].append(left[1:] + lo_a)
        starts = [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in begins]
        at_a, at_b = merge(ends[0], ends[1], *starts)
        pairs = np.searchsorted(self.codes, ids[0][at_a] * len(self.b.bytes) + ids[1][at_b]).astype(np.int32)
        cut = np.searchsorted(at_a, first[0])
        groups = self._groups(ids, at_a, at_b)
        spread = first[0] + first[1]
        out = []
        for i in range(len(texts)):
            (lo_a, hi_a), (lo_b, hi_b), (lo, hi) = first[0][i : i + 2], first[1][i : i + 2], cut[i : i + 2]
            shown = "".join(groups[spread[i] : spread[i + 1]])[:-1]
            out.append({
                "a_ids": ids[0][lo_a:hi_a], "b_ids": ids[1][lo_b:hi_b], "a_cuts": at_a[lo:hi] - lo_a + 1,
                "b_cuts": at_b[lo:hi] - lo_b + 1, "pairs": pairs[lo:hi],
                "digest": sha256(shown.encode()).hexdigest() if hi_a > lo_a else "",
            })
        return out

    def _groups(self, ids: list[np.ndarray], at_a: np.ndarray, at_b: np.ndarray) -> list[str]:
        """Every token as text with the sign that follows it, in the order of the groups."""
        total = len(ids[0]) + len(ids[1])
        out = np.empty(total, dtype=object)
        # A token's place: those of its side before it, and the other side's in groups before (B: up to) its own.
        group_a = np.searchsorted(at_a, np.arange(len(ids[0])))
        group_b = np.searchsorted(at_b, np.arange(len(ids[1])))
        before_b = np.concatenate(([0], at_b + 1))
        place_a = np.arange(len(ids[0])) + before_b[group_a]
        place_b = np.arange(len(ids[1])) + (at_a + 1)[group_b]
        for side, places, last in ((0, place_a, at_a), (1, place_b, at_b)):
            out[places] = self.shown[side][0][ids[side]]
            out[places[last]] = self.shown[side][1][ids[side][last]]
        return out.tolist()


COLUMNS = ("a_ids", "b_ids", "a_cuts", "b_cuts", "pairs", "digest")


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    flat = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def align(
    docs: DataFrame, pairing: Pairing, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, n_a, n_b, and the given columns) of each row; one narrow pass.

    a_ids, b_ids: both token sequences. a_cuts, b_cuts: numbers of tokens before each shared end. pairs: numbers of the
    linked pairs among the pairing's codes. digest: sha256 of `a1,a2|b1;a3|b2,b3`. Null and empty texts, and those whose
    bytes a tokenizer does not keep, have no tokens and an empty digest. Ids may be null or repeated, every row
    gets its own result, other columns are not read. Time is linear in a text's length.
    """
    sent = docs.sparkSession.sparkContext.broadcast(pairing)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = None
        for batch in batches:
            aligner = aligner or Aligner(sent.value)
            texts, lo, size = batch.column(1), 0, 0
            lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            for i, n in enumerate(lengths):
                size += n
                if size >= MERGE_BYTES or i == len(lengths) - 1:
                    done = aligner.run(texts[lo : i + 1].to_pylist())
                    made = [batch.column(0)[lo : i + 1],
                            pa.array([len(d["a_ids"]) for d in done], pa.int64()),
                            pa.array([len(d["b_ids"]) for d in done], pa.int64())]
                    for c in columns:
                        made.append(pa.array([d[c] for d in done], pa.string()) if c == "digest"
                                    else _lists([d[c] for d in done]))
                    yield pa.RecordBatch.from_arrays(made, names=[id_col, "n_a", "n_b", *columns])
                    lo, size = i + 1, 0

    kinds = ", ".join(f"{c} {'string' if c == 'digest' else 'array<int>'}" for c in columns)
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_a long, n_b long, {kinds}")


def sliced(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the lists of one column hold about LINKS values each."""
    for batch in batches:
        ends = batch.column(at).offsets.to_numpy()
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + LINKS, side="right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def link_counts(aligned: DataFrame, possible: int) -> DataFrame:
    """(pair, count): how often each pair is linked in all rows. At most `possible` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(possible, dtype=np.int64)
        for batch in sliced(batches, 0):
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            total += np.bincount(flat, minlength=possible)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["pair", "n"])

    return aligned.select("pairs").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("count"))


def correspondence(counts: DataFrame, pairing: Pairing) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a_id, b_id, count, best) arrays over the possible pairs; best marks each B id's most frequent A ids.

    The table has at most as many rows as the vocabularies have possible pairs, whatever the corpus.
    """
    found, wide = counts.toArrow(), len(pairing.b.bytes)
    count = np.zeros(len(pairing.codes), dtype=np.int64)
    count[found["pair"].to_numpy()] = found["count"].to_numpy()
    a_id, b_id = pairing.codes // wide, pairing.codes % wide
    highest = np.zeros(wide, dtype=np.int64)
    np.maximum.at(highest, b_id, count)
    return a_id, b_id, count, (count > 0) & (count == highest[b_id])


def aligned_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row.

    Three passes: texts to pairs (staged), pairs to counts, counts back to the rows. An empty table gives no rows.
    """
    pairing = Pairing(a_path, b_path)
    aligned = stage(align(docs, pairing, ("pairs", "digest"), id_col, text_col), "aligned")
    _, _, count, best = correspondence(link_counts(aligned, len(pairing.codes)), pairing)
    sent = docs.sparkSession.sparkContext.broadcast((count, best))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, marks = sent.value
        for batch in sliced(batches, 3):
            lists = batch.column(3)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            end = np.cumsum(n)
            sums = [np.concatenate(([0], np.cumsum(v[flat].astype(np.int64)))) for v in (marks, held)]
            each = [pa.array(s[end] - s[end - n]) for s in sums]
            links = pa.array(n)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], links, links, *each, batch.column(4)],
                names=[id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return aligned.mapInArrow(
        run, f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
        "groups_sha256 string")
