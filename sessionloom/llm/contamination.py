"""Benchmark decontamination by winnowing.

Of every window of 6 consecutive 5-grams of words the one with the smallest hash is kept as a
fingerprint (the last of equal ones). A passage of 10 or more words in common contains a full window, so
it has a fingerprint in common whose place in the passage is the same. Fingerprints of documents and items
are joined, and each hit is extended by at most 5 words to either side, compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sessionloom.llm.common import stage, with_uid
from sessionloom.llm.words import ALNUM, Words, ngrams, word_slices

GRAM, WINDOW = 5, 6
SPAN = GRAM + WINDOW - 1
# Words kept around a fingerprint: WINDOW - 1 before it, itself, WINDOW - 1 after it.
AROUND = GRAM + 2 * (WINDOW - 1)

# Up to so many distinct fingerprints of items (8 bytes each) go to the tasks, to drop others at once;
# beyond it all fingerprints of the documents are joined by a shuffle.
FILTER_ROWS = 1_000_000


def winnow(words: Words) -> np.ndarray:
    """Places (word numbers in the slice) of the kept 5-grams of all texts."""
    grams = ngrams(words.hashes, GRAM)
    windows = len(grams) - WINDOW + 1
    if windows <= 0:
        return np.zeros(0, dtype=np.int64)
    best, at = grams[:windows].copy(), np.zeros(windows, dtype=np.int64)
    for j in range(1, WINDOW):
        other = grams[j : j + windows]
        lower = other <= best
        best[lower] = other[lower]
        at[lower] = j
    # Only windows inside one text count.
    start = np.arange(windows)
    owner = np.searchsorted(words.offsets, start, side="right") - 1
    inside = start + SPAN <= words.offsets[owner + 1]
    return np.unique((start + at)[inside])


def contexts(words: Words, places: np.ndarray, owner: np.ndarray, pad: int) -> np.ndarray:
    """Word hashes around fingerprints; `pad` outside the text, so that sides never agree there."""
    index = places[:, None] + np.arange(-(WINDOW - 1), GRAM + WINDOW - 1)[None, :]
    outside = (index < words.offsets[owner][:, None]) | (index >= words.offsets[owner + 1][:, None])
    around = words.hashes[np.clip(index, 0, max(0, len(words.hashes) - 1))]
    around[outside] = pad
    return around


def _marks(words: Words, lengths: list[int], pad: int, keep: dict[int, np.ndarray] | None, items: bool):
    """(owner, word in text, length, key, context) of fingerprints (length 0) and of short n-grams."""
    places = winnow(words)
    keys = ngrams(words.hashes, GRAM)[places]
    if keep is not None:
        chosen = np.isin(keys, keep[0])
        places, keys = places[chosen], keys[chosen]
    owner = np.searchsorted(words.offsets, places, side="right") - 1
    yield owner, places - words.offsets[owner], 0, keys, contexts(words, places, owner, pad)
    size = np.diff(words.offsets)
    for n in lengths:
        if items:  # a short item is one window
            owner = np.flatnonzero(size == n)
            places = words.offsets[owner]
            keys = ngrams(words.hashes, n)[places] if len(places) else np.zeros(0, dtype=np.uint64)
        else:
            keys = ngrams(words.hashes, n)
            places = np.flatnonzero(np.isin(keys, keep[n]) if keep is not None else np.ones(len(keys), dtype=bool))
            owner = np.searchsorted(words.offsets, places, side="right") - 1
            inside = places + n <= words.offsets[owner + 1]
            places, owner = places[inside], owner[inside]
            keys = keys[places]
        yield owner, places - words.offsets[owner], n, keys, None


MARK = pa.struct([("pos", pa.int64()), ("len", pa.int32()), ("key", pa.int64()), ("around", pa.binary())])


def _marked(df: DataFrame, id_col: str, text_col: str, lengths: list[int], pad: int, keep, items: bool) -> DataFrame:
    """(id, n_words, marks) for each row, in one narrow pass."""
    kind = df.schema[id_col].dataType.simpleString()
    sent = df.sparkSession.sparkContext.broadcast(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = sent.value
        for batch in batches:
            sizes, marks = [], []
            for lo, hi, words in word_slices(batch.column(1), ALNUM):
                rows: list[list[dict]] = [[] for _ in range(hi - lo)]
                for owner, pos, n, keys, around in _marks(words, lengths, pad, kept, items):
                    for i in range(len(owner)):
                        rows[owner[i]].append({
                            "pos": int(pos[i]), "len": n, "key": int(keys[i].view(np.int64)),
                            "around": around[i].tobytes() if around is not None else None,
                        })
                sizes += np.diff(words.offsets).tolist()
                marks += rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(marks, pa.list_(MARK))],
                names=[id_col, "n_words", "marks"],
            )

    schema = f"`{id_col}` {kind}, n_words long, marks array<struct<pos:long,len:int,key:long,around:binary>>"
    return df.select(id_col, text_col).mapInArrow(run, schema)


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hits that reach a whole window: (uid, item, first word, end word)."""
    for batch in batches:
        uid, item, pos, length, ours, theirs = batch.columns
        n = len(uid)
        low, high = np.asarray(pos).astype(np.int64), np.asarray(pos).astype(np.int64)
        size = np.asarray(length).astype(np.int64)
        good = size > 0
        high = low + size
        at = np.flatnonzero(~good)
        if len(at):
            a = np.frombuffer(b"".join(ours.take(pa.array(at)).to_pylist()), dtype=np.uint64).reshape(-1, AROUND)
            b = np.frombuffer(b"".join(theirs.take(pa.array(at)).to_pylist()), dtype=np.uint64).reshape(-1, AROUND)
            same = a == b
            side = WINDOW - 1
            left = np.cumprod(same[:, side - 1 :: -1], axis=1).sum(axis=1)
            right = np.cumprod(same[:, side + GRAM :], axis=1).sum(axis=1)
            whole = same[:, side : side + GRAM].all(axis=1) & (left + GRAM + right >= SPAN)
            good[at] = whole
            low[at], high[at] = low[at] - left, low[at] + GRAM + right
        keep = pa.array(good)
        columns = [uid, item, pa.array(low, pa.int64()), pa.array(high, pa.int64())]
        yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], names=["_uid", "item_id", "lo", "hi"])


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(id, n_words, n_hit, n_items, items) for each document; `items` are the sorted ids found, as strings.

    A window is 10 consecutive words of an item, or all words of a shorter item. Empty and null texts
    have no words and no hits; items without words occur nowhere; with no items nothing is hit.
    Ids may be null or repeated: every document row gets its own result, items of equal id count once,
    and a null item id is not counted. The documents' texts are read once and never shuffled.
    """
    spark = docs.sparkSession
    items = items.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).alias("text"))
    marks = stage(
        _marked(items, "item_id", "text", list(range(1, SPAN)), 2, None, True)
        .select("item_id", F.explode("marks").alias("m")).select("item_id", "m.*").distinct(),
        "item-marks",
    )
    distinct = stage(marks.select("len", "key").distinct(), "item-keys")
    lengths = sorted(r["len"] for r in distinct.select("len").distinct().collect() if r["len"])
    keep = None
    if distinct.count() <= FILTER_ROWS:
        keys = distinct.toPandas()
        keep = {n: np.sort(keys["key"][keys["len"] == n].to_numpy(dtype=np.int64).view(np.uint64)) for n in [0, *lengths]}
    marked = with_uid(_marked(docs, id_col, text_col, lengths, 1, keep, False), "doc-marks")
    ours = marked.select("_uid", F.explode("marks").alias("m")).select("_uid", "m.*")
    pairs = ours.join(marks.withColumnRenamed("around", "theirs").withColumnRenamed("pos", "_ipos"), ["len", "key"])
    hits = stage(
        pairs.select("_uid", "item_id", "pos", "len", "around", "theirs")
        .mapInArrow(_extend, "_uid long, item_id string, lo long, hi long"),
        "hits",
    )
    found = hits.groupBy("_uid").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    reach = Window.partitionBy("_uid").orderBy("lo", "hi")
    before = F.max("hi").over(reach.rowsBetween(Window.unboundedPreceding, -1))
    covered = (
        hits.select("_uid", "lo", "hi").distinct()
        .withColumn("new", F.greatest(F.lit(0), F.col("hi") - F.greatest("lo", F.coalesce(before, F.lit(0)))))
        .groupBy("_uid").agg(F.sum("new").alias("n_hit"))
    )
    return (
        marked.select("_uid", id_col, "n_words")
        .join(covered.join(found, "_uid"), "_uid", "left")
        .select(
            id_col, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    )
