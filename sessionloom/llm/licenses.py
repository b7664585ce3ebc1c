"""License scan: phrases, and license templates compiled into token automata.

A template is a line of words with two kinds of markup: `[ ... ]` is an optional region and `{a-b}` a
replaceable region of a to b words. All other words are mandatory and must match exactly, in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sessionloom.llm.words import ALNUM, hash_text, ngrams, word_slices

# Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Wording of public license notices.
TEMPLATES = {
    "mit": [
        "released under the [terms of the] mit license",
        "licensed under the [terms of the] mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files [the software] to deal in the software without restriction",
    ],
    "apache-2.0": ["licensed under the apache license version 2 0 [the license]"],
    "gpl-2.0": ["gnu general public license [as published by the free software foundation] [either] version 2"],
    "gpl-3.0": ["gnu general public license [as published by the free software foundation] [either] version 3"],
    "lgpl": ["gnu lesser general public license [as published by the free software foundation] [either] version {1-1}"],
    "cc-by-4.0": ["licensed under [a] [the] [creative commons attribution] cc by 4 0 [international license]"],
    "cc-by-nc-4.0": ["licensed under [a] [the] [creative commons attribution noncommercial] cc by nc 4 0"],
    "cc-by-sa-4.0": ["licensed under [a] [the] [creative commons attribution sharealike] cc by sa 4 0"],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted "
        "provided that the following conditions are met"
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee "
        "is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
    ],
    "mpl-2.0": ["subject to the terms of the mozilla public license v 2 0"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "copyright": ["copyright [c] {1-10} all rights reserved"],
}


class Automaton:
    """One template as a token automaton: state i reads symbol i; an optional region may be jumped."""

    def __init__(self, label: str, template: str):
        self.label = label
        self.symbols: list[tuple[int, int, int]] = []  # (word hash, 1, 1) or (-1, fewest, most) of a replaceable region
        self.jumps: dict[int, list[int]] = {}
        depth, open_at = 0, 0
        mandatory = 0
        for token in template.replace("[", " [ ").replace("]", " ] ").split():
            if token == "[":
                depth, open_at = 1, len(self.symbols)
            elif token == "]":
                self.jumps.setdefault(open_at, []).append(len(self.symbols))
                depth = 0
            elif token.startswith("{"):
                low, high = token.strip("{}").split("-")
                self.symbols.append((-1, int(low), int(high)))
            else:
                self.symbols.append((int(hash_text(token, ALNUM)[0]), 1, 1))
                mandatory += not depth
        self.mandatory = mandatory
        if self.symbols[0][0] == -1 or 0 in self.jumps:
            raise ValueError(f"a template starts with a mandatory word: {template}")
        # The first word, or the first two where both must follow each other: where to start reading.
        pair = len(self.symbols) > 1 and self.symbols[1][0] != -1 and 1 not in self.jumps
        self.anchor = tuple(s[0] for s in self.symbols[: 2 if pair else 1])

    def closure(self, states: set[tuple[int, int]]) -> set[tuple[int, int]]:
        """States with all jumps over optional regions taken; (state, words its region has read)."""
        todo = list(states)
        while todo:
            state, read = todo.pop()
            if read == 0:
                for target in self.jumps.get(state, []):
                    if (target, 0) not in states:
                        states.add((target, 0))
                        todo.append((target, 0))
        return states

    def match(self, words: np.ndarray, at: int, end: int) -> int:
        """End of the shortest accepted run of words from `at`, or -1."""
        states = self.closure({(0, 0)})
        last = len(self.symbols)
        while states:
            if (last, 0) in states:
                return at
            if at >= end:
                return -1
            word, after = int(words[at]), set()
            for state, read in states:
                if state == last:
                    continue
                symbol, low, high = self.symbols[state]
                if symbol == -1:
                    if read + 1 <= high:
                        after.add((state, read + 1))
                        if read + 1 >= low:
                            after.add((state + 1, 0))
                elif symbol == word:
                    after.add((state + 1, 0))
            states = self.closure(after)
            at += 1
        return -1


def automata() -> list[Automaton]:
    return [Automaton(label, t) for label, texts in TEMPLATES.items() for t in texts]


def strength(words: int) -> float:
    """Score of a match: the more mandatory words agree, the closer to 1."""
    return words / (words + 3.0)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) for each row.

    `spans` are (label, first word, end word) of the accepted templates. One narrow pass over whole
    texts; automata start only where their first words stand. A null or empty text has no words,
    no place and score 0; ids may be null or repeated; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    phrases = [(hash_text(p, ALNUM), label) for p, label in PHRASES.items()]
    machines = automata()
    # Machines by the hash of their first one or two words.
    anchored: dict[int, dict[int, list[Automaton]]] = {1: {}, 2: {}}
    for m in machines:
        key = int(ngrams(np.array(m.anchor, dtype=np.uint64), len(m.anchor))[0])
        anchored[len(m.anchor)].setdefault(key, []).append(m)

    def scan(batch: pa.RecordBatch) -> list[tuple]:
        rows = []
        for lo, hi, words in word_slices(batch.column(1), ALNUM):
            h, offsets = words.hashes, words.offsets
            ends = offsets[1:]
            places: dict[int, list[tuple[int, int, int]]] = {}
            for number, (phrase, _) in enumerate(phrases):
                k = len(phrase)
                grams = ngrams(h, k)
                found = np.flatnonzero(grams == ngrams(phrase, k)[0]) if len(grams) else np.zeros(0, int)
                doc = np.searchsorted(offsets, found, side="right") - 1
                inside = found + k <= ends[doc] if len(found) else np.zeros(0, bool)
                for d, p in zip(doc[inside].tolist(), found[inside].tolist(), strict=True):
                    places.setdefault(d, []).append((number, p - int(offsets[d]), k))
            matched: dict[int, set[tuple[str, int, int, int]]] = {}
            for k, by_key in anchored.items():
                grams = ngrams(h, k)
                starts = np.flatnonzero(np.isin(grams, np.array(list(by_key), dtype=np.uint64)))
                doc = np.searchsorted(offsets, starts, side="right") - 1
                for d, p in zip(doc.tolist(), starts.tolist(), strict=True):
                    for m in by_key[int(grams[p])]:
                        stop = m.match(h, p, int(ends[d]))
                        if stop >= 0:
                            base = int(offsets[d])
                            matched.setdefault(d, set()).add((m.label, p - base, stop - base, m.mandatory))
            for d in range(hi - lo):
                here, accepted = places.get(d, []), sorted(matched.get(d, ()))
                base_labels = sorted({phrases[n][1] for n, _, _ in here})
                labels = sorted({*base_labels, *(a[0] for a in accepted)})
                longest = max([0, *(k for _, _, k in here), *(a[3] for a in accepted)])
                rows.append((
                    int(ends[d] - offsets[d]), len(here), min((p for _, p, _ in here), default=None),
                    max((p for _, p, _ in here), default=None), ",".join(base_labels), ",".join(labels),
                    strength(longest) if longest else 0.0,
                    [{"label": a[0], "first": a[1], "end": a[2]} for a in accepted],
                ))
        return rows

    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*scan(batch), strict=True)) or [[] for _ in names]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[id_col, *names])

    schema = (
        f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, "
        "labels string, score double, spans array<struct<label:string,first:long,end:long>>"
    )
    return docs.select(id_col, text_col).mapInArrow(run, schema)
