"""Plain Python versions of the operators, for small tables only."""

from __future__ import annotations

import hashlib
import re

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def alnum(text):
    return ALNUM.findall(lower(text))


def spaced(text):
    return SPACED.findall(lower(text))


def contamination(docs, items):
    """doc rows (id, text), item rows (id, text) -> list of (id, n_words, n_hit, n_items, sha)."""
    windows: dict[tuple, set[str]] = {}
    for item, text in items:
        w = alnum(text)
        spans = [tuple(w)] if 0 < len(w) < 10 else [tuple(w[i : i + 10]) for i in range(len(w) - 9)]
        for s in spans:
            windows.setdefault(s, set())
            if item is not None:
                windows[s].add(str(item))
    lengths = {len(s) for s in windows}
    out = []
    for doc, text in docs:
        w, hit, found = alnum(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                s = tuple(w[i : i + n])
                if s in windows:
                    hit.update(range(i, i + n))
                    found |= windows[s]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), sha))
    return out


def licenses_base(text):
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    w, places, labels = alnum(text), [], set()
    for p, label in phrases.items():
        for i in range(len(w) - len(p) + 1):
            if tuple(w[i : i + len(p)]) == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def targets(sizes):
    """{source: size} -> {source: target}."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[t] for t in open_) for s in open_}
        above = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not above:
            return {**capped, **share}
        for s in above:
            capped[s] = 3.0 * sizes[s]
