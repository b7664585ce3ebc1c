"""Main text of web pages by a tree-structured graphical model.

Every block element of a page is a binary variable, content or not. Its features give it a unary potential;
a table of child tags gives the potential of each parent-child pair. Messages go up from the leaves and down
from the root (sum-product, exact on a tree); a block is kept where its element's marginal is above one half.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sessionloom.llm.common import drawn
from sessionloom.llm.dom import Node, Page, parse

# Labelled pages that the potentials are fitted on: about so many, drawn by a hash.
LABELLED_PAGES = 2000
STEPS, RATE, DECAY = 300, 1.0, 1e-3
# A pair potential is at most this sure, so that an element can always differ from its parent.
FLOOR = 0.03

# Element and class names of page furniture and of main text.
FURNITURE_TAGS = frozenset("nav footer aside form menu dialog select button fieldset datalist".split())
FURNITURE_NAMES = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice pagination pager "
    "popup promo promotion related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe "
    "toolbar widget alert login search contentinfo complementary".split())
CONTENT_TAGS = frozenset(["article", "main"])
CONTENT_NAMES = frozenset("article articlebody content entry main post story text".split())
# Elements that say nothing by themselves.
PLAIN_TAGS = ["div", "section", "ul", "ol", "table", "blockquote", "pre", "figure", "dl"]
# Names that a labeller or a masked copy does not see.
SEMANTIC = FURNITURE_TAGS | CONTENT_TAGS | {"header", "section"}


def bucket(n: float) -> int:
    return int(math.log2(n + 1))


def furniture(node: Node, inside: bool) -> bool:
    """Whether the element's own name says that it is page furniture; a header inside an article is not."""
    named = any(x in FURNITURE_NAMES for x in node.names)
    return node.tag in FURNITURE_TAGS or (node.tag == "header" and not inside) or named or node.hidden


def nested(page: Page) -> list[bool]:
    """Whether each node lies inside an article or main element (or is one)."""
    inside = []
    for node in page.nodes:
        inside.append(node.tag in CONTENT_TAGS or (node.parent >= 0 and inside[node.parent]))
    return inside


def features(page: Page, masked: bool = False) -> list[list[str]]:
    """Names of the features that hold for each node; `masked` hides what element and class names say."""
    nodes = page.nodes
    chars, linked = [x.chars for x in nodes], [x.linked for x in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        chars[nodes[i].parent] += chars[i]
        linked[nodes[i].parent] += linked[i]
    total, inside, out = max(1, chars[0]), nested(page), []
    for i, x in enumerate(nodes):
        found = [
            "bias", f"own:{bucket(x.chars)}", f"all:{bucket(chars[i])}", f"share:{4 * chars[i] // total}",
            f"links:{int(4 * linked[i] / chars[i]) if chars[i] else 'none'}", f"stops:{min(4, bucket(x.stops))}",
        ]
        if masked:
            found.append("tag:" + ("div" if x.tag in SEMANTIC else x.tag))
        else:
            found.append("tag:" + ("furniture" if x.tag in FURNITURE_TAGS else x.tag))
            found += ["name:" + name for name in x.names if name not in FURNITURE_NAMES]
            if furniture(x, inside[i]):
                found.append("says:furniture")
            elif x.tag in CONTENT_TAGS or any(name in CONTENT_NAMES for name in x.names):
                found.append("says:content")
        out.append(found)
    return out


def markup_labels(page: Page) -> list[int] | None:
    """Labels that a page's own markup gives: inside an article or main element, and not in furniture there.

    None where the page has no such element.
    """
    if not any(x.tag in CONTENT_TAGS for x in page.nodes):
        return None
    out, inside, barred = [], nested(page), []
    for i, x in enumerate(page.nodes):
        bar = (x.parent >= 0 and barred[x.parent]) or (x.parent >= 0 and furniture(x, inside[x.parent]))
        barred.append(bar)
        out.append(int(inside[i] and not bar))
    return out


@dataclass
class Model:
    """Log-odds of features, and for each child tag P(child is content | parent is not, is)."""

    weights: dict[str, float] = field(default_factory=lambda: {
        "bias": -1.0, "says:furniture": -6.0, "says:content": 6.0, "tag:p": 1.0, "links:none": 0.0, "links:3": -2.0,
        "links:4": -2.0})
    pairs: dict[str, tuple[float, float]] = field(default_factory=lambda: {"": (0.1, 0.9)})

    def marginals(self, page: Page) -> list[float]:
        """P(content) of each node, by messages up and down the tree."""
        nodes, get = page.nodes, self.weights.get
        own = [sum(get(f, 0.0) for f in found) for found in features(page)]
        fallback = self.pairs[""]
        table = [self.pairs.get(kind(x, False), fallback) for x in nodes]
        below, sent = own[:], [0.0] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):  # up: a child comes after its parent
            low, high = table[i]
            r = math.exp(max(-30.0, min(30.0, below[i])))
            sent[i] = math.log((high * r + 1 - high) / (low * r + 1 - low))
            below[nodes[i].parent] += sent[i]
        belief = below[:]
        for i in range(1, len(nodes)):  # down
            low, high = table[i]
            rest = max(-30.0, min(30.0, belief[nodes[i].parent] - sent[i]))
            p = 1 / (1 + math.exp(-rest))
            prior = p * high + (1 - p) * low
            belief[i] = below[i] + math.log(prior / (1 - prior))
        return [1 / (1 + math.exp(-max(-30.0, min(30.0, b)))) for b in belief]


def grafted(page: Page, label: list[int], rng: np.random.Generator) -> tuple[Page, list[int]]:
    """A copy with elements that read like the page's text put into it: furniture and plain ones.

    Furniture (by its tag or a name) goes below the root and below a content element, plain lists, tables and
    divisions below a content element. This teaches that an element's own name outweighs its text and its
    parent, and that other elements follow their parent, where the labelled pages have no such case.
    """
    nodes, out = list(page.nodes), list(label)
    texts = [x for x, y in zip(page.nodes, label, strict=True) if y and x.chars] or [Node("p", 0, 1, chars=80)]
    holders = [i for i, y in enumerate(label) if y and nodes[i].children] or [0]

    def put(parent: int, tag: str, names: tuple[str, ...], y: int) -> None:
        at = len(nodes)
        nodes.append(Node(tag, parent, nodes[parent].depth + 1, names, children=2))
        out.append(y)
        for _ in range(2):
            like = texts[int(rng.integers(len(texts)))]
            inner = "li" if tag in ("ul", "ol") else "td" if tag == "table" else like.tag
            nodes.append(replace(like, tag=inner, parent=at, depth=nodes[at].depth + 1, names=(), children=0))
            out.append(y)

    for holder in (int(rng.choice(holders)), 0):
        if rng.random() < 0.5:
            put(holder, str(rng.choice(PLAIN_TAGS)), (str(rng.choice(sorted(FURNITURE_NAMES))),), 0)
        else:
            put(holder, str(rng.choice([*sorted(FURNITURE_TAGS), *["header"] * (4 * (holder == 0))])), (), 0)
    holder = int(rng.choice(holders))
    if holder:
        for _ in range(2):
            put(holder, str(rng.choice(PLAIN_TAGS)), (), 1)
    return Page(nodes, page.blocks), out


def bare(page: Page, label: list[int]) -> tuple[Page, list[int]]:
    """A copy with nothing but the content, put right below the body; all of it is content."""
    nodes = [Node("#root", -1, 0, children=1), Node("html", 0, 1, children=1), Node("body", 1, 2)]
    moved: dict[int, int] = {}
    for i, x in enumerate(page.nodes):
        if label[i] and x.tag not in CONTENT_TAGS:
            moved[i] = len(nodes)
            nodes.append(replace(x, parent=moved.get(x.parent, 2)))
    return Page(nodes, page.blocks), [1] * len(nodes)


def kind(node: Node, masked: bool) -> str:
    """Row of the pair table: the element's name, or what it says it is."""
    if not masked:
        if node.tag in FURNITURE_TAGS:
            return "furniture"
        if node.tag in CONTENT_TAGS or any(name in CONTENT_NAMES for name in node.names):
            return "content"
    return "div" if node.tag in SEMANTIC else node.tag


def fit(pages: list[Page], labels: list[list[int]]) -> Model:
    """Pair potentials by counts, unary weights by logistic regression given the parent's label.

    The parent's part of the odds is held fixed in the regression, so that evidence is not counted twice.
    Each page is seen as it is, with its names masked, with other elements grafted into it, and bare.
    """
    if not pages:
        return Model()
    names: dict[str, int] = {}
    rows, cols, y = [], [], []
    pairs: dict[str, np.ndarray] = {"": np.ones((2, 2))}
    rng = np.random.default_rng(11)
    copies = []
    for page, label in zip(pages, labels, strict=True):
        graft = grafted(page, label, rng)
        copies += [(page, label, False), (page, label, True), (*graft, False), (*bare(page, label), False)]
    for page, label, masked in copies:
        for i, x in enumerate(page.nodes[1:], 1):
            for tag in ("", kind(x, masked)):
                pairs.setdefault(tag, np.ones((2, 2)))[label[x.parent], label[i]] += 1
    sure = {t: tuple(np.clip(n[:, 1] / n.sum(axis=1), FLOOR, 1 - FLOOR).tolist()) for t, n in pairs.items()}
    given = []
    for page, label, masked in copies:
        for i, (x, found) in enumerate(zip(page.nodes, features(page, masked), strict=True)):
            cols += [names.setdefault(f, len(names)) for f in found]
            rows += [len(y)] * len(found)
            y.append(label[i])
            p = sure.get(kind(x, masked), sure[""])[label[x.parent]] if i else 0.5
            given.append(math.log(p / (1 - p)))
    r, c, target, offset = np.array(rows), np.array(cols), np.array(y, dtype=float), np.array(given)
    w, speed = np.zeros(len(names)), np.zeros(len(names))
    seen = np.bincount(c, minlength=len(names))
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(offset + np.bincount(r, w[c], minlength=len(y)), -30, 30)))
        slope = np.bincount(c, (p - target)[r], minlength=len(names)) / seen + DECAY * w
        speed = 0.9 * speed + slope
        w -= RATE * 0.1 * speed
    return Model({f: float(w[i]) for f, i in names.items()}, sure)


def train(pages: DataFrame, html_col: str = "html", id_col: str = "page_id") -> Model:
    """Model from the pages that label themselves by their markup; a sample of about LABELLED_PAGES."""
    marked = pages.select(html_col, id_col).where(F.lower(html_col).rlike("<(article|main)[\\s>]"))
    chosen = drawn(marked, [id_col, F.length(html_col)], LABELLED_PAGES).toPandas()[html_col]
    parsed = [parse(h) for h in sorted(chosen)]
    labelled = [(p, x) for p in parsed if (x := markup_labels(p)) is not None]
    return fit([p for p, _ in labelled], [x for _, x in labelled])


def main_text(model: Model, source: str | None) -> str:
    page = parse(source)
    if not page.blocks:
        return ""
    p = model.marginals(page)
    return "\n\n".join(text for node, text in page.blocks if p[node] > 0.5)


def extract(
    pages: DataFrame, model: Model, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")
) -> DataFrame:
    """(*keep, text, n_chars) for each row; a null, empty or text-less page gives an empty text.

    One narrow pass over whole pages. Ids may be null or repeated; columns other than `keep` are not read.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(sent.value, h) for h in batch.column(len(keep)).to_pylist()]
            columns = [*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "text", "n_chars"])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(*keep, html_col).mapInArrow(run, f"{kinds}, text string, n_chars long")
