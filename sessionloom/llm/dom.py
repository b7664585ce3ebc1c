"""A tolerant reader of page markup: block elements as a tree, with the text between block borders."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# HTML element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
# Of these, a missing end tag takes the rest of the page with it; of the others only the tag is skipped.
ENDLESS = frozenset(["script", "style"])
# Elements that run on within a line, parts of formulas and drawings too.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var math mi mn mo ms mtext mspace mrow mfrac msqrt mroot msup msub msubsup mover munder "
    "munderover mfenced mstyle mpadded mphantom mtable mtr mtd semantics svg g path circle rect line polyline polygon ellipse "
    "text tspan defs use".split())
# An opening tag on the left ends the open elements on the right.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "optgroup": {"optgroup", "option"}, "thead": {"thead", "tbody", "tfoot", "tr", "td", "th"},
    "tbody": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tfoot", "tr", "td", "th"},
}
# An element of the left kind is not ended across one of the right.
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "optgroup": {"select"}}
TABLE = {"table"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<", re.S)
NAMES = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
PART = re.compile(r"[a-z]+")


@dataclass(slots=True)
class Node:
    """A block element; text and link lengths are its own, without those of its children."""

    tag: str
    parent: int
    depth: int
    names: tuple[str, ...] = ()
    hidden: bool = False
    chars: int = 0
    linked: int = 0
    stops: int = 0
    blocks: int = 0
    before: int = 0
    children: int = 0


@dataclass(slots=True)
class Page:
    """Nodes in the order of their opening tags, and (node, text) of each block in page order."""

    nodes: list[Node] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)


def parse(source: str | None) -> Page:
    page = Page([Node("#root", -1, 0)])
    if not source:
        return page
    nodes, stack, parts = page.nodes, [0], []
    link, linked, seen = False, 0, 0

    def close_block() -> None:
        nonlocal linked, seen
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                node = nodes[stack[-1]]
                node.chars += len(text)
                node.linked += min(linked, len(text))
                node.stops += text.count(". ") + text.count(", ") + text.endswith((".", "!", "?"))
                node.blocks += 1
                seen += len(text)
                page.blocks.append((stack[-1], text))
        linked = 0

    def pop_to(place: int) -> None:
        close_block()
        del stack[place:]

    at, n, match = 0, len(source), TOKEN.match
    while at < n:
        m = match(source, at)
        at = m.end()
        name = m.group(2) or m.group(5)
        if name is None:
            piece = m.group()
            if piece[0] != "<" or len(piece) == 1:
                parts.append(piece)
                if link:
                    linked += len(piece)
            elif piece.startswith("<![CDATA["):
                parts.append(html.escape(piece[9:-3]))
            continue
        tag = name.lower()
        if m.group(1) or m.group(4):  # an end tag
            if tag == "a":
                link = False
            elif tag in INLINE or tag in VOID:
                if tag == "br":
                    parts.append(" ")
            else:
                for place in range(len(stack) - 1, 0, -1):
                    if nodes[stack[place]].tag == tag:
                        pop_to(place)
                        link = False
                        break
                else:
                    close_block()
            continue
        rest = m.group(3) or m.group(6) or ""
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
            at = end.end() if end else n if tag in ENDLESS else at
            continue
        if tag in VOID:
            if tag in ("br", "hr", "wbr"):
                parts.append("" if tag == "wbr" else " ")
            if tag == "hr":
                close_block()
            continue
        if tag in INLINE:
            if tag == "a":
                link = True
            continue
        close_block()
        link = False
        # Implied end tags.
        if nodes[stack[-1]].tag == "p":
            stack.pop()
        if tag in ENDS:
            stop = HOLDS.get(tag, TABLE)
            for place in range(len(stack) - 1, 0, -1):
                open_tag = nodes[stack[place]].tag
                if open_tag in stop:
                    break
                if open_tag in ENDS[tag]:
                    del stack[place:]
        names: tuple[str, ...] = ()
        hidden = False
        if rest:
            names = tuple(
                part for _, a, b, c in NAMES.findall(rest) for part in PART.findall((a or b or c).lower()))
            hidden = bool(HIDDEN.search(rest))
        if rest.endswith("/") and tag not in ("p", "div", "li"):
            continue
        parent = stack[-1]
        nodes[parent].children += 1
        nodes.append(Node(tag, parent, nodes[parent].depth + 1, names, hidden, before=seen))
        stack.append(len(nodes) - 1)
    close_block()
    return page
