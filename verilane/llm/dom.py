"""A small tolerant HTML reader: block-level nodes with their own text blocks, in page order.

Inline elements fold into the block around them. Comments, declarations and the contents of elements that never show text
(scripts, styles, vector graphics and the like) are left out. Unclosed and misplaced tags are mended by simple rules: a void element has no
content, a paragraph ends where a block begins, items, cells and rows end their like, and an end tag closes up to the nearest
open element of its name, if there is one. An element without shown text that is never closed hides nothing, but for a script or a style sheet.
What a cut-off page leaves open ends with the page, and a tag cut off at its start isn't text. No character of the text is dropped.

The reader is linear in the page's length: what hides is paired in one pass, open elements are found by their names, and a quote
that never ends is looked for once.
"""

from __future__ import annotations

import re
from html import unescape

#: Fixed names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style textarea title noscript template svg math iframe object select canvas audio video".split())
RAW_TEXT = frozenset("script style textarea title iframe noscript".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table caption tbody td tfoot th thead tr ul".split()
)
ENDS_LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS_LIKE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)|</?\Z", re.S)
_HIDING = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)({'|'.join(sorted(HIDDEN))})(?![a-zA-Z0-9:-])([^>]*)>?", re.S | re.I)
_ENDS = {name: re.compile(rf"</{name}(?![a-zA-Z0-9:-])[^>]*>?", re.I) for name in RAW_TEXT}
_IN_TAG = re.compile(r">|=\s*[\"']")
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


class Node:
    __slots__ = ("blocks", "children", "depth", "label", "linked", "names", "parent", "shown", "tag")

    def __init__(self, tag: str, names: str, parent: Node | None):
        self.tag, self.names, self.parent = tag, names, parent
        self.children: list[Node] = []
        self.blocks: list[tuple[int, str]] = []
        self.shown = self.linked = 0
        self.depth = parent.depth + 1 if parent else 0
        self.label = -1
        if parent:
            parent.children.append(self)


def hidden_spans(html: str) -> dict[int, int]:
    """Where each element without shown text begins and what follows it, in one pass. Scripts and style sheets may end with the page."""
    out: dict[int, int] = {}
    open_: dict[str, list[int]] = {}
    never: set[str] = set()
    at = 0
    while (m := _HIDING.search(html, at)) is not None:
        at = m.end()
        if m.group(2) is None:
            continue
        name = m.group(2).lower()
        if name in RAW_TEXT:
            end = None if m.group(1) or name in never or m.group(3).endswith("/") else _ENDS[name].search(html, at)
            if end is not None:
                out[m.start()] = at = end.end()
            elif not m.group(1) and not m.group(3).endswith("/"):
                if name in ("script", "style"):
                    out[m.start()] = len(html)
                    break
                never.add(name)
        elif not m.group(1):
            if not m.group(3).endswith("/"):
                open_.setdefault(name, []).append(m.start())
        elif open_.get(name):
            out[open_[name].pop()] = at
    return out


class _Open:
    """The open elements, and where those of each name stand among them."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, place: int) -> None:
        for node in self.stack[place:]:
            self.places[node.tag].pop()
        del self.stack[place:]

    def last(self, names) -> int:
        """The place of the innermost open element of some names; 0 if there is none."""
        return max((own[-1] for name in names if (own := self.places.get(name))), default=0)


def parse(html: str | None) -> list[Node]:
    """All block-level nodes in page order, the root first. A block is (its place in the page, its text)."""
    html = html or ""
    hidden = hidden_spans(html)
    root = Node("html", "", None)
    nodes, open_ = [root], _Open(root)
    stack = open_.stack
    buffer: list[str] = []
    never: set[str] = set()
    count = links = 0

    def close_block() -> None:
        nonlocal count
        if buffer:
            text = " ".join(unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                stack[-1].blocks.append((count, text))
                stack[-1].shown += len(text)
                count += 1

    def put(piece: str) -> None:
        buffer.append(piece)
        if links:
            stack[-1].linked += len(piece.strip())

    def tag_end(at: int) -> int:
        """The place of the bracket that ends a tag, or the page's end; quoted values may hold brackets."""
        while (m := _IN_TAG.search(html, at)) is not None:
            if m.group() == ">":
                return m.start()
            quote, at = m.group()[-1], m.end()
            if quote not in never:
                close = html.find(quote, at)
                if close < 0:
                    never.add(quote)
                else:
                    at = close + 1
        return len(html)

    def begin(name: str, attrs: str) -> None:
        node = Node(name, _names(attrs), stack[-1])
        open_.push(node)
        nodes.append(node)

    at = 0
    while True:
        m = _TOKEN.search(html, at)
        if m is None:
            put(html[at:])
            break
        if m.start() > at:
            put(html[at : m.start()])
        at = m.end()
        if m.group(2) is None:
            continue
        name, end, stop = m.group(2).lower(), m.group(1), tag_end(at)
        attrs, at = html[at:stop], min(stop + 1, len(html))
        if name in HIDDEN:
            at = hidden.get(m.start(), at) if not end else at
            continue
        if name == "a":
            links = 0 if end else 1
        if name == "br":
            buffer.append(" ")
        if name not in BLOCK:
            continue
        close_block()
        links = 0
        if end:
            if place := open_.last((name,)):
                open_.cut(place)
            continue
        if name in VOID:
            continue
        if name in ("html", "body"):
            if name == "body" and len(stack) == 1:
                begin(name, attrs)
            continue
        while stack[-1].tag == "p":
            open_.cut(len(stack) - 1)
        if name in ENDS_LIKE:
            like = open_.last(ENDS_LIKE[name])
            if like > open_.last(HOLDS_LIKE.get(name, ())):
                open_.cut(like)
        begin(name, attrs)
    close_block()
    return nodes


def _names(attrs: str) -> str:
    if not attrs or "=" not in attrs:
        return ""
    return " ".join(x or y or z for x, y, z in _NAMES.findall(attrs)).lower()
