"""Main text of web pages by a tree-structured graphical model.

Every block-level node of a page is article or not. A node's own potential adds the weights of its tag, of the words in its class, id
and role, and of how much text and links it holds; a potential of each parent-child pair, by the kind of the child, lets
neighbours in the tree agree or part. Messages go from the leaves to the root and back (sum-product), exactly, since the
graph is a tree, and give each node's marginal. The weights are fitted by the exact gradient of the likelihood over
labelled pages. The text blocks of nodes at or above one half are the main text, in page order.

Contract: a null or empty page gives an empty text. White space within a block becomes one space, blocks are trimmed and joined by an
empty line; character references are decoded; nothing is cut off. A page's cost is linear in its length. Repeated rows give equal rows.
"""

from __future__ import annotations

import math
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, spread, table
from .dom import Node, parse
from .layouts import MARK, Maker

#: Pages to train from, and the seed that makes them.
TRAINING_PAGES, TRAINING_SEED = 600, 20
_WORDS = re.compile(r"[a-z]+")
_MARKED = re.compile(MARK + r"=\"(\d)\"")


KINDS = ("text", "side", "box")


def kind(tag: str) -> str:
    """What a child is to its parent: the pair potential's index."""
    if tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "blockquote", "pre", "figure", "figcaption", "dl", "dt", "dd", "td", "th", "tr", "tbody", "thead"):
        return "text"
    if tag in ("nav", "header", "footer", "aside", "form", "fieldset", "menu", "dialog", "search"):
        return "side"
    return "box"


def static_features(tag: str, names: str) -> list[str]:
    found = [f"t:{tag}"]
    for word in set(_WORDS.findall(names)):
        found.append(f"w:{word}")
        found.extend(f"s:{word[:n]}" for n in (4, 6) if len(word) > n)
    if names:
        found.append("named")
    return found


def text_features(node: Node) -> list[str]:
    """What a node holds, whether text of its own, and the plain element that it stands in."""
    if not node.shown:
        return ["empty"]
    links = node.linked / max(1, node.shown)
    place = [f"d:{node.tag}"] if node.blocks else []
    if node.parent and not node.parent.names:
        place.append(f"u:{node.parent.tag}:{kind(node.tag)}")
    return [*place, f"n:{min(5, int(math.log(node.shown + 1, 4)))}", "linked" if links > 0.6 else "some links" if links > 0.1 else "no links"]


class TreeModel:
    def __init__(self):
        self.weights: dict[str, float] = {"bias": 0.0}
        #: By kind of child: log potentials of (parent, child) = (0, 1), (1, 0) and (1, 1); that of (0, 0) is zero.
        self.pairs = {k: [0.0, 0.0, 0.0] for k in KINDS}
        self._static: dict[tuple[str, str], float] = {}
        self._dynamic: dict[tuple, float] = {}

    def own(self, node: Node) -> float:
        """The log odds of a node by itself."""
        key = (node.tag, node.names)
        static = self._static.get(key)
        if static is None:
            static = sum(self.weights.get(f, 0.0) for f in static_features(*key)) + self.weights["bias"]
            if len(self._static) < 50_000:
                self._static[key] = static
        return static + sum(self.weights.get(f, 0.0) for f in text_features(node))

    def marginals(self, nodes: list[Node], own: list[float]) -> list[float]:
        """Log odds of each node given the whole page."""
        place = {id(n): k for k, n in enumerate(nodes)}
        belief, message = list(own), [0.0] * len(nodes)
        parents = [-1] + [place[id(n.parent)] for n in nodes[1:]]
        for k in range(len(nodes) - 1, 0, -1):  # children come after their parents in page order
            a = belief[k]
            w01, w10, w11 = self.pairs[kind(nodes[k].tag)]
            message[k] = _mix(w11 + a, w10) - _mix(w01 + a, 0.0)
            belief[parents[k]] += message[k]
        for k in range(1, len(nodes)):
            c = belief[parents[k]] - message[k]
            w01, w10, w11 = self.pairs[kind(nodes[k].tag)]
            belief[k] += _mix(w11 + c, w01) - _mix(w10 + c, 0.0)
        return belief

    def fit(self, pages: list[list[Node]], rounds: int = 80, rate: float = 0.5, decay: float = 3e-4) -> TreeModel:
        """Adagrad on the conditional likelihood: observed less expected counts, exact by the messages of all pages at once, level by level."""
        nodes = [n for page in pages for n in page]
        place = {id(n): k for k, n in enumerate(nodes)}
        parent = np.array([place[id(n.parent)] if n.parent else -1 for n in nodes])
        label, sort = np.array([n.label for n in nodes]), np.array([KINDS.index(kind(n.tag)) for n in nodes])
        depth = np.array([n.depth for n in nodes])
        levels = [np.flatnonzero(depth == d) for d in range(1, depth.max() + 1)]
        listed = [["bias", *static_features(n.tag, n.names), *text_features(n)] for n in nodes]
        names = sorted({f for own in listed for f in own})
        number = {f: k for k, f in enumerate(names)}
        sizes = np.array([len(own) for own in listed])
        ids = np.array([number[f] for own in listed for f in own])
        begins = np.cumsum(sizes) - sizes
        weights, pairs = np.zeros(len(names)), np.zeros((len(KINDS), 3))
        seen, pairs_seen = np.full(len(names), 1e-6), np.full(pairs.shape, 1e-6)
        inner = np.flatnonzero(parent >= 0)
        truth = np.eye(4)[2 * label[parent[inner]] + label[inner]]
        for _ in range(rounds):
            belief, message = np.add.reduceat(weights[ids], begins), np.zeros(len(nodes))
            for level in levels[::-1]:
                w01, w10, w11 = pairs[sort[level]].T
                message[level] = np.logaddexp(w11 + belief[level], w10) - np.logaddexp(w01 + belief[level], 0)
                np.add.at(belief, parent[level], message[level])
            upward, cavity = belief.copy(), np.zeros(len(nodes))
            for level in levels:
                cavity[level] = belief[parent[level]] - message[level]
                w01, w10, w11 = pairs[sort[level]].T
                belief[level] += np.logaddexp(w11 + cavity[level], w01) - np.logaddexp(w10 + cavity[level], 0)
            gap = label - 1 / (1 + np.exp(-np.clip(belief, -30, 30)))
            grad = np.bincount(ids, np.repeat(gap, sizes), len(names)) - decay * len(pages) * weights
            seen += grad * grad
            weights += rate * grad / np.sqrt(seen)
            w, a, c = pairs[sort[inner]], upward[inner], cavity[inner]
            terms = np.stack([np.zeros(len(inner)), w[:, 0] + a, w[:, 1] + c, w[:, 2] + a + c], axis=1)
            e = np.exp(terms - terms.max(axis=1, keepdims=True))
            excess = (truth - e / e.sum(axis=1, keepdims=True))[:, 1:]
            pair_grad = np.stack([np.bincount(sort[inner], excess[:, j], len(KINDS)) for j in range(3)], axis=1) - decay * len(pages) * pairs
            pairs_seen += pair_grad * pair_grad
            pairs += rate * pair_grad / np.sqrt(pairs_seen)
        self.weights = dict(zip(names, weights.tolist(), strict=True))
        self.pairs = dict(zip(KINDS, pairs.tolist(), strict=True))
        self._static.clear()
        return self

    def extract(self, html: str | None) -> str:
        nodes = parse(html)
        belief = self.marginals(nodes, [self.own(n) for n in nodes])
        kept = [b for n, odds in zip(nodes, belief, strict=True) if odds >= 0 for b in n.blocks]
        kept.sort()
        return "\n\n".join(text for _, text in kept)


def _mix(x: float, y: float) -> float:
    """log(exp(x) + exp(y))"""
    return x + math.log1p(math.exp(y - x)) if x > y else y + math.log1p(math.exp(x - y))


def labelled(html: str) -> list[Node]:
    """Nodes of a marked page with their labels; the marks leave the features."""
    plain = _MARKED.sub(lambda m: f'id="mark{m.group(1)}"', html)
    nodes = parse(plain)
    for n in nodes:
        found = re.search(r"\bmark(\d)\b", n.names)
        n.label = int(found.group(1)) if found else max(0, n.parent.label if n.parent else 0)
        n.names = re.sub(r"\s*\bmark\d\b\s*", " ", n.names).strip()
    nodes[0].label = int(html.startswith(f'<html {MARK}="1"'))  # the root, whose attributes the reader leaves out
    return nodes


@cache
def trained(pages: int = TRAINING_PAGES, seed: int = TRAINING_SEED) -> TreeModel:
    maker = Maker(seed)
    return TreeModel().fit([labelled(maker.page()) for _ in range(pages)])


def main_text(pages: DataFrame, model: TreeModel | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    model = model or trained()

    def apply(batches):
        for batch in batches:
            texts = [model.extract(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return map_batches(own, apply, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return main_text(spread(table(spark, sf_dir, "pages")))
