"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

A sentence's logit is a bias plus the weights of its different words; a word's weight is the sum over the word itself and
its prefixes, of those features that a screen by likelihood ratio lets in. Sentences combine by noisy-or, P = 1 - prod(1 - p), and the weights are fitted in numpy
to the documents' labels alone: the gradient reaches each sentence in proportion to its share in the document's
probability. The fitted sentence probabilities then locate the offending sentences.

A sentence at or under FLOOR counts as no evidence, so that the length of a clean text doesn't add up to a verdict.

Contract: labels come only from rows outside the held-out fold with a label that isn't null; a score sees the text alone. A text that
is null, empty or without words scores 0. With no labels of both kinds to learn from, every score is 0. Repeated rows score alike.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Memo
from .common import checkpointed, held_out, map_batches, sampled, spread, table

#: The bound of the training sample: documents of each label.
DOCS_PER_LABEL = 5000
PREFIXES = (3, 4, 5)
#: The least log odds of a feature that takes part.
LEAST_ODDS = 1.0
THRESHOLD, FLOOR = 0.3, 0.02
_TOKENS = re.compile(r"[^\W\d_]+|[.!?\n]+")
_ENDS = frozenset(".!?\n")


def word_features(word: str) -> list[str]:
    """The word itself and its prefixes."""
    return [f"={word}", *(f"{n}{word[:n]}" for n in PREFIXES if len(word) >= n)]


def shorter(feature: str) -> str:
    """The longest feature that every word with this one has too; none for the shortest."""
    if feature[0] == "=":
        n = max((n for n in PREFIXES if n < len(feature)), default=0)
        return f"{n}{feature[1 : n + 1]}" if n else ""
    n = int(feature[0]) - 1
    return f"{n}{feature[1:-1]}" if n in PREFIXES else ""


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """Start, end and lower-case words of each sentence that has words."""
    out, words, start, end = [], [], 0, 0
    for m in _TOKENS.finditer(text):
        if m.group()[0] in _ENDS:
            if words:
                out.append((start, m.end(), words))
            words = []
        else:
            if not words:
                start = m.start()
            words.append(m.group().lower())
            end = m.end()
    return out + [(start, end, words)] if words else out


_MULTIPLIERS = np.random.default_rng(5).integers(1, 1 << 63, 6, dtype=np.uint64) | np.uint64(1)


def copy_marks(text: str) -> list[int]:
    """The smallest of a text's word shingles under each of a few hashes."""
    words = text.lower().split()
    shingles = map(" ".join, zip(words, words[1:], words[2:], strict=False)) if len(words) > 2 else [" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, shingles), np.uint64)
    return [int((hashes * f).min().view(np.int64)) for f in _MULTIPLIERS]


def without_copies(marks: list[list[int]]) -> list[int]:
    """Positions of the texts that are no copy or near copy of one before: none of their marks was seen.

    Copies would count one text's rare words many times over. At similarity 0.8 a copy goes unseen once in 0.2 ** -6.
    """
    seen: set[tuple[int, int]] = set()
    kept = []
    for k, own in enumerate(marks):
        own = set(enumerate(own))
        if not own & seen:
            kept.append(k)
        seen |= own
    return kept


def least_gain(n_features: int) -> float:
    """The likelihood ratio that few of so many features reach by chance."""
    return max(0.0, 2 * float(np.log(n_features + 2)) - 4)


def screened(counts: dict[str, tuple[int, int]], n_clean: int, n_toxic: int, n_features: int) -> dict[str, float]:
    """Log odds of the features (clean, toxic documents) that toxic documents hold more often, where a likelihood ratio that few of
    so many features reach by chance says so too."""
    n, least = np.array([n_clean, n_toxic]) + 1.0, least_gain(n_features)
    base, found = n[1] / n.sum(), {}
    # what a longer feature says of the same documents is said once, by the longer one
    said = {g for f in counts if (g := shorter(f)) and counts.get(g) == counts[f]}
    for f, (clean, toxic) in counts.items():
        if f in said:
            continue
        odds = float(np.log((toxic + 0.5) / n[1]) - np.log((clean + 0.5) / n[0]))
        gain = 2 * sum(k * np.log(k / (toxic + clean) / rate) for k, rate in ((toxic, base), (clean, 1 - base)) if k)
        if odds > LEAST_ODDS and gain > least:
            found[f] = odds
    return found


class Model:
    """weights: of each feature that passed the screen. A model that has seen nothing scores 0."""

    def __init__(self, weights: dict[str, float] | None = None, bias: float = -4.0):
        self.weights, self.bias = weights or {}, bias

    def fit(self, docs: list[tuple[int, int, list[list[int]]]], names: list[str], first: list[float], rounds: int = 120, rate: float = 0.1, decay: float = 1e-4) -> Model:
        """docs: label, number of sentences without a screened feature (they differ in nothing), and the features of each other sentence."""
        y, bare = np.array([d[0] for d in docs]), np.array([float(d[1]) for d in docs])
        flat, starts, owner = [], [], []
        for k, (_, _, found) in enumerate(docs):
            for ids in found:
                starts.append(len(flat))
                owner.append(k)
                flat.extend(ids)
        if not flat:
            return self
        ids, begin, owner = np.array(flat), np.array(starts), np.array(owner)
        sizes = np.diff(np.append(begin, len(ids)))
        weights = np.array(first, float)
        bias, seen, seen_bias = self.bias, np.full(len(weights), 1e-8), 1e-8
        share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
        for _ in range(rounds):
            z = np.add.reduceat(weights[ids], begin) + bias
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            idle = 1 / (1 + np.exp(-bias))
            clean = np.bincount(owner, -np.logaddexp(0, z), len(y)) - bare * np.logaddexp(0, bias)  # log prod(1 - p)
            total = np.clip(-np.expm1(clean), 1e-12, None)
            pull = np.where(y == 1, -np.exp(clean) / total, 1.0) * share
            back = pull[owner] * p
            grad = np.bincount(ids, np.repeat(back, sizes), len(weights)) + decay * weights / len(y)
            grad_bias = back.sum() + (pull * bare).sum() * idle
            seen += grad**2
            seen_bias += grad_bias**2
            weights -= rate * grad / np.sqrt(seen)
            weights = np.maximum(weights, 0)
            bias -= rate * grad_bias / np.sqrt(seen_bias)
        self.weights, self.bias = dict(zip(names, map(float, weights), strict=True)), float(bias)
        return self

    def word_weight(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in word_features(word))

    def memo(self) -> Memo:
        """What a token adds to its sentence; NaN where a sentence ends."""
        return Memo(lambda token: np.nan if token[0] in _ENDS else self.word_weight(token), 100_000)

    def probabilities(self, text: str, memo: Memo) -> np.ndarray:
        """The probability of each sentence of a text, those without words left out."""
        tokens = _TOKENS.findall(text.lower())
        if not tokens or not self.weights:
            return np.zeros(0)
        values = np.fromiter(map(memo.__getitem__, tokens), np.float64, len(tokens))
        ends = np.isnan(values)
        values[ends] = 0
        starts = np.flatnonzero(~ends & np.concatenate([[True], ends[:-1]]))
        if not len(starts):
            return np.zeros(0)
        z = np.add.reduceat(values, starts) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def score(self, text: str | None, memo: Memo) -> float:
        """Weights are never negative, so only a text with evidence when all its words count needs the look at different words."""
        if not (self.probabilities(text or "", memo) > FLOOR).any():
            return 0.0
        z = np.array([sum(map(memo.__getitem__, sorted(set(words)))) for _, _, words in sentences(text)]) + self.bias
        evidence = np.clip((1 / (1 + np.exp(-np.clip(z, -60, 60))) - FLOOR) / (1 - FLOOR), 0, 1 - 1e-12)
        return float(abs(np.expm1(np.log1p(-evidence).sum())))


def _marks(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([copy_marks(t.as_py()) for t in batch.column(1)], pa.list_(pa.int64()))], ["doc_id", "marks"])


def train(docs: DataFrame, labels: DataFrame, docs_per_label: int = DOCS_PER_LABEL) -> Model:
    """Fit on at most docs_per_label documents of each label outside the held-out fold. Their whole texts take part.

    The sample stays on the executors; what reaches the driver are a few hashes of each document, the features that pass the screen
    and the sentences that hold one.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where("label in (0, 1)").where(~held_out())
    chosen = sampled(known, ["label"], docs_per_label, 43)  # at most two labels
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") > 0)
    sample = checkpointed(texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label"))
    rows = sorted((r.doc_id, list(r.marks)) for r in map_batches(sample.select("doc_id", "text"), _marks, "doc_id long, marks array<long>").collect())
    kept = frozenset(rows[k][0] for k in without_copies([r[1] for r in rows]))

    def count(batches):
        sums: dict[str, list[int]] = {}
        parts = Memo(word_features, 100_000)
        for batch in batches:
            for key, text, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key in kept:
                    for f in {f for w in {w for _, _, ws in sentences(text) for w in ws} for f in parts[w]}:
                        sums.setdefault(f, [0, 0])[label] += 1
        names = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([sums[f][0] for f in names], pa.int64()), pa.array([sums[f][1] for f in names], pa.int64())], ["feature", "clean", "toxic"])

    def only_kept(batches):
        for batch in batches:
            yield batch.filter(pa.array([k in kept for k in batch.column(0).to_pylist()], pa.bool_()))

    sizes = map_batches(sample.select("doc_id", "label"), only_kept, "doc_id long, label int").groupBy("label").agg(F.count("*").alias("n"))
    n = {r.label: r.n for r in sizes.collect()}
    if len(n) < 2:
        return Model()
    counts = checkpointed(map_batches(sample, count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    # the screen's two conditions by SQL with some room for rounding; features of equal counts pass or fail together, so what says the same is still seen
    n_features, base, both = counts.count(), (n[1] + 1.0) / (n[0] + n[1] + 2.0), F.col("toxic") + F.col("clean")
    odds = F.log((F.col("toxic") + 0.5) / (n[1] + 1.0)) - F.log((F.col("clean") + 0.5) / (n[0] + 1.0))
    part = lambda k, rate: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / both / rate)).otherwise(0.0)
    gain = 2 * (part("toxic", base) + part("clean", 1 - base))
    likely = counts.where((odds > LEAST_ODDS - 1e-6) & (gain > least_gain(n_features) - 1e-6))
    first = screened({r.feature: (r.clean, r.toxic) for r in likely.collect()}, n[0], n[1], n_features)
    names = sorted(first)
    place = {f: k for k, f in enumerate(names)}

    def located(batches):
        own = Memo(lambda w: [place[f] for f in word_features(w) if f in place], 100_000)
        for batch in batches:
            out = []
            for key, text, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key in kept:
                    found = [ids for _, _, words in sentences(text) if (ids := [i for w in sorted(set(words)) for i in own[w]])]
                    out.append((key, label, len(sentences(text)) - len(found), found))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.list_(pa.int32()))), strict=True)], ["doc_id", "label", "bare", "found"])

    parsed = sorted((r.doc_id, r.label, r.bare, [list(x) for x in r.found]) for r in map_batches(sample, located, "doc_id long, label int, bare int, found array<array<int>>").collect())
    return Model().fit([r[1:] for r in parsed], names, [first[f] for f in names])


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row, over whole texts."""

    def apply(batches):
        memo = model.memo()
        for batch in batches:
            found = [model.score(x.as_py(), memo) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found, pa.float64())], ["doc_id", "score"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), apply, "doc_id long, score double")


def offending_sentences(docs: DataFrame, model: Model, at_least: float = 0.5) -> DataFrame:
    """doc_id, start, end, probability and sentence of every sentence at or above at_least; one row each."""

    def apply(batches):
        memo = model.memo()
        for batch in batches:
            rows = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py() or ""
                found = sentences(text)
                for start, end, words in found:
                    z = sum(memo[w] for w in sorted(set(words))) + model.bias if model.weights else -60
                    p = 1 / (1 + np.exp(-max(-60.0, min(60.0, z))))
                    if p >= at_least:
                        rows.append((key, start, end, float(p), text[start:end]))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string()), strict=True)], ["doc_id", "start", "end", "probability", "sentence"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), apply, "doc_id long, start long, end long, probability double, sentence string")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores under threshold, with all their columns. Rows stay where they lie."""

    def apply(batches):
        memo = model.memo()
        for batch in batches:
            keep = [model.score(x.as_py(), memo) < threshold for x in batch.column(batch.schema.get_field_index("text"))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_batches(docs, apply, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    model = train(docs, table(spark, sf_dir, "labels"))
    out = scores(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
