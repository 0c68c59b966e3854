"""Document quality by hierarchical empirical Bayes.

A logistic classifier over counts of characters and words gives each document's evidence. Grouped aggregation sums
the classifier's probabilities by host and by path within a host (here: source, and language within it). A Beta prior
fitted to the hosts by moments shrinks each host towards the global rate, and a second one shrinks each path towards
its host, so sparse sites follow their parents. The posterior of a document is its evidence with the global odds replaced
by those of its path, from which its own share has been taken out.

Scale. The evidence is a map over batches whose result is checkpointed, so that features are worked out once; the sums are partial
aggregates, so a host with a third of all rows is no hot spot. The table of paths is broadcast only if its counted rows are within BROADCAST_ROWS;
otherwise the heavy paths alone are, and the rows of the light ones are joined by shuffle.

Contract: labels come only from rows outside the held-out fold. A null text counts as empty; null source or lang are values of
their own. Without labels of both kinds, the evidence is 0, the score is 0.5 and every document is kept. Repeated rows count each by themselves and score alike.
"""

from __future__ import annotations

import operator
import unicodedata
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import checkpointed, held_out, map_batches, sampled, spread, table

#: The bound of the training sample, for each label.
DOCS_PER_LABEL = 4000
THRESHOLD = 0.5
BROADCAST_ROWS, HEAVY = 50_000, 10_000
#: Limits of a Beta prior's weight in rows.
LEAST_WEIGHT, MOST_WEIGHT = 20.0, 10_000.0
_SPACE, _LETTER, _UPPER, _DIGIT, _OTHER = range(5)
FEATURES = 10


@cache
def _classes() -> np.ndarray:
    """The class of every code point, by its Unicode category."""
    kinds = {"Z": _SPACE, "L": _LETTER, "M": _LETTER, "N": _DIGIT}
    out = np.full(0x110000, _OTHER, np.uint8)
    for point in range(0x110000):
        category = unicodedata.category(chr(point))
        out[point] = _UPPER if category == "Lu" else kinds.get(category[0], _OTHER)
    out[[9, 10, 11, 12, 13]] = _SPACE
    return out


def features(text: str | None) -> list[float]:
    """Shares of upper case, marks, digits, repeated and frequent words, and sizes."""
    text = text or ""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    n = np.bincount(_classes()[codes], minlength=5)
    words = text.split()
    counts = Counter(words)
    total = max(1, len(words))
    top = max(counts.values(), default=0) / total
    letters, solid = max(1, n[_LETTER] + n[_UPPER]), max(1, len(codes) - n[_SPACE])
    long_enough = min(1.0, total / 40)
    return [
        n[_UPPER] / letters, n[_OTHER] / solid, n[_DIGIT] / solid, sum(map(operator.eq, words, words[1:])) / total,
        (1 - len(counts) / total) * long_enough, top * long_enough, top, min(1.0, text.count("!") / total), min(30.0, len(text) / total) / 30, np.log1p(total) / 10,
    ]


class Evidence:
    """Logistic regression on standardised features, with a ridge, by Newton's method."""

    def __init__(self):
        self.mean, self.scale, self.weights, self.bias = np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, rate: float, ridge: float = 0.5, rounds: int = 30) -> Evidence:
        """rate: the share of label 1 among all labelled rows, to which the bias of a sample is moved."""
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])
        w, penalty = np.zeros(z.shape[1]), np.diag([ridge] * FEATURES + [1e-6])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z.T * (p * (1 - p) + 1e-9)) @ z + penalty, z.T @ (y - p) - penalty @ w)
            w += step
            if abs(step).max() < 1e-8:
                break
        sample = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        rate = float(np.clip(rate, 1e-6, 1 - 1e-6))
        self.weights, self.bias = w[:-1], float(w[-1] + np.log(rate / (1 - rate)) - np.log(sample / (1 - sample)))
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weights + self.bias, -30, 30)


def _vectors(batches):
    for batch in batches:
        x = [features(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["label", "x"])


def train(docs: DataFrame, labels: DataFrame, docs_per_label: int = DOCS_PER_LABEL) -> Evidence:
    """Fit on at most docs_per_label documents of each label outside the held-out fold; only their features reach the driver."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("label in (0, 1)").where(~held_out())
    chosen = sampled(known, ["label"], docs_per_label, 17)  # at most two labels
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("label", "text")
    rows = sorted((r.label, list(r.x)) for r in map_batches(texts, _vectors, "label int, x array<double>").collect())
    y = np.array([r[0] for r in rows], float)
    if not rows or y.min() == y.max():
        return Evidence()
    return Evidence().fit(np.array([r[1] for r in rows]), y, known.agg(F.avg("label")).first()[0])


def with_evidence(docs: DataFrame, model: Evidence, text_col: str = "text", name: str = "_logit") -> DataFrame:
    """docs with the evidence as a last column. Rows stay where they lie."""
    at = docs.columns.index(text_col)

    def apply(batches):
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(at)]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.logits(x), pa.float64())], schema=batch.schema.append(pa.field(name, pa.float64())))

    return map_batches(docs, apply, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def _weight(groups: DataFrame, rate: float, parent: str | None) -> float:
    """A Beta prior's weight by moments: how much the groups' rates scatter beyond what their sizes explain."""
    mean = F.col(parent) if parent else F.lit(rate)
    p = F.col("s") / F.col("n")
    row = groups.where("n > 1").agg(F.sum(F.col("n") * (p - mean) ** 2).alias("scatter"), F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * mean * (1 - mean)).alias("spread")).first()
    if not row.k or not row.n or row.n * row.n == row.nn:
        return MOST_WEIGHT
    base = row.spread / row.n
    between = (row.scatter - row.k * base) / (row.n - row.nn / row.n)
    return float(np.clip(base / between - 1, LEAST_WEIGHT, MOST_WEIGHT)) if between > 0 else MOST_WEIGHT


def path_rates(evidence: DataFrame) -> tuple[DataFrame, float, int]:
    """From host, path and p: the posterior rate parameters of each path, the global rate, and the number of rows."""
    paths = checkpointed(evidence.groupBy("host", "path").agg(F.sum("p").alias("s"), F.count("*").alias("n")))
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    total = hosts.agg(F.sum("s"), F.sum("n")).first()
    rate = float(np.clip((total[0] or 0.0) / total[1], 1e-6, 1 - 1e-6)) if total[1] else 0.5
    of_hosts = _weight(hosts, rate, None)
    shrunk = hosts.select("host", F.col("s").alias("host_s"), F.col("n").alias("host_n"), ((F.col("s") + of_hosts * rate) / (F.col("n") + of_hosts)).alias("host_rate"))
    joined = paths.join(shrunk, "host")
    of_paths = _weight(joined, rate, "host_rate")
    return joined.select("host", "path", "s", "n", "host_s", "host_n", F.lit(of_hosts).alias("host_weight"), F.lit(of_paths).alias("path_weight")), rate, total[1] or 0


def _with_rates(scored: DataFrame, rates: DataFrame, total: int, broadcast_rows: int) -> DataFrame:
    """scored with its path's parameters. Few paths are broadcast whole; of many, those that hold over 1 / HEAVY of all rows, of which
    there are fewer than HEAVY, are broadcast, and the rows of all others, none of them frequent, are joined by shuffle."""
    if rates.count() <= broadcast_rows:
        return scored.join(F.broadcast(rates), ["host", "path"])
    heavy, light = (checkpointed(rates.where(c)) for c in (F.col("n") * HEAVY > total, F.col("n") * HEAVY <= total))
    rest = scored.join(F.broadcast(heavy.select("host", "path")), ["host", "path"], "left_anti")
    return scored.join(F.broadcast(heavy), ["host", "path"]).unionByName(rest.join(light.hint("merge"), ["host", "path"]))


def posteriors(scored: DataFrame, broadcast_rows: int | None = None) -> DataFrame:
    """scored (host, path, p and any others) with host_rate, path_rate and score. scored is read several times and should be a checkpoint."""
    rates, rate, total = path_rates(scored.select("host", "path", "p"))
    own = _with_rates(scored, rates, total, BROADCAST_ROWS if broadcast_rows is None else broadcast_rows)
    host = (F.col("host_s") - F.col("p") + F.col("host_weight") * rate) / (F.col("host_n") - 1 + F.col("host_weight"))
    path = (F.col("s") - F.col("p") + F.col("path_weight") * F.col("host_rate")) / (F.col("n") - 1 + F.col("path_weight"))
    own = own.withColumn("host_rate", host).withColumn("path_rate", F.least(F.greatest(path, F.lit(1e-6)), F.lit(1 - 1e-6)))
    p = F.least(F.greatest("p", F.lit(1e-13)), F.lit(1 - 1e-13))
    odds = F.log(p / (1 - p)) + F.log(F.col("path_rate") / (1 - F.col("path_rate"))) - float(np.log(rate / (1 - rate)))
    return own.withColumn("score", 1 / (1 + F.exp(-odds))).drop("s", "n", "host_s", "host_n", "host_weight", "path_weight")


def _keyed(docs: DataFrame, model: Evidence, text_col: str, host_col: str, path_col: str, keep: list[str]) -> DataFrame:
    """The columns keep, host, path and p, once and for all."""
    found = with_evidence(docs, model, text_col)
    host, path = (F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in (host_col, path_col))
    return checkpointed(found.select(*keep, host.alias("host"), path.alias("path"), (1 / (1 + F.exp(-F.col("_logit")))).alias("p")))


#: A score that misses the threshold by rounding alone doesn't reject.
KEEP_FROM = THRESHOLD - 1e-9


def quality(docs: DataFrame, model: Evidence) -> DataFrame:
    """doc_id, evidence (the classifier's probability), host_rate, path_rate, score and keep of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang")
    out = posteriors(_keyed(rows, model, "text", "source", "lang", ["doc_id"]))
    return out.select("doc_id", F.col("p").alias("evidence"), "host_rate", "path_rate", "score", (F.col("score") >= KEEP_FROM).cast("int").alias("keep"))


def keep_good(docs: DataFrame, model: Evidence) -> DataFrame:
    """The rows of docs that score at or above the threshold, with all their columns. Ids may be null or repeated, so the rows themselves are
    carried along, through one checkpoint."""
    names = [f"_c{k}" for k in range(len(docs.columns))]  # so that no column of docs meets one of ours
    own = [names[docs.columns.index(c)] for c in ("text", "source", "lang")]
    kept = posteriors(_keyed(docs.toDF(*names), model, *own, names)).where(F.col("score") >= KEEP_FROM)
    return kept.select(*names).toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    out = quality(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.withColumn("held_out", held_out())
