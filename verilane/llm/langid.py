"""Language identification by a byte convolutional network.

Bytes are embedded; filters of several widths slide over fixed-length windows; the maximum of each filter over a window
feeds a softmax. The network is trained in numpy on the driver from a bounded sample of labelled rows and applied to all
windows of every whole text, batch by batch. A document's logits are the means of its windows' log-probabilities, weighted
by their bytes.

Contract: learns from text and non-null lang of rows outside the held-out fold alone; a prediction sees the text alone.
A null text, or one without a letter, is `und` with score 0; if nothing is there to learn from, so is every row. Repeated
rows get equal results; long texts are read in blocks of windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_batches, sampled, spread, table

WINDOW = 256
EMBEDDING, WIDTHS, FILTERS = 8, (2, 3, 4), 16
#: The bound of the training sample: documents of each language, and windows of each of these.
DOCS_PER_LANG, WINDOWS_PER_DOC = 400, 6
UNKNOWN = "und"
_BLOCK = 64
#: A letter of any script, by Unicode category; numerals such as a half or a circled one are none.
_LETTER = regex.compile(r"\p{L}")
_SPAN = max(WIDTHS)
_PLACES = WINDOW - _SPAN + 1


def windows_of(data: bytes) -> np.ndarray:
    """All windows of a text's bytes; the last one is filled up with zero bytes."""
    short = -len(data) % WINDOW
    return np.frombuffer(data + bytes(short), np.uint8).reshape(-1, WINDOW)


class ByteNet:
    """The network's arrays. conv has a column for each filter; rows beyond a filter's width stay zero."""

    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        self.classes = classes
        self.embed = rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
        self.embed[0] = 0
        self.mask = np.zeros((_SPAN * EMBEDDING, n), np.float32)
        for k, width in enumerate(WIDTHS):
            self.mask[: width * EMBEDDING, k * FILTERS : (k + 1) * FILTERS] = 1
        self.conv = (rng.normal(0, 0.3, self.mask.shape) * self.mask).astype(np.float32)
        self.bias = np.zeros(n, np.float32)
        self.out = rng.normal(0, 0.1, (n, len(classes))).astype(np.float32)
        self.out_bias = np.zeros(len(classes), np.float32)

    def _columns(self, windows: np.ndarray) -> np.ndarray:
        rows = np.ascontiguousarray(self.embed[windows])
        size = rows.itemsize
        view = np.lib.stride_tricks.as_strided(rows, (len(windows), _PLACES, _SPAN * EMBEDDING), (WINDOW * EMBEDDING * size, EMBEDDING * size, size))
        return view.reshape(-1, _SPAN * EMBEDDING)

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        sums = (self._columns(windows) @ self.conv).reshape(len(windows), _PLACES, -1)
        return np.maximum(sums.max(axis=1) + self.bias, 0)

    def log_probs(self, windows: np.ndarray) -> np.ndarray:
        made = []
        for at in range(0, len(windows), _BLOCK):
            logits = self.pooled(windows[at : at + _BLOCK]) @ self.out + self.out_bias
            logits -= logits.max(axis=1, keepdims=True)
            made.append(logits - np.log(np.exp(logits).sum(axis=1, keepdims=True)))
        return np.concatenate(made) if made else np.zeros((0, len(self.classes)), np.float32)

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 6, rate: float = 0.01, seed: int = 11) -> ByteNet:
        """Adam on the cross-entropy; gradients flow through the places where each filter peaked."""
        rng = np.random.default_rng(seed)
        names = ("embed", "conv", "bias", "out", "out_bias")
        first = {k: np.zeros_like(getattr(self, k)) for k in names}
        second = {k: np.zeros_like(getattr(self, k)) for k in names}
        step, n = 0, len(self.bias)
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), _BLOCK):
                pick = order[at : at + _BLOCK]
                x, y = windows[pick], labels[pick]
                columns = self._columns(x)
                sums = (columns @ self.conv).reshape(len(x), _PLACES, n)
                peak = sums.argmax(axis=1)
                high = np.take_along_axis(sums, peak[:, None, :], 1)[:, 0] + self.bias
                hidden = np.maximum(high, 0)
                logits = hidden @ self.out + self.out_bias
                logits -= logits.max(axis=1, keepdims=True)
                probs = np.exp(logits)
                probs /= probs.sum(axis=1, keepdims=True)
                probs[np.arange(len(x)), y] -= 1
                probs /= len(x)
                back = (probs @ self.out.T) * (high > 0)
                at_peak = columns.reshape(len(x), _PLACES, -1)[np.arange(len(x))[:, None], peak]
                d_columns = back[:, :, None] * self.conv.T[None]
                d_embed = np.zeros_like(self.embed)
                seen = x[np.arange(len(x))[:, None, None], peak[:, :, None] + np.arange(_SPAN)]
                np.add.at(d_embed, seen.ravel(), d_columns.reshape(-1, EMBEDDING))
                d_embed[0] = 0
                grads = {"embed": d_embed, "conv": np.einsum("bn,bnk->kn", back, at_peak) * self.mask, "bias": back.sum(0), "out": hidden.T @ probs, "out_bias": probs.sum(0)}
                step += 1
                for k in names:
                    first[k] = 0.9 * first[k] + 0.1 * grads[k]
                    second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                    pace = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                    setattr(self, k, (getattr(self, k) - pace * first[k] / (np.sqrt(second[k]) + 1e-7)).astype(np.float32))
        return self

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language and its probability for each text, over all its windows."""
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        pending: list[tuple[int, np.ndarray, int]] = []
        held = 0

        def flush():
            nonlocal held
            if not pending:
                return
            logs = self.log_probs(np.concatenate([w for _, w, _ in pending]))
            at = 0
            for k, own, size in pending:
                weights = np.full(len(own), WINDOW, np.float64)
                weights[-1] = size - WINDOW * (len(own) - 1)
                mean = weights @ logs[at : at + len(own)] / size
                at += len(own)
                probs = np.exp(mean - mean.max())
                best = int(probs.argmax())
                langs[k], scores[k] = self.classes[best], float(probs[best] / probs.sum())
            pending.clear()
            held = 0

        for k, text in enumerate(texts):
            if text and _LETTER.search(text):
                data = text.encode("utf-8", "replace")
                pending.append((k, windows_of(data), len(data)))
                held += len(data)
                if held > 1 << 20:
                    flush()
        flush()
        return langs, scores


def _training_windows(batches):
    for batch in batches:
        out_lang, out_data = [], []
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = windows_of(text.encode("utf-8", "replace"))
            for k in np.unique(np.linspace(0, len(own) - 1, WINDOWS_PER_DOC).astype(int)):
                out_lang.append(lang)
                out_data.append(own[k].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out_lang, pa.string()), pa.array(out_data, pa.binary())], ["lang", "data"])


def train(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> ByteNet | None:
    """Fit on at most docs_per_lang documents of each language, chosen by a hash of doc_id outside the held-out fold."""
    usable = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out())
    rows = map_batches(sampled(usable, ["lang"], docs_per_lang, 21).select("lang", "text"), _training_windows, "lang string, data binary").collect()
    if not rows:
        return None
    rows.sort()
    classes = sorted({r.lang for r in rows})
    windows = np.frombuffer(b"".join(bytes(r.data) for r in rows), np.uint8).reshape(-1, WINDOW)
    return ByteNet(classes).fit(windows, np.array([classes.index(r.lang) for r in rows]))


def identify(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row."""

    def apply(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            langs, scores = net.predict(texts) if net else ([UNKNOWN] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), apply, "doc_id long, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    out = identify(docs, train(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
