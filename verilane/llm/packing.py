"""Harmonic packing of token ids into sequences of a fixed capacity.

What a document holds beyond whole sequences is its rest, and rests are partitioned into reciprocal-capacity classes: class k holds
lengths above capacity / (k + 1) and up to capacity / k, and a bin of class k takes exactly k of them. What such a bin lacks, less than
one rest of its class, is filled with the beginning of the next rest that comes; only what is left of that rest is classified. So there is
at most one cut for each bin, every full bin is a sequence without padding, and no bin waits for more than one document. Rests of
capacity / CLASSES and less share the last class, whose bins are filled in order. Each worker fills its bins by itself. Bins still
open when a worker ends are emptied into shared sequences, longest piece first: whole ones, and for what remains one for each
binary digit of its length, so that these need no padding either.

Contract: a null text is empty, a document's ids are those of its text and then END. Each id lies in exactly one piece. Repeated
rows, and rows with a null id, are packed each by themselves. What a worker holds beyond a batch is less than one sequence's ids in each of CLASSES
classes. A lost task is run again on the same rows in the same order and gives the same pieces.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenizers import Tokenizer

from .bpe import LATIN, Encoder, default_vocabulary, encoder_pieces
from .common import map_batches, spread, table

CAPACITY, END = 2048, 1
#: Reciprocal classes; the last one holds all shorter rests.
CLASSES = 32
#: The most runs of text, and the most of their pieces, whose ids a worker remembers; about 0.4 kB each. Fewer cost time, not results.
REMEMBERED = 600_000
#: White space of Unicode beyond ASCII, as the tokenizer's pattern sees it.
_WIDE_SPACE = "[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_MARKS = frozenset(".,;:!?")
#: Pieces that the library gets as one text, and such texts at a time.
_GROUP = 512
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_TYPES = pa.schema([(f.split()[0], pa.int64()) for f in SCHEMA.split(", ")])


def piece_lengths(total: int, capacity: int = CAPACITY) -> list[int]:
    """The lengths of the sequences that total ids fill without padding."""
    return [capacity] * (total // capacity) + [capacity >> k for k in range(1, capacity.bit_length()) if total % capacity & capacity >> k]


class Bins:
    """One worker's open bins; each piece is (doc_id, start, ids as bytes, doc_tokens)."""

    def __init__(self, worker: int, capacity: int = CAPACITY, classes: int = CLASSES):
        if capacity & capacity - 1:
            raise ValueError("the capacity must be a power of two")
        self.capacity, self.classes, self.next_id = capacity, classes, worker << 36
        self.open: list[list[tuple]] = [[] for _ in range(classes + 1)]
        self.filled = [0] * (classes + 1)
        #: The class whose bin has all its rests and waits for a filler; 0 if there is none.
        self.waiting = 0
        self.done: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for key, start, ids, tokens in pieces:
            n = len(ids) // 4
            self.done.append((key, start, n, zlib.crc32(ids), tokens, self.next_id, at))
            at += n
        self.next_id += 1

    def add(self, key: int | None, ids: bytes) -> None:
        """All ids of one document, as little-endian 32-bit bytes."""
        tokens, start, width = len(ids) // 4, 0, 4 * self.capacity
        while tokens - start >= self.capacity:
            self._close([(key, start, ids[4 * start : 4 * start + width], tokens)])
            start += self.capacity
        while start < tokens:
            k = self.waiting or min(self.classes, self.capacity // (tokens - start))
            size = min(tokens - start, self.capacity - self.filled[k])
            own = self.open[k]
            own.append((key, start, ids[4 * start : 4 * (start + size)], tokens))
            start += size
            self.filled[k] += size
            if self.filled[k] == self.capacity:
                self._close(own)
                self.open[k], self.filled[k], self.waiting = [], 0, 0
            elif len(own) == k < self.classes:
                self.waiting = k

    def finish(self) -> None:
        """Empty the open bins: longest piece first into whole sequences, the rest into lengths that are powers of two."""
        left = sorted((p for own in self.open for p in own), key=lambda p: -len(p[2]))
        self.open, self.filled, self.waiting = [[] for _ in self.open], [0] * len(self.filled), 0
        lengths = piece_lengths(sum(len(p[2]) for p in left) // 4, self.capacity)[::-1]
        own, room = [], lengths[-1] if lengths else 0
        for key, start, ids, tokens in left:
            while ids:
                part, ids = ids[: 4 * room], ids[4 * room :]
                own.append((key, start, part, tokens))
                start += len(part) // 4
                room -= len(part) // 4
                if not room:
                    self._close(own)
                    lengths.pop()
                    own, room = [], lengths[-1] if lengths else 0

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.done, strict=True)) if self.done else [[]] * len(_TYPES)
        self.done = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_TYPES)


class RunIds:
    """The ids of whole texts by the tokenizers library, batch by batch.

    White space splits a batch's texts into runs, of which each different one is looked up once; ids are then gathered by arrays. Runs that
    aren't remembered fall into pieces, and the pieces that aren't go to the library as one text, whose ids fall apart again at the ends of
    words. This second instance of the library has no normaliser and no pattern of its own, since both have been applied. Runs beyond plain
    Latin go to the first one as they are.
    """

    def __init__(self, path: str, bound: int = REMEMBERED):
        self.library, self.split, self.bound = Tokenizer.from_file(path), encoder_pieces(path), bound
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.words = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
        for one in (self.library, self.words):
            one.no_truncation()
            one.no_padding()
        names = self.library.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(self.library.get_vocab_size() + 1, bool)
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.byte_names = Encoder.byte_names()
        self.runs: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {}

    def _cut(self, run: str) -> list[str] | None:
        """The pieces of a run; words, with or without a mark behind them, need no pattern."""
        if not run.isascii():
            if max(run) > LATIN:
                return None
            run = unicodedata.normalize("NFC", run)
        low = run.lower()
        if low.isalpha():
            return [low]
        if low[-1] in _MARKS and low[:-1].isalpha():
            return [low[:-1], low[-1]]
        return self.split(run)

    def _byte_level(self, piece: str) -> str:
        return piece if piece.isascii() and piece.isprintable() else piece.encode("utf-8").decode("latin-1").translate(self.byte_names)

    def _learn(self, wanted: list[str]) -> list[bytes]:
        cut = list(map(self._cut, wanted))
        known = self.pieces
        fresh = list({p for own in cut if own is not None for p in own if p not in known})
        new: dict[str, bytes] = {}
        for at in range(0, len(fresh), 8 * _GROUP):
            groups = [fresh[k : k + _GROUP] for k in range(at, min(at + 8 * _GROUP, len(fresh)), _GROUP)]
            found = self.words.encode_batch_fast([" ".join(map(self._byte_level, g)) for g in groups], add_special_tokens=False)
            for group, own in zip(groups, found, strict=True):
                ids = np.array(own.ids, "<u4")
                ends = 4 * (np.flatnonzero(self.ends[ids]) + 1)
                if len(ends) != len(group):
                    raise ValueError("the library cut a piece, or the vocabulary lacks a byte")
                data, start = ids.tobytes(), 0
                for piece, end in zip(group, ends.tolist(), strict=True):
                    new[piece] = data[start:end]
                    start = end
        known.update(islice(new.items(), max(0, self.bound - len(known))))
        out = []
        for run, own in zip(wanted, cut, strict=True):
            if own is None:
                out.append(np.array(self.library.encode(run, add_special_tokens=False).ids, "<u4").tobytes())
            else:
                out.append(b"".join([known.get(p) or new[p] for p in own]))
        # the frequent runs come early and stay; a batch's runs are taken up to the bound, not all of them
        self.runs.update(islice(zip(wanted, out, strict=True), max(0, self.bound - len(self.runs))))
        return out

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a batch, END after each, and where each text's ids begin, with the end of the last one."""
        plain = pc.replace_substring_regex(texts.fill_null(""), pattern=_WIDE_SPACE, replacement=" ")
        lists = pc.ascii_split_whitespace(plain)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.runs.get, words))
        gaps = [k for k, x in enumerate(found) if x is None]
        for k, ids in zip(gaps, self._learn([words[k] for k in gaps]), strict=True):
            found[k] = ids
        found.append(np.array([END], "<u4").tobytes())
        pool = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begins = np.cumsum(sizes) - sizes
        ends = np.asarray(lists.offsets, np.int64)[1:]
        index = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), ends, len(words))
        own = sizes[index]
        after = np.cumsum(own)
        ids = pool[np.repeat(begins[index] - (after - own), own) + np.arange(after[-1] if len(after) else 0)]
        return ids, np.concatenate([[0], after[ends + np.arange(len(ends))]])


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """The pieces of all rows of docs, with their places."""
    path = path or default_vocabulary()

    def apply(batches):
        known, bins = run_ids(path, remembered), Bins(TaskContext.get().partitionId(), capacity)
        for batch in batches:
            ids, bounds = known.of(batch.column(1).cast(pa.string()))
            data, bounds = ids.tobytes(), (4 * bounds).tolist()
            for key, start, end in zip(batch.column(0).to_pylist(), bounds, bounds[1:], strict=False):
                bins.add(key, data[start:end])
                if len(bins.done) > 20_000:
                    yield bins.take()
            yield bins.take()
        bins.finish()
        yield bins.take()

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), apply, SCHEMA)


@cache
def run_ids(path: str, remembered: int) -> RunIds:
    """One for each worker process."""
    return RunIds(path, remembered)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spread(table(spark, sf_dir, "documents")))
