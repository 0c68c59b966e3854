"""Compact codes of vectors: product quantisation with integer codebooks, entries found by a vector-approximation filter.

Contract. Rows whose vector is null, empty or holds null or non-finite components are dropped. Each component x becomes the integer floor(FACTOR x). A vector is
cut into PARTS equal consecutive parts. A part position's codebook begins as that part of the ENTRIES vectors of the smallest ids; each of ROUNDS rounds
assigns every part to its codebook's nearest entry (squared Euclidean distance, ties to the lower index) and replaces each entry by the floor of its parts'
mean; an entry without parts stays. Then the parts are assigned once more: the code is the entries' indices, the error the sum of the squared distances.

Method (VA-file). An entry's coordinates are quantised to BITS bits each: within every coordinate the range of the codebook is cut into cells. For a vector's
part one table for each coordinate holds the least and the greatest squared distance to each cell. Their sums over an entry's cells bound its distance from
both sides, and only entries whose lower bound doesn't exceed the least upper bound are refined by their integer distances.

Scale. The table is scanned once for the first codebook (a top-k), once a round and once at the end; nothing but sums is shuffled: each task returns for every entry
it met the sums and counts of its parts. Codebooks have ENTRIES vectors whatever the table's size; they go to the driver and, inside the closure, to the
tasks. The errors of equal labels are summed by aggregation and joined back, so a hot label is split as a skewed join is.

Integers: while all components are below SMALL in size, 64-bit arithmetic is exact; beyond that, the same code runs on integers of any size. An error beyond a long's range
is given as the greatest long. Sums travel in limbs of 32 bits, so no sum overflows.

Nulls, ties and odd rows: a null id is after all others; rows of one id stand by their vectors; a repeated row counts as often as it occurs. With fewer rows than ENTRIES
the codebooks are smaller. All vectors have the number of components of the first one by id; rows of another number take no part. If PARTS doesn't
divide it, zeros are added at the end. Null labels are equal to each other. Other columns aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_batches, table

FACTOR, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Bits of an entry's coordinate in the approximation.
BITS = 3
#: Components below this in size have differences whose squares, up to 2^16 of them together, fit 64 bits.
SMALL = 1 << 22
_LONG, _LIMB = (1 << 63) - 1, 32
#: Rows whose bounds are worked out at once.
_CHUNK = 1024


def integers(values: np.ndarray) -> np.ndarray:
    """floor(FACTOR x) of finite doubles, as 64-bit integers if all are small, else as integers of any size."""
    with np.errstate(over="ignore"):
        scaled = np.floor(FACTOR * values)
    if not scaled.size or np.abs(scaled).max() < SMALL:
        return scaled.astype(np.int64)
    # a double of 2^53 or more is an integer itself
    exact = [int(s) if abs(x) < 2.0**53 else FACTOR * int(x) for s, x in zip(scaled.flat, values.flat, strict=True)]
    return np.array(exact, object).reshape(values.shape)


def in_parts(rows: np.ndarray, parts: int) -> np.ndarray:
    """Rows cut into parts: rows x parts x width."""
    width = -(-rows.shape[1] // parts)
    full = np.zeros((len(rows), parts * width), rows.dtype)
    full[:, : rows.shape[1]] = rows
    return full.reshape(len(rows), parts, width)


class Approximation:
    """One part position's codebook with its entries' cells."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries
        low, high = entries.min(axis=0), entries.max(axis=0)
        # cells of equal whole width in each coordinate: cell c is from edge c to edge c + 1, without it
        width = (high - low) // (1 << bits) + 1
        self.low = low[None] + width[None] * np.arange(1 << bits).astype(entries.dtype)[:, None]
        self.high = self.low + width[None] - 1
        self.cells = ((entries - low) // width).astype(np.int64)

    def bounds(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest squared distance of each point to the cells of each entry."""
        under, over = self.low[None] - points[:, None], points[:, None] - self.high[None]  # points x cells x coordinates
        near = np.maximum(np.maximum(under, over), 0) ** 2
        far = np.maximum(np.abs(under), np.abs(over)) ** 2
        axes = range(points.shape[1])
        return sum(near[:, self.cells[:, j], j] for j in axes), sum(far[:, self.cells[:, j], j] for j in axes)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and squared distance of each point's nearest entry, and how many distances were worked out."""
        least, most = self.bounds(points)
        rows, found = np.nonzero(least <= most.min(axis=1)[:, None])  # by row, then by entry; every row has one
        distances = ((points[rows] - self.entries[found]) ** 2).sum(axis=1)
        starts = np.searchsorted(rows, np.arange(len(points)))
        best = np.minimum.reduceat(distances, starts)
        hits = np.flatnonzero(distances == best[rows])
        first = hits[np.searchsorted(rows[hits], np.arange(len(points)))]
        return found[first], best, len(rows)


class Quantiser:
    """All codebooks: parts x entries x width."""

    def __init__(self, books: np.ndarray):
        small = all(abs(int(x)) < SMALL for x in books.flat)
        self.books = books.astype(np.int64 if small else object)
        # without entries there is nothing to search
        self.wide = [Approximation(b.astype(object)) for b in books] if books.shape[1] else []
        self.narrow = [Approximation(b) for b in self.books] if small and books.shape[1] else None

    def assign(self, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices and squared distances, rows x parts."""
        searchers = self.narrow if self.narrow and cut.dtype != object else self.wide
        if searchers is self.wide:
            cut = cut.astype(object)
        indices, distances = np.zeros(cut.shape[:2], np.int64), np.zeros(cut.shape[:2], cut.dtype)
        for at in range(0, len(cut), _CHUNK):
            for p, searcher in enumerate(searchers):
                own = slice(at, at + _CHUNK)
                indices[own, p], distances[own, p], _ = searcher.nearest(cut[own, p])
        return indices, distances


def _vectors(batch, size: int) -> np.ndarray:
    """The integer vectors of a batch whose last column holds lists of size doubles."""
    return integers(batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size))


def _fit(rows: DataFrame, seeds: np.ndarray, size: int, parts: int, rounds: int) -> np.ndarray:
    """The final codebooks. seeds: the integer vectors of the first ids; rows: a column of vectors of that size."""
    books = in_parts(seeds, parts).swapaxes(0, 1)
    width, count = books.shape[2], books.shape[1]
    for _ in range(rounds):
        quantiser = Quantiser(books)

        def sums(batches, quantiser=quantiser):
            totals, counts = np.zeros((parts, count, width), object), np.zeros((parts, count), np.int64)
            for batch in batches:
                cut = in_parts(_vectors(batch, size), parts)
                indices, _ = quantiser.assign(cut)
                for p in range(parts):
                    own = np.zeros((count, width), cut.dtype)
                    np.add.at(own, indices[:, p], cut[:, p])
                    totals[p] += own.astype(object)
                    counts[p] += np.bincount(indices[:, p], minlength=count)
            out = []
            for p, e in zip(*np.nonzero(counts), strict=True):
                out.append((p, e, -1, 0, int(counts[p, e])))
                for j, total in enumerate(totals[p, e]):
                    sign, left, limb = (1 if total >= 0 else -1), abs(int(total)), 0
                    while left:
                        out.append((p, e, j, limb, sign * (left & (1 << _LIMB) - 1)))
                        left, limb = left >> _LIMB, limb + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["part", "entry", "pos", "limb", "value"])

        made = map_batches(rows, sums, "part long, entry long, pos long, limb long, value long")
        # at most parts x entries x components of sums, whatever the table's size
        found = made.groupBy("part", "entry", "pos", "limb").agg(F.sum("value").alias("value")).collect()
        totals, counts = np.zeros((parts, count, width), object), np.zeros((parts, count), object)
        for r in found:
            if r.pos < 0:
                counts[r.part, r.entry] = r.value
            else:
                totals[r.part, r.entry, r.pos] += r.value << _LIMB * r.limb
        books = books.astype(object)
        for p, e in zip(*np.nonzero(counts), strict=True):
            books[p, e] = totals[p, e] // counts[p, e]
    return books


def encode(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None]:
    """vec_id, label, code (two hexadecimal digits a part) and error of every kept row, and the codebooks (parts x entries x width; None without rows)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits a part")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    own = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    own = own.where((F.size("v") > 0) & ~F.exists("v", odd))
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    head = own.orderBy(*order).select("v").first()
    if head is None:
        return own.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), None
    size = len(head.v)
    own = own.where(F.size("v") == size)
    seeds = integers(np.array([r.v for r in own.orderBy(*order).limit(entries).select("v").collect()], np.float64))
    books = _fit(own.select("v"), seeds, size, parts, rounds)
    quantiser = Quantiser(books)

    def coded(batches):
        for batch in batches:
            indices, distances = quantiser.assign(in_parts(_vectors(batch, size), parts))
            codes = [bytes(row).hex() for row in indices.astype(np.uint8)]
            errors = [min(int(x), _LONG) for x in distances.sum(axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    kinds = dict(own.dtypes)
    return map_batches(own, coded, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """label_error is the sum of the errors of rows with an equal label; coded is read twice."""
    sums = coded.groupBy(F.col("label").alias("same")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("same")))
    return joined.withColumn("label_error", F.least("total", F.lit(_LONG)).cast("long")).drop("same", "total")


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(str(int(x)) for x in books.flat).encode()).hexdigest()


def query(spark, sf_dir: str) -> DataFrame:
    coded, books = encode(table(spark, sf_dir, "embeddings"))
    out = with_label_errors(checkpointed(coded))
    digest = "" if books is None else codebooks_digest(books)
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _assigned(book: str) -> str:
    """SQL: entry and distance of every row's part. One row for each part and entry is compared, without a filter."""
    return f"""SELECT r, p, arg_min(e, d * {ENTRIES} + e) AS e, min(d) AS d FROM (
      SELECT v.r, v.p, b.e, CAST(list_sum(list_transform(list_zip(v.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM cut v JOIN {book} b USING (p)) GROUP BY r, p"""


def _moved(book: str, near: str) -> str:
    """SQL: the codebook after a round."""
    return f"""SELECT b.p, b.e, coalesce(t.v, b.v) AS v FROM {book} b LEFT JOIN (
      SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS v FROM (
        SELECT p, e, j, sum(x) AS s, count(*) AS n FROM (SELECT a.p, a.e, unnest(c.v) AS x, generate_subscripts(c.v, 1) AS j FROM {near} a JOIN cut c USING (r, p)) GROUP BY p, e, j) GROUP BY p, e) t USING (p, e)"""


#: The same by plain comparison of every part with every entry.
ORACLE_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({FACTOR} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cut AS (
  SELECT r, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS v FROM kept, range({PARTS}) t(p)
), b0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM cut WHERE r <= {ENTRIES}
), a0 AS MATERIALIZED ({_assigned("b0")}), b1 AS MATERIALIZED ({_moved("b0", "a0")}
), a1 AS MATERIALIZED ({_assigned("b1")}), b2 AS MATERIALIZED ({_moved("b1", "a1")}
), a2 AS MATERIALIZED ({_assigned("b2")}), coded AS (
  SELECT r, string_agg(lower(lpad(to_hex(e), 2, '0')), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY r
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256 FROM kept JOIN coded USING (r)
"""
