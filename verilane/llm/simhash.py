"""SimHash near-duplicates, joined by fuzzy Golay keys.

Contract. A text's bytes A-Z are lower-cased; words are runs of bytes outside 0x20 and 0x09-0x0D; shingles are three
consecutive words joined by a space, repeats included (fewer words: the whole sequence; none, an empty or a null
text: fingerprint zero, linked like any other). A fingerprint bit is 1 if it is set in over half of the shingles'
XXH64 (seed 42). Fingerprints at two or fewer differing bits are linked; a component is what links reach.

Candidates. The fingerprint is cut into three segments. Two errors leave one segment whole (pigeonhole); the
other two segments together hold at most two errors, so a word in the middle exists that differs from either side by at
most one bit. A key is the whole segment with the Golay indices of the two others for such a middle word: at most
1 + 5 + 5 keys for each choice of the whole segment. Fingerprints that share a key are joined and verified.

Scale. Exact copies collapse to one fingerprint before any key is made. A key that over HOT fingerprints share
would give pairs in the square of its size; those fingerprints, all of them, are linked through the middle words
themselves (65 per fingerprint, each naming the smallest fingerprint in its unit ball), which finds the same links in linear size.
Repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import golay
from .common import checkpointed, map_batches
from .components import component_labels

BITS, DISTANCE, SHINGLE, SEED = 64, 2, 3, 42
#: First bit and width of each segment.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Fingerprints that share a key beyond this many are linked through middle words.
HOT = 32
_CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of one text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles, total = iter([b" ".join(words)]), 1
    else:
        shingles, total = map(b" ".join, zip(words, words[1:], words[2:], strict=False)), len(words) - SHINGLE + 1
    return majority(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), total)


def majority(hashes, total: int | None = None) -> int:
    """The bits that over half of the hashes have; hashes is an array or an iterator of so many."""
    total, hashes = len(hashes) if total is None else total, iter(hashes) if total is not None else hashes
    counts = np.zeros(BITS, np.int64)
    for start in range(0, total, _CHUNK):
        block = hashes[start : start + _CHUNK].astype("<u8") if isinstance(hashes, np.ndarray) else np.fromiter(hashes, "<u8", min(_CHUNK, total - start))
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for batch in batches:
        values = np.array([fingerprint(x.as_py()) for x in batch.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(values, pa.int64())], ["doc_id", "fp"])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""
    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), _fingerprints, "doc_id long, fp long")


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in fps and their keys, each pair once. fps are unsigned."""
    parts = [(fps >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    balls = [golay.ball_indices(part, width) for part, (_, width) in zip(parts, SEGMENTS, strict=True)]
    owners, keys = [], []
    for whole in range(3):
        a, b = (k for k in range(3) if k != whole)
        n_a, n_b = balls[a].shape[1], balls[b].shape[1] - 1
        left = np.concatenate([balls[a], np.repeat(balls[a][:, :1], n_b, axis=1)], axis=1)
        right = np.concatenate([np.repeat(balls[b][:, :1], n_a, axis=1), balls[b][:, 1:]], axis=1)
        made = parts[whole][:, None] << 24 | left << 12 | right | whole << 46
        made.sort(axis=1)
        fresh = np.ones(made.shape, bool)
        fresh[:, 1:] = made[:, 1:] != made[:, :-1]
        rows, _ = np.nonzero(fresh)
        owners.append(rows)
        keys.append(made[fresh])
    return np.concatenate(owners), np.concatenate(keys)


def _keyed(batches):
    for batch in batches:
        fps = np.asarray(batch.column(0).to_numpy(zero_copy_only=False))
        owners, keys = fuzzy_keys(fps.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(fps[owners], pa.int64())], ["key", "fp"])


def _shared_keys(distinct: DataFrame) -> DataFrame:
    """key, fp and n, how many fingerprints share the key, of all keys that several share."""
    # counts come from an aggregation, so that a crowded key isn't gathered in one task; its rows are split by the skew join. Spark takes the keys
    # for as few as the fingerprints, of which each has 33: without the hint it would send all of them through the driver as a small table
    keyed = map_batches(distinct.select("fp"), _keyed, "key long, fp long")
    return keyed.hint("merge").join(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")


def links(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """Pairs (a, b) of different fingerprints whose links connect all that the definition connects. distinct: one column fp."""
    busy = checkpointed(_shared_keys(distinct))
    mild = busy.where(F.col("n") <= hot)
    pairs = mild.select("key", F.col("fp").alias("a")).join(mild.select("key", F.col("fp").alias("b")), "key").where("a < b")
    near = pairs.select("a", "b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)
    crowd = busy.where(F.col("n") > hot).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(BITS)])
    ball = crowd.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"))
    centre = ball.groupBy("middle").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("middle", "a")
    linked = ball.hint("merge").join(centre, "middle").where("fp <> a").select("a", F.col("fp").alias("b"))
    return near.unionByName(linked).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id (the smallest id that links reach) of every row of docs."""
    marked = checkpointed(with_fingerprints(docs, id_col, text_col))
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    labels = component_labels(links(classes.select("fp")))
    rooted = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = checkpointed(rooted)
    merged = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = rooted.join(merged, "root").select("fp", "component_id")
    return marked.join(found, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component: the smallest id's, a null id after all others.

    An id leaves as one row: of its texts that come first in their components the one with the smallest digest, and of rows that
    differ in other columns only the first in their order. Rows with a null id are different documents unless linked.
    """
    marked = docs.withColumns({"_h": F.md5(F.coalesce("text", F.lit(""))), "_none": F.col("doc_id").isNull(), "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0))})
    key = ["_h", "_none", "_id"]
    # a text stands under a number of its own, so that ids that are null or repeated name one text each
    texts = checkpointed(marked.groupBy(*key).agg(F.any_value("text").alias("text")).withColumn("_row", F.monotonically_increasing_id()))
    found = near_duplicates(texts, "_row").withColumnRenamed("doc_id", "_row").select("_row", "component_id")
    ranked = texts.join(found, "_row").groupBy("component_id").agg(F.min(F.struct("_none", "_id", "_h")).alias("k")).select("k.*")
    kept = ranked.groupBy("_none", "_id", F.when(F.col("_none"), F.col("_h"))).agg(F.min("_h").alias("_h")).select(*key)
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*[c for c in docs.columns if c not in ("doc_id", "text")], "text"))
    rows = marked.join(kept, key, "left_semi").withColumn("_rank", rank)
    return rows.where("_rank = 1").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    from .common import spread, table

    out = near_duplicates(spread(table(spark, sf_dir, "documents")))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
