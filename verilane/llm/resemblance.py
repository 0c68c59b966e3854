"""Near copies for the pipeline: SimHash and Golay keys first, and then, exactly, what they can't reach.

Contract. Words are as in simhash: bytes A-Z lower-cased, runs of bytes outside 0x20 and 0x09-0x0D. A shingle is five
consecutive words (fewer words: the whole sequence; none: no shingle, and texts without one resemble each other). Texts whose sets of shingles have a
Jaccard similarity of SIMILARITY or more are linked; a component is what links reach. Every link is verified on the whole sets of 64-bit hashes.

Candidates. simhash.links joins the fingerprints of the five-word shingles through fuzzy Golay keys, as the operator of that name does. A pair at
0.8 differs in some ten of 64 bits, far outside what Golay keys join, so the exact similarity join of operators.similar takes their links as known and
finds the rest: texts that are alike share a shingle of their prefixes, whatever the size of the crowd that shares it, so no link is lost.

Rows. Of each component the row of the smallest id stays, null after all others. An id leaves as one row: of several texts that its id makes first in their
components the smallest digest, and of rows alike in id and text only one, the first in the order of the other columns, then of a digest of the row. Texts of null ids are different documents. Columns of any
name and type are carried along; null counts as an empty text; an empty table stays empty.
"""

from __future__ import annotations

import string
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verilane.operators.similar import TextSets, digest

from . import simhash
from .common import checkpointed, map_batches

SHINGLE, SIMILARITY, SEED = 5, "0.8", 42


def folded(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def shingle_hashes(text: bytes) -> np.ndarray:
    """The hashes of a folded text's shingles, repeats included."""
    words = text.split()
    if len(words) < SHINGLE:
        runs = [b" ".join(words)] if words else []
    else:
        runs = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64)


def _fingerprints(batches):
    for batch in batches:
        own = {t: k for k, t in enumerate(batch.column(0).to_pylist())}  # copies within a batch are read once
        fps = [simhash.majority(shingle_hashes(batch.column(1)[k].as_py())) for k in own.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())], ["t", "fp"])


def _golay_links(docs: DataFrame, text: str, sets: DataFrame) -> DataFrame:
    """Pairs of numbers of texts whose fingerprints are linked or equal; a fingerprint stands for its texts by the smallest number."""
    marked = map_batches(docs.select(digest(F.col(text)).alias("t"), folded(F.col(text)).cast("binary").alias("text")), _fingerprints, "t binary, fp long")
    own = checkpointed(sets.where("n > 0").select("s", "t").join(marked.groupBy("t").agg(F.min("fp").alias("fp")), "t").select("s", "fp"))
    first = own.groupBy("fp").agg(F.min("s").alias("c"), F.count("*").alias("k"))
    ends = first.select(F.col("fp").alias("a"), F.col("c").alias("ca")), first.select(F.col("fp").alias("b"), F.col("c").alias("cb"))
    linked = simhash.links(own.select("fp").distinct()).join(ends[0], "a").join(ends[1], "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    same = own.join(first.where("k > 1"), "fp").where("s <> c").select(F.col("c").alias("a"), F.col("s").alias("b"))
    return linked.unionByName(same)


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """t, the digest of each different text, and root, what all texts of its component have in common."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sets = TextSets(own, "text", "id", SHINGLE, SIMILARITY, folded(F.col("text")))
    roots = sets.groups(_golay_links(own, "text", sets.sets))
    # texts without a shingle are one component
    return roots.join(sets.sets.select("t", "n"), "t").select("t", F.when(F.col("n") > 0, F.col("root")).otherwise(F.lit(b"")).alias("root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, with all its columns."""
    names = [f"_c{k}" for k in range(len(docs.columns))]  # so that no column of docs meets one of ours
    key, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    rows = docs.toDF(*names).withColumns({"t": digest(text), "none": key.isNull(), "id": F.coalesce(key.cast("long"), F.lit(0))})
    first = rows.groupBy("t").agg(F.min(F.when(~F.col("none"), F.col("id"))).alias("m"))
    first = first.select("t", F.col("m").isNull().alias("none"), F.coalesce("m", F.lit(0)).alias("id"))
    kept = components(docs.select("doc_id", "text")).join(first, "t").groupBy("root").agg(F.min(F.struct("none", "id", "t")).alias("k")).select("k.*")
    kept = kept.groupBy("none", "id", F.when(F.col("none"), F.col("t"))).agg(F.min("t").alias("t")).select("t", "none", "id")
    # columns of types without an order count by a digest of the row alone
    ordered = [n for n, f in zip(names, docs.schema.fields, strict=True) if not any(kind in f.dataType.simpleString() for kind in ("map<", "variant", "interval"))]
    rank = F.row_number().over(Window.partitionBy("t", "none", "id").orderBy(*ordered, F.md5(F.struct(*names).cast("string"))))
    return rows.join(kept, ["t", "none", "id"], "left_semi").withColumn("rank", rank).where("rank = 1").select(*names).toDF(*docs.columns)
