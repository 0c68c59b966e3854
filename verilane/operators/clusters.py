"""Clusters of like propositions within a document: groups that chains of pairs at a given Jaccard similarity connect."""

from __future__ import annotations

from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verilane.sources.session import cut

from .components import component_labels
from .similar import set_pairs

#: Token sets of fewer words are no proposition; sets this much alike are one cluster. Fixed values.
LEAST_WORDS, LIKE = 4, "0.6"
#: So many keys of several rows are sent to all tasks; more are joined.
SENT = 100_000


def clusters(propositions: DataFrame, document: str, tokens: str) -> DataFrame:
    """document, node (a proposition's number), root (its cluster's smallest number) for every proposition of LEAST_WORDS different words or more.

    Equal sets of a document are one node with n, how many they are. Pairs come from the similarity join within a document, clusters from components
    over all documents at once, so a long document is no single task.
    """
    own = propositions.select(F.col(document).alias("_d"), F.array_sort(F.array_distinct(tokens)).alias("_t")).where(F.size("_t") >= LEAST_WORDS)
    nodes = cut(own.groupBy("_d", "_t").agg(F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()))
    labels = component_labels(set_pairs(nodes, "node", "_t", LIKE, ["_d"]).select("a", "b"))
    return nodes.join(labels, "node", "left").select(F.col("_d").alias(document), "node", F.coalesce("root", "node").alias("root"), "n")


def largest_clusters(propositions: DataFrame, document: str, tokens: str) -> DataFrame:
    """document, n_clusters and max_cluster, the size of its largest cluster; documents without a proposition have no row."""
    sizes = clusters(propositions, document, tokens).groupBy(document, "root").agg(F.sum("n").alias("size"))
    return sizes.groupBy(document).agg(F.count("*").alias("n_clusters"), F.max("size").alias("max_cluster"))


def cluster_sizes(sets: list[tuple], like: Fraction) -> list[int]:
    """The sizes of the clusters of one document's token sets: prefixes by rare tokens first, and no pair is verified that chains connect already."""
    copies = Counter(sets)
    nodes = sorted(copies, key=len)
    often = Counter(t for s in nodes for t in s)
    root, whole, lists = list(range(len(nodes))), list(map(frozenset, nodes)), {}

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    for k, own in enumerate(nodes):
        n, tried = len(own), set()
        for t in sorted(own, key=lambda t: (often[t], t))[: n - -(-like.numerator * n // like.denominator) + 1]:
            if often[t] == 1:
                continue
            met = lists.setdefault(t, [])
            for o in met:
                m = len(nodes[o])
                if m * like.denominator < n * like.numerator or o in tried or top(o) == top(k):
                    continue
                tried.add(o)
                shared = len(whole[k] & whole[o])
                if shared * like.denominator >= (n + m - shared) * like.numerator:
                    root[top(o)] = top(k)
            met.append(k)
    sizes = Counter()
    for k, own in enumerate(nodes):
        sizes[top(k)] += copies[own]
    return list(sizes.values())


def _largest_in_rows(batches):
    like = Fraction(LIKE)
    for batch in batches:
        lines = batch.column(1).flatten()
        codes = lines.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).tolist()
        ends = np.cumsum([0, *lines.value_lengths().to_pylist()]).tolist()
        sets = [tuple(sorted(codes[a:b])) for a, b in zip(ends, ends[1:], strict=False)]
        own = np.cumsum([0, *batch.column(1).value_lengths().to_pylist()]).tolist()
        sizes = [cluster_sizes(sets[a:b], like) for a, b in zip(own, own[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sizes), pa.int64()), pa.array(map(max, sizes), pa.int64())], [batch.schema.names[0], "n_clusters", "max_cluster"])


def largest_clusters_of_rows(documents: DataFrame, document: str, lines: Column, large: Column) -> DataFrame:
    """What largest_clusters gives for documents whose propositions are arrays of tokens, lines, of one row.

    A document in one row needs no shuffle: it is clustered where it lies. Those in several rows, those that large is true of and those of a null key go
    through largest_clusters.
    """
    tokens = F.filter(F.transform(lines, F.array_distinct), lambda t: F.size(t) >= LEAST_WORDS)
    own = documents.select(document, F.coalesce(large, F.lit(False)).alias("_large"), tokens.alias("_l"))
    several = cut(documents.groupBy(document).agg(F.count("*").alias("_n")).where((F.col("_n") > 1) | F.col(document).isNull()).select(F.col(document).alias("_several")))
    n, same = several.count(), F.col(document).eqNullSafe(F.col("_several"))
    several = F.broadcast(several) if n <= SENT else several
    alone = own.join(several, same, "left_anti") if n else own
    rest = alone.where("_large")
    rest = cut((rest.unionByName(own.join(several, same, "left_semi")) if n else rest).where(F.size("_l") > 0))
    conf = documents.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    key = f"{document} {dict(documents.dtypes)[document]}"
    found = alone.where("not _large").where(F.size("_l") > 0).select(document, "_l").mapInArrow(_largest_in_rows, f"{key}, n_clusters long, max_cluster long")
    if rest.isEmpty():
        return found
    return found.unionByName(largest_clusters(rest.select(document, F.explode("_l").alias("_t")), document, "_t"))
