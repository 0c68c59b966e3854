"""Exact top-k by inner product with KD-trees over shards.

Vectors are turned into integers floor(256 x). A few median splits of a bounded sample give every vector a cell; rows are ordered by
cell and cut into shards of bounded size, whatever a cell holds. Each shard gets a tree by median splits of the widest dimension, with a tight box
around every node, once, and is written as one row. The inner product of a query with any vector of a box is at most the sum of the
better of the two bounds in every dimension. A query walks a shard's tree best box first and ends when the best box left is under its kth score,
which goes on from shard to shard within a task, and from round to round between tasks.

Scale. Queries grow with the table, so they are handled in blocks of at most BLOCK_BYTES, one after another: the driver and each executor
hold one block at a time. A block meets the shards in rounds of 1/256, 1/16 and the rest of them; after each round
the kth scores are merged, so that in the next one a task returns only rows that still beat them. Candidates are shuffled once, to be
sharded. The sample only shapes the cells: it decides how much is pruned, never what is found.

Contract: queries are the rows whose id is divisible by QUERY_EVERY, against all rows of other ids and the same number of components. Ties go
to the smaller id. Vectors that are null or empty or hold null, NaN or infinite components (or ones whose 256-fold is infinite), and rows without an id,
take no part. Every row counts by itself: a repeated candidate is returned as often as it occurs, and a repeated query gets each candidate once for each of its
rows. Scores are exact integers; one beyond a long's range is taken for the nearest long. With fewer than k candidates all are returned. An empty table
gives an empty result.
"""

from __future__ import annotations

import heapq
import pickle
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, map_batches, shared_folder, table

K, QUERY_EVERY, FACTOR = 5, 50, 256.0
#: Bytes of a shard's vectors, rows of a leaf, and bytes of the query vectors of a block.
SHARD_BYTES, LEAF_ROWS, BLOCK_BYTES = 4 << 20, 64, 32 << 20
#: Rows of the sample that shapes the cells, and the most levels of splits.
SAMPLE_ROWS, LEVELS = 20_000, 8
#: A shard is in round r with the odds of one in this; below FEW shards there is one round.
ROUNDS, FEW = (256, 16, 1), 64
_EXACT, _LONG = 1 << 53, (1 << 63) - 1


def integers(ids: pa.Array, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By number of components: the ids and the integer vectors of the rows that take part."""
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    sizes = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0))
    known = np.asarray(pc.is_valid(ids)) & np.asarray(pc.is_valid(vectors))
    for size in set(sizes[known & (sizes > 0)].tolist()):
        pick = np.flatnonzero(known & (sizes == size))
        flat = vectors.take(pa.array(pick)).flatten()
        x = np.asarray(flat.cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64).reshape(len(pick), size)  # null becomes NaN
        with np.errstate(over="ignore", invalid="ignore"):
            ints = np.floor(FACTOR * x)
        fine = np.isfinite(ints).all(axis=1)
        out[size] = (np.asarray(ids.take(pa.array(pick[fine]))).astype(np.int64), ints[fine])
    return out


class Tree:
    """A KD-tree in arrays: node k has the rows start[k]:end[k] of order, and child[k], child[k] + 1 or no child (-1)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF_ROWS):
        order = np.arange(len(rows))
        self.start, self.end, self.child = [0], [len(rows)], [-1]
        low, high = [rows.min(axis=0)], [rows.max(axis=0)]
        k = 0
        while k < len(self.start):
            a, b = self.start[k], self.end[k]
            spread = high[k] - low[k]
            if b - a > leaf and spread.max() > 0:
                own, axis, half = order[a:b], int(spread.argmax()), (b - a) // 2
                order[a:b] = own[np.argpartition(rows[own, axis], half)]
                self.child[k] = len(self.start)
                for x, y in ((a, a + half), (a + half, b)):
                    self.start.append(x)
                    self.end.append(y)
                    self.child.append(-1)
                    part = rows[order[x:y]]
                    low.append(part.min(axis=0))
                    high.append(part.max(axis=0))
            k += 1
        self.low, self.high = np.array(low), np.array(high)
        self.ids, self.rows = ids[order], np.ascontiguousarray(rows[order])
        self.largest = float(np.abs(rows).max())

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The highest inner product that each query can have in each node's box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, own_id: int, bounds: np.ndarray, best: list, least: float, k: int) -> None:
        """Update best, a heap of (score, -id) with at most k entries, walking the boxes from the best; least bounds the kth score from below."""
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            floor = max(least, best[0][0]) if len(best) == k else least
            if -bound < floor:
                return
            child = self.child[node]
            if child >= 0:
                heapq.heappush(heap, (-bounds[child], child))
                heapq.heappush(heap, (-bounds[child + 1], child + 1))
                continue
            a, b = self.start[node], self.end[node]
            scores = self.rows[a:b] @ query
            for at in np.flatnonzero(scores >= floor):
                _offer(best, int(scores[at]), int(self.ids[a + at]), own_id, k)

    def search_wide(self, query: np.ndarray, own_id: int, best: list, least: float, k: int) -> None:
        """As search, over all rows in integers of any size, for components whose products exceed what a double holds exactly."""
        own = [int(x) for x in query]
        for key, row in zip(self.ids.tolist(), self.rows.tolist(), strict=True):
            score = max(-_LONG, min(_LONG, sum(int(x) * y for x, y in zip(row, own, strict=True))))
            if score >= least:
                _offer(best, score, key, own_id, k)


def _offer(best: list, score: int, key: int, own_id: int, k: int) -> None:
    if key != own_id:
        if len(best) < k:
            heapq.heappush(best, (score, -key))
        elif (score, -key) > best[0]:
            heapq.heapreplace(best, (score, -key))


def splits(rows: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and value of each node of a complete tree of median splits; node k has the children 2k and 2k + 1."""
    axes, values = np.zeros(1 << levels, np.int64), np.full(1 << levels, np.inf)
    own = {1: rows}
    for node in range(1, 1 << levels):
        part = own.pop(node)
        if len(part):
            axes[node] = (part.max(axis=0) - part.min(axis=0)).argmax()
            values[node] = np.median(part[:, axes[node]])
        right = part[:, axes[node]] >= values[node] if len(part) else np.zeros(0, bool)
        own[2 * node], own[2 * node + 1] = part[~right], part[right]
    return axes, values


def cells(rows: np.ndarray, axes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The cell of each row."""
    node = np.ones(len(rows), np.int64)
    for _ in range(len(axes).bit_length() - 1):
        node = 2 * node + (rows[np.arange(len(rows)), axes[node]] >= values[node])
    return node - len(axes)


def _as_rows(batches):
    for batch in batches:
        for size, (ids, ints) in integers(batch.column(0), batch.column(1)).items():
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([size] * len(ids), pa.int32()), pa.array([row.tobytes() for row in ints], pa.binary())], ["vec_id", "size", "data"])


_ROWS = "vec_id long, size int, data binary"


def _shards(vectors: DataFrame, count: int) -> DataFrame:
    """draw (a number from 0 to 255), size and tree (a pickled Tree) of every shard. vectors: vec_id, embedding; count: its rows."""
    some = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, count // SAMPLE_ROWS))) == 0).limit(2 * SAMPLE_ROWS)
    sample: dict[int, list[bytes]] = {}
    for r in map_batches(some, _as_rows, _ROWS).collect():
        sample.setdefault(r["size"], []).append(bytes(r["data"]))
    shapes = {}
    for size, own in sample.items():
        levels = min(LEVELS, max(0, (count * 8 * size // SHARD_BYTES).bit_length()))
        shapes[size] = splits(np.frombuffer(b"".join(own), np.float64).reshape(-1, size), levels)

    def placed(batches):
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            for size, (ids, ints) in integers(batch.column(0), batch.column(1)).items():
                cell = cells(ints, *shapes[size]) if size in shapes else np.zeros(len(ids), np.int64)
                order = (np.arange(at, at + len(ids), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)  # spreads a cell over tasks
                at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([size] * len(ids), pa.int32()), pa.array(cell), pa.array(order), pa.array(ids), pa.array([row.tobytes() for row in ints], pa.binary())], ["size", "cell", "salt", "vec_id", "data"])

    def built(batches):
        rng = np.random.default_rng(TaskContext.get().partitionId())
        waiting: list[tuple[int, bytes]] = []
        size = 0

        def shard():
            tree = Tree(np.array([w[0] for w in waiting], np.int64), np.frombuffer(b"".join(w[1] for w in waiting), np.float64).reshape(-1, size))
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array([int(rng.integers(256))], pa.int32()), pa.array([size], pa.int32()), pa.array([pickle.dumps(tree)], pa.binary())], ["draw", "size", "tree"])

        for batch in batches:
            for own, key, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if waiting and (own != size or len(waiting) * 8 * size >= SHARD_BYTES):
                    yield shard()
                size = own
                waiting.append((key, data))
        if waiting:
            yield shard()

    ordered = map_batches(vectors, placed, "size int, cell long, salt long, vec_id long, data binary").repartitionByRange("size", "cell", "salt").sortWithinPartitions("size", "cell", "salt")
    return checkpointed(map_batches(ordered.select("size", "vec_id", "data"), built, "draw int, size int, tree binary"))


_FOUND = "query long, score long, vec_id long"


def _search(shards: DataFrame, shared, k: int) -> DataFrame:
    """The best k rows of each task's shards for each query of a block, as far as they reach the scores known before."""

    def apply(batches):
        blocks = shared.value
        best = {size: [[] for _ in ids] for size, (ids, _, _) in blocks.items()}
        for batch in batches:
            for size, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if size not in blocks:
                    continue
                tree = pickle.loads(data.as_py())
                ids, rows, least = blocks[size]
                for at in range(0, len(ids), 256):
                    part = rows[at : at + 256]
                    wide = np.abs(part).max(axis=1) * tree.largest * size >= _EXACT
                    with np.errstate(over="ignore", invalid="ignore"):
                        bounds = tree.bounds(part)
                    for j, own in enumerate(bounds, at):
                        if wide[j - at]:
                            tree.search_wide(rows[j], int(ids[j]), best[size][j], least[j], k)
                        elif own[0] >= least[j]:
                            tree.search(rows[j], int(ids[j]), own, best[size][j], least[j], k)
        for size, lists in best.items():
            found = [(size << 40 | j, score, -key) for j, own in enumerate(lists) for score, key in own]
            for at in range(0, len(found), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found[at : at + 50_000], strict=True)], ["query", "score", "vec_id"])

    return map_batches(shards.select("size", "tree"), apply, _FOUND)


def _block(shards: DataFrame, rounds: list, queries: list, k: int) -> DataFrame:
    """query_id, vec_id, score and copies of the best k rows for each query of a block. queries: rows of vec_id, size, data and copies."""
    spark = shards.sparkSession
    by_size: dict[int, list] = {}
    for r in queries:
        by_size.setdefault(r["size"], []).append((r["vec_id"], bytes(r["data"]), r["copies"]))
    blocks = {size: (np.array([q[0] for q in own]), np.frombuffer(b"".join(q[1] for q in own), np.float64).reshape(-1, size), np.full(len(own), -np.inf)) for size, own in by_size.items()}
    best = None
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    for at, (first, last) in enumerate(rounds):
        shared = spark.sparkContext.broadcast(blocks)
        found = _search(shards.where(F.col("draw").between(first, last)), shared, k)
        found = found if best is None else found.unionByName(best)
        best = checkpointed(found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r"))
        if at + 1 < len(rounds):
            for r in best.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).collect():
                blocks[r.query >> 40][2][r.query & (1 << 40) - 1] = r.least
        shared.unpersist()
    keys = [(size << 40 | j, q[0], q[2]) for size, own in by_size.items() for j, q in enumerate(own)]
    return best.join(F.broadcast(spark.createDataFrame(keys, "query long, query_id long, copies long")), "query").select("query_id", "vec_id", "score", "copies")


def top_k(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY, id_col: str = "vec_id", vector_col: str = "embedding", block_bytes: int = BLOCK_BYTES, few: int = FEW) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the best k rows for every query."""
    spark = vectors.sparkSession
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    shards = _shards(own, own.count())
    asked = checkpointed(map_batches(own.where(F.col("vec_id") % every == 0), _as_rows, _ROWS))
    size = asked.agg(F.sum(F.length("data") + 64).alias("n")).first().n or 0
    blocks = -(-size // block_bytes)
    edges = [0] + [256 // n for n in ROUNDS]
    rounds = list(zip(edges, (e - 1 for e in edges[1:]), strict=False)) if shards.count() > few else [(0, 255)]
    path, found = f"{shared_folder(spark)}/topk-{uuid.uuid4().hex}", None
    for part in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == part)
        queries = mine.groupBy(*asked.columns).agg(F.count("*").alias("copies")).orderBy("vec_id", "data").collect()
        found = _block(shards, rounds, queries, k) if queries else found
        if blocks > 1 and queries:
            found.write.mode("append").parquet(path)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = spark.read.parquet(path) if blocks > 1 else found
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    each = found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)))))
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


#: The same rows by a plain comparison of every query with every row.
ORACLE_SQL = f"""
WITH parts AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({FACTOR} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % {QUERY_EVERY} = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
