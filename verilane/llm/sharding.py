"""Shards of nearly equal bytes by minimax contiguous partition. DataFrame functions only.

The law is `bytes`. Equal texts are one atomic group; groups are ordered by a digest of their text. The smallest capacity
at which a greedy walk over the ordered groups needs no more than the given number of shards is found by binary search, and
the groups are cut there. A group that exceeds the mean of what is left takes a shard of its own first, largest first,
so that one text with a third of all rows leaves the other shards equal; cuts are placed as near to equal
shares as that capacity allows.

Scale. The driver never sees the groups: it holds sums over key prefixes, and only those prefixes in which
a cut can still fall are split further, a hexadecimal digit each round, until each such prefix is a single group. What it
holds is bounded by the number of shards, not by the input. A row's shard then follows from its own digest by
comparison with the cut keys, without a join. Slots are row numbers within hashed parts of each shard, moved up by the
sizes of the parts before, so neither a shard nor a hot text meets in one task.

Contract: size is the UTF-8 bytes of the text plus 16; a null text has none, forms a group of its own and has checksum 0. Repeated
rows each get a slot. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

SHARDS, ROW_BYTES = 40, 16
#: Rows that one slot part of a shard aims at, and the least number of parts.
PART_ROWS, LEAST_PARTS = 1_000_000, 64
_FIRST_DIGITS, _DIGITS = 3, 32
#: Above every hexadecimal key.
_END = "~"


class Blocks:
    """Consecutive key prefixes with their bytes, number of groups and largest group."""

    def __init__(self, rows: list[tuple[str, int, int, int]]):
        self.rows = sorted(rows)
        self.ends = [0, *accumulate(r[1] for r in self.rows)]
        self.total = self.ends[-1]

    def forward(self, capacity: int, shards: int) -> list[int]:
        """Block positions of the greedy cuts from the left, blocks kept whole."""
        cuts = [0]
        for _ in range(shards):
            cuts.append(max(cuts[-1], bisect_right(self.ends, self.ends[cuts[-1]] + capacity) - 1))
        return cuts

    def backward(self, capacity: int, shards: int) -> list[int]:
        """The same from the right: the first blocks at which the last k shards can begin."""
        cuts = [len(self.rows)]
        for _ in range(shards):
            least = self.ends[cuts[-1]] - capacity
            at = bisect_right(self.ends, least - 1)
            cuts.append(min(at, cuts[-1]))
        return cuts[::-1]

    def fits(self, capacity: int, shards: int) -> bool:
        return self.forward(capacity, shards)[-1] == len(self.rows)

    def least_capacity(self, shards: int, low: int, high: int) -> int:
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.fits(middle, shards) else (middle + 1, high)
        return low

    def open_blocks(self, shards: int, low: int, high: int) -> list[int]:
        """Blocks of several groups in which a cut of any capacity from low to high can fall."""
        left, right = self.forward(low, shards), self.backward(low, shards)
        found: set[int] = set()
        for k in range(1, shards):
            ideal = self.total * k // shards
            near = min(self.ends[left[k]], self.total - (shards - k) * high, ideal)
            far = max(k * high, self.ends[right[k]], ideal)
            first = max(0, bisect_right(self.ends, near) - 1)
            last = min(len(self.rows) - 1, bisect_right(self.ends, min(far, self.total)) - 1)
            found.update(p for p in range(first, last + 1) if self.rows[p][2] > 1)
        return sorted(found)

    def cut_keys(self, shards: int, capacity: int) -> list[str]:
        """The key at which each shard after the first begins, as near to equal shares as the capacity allows."""
        left, right = self.forward(capacity, shards), self.backward(capacity, shards)
        keys, before = [], 0
        for k in range(1, shards):
            ideal = self.total * k // shards
            near = bisect_right(self.ends, ideal) - 1
            if near + 1 < len(self.ends) and self.ends[near + 1] - ideal < ideal - self.ends[near]:
                near += 1
            reach = bisect_right(self.ends, self.ends[before] + capacity) - 1
            before = max(before, right[k], min(near, left[k], reach))
            keys.append(self.rows[before][0] if before < len(self.rows) else _END)
        return keys


def _sums(groups: DataFrame, digits: int) -> list[tuple[str, int, int, int]]:
    """Bounded: at most 16 ** _FIRST_DIGITS prefixes, or sixteen for each open block."""
    rows = groups.groupBy(F.substring("key", 1, digits).alias("p")).agg(F.sum("bytes"), F.count("*"), F.max("bytes")).collect()
    return [tuple(r) for r in rows]


def cut_points(groups: DataFrame, shards: int) -> tuple[list[str], list[str]]:
    """groups: key, bytes. The keys with a shard of their own, and the first keys of the shards after the first of the rest."""
    if shards < 1:
        raise ValueError("there must be a shard")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    alone: list[str] = []
    for key, size in groups.orderBy(F.desc("bytes"), "key").limit(shards).select("key", "bytes").collect():
        left = shards - len(alone)
        if left > 1 and size * left > total:
            alone.append(key)
            total -= size
        else:
            break
    rest, m = groups.where(~F.col("key").isin(alone)) if alone else groups, shards - len(alone)
    digits = _FIRST_DIGITS
    blocks = Blocks(_sums(rest, digits))
    largest = max((r[3] for r in blocks.rows), default=0)
    while True:
        low = max(-(-blocks.total // m), largest)
        high = blocks.least_capacity(m, low, low + max((r[1] for r in blocks.rows), default=0))
        wide = blocks.open_blocks(m, low, high)
        if not wide or digits >= _DIGITS:
            break
        by_length: dict[int, list[str]] = {}
        for p in wide:
            by_length.setdefault(len(blocks.rows[p][0]), []).append(blocks.rows[p][0])
        split = set(wide)
        kept = [r for p, r in enumerate(blocks.rows) if p not in split]
        for length, prefixes in by_length.items():
            kept += _sums(rest.where(F.substring("key", 1, length).isin(prefixes)), length + 1)
        digits = max(digits, max(by_length) + 1)
        blocks = Blocks(kept)
    return alone, blocks.cut_keys(m, blocks.least_capacity(m, low, high))


def shard_column(alone: list[str], cuts: list[str]):
    """The shard of a row from its key alone."""
    own = F.lit(len(alone)) + sum((F.when(F.col("key") >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    for k, key in enumerate(alone):
        own = F.when(F.col("key") == F.lit(key), k).otherwise(own)
    return own.cast("int")


def shards_of(docs: DataFrame, n_shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.when(F.col(text_col).isNull(), "").otherwise(F.substring(F.sha2(text, 256), 1, _DIGITS))
    rows = checkpointed(docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("key")))
    groups = checkpointed(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    alone, cuts = cut_points(groups, n_shards)
    parts = max(LEAST_PARTS, -(-(groups.agg(F.sum("n")).first()[0] or 0) // (PART_ROWS * n_shards)))
    placed = rows.withColumn("shard", shard_column(alone, cuts)).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    offsets = sizes.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    ranked = placed.withColumn("rank", F.row_number().over(within))
    # offsets has n_shards * parts rows at most
    out = ranked.join(F.broadcast(offsets), ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark, sf_dir: str) -> DataFrame:
    return shards_of(table(spark, sf_dir, "documents"))
