import random
import zlib

import pytest
from pyspark.sql import functions as F

from verilane.llm import sharding
from verilane.llm.sharding import Blocks


def plain_least(sizes, shards):
    """The smallest capacity by dynamic programming over all contiguous partitions."""
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        best = [min(max(best[a], sum(sizes[a:b])) for a in range(b + 1)) for b in range(len(sizes) + 1)]
    return best[-1]


@pytest.mark.parametrize("seed", range(12))
def test_capacity_is_the_least_and_cuts_hold_it(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 3, 5, 20]) for _ in range(rng.randint(1, 40))]
    shards = rng.randint(1, 9)
    blocks = Blocks([(f"{k:03}", s, 1, s) for k, s in enumerate(sizes)])
    least = blocks.least_capacity(shards, max(max(sizes), -(-sum(sizes) // shards)), sum(sizes))
    assert least == plain_least(sizes, shards)
    keys = blocks.cut_keys(shards, least)
    loads = [0] * shards
    for k, s in enumerate(sizes):
        loads[sum(f"{k:03}" >= c for c in keys)] += s
    assert max(loads) <= least and len(keys) == shards - 1


def test_refined_cuts_equal_those_over_all_groups(spark):
    rows = [(__import__("hashlib").sha256(str(k).encode()).hexdigest()[:32], 17 + k * k % 997) for k in range(3000)]
    groups = spark.createDataFrame(rows, "key string, bytes long")
    for shards in (1, 7, 40):
        alone, cuts = sharding.cut_points(groups, shards)
        assert alone == []
        whole = Blocks([(k, s, 1, s) for k, s in rows])
        low = max(max(s for _, s in rows), -(-whole.total // shards))
        least = whole.least_capacity(shards, low, whole.total)
        loads = [0] * shards
        for k, s in rows:
            loads[sum(k >= c for c in cuts)] += s
        assert max(loads) <= least


def test_whole_operator(spark):
    rng = random.Random(5)
    rows = [(k, "x" * rng.randint(0, 400)) for k in range(800)] + [(k, "hot" * 30) for k in range(800, 1200)]
    rows += [(2000, None), (2001, None), (2002, "é" * 10), (2003, "y" * 20000), (5, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("size", F.lit(1)).withColumn("part", F.lit(0))
    out = [r.asDict() for r in sharding.shards_of(docs, 10).collect()]
    assert len(out) == len(rows) and {r["law"] for r in out} == {"bytes"}
    texts = {k: t for k, t in rows}
    where, loads, slots = {}, [0] * 10, [[] for _ in range(10)]
    for r in out:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 16, zlib.crc32(data))
        assert where.setdefault(texts[r["doc_id"]], r["shard"]) == r["shard"]
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    rest = sorted(loads)[:-2]  # the hot and the long text have shards of their own
    assert max(rest) - min(rest) <= 2 * 11 * 416


def test_empty_and_tiny_tables(spark):
    assert sharding.shards_of(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = sharding.shards_of(spark.createDataFrame([(1, "a")], "doc_id long, text string")).collect()
    assert [(r.size, r.slot, r.grown_shard) for r in one] == [(17, 0, None)]
