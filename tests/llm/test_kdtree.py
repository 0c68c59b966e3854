import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from verilane.llm import kdtree


def plain(rows, k=5, every=50):
    """Every query row against every row, in Python integers; the rows of one query id are ranked together."""
    ints = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    scores = {}
    for q, a in ints:
        if q % every == 0:
            scores.setdefault(q, []).extend((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ints if i != q and len(a) == len(b))
    return sorted((q, r, i, -s) for q, found in scores.items() for r, (s, i) in enumerate(sorted(found)[:k], 1))


def as_floats(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


@pytest.mark.parametrize(("block_bytes", "few", "shard_bytes"), [(32 << 20, 64, 4 << 20), (500, 0, 1500)])
def test_against_all_pairs(spark, monkeypatch, block_bytes, few, shard_bytes):
    monkeypatch.setattr(kdtree, "SHARD_BYTES", shard_bytes)
    rng = random.Random(1)
    rows = [(k, [round(rng.gauss(0, 0.3), 2) for _ in range(6)]) for k in range(700)]
    rows += [(k, [0.25] * 6) for k in range(700, 760)] + [(k, [rng.random(), 1.0]) for k in (800, 801, 850, 851)]
    rows += [(900, None), (950, []), (901, [1.0, None] * 3), (1000, [float("nan")] * 6), (1001, [float("inf")] * 6), (None, [1.0] * 6), (5, rows[5][1]), (-50, [-0.5] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).withColumn("rank", F.lit(0)).repartition(3)
    got = sorted(tuple(r) for r in kdtree.top_k(frame, block_bytes=block_bytes, few=few).collect())
    assert got == plain(as_floats(rows))


def test_repeated_rows_against_the_sql(spark, tmp_path):
    rows = [(0, [1.0, 0.5])] * 2 + [(1, [1.0, 1.0])] * 2 + [(k, [0.1 * k, 0.2]) for k in range(2, 9)] + [(50, [0.5, 0.5]), (50, [-1.0, 2.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in kdtree.query(spark, str(tmp_path)).collect())
    assert got == plain(rows)
    embeddings = pd.DataFrame(rows, columns=["vec_id", "embedding"])  # noqa: F841
    assert got == sorted(duckdb.sql(kdtree.ORACLE_SQL).fetchall())


def test_one_vector_in_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(kdtree, "SHARD_BYTES", 2000)
    rng = random.Random(4)
    rows = [(k, [0.5] * 4) for k in range(300)] + [(k, [round(rng.gauss(0, 0.4), 2) for _ in range(4)]) for k in range(300, 900)] + [(7, [0.5] * 4)] * 300
    got = sorted(tuple(r) for r in kdtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == plain(rows)


def test_large_components_are_exact(spark):
    rows = [(0, [1e9, 1.0]), (1, [1e9, 2.0]), (2, [1e9, 1.5]), (3, [3.0, 1.0]), (50, [1e3, 3.0]), (4, [1e308, 1.0]), (100, [1.0, 1e5])]
    got = sorted(tuple(r) for r in kdtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    limit = (1 << 63) - 1
    want = [(q, r, i, min(limit, s)) for q, r, i, s in plain([r for r in rows if r[0] != 4])]
    assert [r for r in got if r[0] != 0] == [r for r in want if r[0] != 0]
    # scores beyond a long are the nearest long, and ties go to the smaller id
    assert [r[2:] for r in got if r[0] == 0][:3] == [(1, limit), (2, limit), (50, 256 * 10**9 * 256 * 10**3 + 256 * 768)]


def test_boxes_are_tight_and_bounds_hold():
    rng = np.random.default_rng(2)
    rows, queries = rng.integers(-100, 100, (1000, 8)).astype(float), rng.integers(-50, 50, (5, 8)).astype(float)
    tree = kdtree.Tree(np.arange(1000), rows, leaf=16)
    bounds = tree.bounds(queries)
    for node, (a, b) in enumerate(zip(tree.start, tree.end, strict=True)):
        part = tree.rows[a:b]
        assert (part.min(0) == tree.low[node]).all() and (part.max(0) == tree.high[node]).all()
        assert ((part @ queries.T).max(0) <= bounds[:, node]).all()


def test_cells_are_even():
    rows = np.random.default_rng(3).normal(size=(4096, 5))
    assert set(np.bincount(kdtree.cells(rows, *kdtree.splits(rows, 4))).tolist()) == {256}


def test_few_rows_and_none(spark):
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in kdtree.top_k(few).collect()] == [(0, 1, 1, 256 * 512)]
    assert kdtree.top_k(few.limit(0)).count() == 0
