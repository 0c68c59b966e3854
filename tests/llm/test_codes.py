import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from verilane.llm import codes


def plain(rows, parts=16, entries=64, rounds=2):
    """The contract in Python integers. rows: vec_id, vector, label."""
    kept = [(i, [float(x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = -(-len(kept[0][1]) // parts)
    whole = lambda x: 256 * int(x) if abs(x) >= 2.0**53 else math.floor(256 * x)
    cut = []
    for _, v, _ in kept:
        ints = [whole(x) for x in v] + [0] * (parts * width - len(v))
        cut.append([ints[p * width : (p + 1) * width] for p in range(parts)])
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        met = {}
        for c in cut:
            for p in range(parts):
                met.setdefault((p, near(p, c[p])[1]), []).append(c[p])
        for (p, e), own in met.items():
            books[p][e] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by_label = [], {}
    for (i, _, label), c in zip(kept, cut, strict=True):
        best = [near(p, c[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), label))
        by_label[label] = by_label.get(label, 0) + out[-1][2]
    top = (1 << 63) - 1
    return sorted(((i, code, min(e, top), min(by_label[label], top), digest) for i, code, e, label in out), key=str)


def result(spark, rows, kind="float", **how):
    frame = spark.createDataFrame([(i, v, label) for i, v, label in rows], f"vec_id long, embedding array<{kind}>, label int")
    frame = frame.withColumns({"v": F.lit("clash"), "code": F.lit(1), "error": F.lit("x"), "m": F.create_map(F.lit("a"), F.lit(1))}).repartition(3)
    coded, books = codes.encode(frame, **how)
    digest = "" if books is None else codes.codebooks_digest(books)
    return sorted(((r.vec_id, r.code, r.error, r.label_error, digest) for r in codes.with_label_errors(coded).collect()), key=str)


def vectors(n, size, seed=1):
    rng = random.Random(seed)
    return [(k, [float(np.float32(rng.gauss(0, 0.3))) for _ in range(size)], rng.choice([1, 2, None])) for k in range(n)]


ODD = [(500, None, 1), (501, [], 1), (502, [None] + [1.0] * 31, 1), (503, [float("nan")] * 32, 2), (504, [float("inf")] + [0.0] * 31, 2), (505, [0.5] * 20, 2), (None, [0.25] * 32, None), (None, [0.25] * 32, None)]


def test_equal_to_the_plain_contract(spark):
    rows = vectors(150, 32) + ODD + [(7, [1.5] * 32, 1)] * 20 + [(k, [0.0] * 32, 2) for k in range(600, 640)]
    assert result(spark, rows) == plain(rows)


def test_few_rows_odd_sizes_and_parameters(spark):
    rows = vectors(9, 10, 2) + [(3, [0.1] * 10, 1)]
    assert result(spark, rows) == plain(rows)
    assert result(spark, rows, parts=3, entries=4, rounds=5) == plain(rows, 3, 4, 5)
    assert result(spark, []) == [] and result(spark, ODD[:5]) == []


@pytest.mark.parametrize("kind", ["float", "double"])
def test_components_of_any_size(spark, kind):
    rng = random.Random(4)
    top = 3e38 if kind == "float" else 1.5e308
    rows = [(k, [float(np.float32(rng.choice([1e5, 1e-3, -1e12, 7e30])) if kind == "float" else rng.uniform(-1, 1) * top) for _ in range(6)], 1) for k in range(40)]
    rows += [(100, [float(np.float32(top))] * 6 if kind == "float" else [top] * 6, 1)]
    assert result(spark, rows, kind, parts=2, entries=5) == plain(rows, 2, 5)


def test_the_filter_misses_nothing_and_prunes():
    rng = np.random.default_rng(0)
    for spread, width, count in ((300, 4, 64), (2, 4, 64), (1, 1, 3), (10_000, 8, 256), (0, 2, 5)):
        entries = rng.integers(-spread, spread + 1, (count, width))
        points = np.concatenate([rng.integers(-2 * spread - 1, 2 * spread + 2, (500, width)), entries])
        for dtype in (np.int64, object):
            found, distances, refined = codes.Approximation(entries.astype(dtype)).nearest(points.astype(dtype))
            every = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
            assert (found == every.argmin(axis=1)).all() and (distances == every.min(axis=1)).all()
        if (spread, count) == (300, 64):
            assert refined < 0.35 * len(points) * count


def test_the_query_equals_its_sql(spark, tmp_path):
    rows = [r for r in vectors(200, 32, 3) + ODD if r[1] is None or len(r[1]) != 20]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    got = sorted((tuple(r) for r in codes.query(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(con.execute(codes.ORACLE_SQL).fetchall(), key=str) == plain(rows)
