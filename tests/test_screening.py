"""Medians in bounded memory and clusters of propositions against plain loops."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from verilane.operators import clusters, screening


@pytest.mark.parametrize("kind", ["few", "many", "ties"])
def test_exact_medians(spark, kind):
    rng = random.Random(kind)
    draw = {"few": lambda: rng.choice([1.0, 2.0, 2.0, 9.0]), "many": lambda: rng.gauss(0, 1e6), "ties": lambda: float(rng.randrange(3) if rng.random() < 0.9 else rng.randrange(10**6))}[kind]
    rows = [(g, rng.choice([0, None]), draw()) for g, n in (("a", 1), ("b", 2), ("c", 3), ("hot", 6000), (None, 501), ("e", 40)) for _ in range(n)] + [("a", 0, None), ("none", 0, None)]
    frame = spark.createDataFrame(rows, "g string, h int, x double").withColumn("n", F.lit("clash")).repartition(5)
    cells = {}
    for g, h, x in rows:
        if x is not None:
            cells.setdefault((g, h), []).append(x)
    got = {(r.g, r.h): (r.m, r.n) for r in screening.exact_median(frame, ["g", "h"], F.col("x"), "m").collect()}
    assert got == {k: (statistics.median(v), len(v)) for k, v in cells.items()}
    both = {(r.g, r.h): (r.median, r.mad, r.n) for r in screening.median_mad(frame.drop("n"), ["g", "h"], "x").collect()}
    assert both == {k: (statistics.median(v), statistics.median(abs(x - statistics.median(v)) for x in v), len(v)) for k, v in cells.items()}


def test_clusters_against_all_pairs(spark):
    rng = random.Random(5)
    rows = [(d, rng.sample("abcdefghij", rng.randint(2, 6)) + ["a"] * rng.randrange(2)) for d in range(12) for _ in range(14)] + [(99, []), (98, ["a", "b", "c"])]
    got = {r.d: (r.n_clusters, r.max_cluster) for r in clusters.largest_clusters(spark.createDataFrame(rows, "d int, t array<string>"), "d", "t").collect()}
    want = {}
    for d in {d for d, _ in rows}:
        sets = [frozenset(t) for e, t in rows if e == d and len(set(t)) >= 4]
        group = list(range(len(sets)))
        for a in range(len(sets)):
            for b in range(a):
                if 5 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]):
                    old, new = group[a], group[b]
                    group = [new if g == old else g for g in group]
        if sets:
            want[d] = (len(set(group)), max(group.count(g) for g in group))
    assert got == want
