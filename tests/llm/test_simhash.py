import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from verilane.llm import golay, simhash
from verilane.llm.components import component_labels


def plain_fingerprint(text):
    words = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)]
    hashes = [xxhash.xxh64(x, seed=42).intdigest() for x in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """fps: dict id -> fingerprint; the smallest id reachable through links."""
    left = {k: k for k in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 2 and left[b] < left[a]:
                    left[a], changed = left[b], True
    return left


def test_golay_is_perfect_and_balls_share_a_key():
    words = np.arange(1 << 23)
    code = golay.decode(words)
    assert (np.bincount(code) == 2048).all()
    rng = np.random.default_rng(1)
    some = rng.integers(0, 1 << 23, 500)
    keys = golay.ball_indices(some, 23)
    assert {len(set(k)) for k in keys} <= {1, 6}
    other = some ^ (1 << rng.integers(0, 23, 500)) ^ (1 << rng.integers(0, 23, 500))
    for a, b in zip(keys, golay.ball_indices(other, 23), strict=True):
        assert set(a) & set(b)


def test_keys_meet_at_every_distance_up_to_two():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 4000, dtype=np.uint64)
    one, two = (np.uint64(1) << rng.integers(0, 64, 4000, dtype=np.uint64) for _ in range(2))
    for b in (a, a ^ one, a ^ one ^ two):
        rows_a, keys_a = simhash.fuzzy_keys(a)
        rows_b, keys_b = simhash.fuzzy_keys(b)
        assert len(keys_a) <= 33 * len(a)
        met = {r for r, k in set(zip(rows_a.tolist(), keys_a.tolist(), strict=True)) & set(zip(rows_b.tolist(), keys_b.tolist(), strict=True))}
        assert met == set(range(len(a)))


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(-5, 129)]
    out = {r.node: r.root for r in component_labels(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[k] == 0 for k in range(41)) and all(out[k] == -5 for k in range(100, 130))
    assert component_labels(spark.createDataFrame([], "a long, b long")).count() == 0


def test_whole_operator_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(50)] + ["Äpfel", "ÉTÉ", "x y"]
    base = [[rng.choice(vocabulary) for _ in range(300)] for _ in range(8)]
    rows = []
    for k in range(120):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(300)] = "Edited"
        rows.append((k, rng.choice([" ", "\n", "\t ", "\x0b"]).join(words)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "one two"), (5, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("key", F.lit(None).cast("int"))
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    fps = {k: plain_fingerprint(t) for k, t in rows}
    want = plain_components(fps)
    for r in out:
        assert r.fp % (1 << 64) == fps[r.doc_id] and r.component_id == want[r.doc_id]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_hot_keys_give_the_same_links(spark):
    centre = 0x0123456789ABCDEF
    fps = sorted({centre} | {centre ^ (1 << a) ^ (1 << b) for a in range(0, 64, 5) for b in range(0, 64, 7)} | {(centre * k) % (1 << 64) for k in range(3, 40)})
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    want = plain_components(dict(enumerate(fps)))
    for hot in (1, 4, 10**6):
        labels = {r.node % (1 << 64): r.root % (1 << 64) for r in component_labels(simhash.links(frame, hot)).collect()}
        groups = {}
        for k, f in enumerate(fps):
            groups.setdefault(labels.get(f, f), set()).add(k)
        assert sorted(map(sorted, groups.values())) == sorted(sorted(k for k in want if want[k] == v) for v in set(want.values()))


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_null_and_repeated_ids_keep_one_row_by_a_total_order(spark):
    from verilane.llm import resemblance

    words = [" ".join(f"{c}{k}" for k in range(80)) for c in "abcdef"]
    rows = [(1, words[0], "x"), (2, words[1], "x"), (2, words[0], "x"), (None, words[2], "x"), (None, words[3], "z"), (None, words[3], "y"), (None, words[1], "x"), (7, words[4], "q"), (7, words[4], "p"), (8, words[5], "x"), (8, words[5], "x")]
    # 2 loses its copy of 1's text and keeps its own; null ids are kept unless their text has an id
    want = sorted([(1, words[0], "x"), (2, words[1], "x"), (None, words[2], "x"), (None, words[3], "y"), (7, words[4], "p"), (8, words[5], "x")], key=repr)
    for keep in (simhash.keep_one, resemblance.keep_one):
        for order in (rows, rows[::-1]):
            docs = spark.createDataFrame(order, "doc_id long, text string, lang string").repartition(3)
            assert sorted(map(tuple, keep(docs).collect()), key=repr) == want
    both = [(5, words[0]), (5, words[1])]
    for keep in (simhash.keep_one, resemblance.keep_one):
        assert len({tuple(keep(spark.createDataFrame(order, "doc_id long, text string")).first()) for order in (both, both[::-1])}) == 1


def test_keys_never_pass_through_the_driver(spark):
    fps = spark.range(3000).select(F.xxhash64("id").alias("fp")).distinct()
    shared = simhash._shared_keys(fps)
    shared.collect()
    plan = shared._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
