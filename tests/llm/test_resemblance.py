import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from verilane.llm import resemblance


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} - {()}


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def plain_kept(rows):
    """The smallest id of each component of rows of different ids, all pairs compared."""
    sets = {k: shingles(t) for k, t in rows}
    left = {k: k for k in sets}

    def root(k):
        while left[k] != k:
            k = left[k]
        return k

    for a in sets:
        for b in sets:
            if b < a and alike(sets[a], sets[b]):
                x, y = sorted((root(a), root(b)))
                left[y] = x
    return sorted(k for k in left if left[k] == k)


def copies(rng, base, edits):
    words = list(base)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def test_stage_finds_near_copies_against_all_pairs(spark, tmp_path):
    rng = random.Random(5)
    bases = [[f"w{rng.randrange(400)}" for _ in range(200)] for _ in range(12)]
    # up to 12 edited words: similarities on both sides of 0.8
    rows = [(k, copies(rng, bases[k % 12], rng.randrange(13))) for k in range(120)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "one two"), (204, "ONE two"), (205, "one"), (206, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = corpus_pipeline.near_duplicate_stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == plain_kept(rows)


@pytest.mark.parametrize(("n", "words", "edits"), [(100, 300, 3), (300, 60, 8), (600, 60, 8)])
def test_crowds_lose_no_link(spark, n, words, edits):
    """Uneven copies of one text: many are alike only through others."""
    rng = random.Random(n)
    base = [f"w{k}" for k in range(words)]
    rows = [(k, copies(rng, base, rng.randrange(edits))) for k in range(n)] + [(5000 + k, " ".join(f"v{rng.randrange(999)}" for _ in range(90))) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in resemblance.keep_one(docs).collect()) == plain_kept(rows)


def test_columns_of_any_name_and_type_are_kept(spark):
    rows = [(1, "a b c d e f", "mongo-1", True, "x", {"k": 1}, 7), (2, "a b c d e F", "mongo-2", None, "y", None, 8), (2, "other", "mongo-3", False, "z", {}, 9), (None, "lone text", "mongo-4", True, None, {"a": None}, 1), (3, "other", "m", True, "w", {"q": 2}, 2), (1, "a b c d e f", "mongo-1", True, "x", {"k": 2}, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, _none boolean, _h string, tags map<string,int>, t int").withColumns({"s": F.lit("clash"), "root": F.lit(1.5), "none": F.array(F.lit(1)), "rank": F.lit("r"), "_c0": F.lit("c")})
    out = resemblance.keep_one(docs)
    assert out.schema == docs.schema
    got = {(r.doc_id, r["_id"], r["_none"], r["_h"], r.t, r.s, r["_c0"]) for r in out.collect()}
    assert got == {(1, "mongo-1", True, "x", 7, "clash", "c"), (2, "mongo-3", False, "z", 9, "clash", "c"), (None, "mongo-4", True, None, 1, "clash", "c")} and out.count() == 3
