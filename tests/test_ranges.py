"""Passages, intervals, prefixes, numbering and runs against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from verilane.operators import passages, ranges


@pytest.mark.parametrize(("at_once", "held"), [(1 << 20, 1 << 24), (40, 1 << 24), (1 << 20, 30)])
def test_occurrences_of_many_passages(spark, at_once, held):
    rng = random.Random(1)
    words = ["ab", "abc", "é", "d d", "x", "longer", "the"]
    texts = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for k in range(80)] + [(500, None), (501, ""), (502, "a" * 5000), (7, "the longer é")]
    needles = [t[a : a + n] for _, t in texts if t for a in [rng.randrange(len(t))] for n in (1, 3, 9, 40, 90)] + ["", None, "nowhere", "aaaa", "the longer é x"]
    rows = [(k, n) for k, n in enumerate(needles)]
    frame = spark.createDataFrame(rows + rows[:5], "k int, needle string")
    got = sorted(tuple(r) for r in passages.occurrences(frame, spark.createDataFrame(texts, "t int, haystack string").repartition(3), "t", at_once=at_once, held=held).collect())
    assert got == sorted((t, n, text.find(n) + 1) for t, text in texts if text for n in set(needles) if n and n in text)


def test_words_are_read_only_for_passages_with_inner_words(spark, monkeypatch):
    def never(*args):
        raise AssertionError("the texts' words were read")

    monkeypatch.setattr(passages, "_by_word", never)
    frame = spark.createDataFrame([(n,) for n in ("b c", "ab", "c d", "x", "zz")], "needle string")
    got = passages.occurrences(frame, spark.createDataFrame([(1, "ab cd"), (2, "b c d x")], "t int, haystack string"), "t", at_once=4)
    assert sorted(map(tuple, got.collect())) == [(1, "ab", 1), (1, "b c", 2), (2, "b c", 1), (2, "c d", 3), (2, "x", 7)]


def test_a_short_passage_costs_the_automaton_a_number_alone():
    machine, others = passages.automaton(["ab", "abc", "x" * 40 + "ab", "x" * 50])
    assert set(others) and all(k >= 4 for k in others) and machine.get("ab") == 0 and machine.get("abc") == 1
    assert passages.first_places(machine, others, ["ab", "abc", "x" * 40 + "ab", "x" * 50], "abc" + "x" * 50 + "ab") == {0: 0, 1: 0, 2: 13, 3: 3}


def test_intervals(spark):
    rng = random.Random(2)
    spans = [(rng.choice("ab"), k, s, s + rng.choice([0, 1, 2, 3, 7, 8, 9, 100, 5000, -4])) for k, s in enumerate(rng.randrange(-200, 200) for _ in range(120))] + [("a", 900, -(2**61), 2**61), ("c", 901, 0, 5), ("a", 902, None, 5)]
    points = [(rng.choice("ab"), j, rng.randrange(-250, 400)) for j in range(200)] + [("a", 300, None), ("z", 301, 1)]
    got = ranges.in_intervals(spark.createDataFrame(points, "g string, j int, p long"), spark.createDataFrame(spans, "g string, k int, a long, b long"), ["g"], "p", "a", "b")
    assert sorted((r.j, r.k) for r in got.collect()) == sorted((j, k) for g, j, p in points for h, k, a, b in spans if g == h and p is not None and a is not None and a <= p < b)
    none = ranges.in_intervals(spark.createDataFrame(points, "g string, j int, p long"), spark.createDataFrame([], "g string, k int, a long, b long"), ["g"], "p", "a", "b")
    assert none.count() == 0 and set(none.columns) == {"g", "j", "p", "k", "a", "b"}


def test_longest_prefix(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    prefixes = {word(rng.randrange(0, 7)) for _ in range(40)} - {""}
    rows = [(k, word(rng.randrange(0, 9))) for k in range(120)] + [(200, None), (201, "zz")] + [(7, "abab")] * 3
    frame = spark.createDataFrame(sorted((p, len(p)) for p in prefixes), "prefix string, v int")
    got = sorted(((r.k, r.c, r.prefix, r.v) for r in ranges.longest_prefix(spark.createDataFrame(rows, "k int, c string"), frame, "c", "prefix").collect()), key=str)
    best = lambda c: max((p for p in prefixes if c and c.startswith(p)), key=len, default=None)
    assert got == sorted(((k, c, best(c), best(c) and len(best(c))) for k, c in rows), key=str)
    with_empty = ranges.longest_prefix(spark.createDataFrame(rows, "k int, c string"), spark.createDataFrame([("", 0)], "prefix string, v int"), "c", "prefix")
    assert with_empty.where("v = 0").count() == len(rows) - 1


@pytest.mark.parametrize("keys", [["g"], [], ["g", "h"]])
def test_numbering_by_ranges(spark, keys):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randrange(2), rng.randrange(50)) for _ in range(400)]
    frame = spark.createDataFrame(rows, "g string, h int, v int").repartition(7)
    got = ranges.numbered(frame, keys, [F.col("v"), F.col("h")], "no").collect()
    groups, want = {}, []
    for r in rows:
        groups.setdefault(tuple(r["gh".index(k)] for k in keys), []).append(r)
    for own in groups.values():
        want += [(*r, k) for k, r in enumerate(sorted(own, key=lambda r: (r[2], r[1])), 1)]
    # rows alike in keys and order may stand in any order among themselves
    assert sorted((r.v, r.h, r.no) + tuple(r[k] or "" for k in keys) for r in got) == sorted((v, h, no) + tuple({"g": g, "h": h}[k] or "" for k in keys) for g, h, v, no in want)


def test_gutters(spark):
    pages = {1: [f"{k} text" for k in range(1, 9)], 2: ["1 a", "5 b", "9 c", "2 d", "7 e"], 3: ["1 a", "2 b", "3 c", "4 d"], 4: ["1 a", "no", "2 b", "3 c", "", "12 x"], 5: ["100 a", "2b", "x", "3 c", "4 d"], 6: ["3 a", "4 b", "no", "9 c", "10 d", "11"]}
    rows = [(p, k, line) for p, own in pages.items() for k, line in enumerate(own)]
    out = {r.p: r for r in ranges.without_gutters(spark.createDataFrame(rows, "p int, k int, line string").repartition(3), ["p"], "k", "line").collect()}
    assert out[1].gutter and out[1].text == " ".join(["text"] * 8) and (out[1].runs, out[1].longest, out[1].by_one, out[1].steps) == (1, 8, 7, 7)
    assert not out[2].gutter and out[2].text == "\n".join(pages[2]) and out[2].by_one == 0
    assert not out[3].gutter  # under five lines
    assert out[4].gutter and out[4].text == "a no b c  x" and (out[4].numbered, out[4].runs, out[4].longest) == (4, 2, 3)
    assert not out[5].gutter and out[5].numbered == 2
    assert out[6].gutter and (out[6].numbered, out[6].steps, out[6].by_one) == (4, 3, 2) and out[6].text == "a b no c d 11"
