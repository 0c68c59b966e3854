"""The exact similarity join and components against all pairs in plain Python."""

import hashlib
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from verilane.operators import clusters, similar
from verilane.operators.components import component_labels


def grams(text, words=5):
    parts = (text or "").lower().encode().split()
    return {tuple(parts[k : k + words]) for k in range(max(1, len(parts) - words + 1))} if parts else set()


def alike(a, b, least):
    return bool(a and b) and len(a & b) >= least * len(a | b)


def groups_of(texts, least, words=5):
    sets, parent = {t: grams(t, words) for t in texts}, {t: t for t in texts}

    def root(t):
        while parent[t] != t:
            parent[t] = parent[parent[t]]
            t = parent[t]
        return t

    every, pairs = list(sets), set()
    for k, a in enumerate(every):
        for b in every[:k]:
            if alike(sets[a], sets[b], least):
                pairs.add(frozenset((a, b)))
                parent[root(a)] = root(b)
    return pairs, {t: root(t) for t in every}


def variants(rng, n, words=60, edits=12, tail=0):
    """Uneven copies of one text: some are alike only through others."""
    base = [f"w{rng.randrange(4000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits)):
            at = rng.randrange(len(own))
            kind = rng.randrange(3)
            if kind == 0:
                own[at] = f"x{rng.randrange(10**6)}"
            elif kind == 1 and len(own) > 8:
                del own[at]
            else:
                own.insert(at, f"y{rng.randrange(10**6)}")
        out.append(" ".join(own + [f"t{rng.randrange(50)}" for _ in range(rng.randrange(tail + 1))]))
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    passage = " ".join(f"p{k}" for k in range(60))
    out = variants(rng, 120) + variants(rng, 40, 20, 4, 6) + variants(rng, 30, 12, 3)
    out += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    out += [passage + " " + " ".join(f"v{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 40))) for _ in range(60)]  # a passage that many texts share
    return out + ["one", "one two", "one two three four", "One  TWO three four", "", " \t", passage.upper(), "é " * 30, "É\n" * 30]


def md5(text):
    return hashlib.md5((text or "").encode()).digest()


@pytest.mark.parametrize("least", ["0.8", "0.5", "1"])
def test_all_pairs_and_groups(spark, least):
    texts = corpus()
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000 + k, t) for k, t in enumerate(texts[:50] * 3)] + [(None, texts[0]), (7, texts[7]), (5000, None), (None, None)]
    docs = spark.createDataFrame(rows, "id long, text string").withColumns({"s": F.lit("clash"), "t": F.lit(1), "m": F.create_map(F.lit("a"), F.lit(1))}).repartition(4)
    found = similar.TextSets(docs, any_id="id", alike=least)
    want, roots = groups_of(set(texts), Fraction(least))
    pairs = {frozenset((bytes(r.t1), bytes(r.t2))): (r.shared, r.total) for r in found.pairs().collect()}
    assert set(pairs) == {frozenset(map(md5, p)) for p in want}
    sizes = {frozenset(map(md5, p)): (len(grams(a) & grams(b)), len(grams(a) | grams(b))) for p in want for a, b in [tuple(p)]}
    assert pairs == sizes
    by_root = {}
    for t, r in roots.items():
        by_root.setdefault(r, set()).add(md5(t))
    got = {}
    for r in found.groups().collect():
        got.setdefault(bytes(r.root), set()).add(bytes(r.t))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, by_root.values()))
    assert all(min(own) == root for root, own in got.items())


@pytest.mark.parametrize("n", [300, 600])
def test_a_crowd_of_uneven_copies_loses_no_link(spark, n):
    rng = random.Random(n)
    texts = variants(rng, n, 40, 14)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string").repartition(6)
    found = similar.TextSets(docs, any_id="id")
    _, roots = groups_of(set(texts), Fraction("0.8"))
    got = {bytes(r.t): bytes(r.root) for r in found.groups().collect()}
    assert len(set(got.values())) == len(set(roots.values()))
    for t, r in roots.items():
        assert got[md5(t)] == got[md5(r)]


def test_a_crowd_isn_t_compared_pair_by_pair(spark, monkeypatch):
    texts = variants(random.Random(9), 500, 200, 6)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string")
    found = similar.TextSets(docs, any_id="id")
    compared = []
    inner = found.verified
    monkeypatch.setattr(found, "verified", lambda pairs: compared.append(pairs.count()) or inner(pairs))
    assert found.groups().select("root").distinct().count() == len(set(groups_of(set(texts), Fraction("0.8"))[1].values()))
    assert sum(compared) < 20 * len(texts)  # all pairs are 124,750


def test_a_passage_that_the_sample_misses_brings_no_texts_together(spark, monkeypatch):
    rng = random.Random(11)
    passage = [f"p{k}" for k in range(20)]
    texts = [" ".join([f"w{rng.randrange(10**9)}" for _ in range(80)] + passage) for _ in range(60)]
    near = texts[0].replace(" p19", " other")
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, near])], "id long, text string").repartition(4)
    monkeypatch.setattr(similar, "SAMPLE_ROWS", 1)
    found = similar.TextSets(docs, any_id="id")
    assert found.lists().select("s").distinct().count() == 2  # the two near copies, not the passage's texts
    got = {bytes(r.t): bytes(r.root) for r in found.groups().collect()}
    assert got[md5(near)] == got[md5(texts[0])] and len(set(got.values())) == 60


def test_partitions_do_not_each_send_their_most_frequent_tokens_to_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    plans = []
    inner = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: plans.append(self._jdf.queryExecution().executedPlan().toString()) or inner(self))
    docs = spark.createDataFrame([(k, " ".join(f"w{k // 6}x{j}" for j in range(30))) for k in range(120)], "id long, text string")
    assert similar.TextSets(docs, any_id="id").groups().count() == 20
    assert plans and not [p for p in plans if "TakeOrdered" in p]


def test_the_most_frequent_tokens(spark):
    rng = random.Random(8)
    rows = [(rng.getrandbits(63) - (1 << 62), n) for n, k in ((9, 3), (7, 40), (5, 4000)) for _ in range(k)]
    counts = spark.createDataFrame(rows, "token long, n long").repartition(5)
    for most in (0, 3, 43, 2000, 5000):
        got = [tuple(r) for r in similar.most_frequent(counts, most)]
        assert got == sorted(got) and set(got) <= set(rows)
        whole = [r for r in rows if sum(n >= r[1] for _, n in rows) <= most]
        assert set(whole) <= set(got) and abs(len(got) - min(most, len(rows))) <= 150


def test_sets_of_columns(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice("ab"), rng.sample("c d e f g h i j k l".split(), rng.randrange(0, 7))) for k in range(150)] + [(200, "a", ["c", "c", "d"]), (201, "a", ["d", "c"]), (202, "b", None)]
    frame = spark.createDataFrame(rows, "k long, g string, words array<string>")
    for least in ("0.4", "0.75", "1"):
        got = {(r.g, r.a, r.b, r.shared, r.total) for r in similar.set_pairs(frame, "k", "words", least, ["g"]).collect()}
        want = {(g, k, j, len(a & b), len(a | b)) for k, g, x in rows for j, h, y in rows if g == h and k < j for a, b in [(set(x or ()), set(y or ()))] if alike(a, b, Fraction(least))}
        assert got == want


def test_empty_table(spark):
    found = similar.TextSets(spark.createDataFrame([], "id long, text string"), any_id="id")
    assert found.pairs().count() == 0 and found.groups().count() == 0


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(300, 420)] + [(5, 5)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    frame = spark.createDataFrame(edges + edges[:5], "a long, b long")
    assert {(r.node, r.root) for r in component_labels(frame).collect()} == {(x, root(x)) for x in list(parent)}


def test_pairs_by_centres_are_those_of_whole_sets(spark):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choice(base) if rng.random() < 0.04 * (k % 3) else w for w in base) for k in range(30)] + [" ".join(f"x{k}y{j}" for j in range(20)) for k in range(3)] + ["one two", ""]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string")
    found = similar.TextSets(docs, any_id="doc_id")
    every = found.sets.select(F.col("s").alias("a")).crossJoin(found.sets.select(F.col("s").alias("b"))).where("a < b").localCheckpoint()
    want = sorted(map(tuple, found.verified(every).collect()))
    assert want and sorted(map(tuple, found._by_centres(every).collect())) == want


@pytest.mark.parametrize("most", [99, 6])
def test_clusters_of_rows_equal_those_of_exploded_lines(spark, most):
    rng = random.Random(9)
    line = lambda: rng.sample("abcdefghijkl", rng.randrange(2, 9))
    rows = [(None if k % 14 == 0 else k % 60, [line() for _ in range(rng.randrange(12))]) for k in range(90)] + [(7, None), (2000, None)]
    docs = spark.createDataFrame(rows, "d long, lines array<array<string>>").repartition(3)
    got = clusters.largest_clusters_of_rows(docs, "d", F.col("lines"), F.size("lines") > most)
    want = clusters.largest_clusters(docs.select("d", F.explode("lines").alias("t")), "d", "t")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_document_in_one_row_is_clustered_without_a_shuffle_of_its_tokens(spark):
    docs = spark.createDataFrame([(k, [["a", "b", "c", "d"], ["a", "b", "c", "e"], ["x", "y", "z", "w"]]) for k in range(20)], "d long, lines array<array<string>>")
    got = clusters.largest_clusters_of_rows(docs, "d", F.col("lines"), F.lit(False))
    assert {tuple(r)[1:] for r in got.collect()} == {(2, 2)} and got.count() == 20
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
