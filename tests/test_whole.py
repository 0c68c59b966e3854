"""Queries that once stopped short of the whole job, against plain Python over all rows."""

import hashlib
import re

from verilane.plans import catalog


def tokens(name, least):
    return {t for t in re.split("[^a-z0-9]+", name.lower()) if len(t) >= least}


def test_token_jaccard_link_scores_every_file(spark, tmp_path):
    # the best file of part 9 is the eighth of its brand; part 20's only link is its type's token
    names = {k: f"only{k} word{k}" for k in range(1, 8)} | {8: "great red bolt", 9: "red bolt", 10: "red bolt", 11: "", 20: "none such", 21: "steel rod"}
    rows = [(k, n, "A" if k < 20 else "B", "STEEL" if k == 20 else "x") for k, n in names.items()] + [(30, "red bolt", "C", "red")]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    want = set()
    for k, name, brand, kind in rows:
        for src, v in ((1, tokens(name, 3)), (2, tokens(kind, 3))):
            own = [(len(v & f) / len(v | f), -o) for o, n, b, _ in rows if b == brand and o != k for f in [tokens(n, 3)] if v and f]
            if own and max(own)[0] >= 0.25:
                want.add((k, -max(own)[1], src, round(max(own)[0], 6)))
                break
    got = {tuple(r) for r in catalog.queries()["token_jaccard_link"](spark, str(tmp_path)).select("p_partkey", "file", "src", "score").collect()}
    assert got == want and (9, 10, 1, 1.0) in got and (20, 21, 2, 0.5) in got


def test_card_text_escapes_the_whole_text(spark, tmp_path):
    text = "a & b. " * 20 + '<i>"end"</i>'
    spark.createDataFrame([(1, text), (2, None), (3, "x" * 300 + "!")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in catalog.queries()["card_text"](spark, str(tmp_path)).collect()}
    assert out[1].escaped == "a &amp; b. " * 20 + "&lt;i&gt;&quot;end&quot;&lt;/i&gt;" and out[1].teaser == "a & b."
    assert out[2].escaped is None and out[3].escaped == "x" * 300 + "!" and out[3].teaser == "x" * 220


def test_stratified_sample_fills_what_a_stratum_lacks(spark, tmp_path):
    rows = [(k, "en") for k in range(100)] + [(k, "de") for k in range(100, 130)] + [(k, "fr") for k in range(200, 260)] + [(k, "es") for k in range(300, 305)]
    spark.createDataFrame(rows, "doc_id long, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    by_hash = sorted(rows, key=lambda r: (hashlib.md5(f"7-{r[0]}".encode()).hexdigest(), r[0]))
    want, left = [], []
    for lang, n in (("en", 40), ("de", 40), ("fr", 20), ("es", 20)):
        own = [r for r in by_hash if r[1] == lang]
        want, left = want + own[:n], left + own[n:]
    want += [r for r in by_hash if r in left][: 120 - len(want)]
    got = catalog.queries()["stratified_sample"](spark, str(tmp_path)).collect()
    assert len(want) == 120 and sorted((r.doc_id, r.lang) for r in got) == sorted(want)


def test_dup_finder_at_the_edges_of_ten(spark, tmp_path):
    # groups of 9 to 12 equal texts with one opening, near ones 49 to 51 characters longer, and another opening
    texts = [c * 3 for c, n in zip("abcd", (9, 10, 11, 12), strict=True) for _ in range(n)] + ["e" * 52, "f" * 53, "g" * 54, "h" * 104, "h" * 104]
    rows = [((7 * k) % 101, "o" * 40 + t) for k, t in enumerate(texts)] + [(200, "other"), (201, "other"), (202, "another")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for k, t in rows:
        own = [(-0.99 if t == u else -0.92, o) for o, u in rows if o != k and t[:40] == u[:40] and (t == u or abs(len(t) - len(u)) <= 50)]
        want |= {(k, o, -s, "high" if -s >= 0.90 else "possible") for s, o in sorted(own)[:10]}
    got = catalog.queries()["dup_finder_tiers"](spark, str(tmp_path)).select("doc_id", "other", "score", "tier").collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_weighted_score_compares_names_not_parts(spark, tmp_path, monkeypatch):
    # 40 parts of two names: the similarity join gets the names alone, and all pairs of a name's parts are scored
    from verilane.plans import joins

    rows = [(k, ["red bolt", "bolt red", "hot gear", "a"][k % 4], "A", f"T{k % 3}", k % 7) for k in range(40)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    met, join = [], joins.set_pairs
    monkeypatch.setattr(joins, "set_pairs", lambda sets, *more: (met.append(sets.count()), join(sets, *more))[1])
    classes = {}
    for k, n, _, t, z in rows:
        classes.setdefault((frozenset(tokens(n, 3)), t, z), []).append(k)
    own = [(min(ks), *c) for c, ks in classes.items() if c[0]]
    want = {(a, b, round(0.5 + 0.2 * (t == u) + 0.2 * (1.0 if y == z else 0.5 if abs(y - z) == 1 else 0.0), 3)) for a, n, t, y in own for b, m, u, z in own if a < b and n == m}
    got = catalog.queries()["weighted_score"](spark, str(tmp_path)).select("p_partkey", "candidate", "score").collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want and met == [2]


def test_monthly_rates_reads_a_claim_once(spark, tmp_path):
    from datetime import datetime

    rows = [(k, 4, datetime(1997, 11, 3)) for k in range(8)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    out = catalog.queries()["monthly_rates"](spark, str(tmp_path))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("month") <= 20
    assert sorted((r.o_orderkey, r.rate, r.total, r.months, r.flagged, r.implied) for r in out.collect()) == [(k, 104, 104 * (k + 1 + k % 4), k + 1, k % 4 == 2, float(k + 1 + k % 4)) for k in range(8) if k % 4 < 3]
