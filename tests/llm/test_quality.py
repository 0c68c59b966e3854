import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from verilane.llm import quality


def corpus(n=500):
    rng = random.Random(9)
    docs, labels = [], []
    for k in range(n):
        words = ["".join(rng.choice(["ba", "do", "li", "ne", "ru", "the"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(10, 200))]
        host = rng.choice(["good.example", "bad.example", None])
        bad = rng.random() < {"good.example": 0.1, "bad.example": 0.6, None: 0.2}[host]
        text = " ".join(words)
        if bad:
            text = rng.choice([text.upper() + "!!", " | ".join(words), " ".join(w for w in words for _ in range(10)), " ".join(w + "$$%" for w in words)])
        docs.append((k, text, rng.choice(["en", "de", None]), host))
        labels.append((k, int(not bad)))
    docs += [(1000, None, "en", "rare.example"), (1001, "", None, None), (1002, "plain words here and there " * 20_000, "en", "good.example"), (7, *docs[7][1:])]
    return docs, labels


def test_held_out_documents_and_edges(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("score", F.lit("clash")).withColumn("host", F.lit(1)).withColumn("p", F.lit(2))
    model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    out = quality.quality(docs, model).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    kept = [(k, y) for k, y in labels if zlib.crc32(str(k).encode()) % 4 == 2]
    assert np.mean([by[k].keep == y for k, y in kept]) > 0.97
    good = quality.keep_good(docs, model)
    assert good.columns == docs.columns and good.count() == sum(r.keep for r in out)


def test_rates_against_a_plain_loop(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(f"h{rng.randrange(6)}", f"p{rng.randrange(2)}", round(rng.random() ** (1 + k % 3), 3)) for k in range(400)] + [("lone", "p0", 0.9)]
    frame = spark.createDataFrame(rows, "host string, path string, p double")
    rates, rate, total = quality.path_rates(frame)
    assert total == len(rows)
    assert abs(rate - np.mean([r[2] for r in rows])) < 1e-9
    for r in rates.collect():
        own = [p for h, q, p in rows if (h, q) == (r.host, r.path)]
        assert r.n == len(own) and abs(r.s - sum(own)) < 1e-6 and abs(r.host_s - sum(p for h, _, p in rows if h == r.host)) < 1e-6
    out = quality.posteriors(frame).collect()
    one = rates.first()
    monkeypatch.setattr(quality, "HEAVY", 10)  # some paths hold over a tenth of all rows, others less
    assert 0 < rates.where("n * 10 > 401").count() < rates.count()
    parts = sorted(quality.posteriors(frame, 0).collect())
    assert len(parts) == len(out) and all(abs(a - b) < 1e-12 for x, y in zip(parts, sorted(out), strict=True) for a, b in zip(x[2:], y[2:], strict=True))
    assert len(out) == len(rows)
    for r in out:
        hosts, paths = [p for h, _, p in rows if h == r.host], [p for h, q, p in rows if (h, q) == (r.host, r.path)]
        host = (sum(hosts) - r.p + one.host_weight * rate) / (len(hosts) - 1 + one.host_weight)
        path = (sum(paths) - r.p + one.path_weight * host) / (len(paths) - 1 + one.path_weight)
        p = min(max(r.p, 1e-13), 1 - 1e-13)
        odds = np.log(p / (1 - p)) + np.log(path / (1 - path)) - np.log(rate / (1 - rate))
        assert abs(r.score - 1 / (1 + np.exp(-odds))) < 1e-9


def test_sparse_hosts_shrink_to_the_global_rate(spark):
    rows = [("good", "a", 0.95)] * 300 + [("bad", "a", 0.05)] * 300 + [("rare", "a", 0.05)]
    rates, rate, _ = quality.path_rates(spark.createDataFrame(rows, "host string, path string, p double"))
    weight = rates.first().host_weight
    assert weight == quality.LEAST_WEIGHT and abs(rate - 0.5) < 0.01


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text", "en", "s"), (2, None, None, None)], "doc_id long, text string, lang string, source string")
    model = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r.keep for r in quality.quality(docs, model).collect()] == [1, 1] and quality.keep_good(docs, model).count() == 2
    assert quality.quality(docs.limit(0), model).count() == 0 and quality.keep_good(docs.limit(0), model).count() == 0


def test_query(spark, tmp_path):
    rows, labels = corpus(120)
    spark.createDataFrame([(*r, "x") for r in rows] + [(None, "words of a null id", "en", "s", "x")], "doc_id long, text string, lang string, source string, keep string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    out = quality.query(spark, str(tmp_path)).collect()
    assert len(out) == len(rows) + 1 and all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
