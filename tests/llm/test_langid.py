import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from verilane.llm import langid
from verilane.llm.common import held_out, sampled

SYLLABLES = {"aa": ["the", "ing", "er", "th", "wh"], "bb": ["sch", "ung", "pf", "ü", "ei"], "cc": ["ción", "ñ", "ll", "que", "ado"]}


def text_of(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    rows = [(k, text_of(rng, lang, rng.choice([5, 60, 900])), lang) for k in range(n) for lang in [rng.choice(list(SYLLABLES))]]
    return rows + [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 --- 456", "cc"), (1003, text_of(rng, "cc", 40), None), (1004, text_of(rng, "bb", 40000), "bb")]


def test_convolution_equals_a_plain_loop():
    net = langid.ByteNet(["x", "y"])
    rng = np.random.default_rng(0)
    window = rng.integers(0, 256, (1, langid.WINDOW)).astype(np.uint8)
    pooled = net.pooled(window)[0]
    emb = net.embed[window[0]]
    for f in range(pooled.size):
        width = langid.WIDTHS[f // langid.FILTERS]
        kernel = net.conv[: width * langid.EMBEDDING, f].reshape(width, -1)
        best = max(float((emb[p : p + width] * kernel).sum()) for p in range(langid.WINDOW - max(langid.WIDTHS) + 1))
        assert abs(max(best, 0) - pooled[f]) < 1e-3


def test_held_out_accuracy_and_edges(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("held_out", F.lit(1))
    net = langid.train(docs)
    assert net.classes == ["aa", "bb", "cc"]
    out = {r.doc_id: r for r in langid.identify(docs, net).collect()}
    assert len(out) == len(rows)
    kept = [(k, lang) for k, t, lang in rows if k < 1000 and zlib.crc32(str(k).encode()) % 4 == 2]
    assert kept and sum(out[k].lang_pred == lang for k, lang in kept) >= 0.97 * len(kept)
    assert all(out[k].lang_pred == "und" and out[k].score == 0 for k in (1000, 1001, 1002))
    assert out[1003].lang_pred == "cc" and out[1004].lang_pred == "bb" and 0 < out[1004].score <= 1


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.train(empty) is None and langid.identify(empty, None).count() == 0
    unlabelled = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.identify(unlabelled, langid.train(unlabelled)).first().lang_pred == "und"


def test_sample_is_bounded_and_stable(spark):
    frame = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("g"))
    one = sampled(frame, ["g"], 100, 5).groupBy("g").count().collect()
    assert {r.g: r["count"] for r in one} == {"a": 100, "b": 100}
    ids = {r.doc_id for r in sampled(frame, ["g"], 100, 5).collect()}
    assert ids == {r.doc_id for r in sampled(frame.repartition(7), ["g"], 100, 5).collect()}
    out = spark.createDataFrame([(7,), (None,)], "doc_id long").select(held_out()).collect()
    assert [r[0] for r in out] == [zlib.crc32(b"7") % 4 == 2, False]


def test_numerals_are_no_letters(spark, tmp_path):
    docs = corpus(120) + [(2000, "\u00bd \u00b2", "aa"), (2001, "\u2460 \u216b", "bb"), (2002, "1\u00aa", "aa"), (2003, "\u4f60", None)]
    spark.createDataFrame([(*r, True) for r in docs], "doc_id long, text string, lang string, held_out boolean").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in langid.query(spark, str(tmp_path)).collect()}
    assert len(out) == len(docs) and all(out[k].lang_pred == "und" and out[k].score == 0 for k in (2000, 2001))
    assert out[2002].lang_pred != "und" and out[2003].lang_pred != "und"
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in out.items())
