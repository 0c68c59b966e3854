import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from verilane.llm import toxicity
from verilane.llm.toxicity import Model

BAD = ["vileword", "grimzed"]


def corpus(n=400):
    rng = random.Random(4)
    docs, labels = [], []
    for k in range(n):
        words = ["".join(rng.choice(["ba", "do", "li", "ne", "ru"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.choice([8, 60, 300]))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(2):
                words[rng.randrange(len(words))] = rng.choice(BAD) + rng.choice(["", "ish", "ly"])
        docs.append((k, "".join(w + rng.choice([" ", " ", " ", ". ", "\n"]) for w in words)))
        labels.append((k, toxic))
    docs += [(1000, None), (1001, ""), (1002, "123 !!"), (1003, "vileword. " * 50_000), (1004, "bado line " * 60_000), (3, docs[3][1])]
    return docs, labels + [(1004, None), (5, labels[5][1])]


def test_held_out_documents_and_edges(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("label", F.lit(9))
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = {r.doc_id: r.score for r in toxicity.scores(docs, model).collect()}
    assert toxicity.scores(docs, model).count() == len(rows) and all(0 <= s <= 1 for s in out.values())
    kept = [(k, y) for k, y in labels if k < 1000 and zlib.crc32(str(k).encode()) % 4 == 2]
    assert np.mean([(out[k] >= toxicity.THRESHOLD) == y for k, y in kept]) > 0.97
    assert out[1000] == out[1001] == out[1002] == 0 and out[1003] > 0.9 and out[1004] < toxicity.THRESHOLD
    clean = toxicity.keep_clean(docs, model)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {k for k, s in out.items() if s < toxicity.THRESHOLD}
    spans = toxicity.offending_sentences(docs.where("doc_id < 1000"), model).collect()
    texts = dict(rows)
    assert spans and all(any(w in r.sentence.lower() for w in BAD) and texts[r.doc_id][r.start : r.end] == r.sentence for r in spans)


def test_noisy_or_by_hand():
    model = Model({"=bad": 6.0}, -4.0)
    p = 1 / (1 + np.exp(-2.0))
    one = (p - toxicity.FLOOR) / (1 - toxicity.FLOOR)
    assert abs(model.score("Bad day. Fine", model.memo()) - one) < 1e-9
    assert abs(model.score("bad bad! ok\nso BAD", model.memo()) - (1 - (1 - one) ** 2)) < 1e-9
    assert model.score("fine. " * 10_000, model.memo()) == 0


def test_copies_count_once():
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(100)) for _ in range(20)]
    assert toxicity.without_copies([toxicity.copy_marks(t) for t in texts for _ in range(5)]) == list(range(0, 100, 5))


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, none)
    assert toxicity.scores(docs, model).first().score == 0
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.scores(empty, model).count() == 0 and toxicity.keep_clean(empty, model).count() == 0


def test_long_labelled_texts_train_and_the_screen_by_sql_equals_the_plain_one(spark):
    filler = "bado line of neru " * 3000  # over 20,000 characters each
    rows = [(k, filler + (f" vileword {k} ." if k % 3 == 0 else f" kind word {k} .")) for k in range(60)]
    docs = spark.createDataFrame([(k, f"{t} u{k}a u{k}b u{k}c " + " ".join(f"z{k}y{j}" for j in range(60))) for k, t in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(k, int(k % 3 == 0)) for k, _ in rows], "doc_id long, toxic int"))
    assert model.word_weight("vileword") > 0
    assert toxicity.screened({"=bad": (0, 1)}, 20, 2, 3) and not toxicity.screened({"=bad": (0, 1)}, 20, 2, 10**6)


def test_few_features(spark):
    rows = [(k, "good day") for k in range(1, 20)] + [(k, "bad") for k in range(100, 108)]
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, int(k >= 100)) for k, _ in rows], "doc_id long, toxic int"))
    assert model.word_weight("bad") > 0 and model.word_weight("good") == 0


def test_offending_sentences_of_nothing(spark):
    docs = spark.createDataFrame([(1, None), (None, "bad"), (2, "")], "doc_id long, text string")
    out = toxicity.offending_sentences(docs, Model({"=bad": 9.0}, -4.0)).collect()
    assert [(r.doc_id, r.sentence) for r in out] == [(None, "bad")]
    assert toxicity.offending_sentences(docs, Model()).count() == 0


def test_query(spark, tmp_path):
    rows, labels = corpus(120)
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, predicted int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = toxicity.query(spark, str(tmp_path)).collect()
    assert len(out) == len(rows) and all(r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
