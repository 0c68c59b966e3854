import random

from corpus_pipeline import STAGES, run
from verilane.llm import bpe, packing, quality, simhash, toxicity


def plain_run(docs, labels, spark):
    """The pipeline in plain Python, one document after another, with the same fitted models."""
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    good = {r.doc_id for r in quality.quality(frame, quality.train(frame, marks)).collect() if r.keep}
    model = toxicity.train(frame, marks)
    memo = model.memo()
    left = [d for d in docs if d[0] in good and model.score(d[1], memo) < toxicity.THRESHOLD]
    fps = {d[0]: simhash.fingerprint(d[1]) for d in left}
    root = {k: k for k in fps}
    for _ in range(len(fps)):
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 2:
                    root[a] = min(root[a], root[b])
        if all(root[root[k]] == root[k] for k in root):
            break
    enc = bpe.encoder(bpe.default_vocabulary())
    return {(d[0], n) for d in left if root[d[0]] == d[0] for n in [len(enc.encode(d[1])) + 1]}


def test_pipeline_against_a_plain_version(spark, tmp_path):
    rng = random.Random(3)
    docs, labels = [], []
    for k in range(160):
        words = ["".join(rng.choice(["ba", "do", "li", "ne", "ru"]) for _ in range(rng.randint(1, 4))) for _ in range(120)]
        bad, toxic = rng.random() < 0.2, rng.random() < 0.25
        for _ in range(3 * toxic):
            words[rng.randrange(120)] = "vileword"
        text = " ".join(words).upper() + "!!" if bad else " ".join(words)
        docs.append((k, text, "en", "s", len(text)))
        labels.append((k, int(not bad), int(toxic)))
    docs += [(200 + k, docs[k][1], "en", None, 1) for k in range(40)] + [(300, None, None, None, None), (301, "", "en", "s", 0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.doc_tokens) for r in out} == plain_run(docs, labels, spark)
    assert sum(r.length for r in out) == sum(n for _, n in {(r.doc_id, r.doc_tokens) for r in out})
    step = frame
    for name, stage in STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == frame.columns, name


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert run(spark, str(tmp_path)).count() == 0
    assert packing.CAPACITY == 2048
