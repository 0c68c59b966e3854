import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from verilane.llm import bpe, packing

PATH = bpe.default_vocabulary()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


ROWS = [
    (1, None), (2, ""), (3, "   "), (4, "It's they'll I'D 2024 -- a<|endoftext|>b <|startoftext|>"), (5, "Große Ñandú été 你好 ΑΣ İ é\x1cx\xa0y"),
    (6, "inthanre " * 4000), (7, "x" * 3000), (8, "a b"), (8, "a b"), (9, "՘ ႔0 ẹ́"),
]


def test_ids_equal_the_library(library):
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz'0123!?.éßΣİ<|>endoftext \n\x85 "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [t or "" for _, t in ROWS]
    texts += ["".join(rng.choice("ab") for _ in range(n)) for n in range(60)] + ["th" * n + "e" * n for n in range(40)]
    enc = bpe.encoder(PATH)
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        got = enc.encode(text)
        assert got == want.ids and enc.decode(got) == library.decode(want.ids, skip_special_tokens=False)


def test_every_code_point_is_classed_as_in_the_library(library):
    enc = bpe.encoder(PATH)
    points = [chr(c) for c in [*range(0x3000), *range(0x3000, 0x110000, 97)] if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b e{c} {c}́ {c}" for c in points]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert enc.encode(text) == want.ids, hex(ord(text[1]))


def test_digests(spark, library):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    out = bpe.digests(docs, PATH).collect()
    assert len(out) == len(ROWS)
    texts = dict(ROWS)
    for r in out:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("capacity", [2048, 16])
def test_pieces_cover_all_ids_without_padding(spark, library, capacity):
    rng = random.Random(2)
    rows = ROWS[:7] + [(10 + k, " ".join(rng.choice(["the", "of", "x1"]) for _ in range(rng.randint(0, 300)))) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("offset", F.lit("clash"))
    out = packing.pack(docs, PATH, capacity).collect()
    own, placed = defaultdict(list), defaultdict(list)
    for r in out:
        own[r.doc_id].append(r)
        placed[r.sequence_id].append((r.offset, r.length))
    for key, text in rows:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(own[key], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            at += r.length
            assert r.ids_crc32 == zlib.crc32(ids[r.start : at].tobytes())
        assert at == len(ids)
    for pieces in placed.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity and end & end - 1 == 0


def test_packing_edges(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert packing.piece_lengths(0) == [] and packing.piece_lengths(5000) == [2048, 2048, 512, 256, 128, 8]
    with pytest.raises(ValueError):
        packing.Bins(0, 100)


def test_a_vocabulary_without_some_byte_is_refused(tmp_path):
    import json

    with open(PATH, encoding="utf-8") as file:
        spec = json.load(file)
    spec["model"]["vocab"] = {"a": 0, "a</w>": 1, "b": 2}
    spec["model"]["merges"], spec["added_tokens"] = [], []
    (tmp_path / "small.json").write_text(json.dumps(spec))
    enc = bpe.Encoder(str(tmp_path / "small.json"))
    assert enc.encode("aa a") == [0, 1, 1]
    for text in ("ax", "ab", "b", "x"):
        with pytest.raises(ValueError):
            enc.encode(text)


def test_query_columns(spark, tmp_path, library):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("length", F.lit("clash"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.n_tokens for r in bpe.query(spark, str(tmp_path)).collect()) == sorted(len(library.encode(t or "", add_special_tokens=False).ids) for _, t in ROWS)
    out = packing.query(spark, str(tmp_path)).collect()
    assert sum(r.length for r in out) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ROWS)


def test_what_a_worker_remembers_is_bounded_within_a_batch_too(library):
    texts = [" ".join(f"w{k}x{n}" for k in range(50)) for n in range(4)]
    ids = packing.RunIds(PATH, 20)
    for _ in range(2):
        found, bounds = ids.of(pa.array(texts))
        for text, start, end in zip(texts, bounds, bounds[1:], strict=False):
            assert found[start:end].tolist() == library.encode(text, add_special_tokens=False).ids + [packing.END]
    assert len(ids.runs) <= 20 and len(ids.pieces) <= 20
