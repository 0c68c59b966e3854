import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from verilane.llm import audio


def plain_crc(data):
    crc = 0xFFFF
    for byte in data:
        for bit in range(7, -1, -1):
            top = crc >> 15 ^ byte >> bit & 1
            crc = crc << 1 & 0xFFFF ^ (0x8005 if top else 0)
    return crc


@pytest.mark.parametrize("size", [64, 896, 922, 960, 1024, 922 * 32, 64 * 1000, 64 * 4001])
def test_round_trip_is_lossless(size):
    data = random.Random(size).randbytes(size)
    data = data[:30] + b"\xff\xfa\xe4\x00ID3TAG\xff\xfb" + data[42:]
    blob = audio.store(data)
    found = audio.read(blob)
    assert audio.payload(blob, found) == data and found.skipped == found.failed == 0 and found.checked == len(found.offsets)
    assert found.table["frames"] == len(found.offsets) and found.table["bytes"] == len(blob) - found.table["offset"]
    assert found.samples == 1152 * len(found.offsets) and found.seconds == found.samples / 48000
    for k, at in enumerate(found.offsets):
        assert found.seek(1152 * k) == found.seek(1152 * k + 1151) == at


def test_checksums_by_bits():
    rows = np.random.default_rng(0).integers(0, 256, (50, 34)).astype(np.uint8)
    assert [plain_crc(bytes(r)) for r in rows] == audio.checksums(rows).tolist()


def test_damage_tags_and_resynchronisation():
    data = random.Random(1).randbytes(64 * 200)
    blob = audio.store(data)
    found = audio.read(blob)
    third = found.offsets[3]
    noise = b"\xff\xfa\xe4" + bytes(50) + b"\xff\xff\xff"
    broken = audio.read(blob[:third] + noise + blob[third:])
    # what follows the noise is found again at its new place, frame by frame
    assert broken.skipped > 0 and [at + len(noise) for at in found.offsets[3:]] == [at for at in broken.offsets if at > third]
    flipped = bytearray(blob)
    flipped[third + 20] ^= 1
    assert audio.read(bytes(flipped)).failed == 1
    tagged = audio.read(blob + b"TAG" + b"Name".ljust(30, b"\0") + b"Who".ljust(30, b"\0") + bytes(65))
    assert tagged.tags["v1.title"] == "Name" and len(tagged.offsets) == len(found.offsets) and tagged.skipped == 0
    cut = audio.read(blob[:-5])
    assert len(cut.offsets) == len(found.offsets) - 1 and cut.skipped > 0
    assert audio.read(b"").offsets == [] and audio.read(b"\xff" * 500).offsets == [] and audio.read(b"ID3").skipped == 3


def test_columns(spark):
    rows = [(1, None), (2, ""), (3, "é" * 32), (4, "a" * 64), (5, "b" * 65), (6, "long text " * 200_000), (4, "a" * 64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit("clash"))
    media = audio.with_media(docs)
    out = audio.digests(media).collect()
    assert len(out) == len(rows)
    texts = dict(rows)
    for r in out:
        raw = (texts[r.doc_id] or "").encode()
        pay = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
        blob = audio.store(pay)
        assert (r.media_bytes, r.media_sha256) == (len(blob), hashlib.sha256(blob).hexdigest())
    index = {r.doc_id: r for r in audio.frame_index(media).collect()}
    assert index[6].samples == 1152 * len(index[6].offsets) and index[6].tags["payload_bytes"] == "2000000" and index[6].failed == 0
    assert audio.digests(audio.with_media(docs.limit(0))).count() == 0


def test_text_that_looks_like_a_trailing_tag(spark):
    texts = {n: ("xyTAG" + "z" * 200)[:n] for n in (65, 100, 128)}
    for text in texts.values():
        blob = audio.store(audio.payload_of(text)[0])
        assert blob[-128:-125] == b"TAG"
        found = audio.read(blob)
        assert audio.payload(blob, found) == audio.payload_of(text)[0] and found.skipped == 0 and not any(k.startswith("v1.") for k in found.tags)
        tagged = audio.read(blob + b"TAG" + b"Name".ljust(125, b"\0"))
        assert tagged.tags["v1.title"] == "Name" and tagged.offsets == found.offsets and tagged.skipped == 0
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in audio.digests(audio.with_media(docs)).collect():
        assert (r.payload_bytes, r.payload_sha256) == (128, hashlib.sha256(audio.payload_of(texts[r.doc_id])[0]).hexdigest())


def test_foreign_files_and_the_bound_of_remembered_headers(spark, tmp_path):
    import numpy as np

    from verilane.llm import audio

    plain = audio.store(b"x" * 640)
    no_tag = plain[len(audio.id3({audio.LENGTH_TAG: "640"})) :]
    assert audio.payload(no_tag, audio.read(no_tag)).startswith(b"x" * 640)
    wrong = audio.id3({audio.LENGTH_TAG: "many"}) + no_tag
    assert audio.payload(wrong, audio.read(wrong)).startswith(b"x" * 640)
    noise = np.random.default_rng(1).integers(0, 256, 400_000, dtype=np.uint8)
    noise[::3] = 255
    assert audio.read(noise.tobytes()).skipped > 0 and audio.header.cache_info().currsize <= 1 << 14
    assert audio.payload(b"", audio.read(b"")) == b""
    spark.createDataFrame([(1, "text", "x"), (None, None, None)], "doc_id long, text string, feature string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in audio.query(spark, str(tmp_path)).collect()}
    assert out[1].n_bytes == 4 and out[None].n_bytes == 0 and out[None].payload_bytes == 64
