import gzip
import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from verilane.llm import warc

LONG = "<p>" + "long enough to be referred to " * 9 + "</p>"


def rows_of():
    rng = random.Random(3)
    out = [(k, f"http://h{k % 3}.org/{k}", "<html>" + " ".join(rng.choice("abcdef") for _ in range(rng.randrange(300))) + "</html>") for k in range(60)]
    out += [(k, "http://copy.org/", LONG) for k in range(200, 160, -1)] + [(k, None, "short") for k in range(300, 310)]
    out += [(400, "http://é.org/a b\r\nX: y", "é漢" * 100), (401, "", None), (402, "http://x", ""), (403, "http://big", "0123456789é" * 200_000), (-5, "u", "neg" * 50)]
    return out + [(500, "w", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 20), (None, "n", LONG), (None, "n", "only without an id " * 9), (163, "again", LONG), (161, "first twice", LONG)]


def plain(rows):
    least = {}
    for k, _, html in rows:
        if k is not None:
            least[html or ""] = min(k, least.get(html or "", k))
    out = []
    for k, _, html in rows:
        data = (html or "").encode()
        first = least.get(html or "")
        again = len(data) >= 100 and first is not None and k != first
        out.append((k, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def found(frame):
    return sorted((tuple(r) for r in frame.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


@pytest.fixture(scope="module")
def pages(spark):
    frame = spark.createDataFrame(rows_of(), "page_id long, url string, html string")
    return frame.withColumns({"digest": F.lit("clash"), "first": F.lit(1), "large": F.lit("x"), "m": F.create_map(F.lit("a"), F.lit(1))}).repartition(3)


def test_written_and_read_again(spark, pages, tmp_path):
    warc.write_archives(pages, str(tmp_path / "a"), file_rows=1)
    records = warc.read_archives(spark, str(tmp_path / "a"))
    assert records.where("damage is not null").count() == 0
    assert found(warc.resolved(records)) == plain(rows_of())
    bodies = {bytes(r.payload).decode() for r in records.where("record_type = 'response'").collect()}
    assert bodies == {html or "" for _, _, html in rows_of()}
    # the files are plain concatenations of gzip members
    for file in (tmp_path / "a").glob("part-*"):
        assert gzip.decompress(file.read_bytes()).startswith(b"WARC/1.1\r\n")


def test_a_lost_response_leaves_its_revisits_readable(spark, pages, tmp_path):
    warc.write_archives(pages, str(tmp_path / "a"))
    records = warc.read_archives(spark, str(tmp_path / "a"), with_payload=False)
    left = records.where("not (record_type = 'response' and record_id = '<urn:page:161>')")
    assert found(warc.resolved(left)) == sorted((r for r in plain(rows_of()) if r[:1] != (161,)), key=str)


def test_the_query_equals_its_sql(spark, tmp_path):
    one = {(r[0], r[2]): r for r in rows_of()}.values()
    spark.createDataFrame(list(one), "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert found(warc.query(spark, str(tmp_path))) == sorted(con.execute(warc.ORACLE_SQL).fetchall(), key=str) == plain(one)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert warc.query(spark, str(tmp_path)).count() == 0


def members(n, compressed):
    plain_ = [warc.record(k, f"http://x/{k}", f"body {k} ".encode() * 40) for k in range(n)]
    return [warc.member(r) for r in plain_] if compressed else plain_


def ids(data):
    return [int(re.findall(r"\d+", own.fields["warc-record-id"])[0]) for _, _, own, _ in warc.salvage(data) if own]


@pytest.mark.parametrize("compressed", [True, False])
def test_salvage_recovers_all_but_the_damaged_record(compressed):
    parts, rng = members(9, compressed), random.Random(5)
    starts = [sum(map(len, parts[:k])) for k in range(10)]
    for trial in range(200):
        data, hit = bytearray(b"".join(parts)), rng.randrange(9)
        at = starts[hit] + rng.randrange(len(parts[hit]))
        kind = trial % 4
        if kind == 0:
            data[at] ^= 1 << rng.randrange(8)
        elif kind == 1:
            del data[at : at + rng.randrange(1, 30)]
        elif kind == 2:
            data[at:at] = rng.randbytes(rng.randrange(1, 50))
        else:
            data = data[:at]
        got = ids(bytes(data))
        lost = set(range(9)) - set(got)
        assert got == sorted(set(got))
        assert lost <= ({hit, hit + 1} if kind == 1 else {hit} if kind < 3 else set(range(hit, 9)))
        # every byte is either a record's or in a quarantined gap, in order
        spans = sorted({(o, n) for o, n, _, _ in warc.salvage(bytes(data))})
        assert sum(n for _, n in spans) == len(data)
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
        assert all((own is None) == (reason is not None) for _, _, own, reason in warc.salvage(bytes(data)))


def test_salvage_of_junk_mixed_and_foreign_archives():
    a, b = members(3, True), members(3, False)
    assert ids(b"junk" + a[0] + b[1] + b"\x1f\x8b\x08 false start WARC/1.1\r\n" + a[2]) == [0, 1, 2]
    gaps = [(o, n, why) for o, n, own, why in warc.salvage(b"junk" + a[0] + b"tail") if own is None]
    assert [g[:2] for g in gaps] == [(0, 4), (4 + len(a[0]), 4)] and all(g[2] for g in gaps)
    assert list(warc.salvage(b"")) == []
    assert [r[2] for r in warc.salvage(b"nothing here")] == [None]
    whole = gzip.compress(b"".join(b))  # several records in one member
    assert ids(whole) == [0, 1, 2]
    old = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:page:7>\r\nX-Folded: a\r\n b\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (_, _, own, _), = warc.salvage(old)
    assert own.payload == b"abc" and own.fields["x-folded"] == "a b"


def test_a_large_record_ends_in_a_zero_byte_too():
    data = warc.member(warc.record(1, None, b"x" * (17 << 20)))
    assert data[-1] == 0 and ids(data + members(3, True)[2]) == [1, 2]


def test_gaps_reach_the_table(spark, tmp_path):
    parts = members(4, True)
    parts[1] = parts[1][:20] + b"\0" * 10 + parts[1][30:]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(parts))
    rows = warc.read_archives(spark, str(tmp_path)).orderBy("offset").collect()
    assert [r.record_id for r in rows] == ["<urn:page:0>", None, "<urn:page:2>", "<urn:page:3>"]
    assert rows[1].damage and (rows[1].offset, rows[1].length) == (len(parts[0]), len(parts[1]))
