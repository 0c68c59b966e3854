"""WARC archives: writing pages with revisits, and a reader that salvages what damaged archives still hold.

Writing. A page becomes a response record: WARC headers, an HTTP head and the payload. Of pages with equal payloads of at least REVISIT_BYTES the one
with the smallest id is the response; the others are revisit records that name it and keep the HTTP head only. Each record is a gzip member
of its own. Files are written by Spark's text writer, which commits them whole or not at all on any file system: a member
ends in the highest byte of its length, which is zero under 16 MB (a larger record is followed by an empty member, whose last byte is zero), so a
row is some members without the last byte, and the writer's line separator is that byte.

Reading. A file is walked from its start. Where a gzip member or a version line begins, the records are checked: the member's own checksum and length,
the version line, the header's fields, Content-Length, the end of the record and both digests. After a failed check the reader searches for the next
position at which a member or a version line begins and everything checks, goes on from there, and logs the bytes between as a quarantined gap
with the first failure as its reason. Members and plain records may be mixed in one file.

Scale. Payloads are compressed where they are scanned. What is known of equal payloads is one row for each payload that occurs more than once, written to the shared
folder, so that the planner sees its size and broadcasts it below its own limit, and else shuffles. A file has at most
FILE_ROWS rows of ROW_BYTES or one larger record each; a reader's task holds one file, a batch of rows and one record at a time. Revisits meet their responses in a join of small rows.

Nulls and ties: a null html is an empty payload. A null id is after all others, so it is a response only if no row with an id has its payload; rows that share the smallest id
and the payload are all responses. A null or odd url is percent-encoded or left out. Only the three named columns are read, whatever else the table
has. An empty table gives an empty archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, map_batches, shared_folder, spread, table

REVISIT_BYTES = 100
#: A row of the writer holds members up to this many bytes, or one larger member; a file has at most so many rows.
ROW_BYTES, FILE_ROWS = 1 << 20, 32
#: Archives say no other time, so that equal pages give equal bytes.
DATE = "2000-01-01T00:00:00Z"
VERSION, END = b"WARC/1.1", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MAGIC = b"\x1f\x8b\x08"
#: A record's header is at most this long, and its version line is one of these.
_HEADER_BYTES = 1 << 16
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_DIGESTS = {"sha256": hashlib.sha256, "sha1": hashlib.sha1, "md5": hashlib.md5}
_RECORD_ID = re.compile(r"<urn:page:(-?\d+)>")


# --- writing


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One record; refers_to makes it a revisit."""
    digest = hashlib.sha256(payload).hexdigest()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{page_id if page_id is not None else 'null'}>"), ("WARC-Date", DATE)]
    if url:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~-._", errors="replace")))
    if refers_to is None:
        block += payload
    else:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + END


def member(data: bytes) -> bytes:
    """data as a gzip member whose last byte is zero, with an empty member after it if need be."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = packer.compress(data) + packer.flush()
    return out if out[-1] == 0 else out + member(b"")


def _members(batches):
    def row(members):
        return pa.RecordBatch.from_arrays([pa.array([b"".join(members)[:-1]], pa.binary())], ["members"])

    waiting, size = [], 0
    for batch in batches:
        for cells in zip(*batch.columns, strict=True):  # one row's bytes at a time
            page_id, url, html, refers_to = (c.as_py() for c in cells)
            waiting.append(member(record(page_id, url and url.decode("utf-8", "replace"), html or b"", refers_to)))
            size += len(waiting[-1])
            if size >= ROW_BYTES:
                yield row(waiting)
                waiting, size = [], 0
    if waiting:
        yield row(waiting)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_rows: int = FILE_ROWS) -> None:
    """The pages as gzip-compressed WARC files under path."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").cast("binary").alias("url"), payload.alias("html"), (F.octet_length(payload) >= REVISIT_BYTES).alias("large"), F.sha2(payload, 256).alias("digest"))
    equal = own.where("large").groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1 and first is not null")
    known = f"{path}-equal-payloads"
    equal.select("digest", "first").write.parquet(known)
    # a small payload looks for a digest that isn't there, by its row, so that none of them is a hot key
    own = own.withColumn("digest", F.when(F.col("large"), F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce("page_id", F.lit(0)))))
    marked = own.join(spark.read.schema("digest string, first long").parquet(known), "digest", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = map_batches(marked.select("page_id", "url", "html", refers.alias("refers_to")), _members, "members binary")
    rows.select(F.col("members").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", str(file_rows)).text(path)


# --- reading


class Damaged(Exception):
    """What a check found wrong."""


@dataclass
class Record:
    fields: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        """What follows the HTTP head, or the block of a record that isn't HTTP."""
        if not self.fields.get("content-type", "").startswith("application/http"):
            return self.block
        return self.block.partition(END)[2]

    def check(self) -> None:
        for name, data in (("warc-block-digest", self.block), ("warc-payload-digest", self.payload)):
            kind, _, said = self.fields.get(name, "").partition(":")
            # a revisit names the payload of the record that it refers to
            if kind.lower() in _DIGESTS and not (name == "warc-payload-digest" and self.fields["warc-type"] == "revisit"):
                found = _DIGESTS[kind.lower()](data)
                if said.lower() != found.hexdigest() and said.upper() != base64.b32encode(found.digest()).decode():
                    raise Damaged(f"{name} differs")


def parse(data: bytes, at: int) -> tuple[Record, int]:
    """The record at a version line of data and the position after it."""
    head = data.find(END, at, at + _HEADER_BYTES)
    if head < 0:
        raise Damaged("header without an end")
    lines = data[at:head].split(b"\r\n")
    if lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise Damaged("no version line")
    fields: dict[str, str] = {}
    last = ""
    for line in lines[1:]:
        if line[:1] in (b" ", b"\t") and last:  # a folded value
            fields[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise Damaged("header line without a name")
        last = name.decode().lower()
        fields[last] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not re.fullmatch(r"\d{1,18}", length) or "warc-type" not in fields or "warc-record-id" not in fields:
        raise Damaged("header without its fields")
    start, end = head + len(END), head + len(END) + int(length)
    if end + len(END) > len(data):
        raise Damaged("record cut short")
    if data[end : end + len(END)] != END:
        raise Damaged("record doesn't end where it says")
    found = Record(fields, data[start:end])
    found.check()
    return found, end + len(END)


def _member_at(data: memoryview, at: int) -> tuple[bytes, int]:
    """A gzip member's content, checked by its own checksum, and the position after it."""
    engine, out, pos = zlib.decompressobj(31), [], at
    try:
        while not engine.eof and pos < len(data):
            out.append(engine.decompress(data[pos : pos + (1 << 16)]))
            pos += 1 << 16
    except zlib.error as wrong:
        raise Damaged(f"member: {wrong}") from None
    if not engine.eof:
        raise Damaged("member cut short")
    return b"".join(out), min(pos, len(data)) - len(engine.unused_data)


def _records_at(data: bytes, view: memoryview, at: int) -> tuple[list[Record], int]:
    if data.startswith(_MAGIC, at):
        content, end = _member_at(view, at)
        found, pos = [], 0
        while pos < len(content):
            own, pos = parse(content, pos)
            found.append(own)
        return found, end
    if data.startswith(b"WARC/", at):
        own, end = parse(data, at)
        return [own], end
    raise Damaged("no member and no version line")


def salvage(data: bytes) -> Iterator[tuple[int, int, Record | None, str | None]]:
    """Offset, length, record and reason: the records of an archive in order, and as rows without a record the gaps with what was wrong there."""
    at, view = 0, memoryview(data)
    gap, reason = None, None
    while at < len(data):
        try:
            found, end = _records_at(data, view, at)
        except Damaged as wrong:
            if gap is None:
                gap, reason = at, str(wrong)
            onward = _START.search(data, at + 1)
            at = onward.start() if onward else len(data)
            continue
        if gap is not None:
            yield gap, at - gap, None, reason
            gap = None
        for own in found:
            yield at, end - at, own, None
        at = end
    if gap is not None:
        yield gap, len(data) - gap, None, reason


_READ = "file string, offset long, length long, damage string, record_type string, record_id string, target_uri string, refers_to string, http_length long, said_digest string, payload_bytes long, payload_digest string, payload binary"
_HTTP_LENGTH = re.compile(rb"\r\nContent-Length:\s*(\d{1,18})\r\n", re.I)


def _row(file: str, offset: int, length: int, own: Record | None, damage: str | None, with_payload: bool) -> tuple:
    if own is None:
        return (file, offset, length, damage, *[None] * 9)
    f, payload = own.fields, own.payload
    http = _HTTP_LENGTH.search(own.block.partition(END)[0] + b"\r\n")
    return (file, offset, length, None, f["warc-type"], f["warc-record-id"], f.get("warc-target-uri"), f.get("warc-refers-to"), int(http[1]) if http else None, f.get("warc-payload-digest"), len(payload), hashlib.sha256(payload).hexdigest(), payload if with_payload else None)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row for each record, and for each gap one with damage and the other columns null, of the WARC files under path."""
    names = [c.rsplit(" ", 1) for c in _READ.split(", ")]
    kinds = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[k]) for n, k in names])

    def read(batches):
        for batch in batches:
            for file, content in zip(*batch.columns, strict=True):
                rows, size = [], 0
                for found in salvage(content.as_py() or b""):
                    rows.append(_row(file.as_py(), *found, with_payload))
                    size += len(rows[-1][-1] or b"") + 500
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in rows], kinds)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in rows], kinds)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!._]*").load(path)
    return map_batches(files.select("path", "content"), read, _READ)


def resolved(records: DataFrame) -> DataFrame:
    """Records of write_archives by page_id, revisits with the payload of the response that they refer to, or with what they say of it if that is lost."""
    page = lambda c: F.regexp_extract(c, _RECORD_ID.pattern, 1).cast("string")
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    own = records.where("damage is null").select(number(F.col("record_id")).alias("page_id"), "record_type", number(F.col("refers_to")).alias("refers_to"), "http_length", F.regexp_extract("said_digest", "^sha256:(.*)$", 1).alias("said"), "payload_bytes", "payload_digest")
    responses = own.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("said"), F.col("payload_bytes").alias("n")).distinct()
    joined = own.where("record_type = 'revisit'").join(responses, ["refers_to", "said"], "left").select("page_id", F.coalesce("n", "http_length").alias("payload_bytes"), F.col("said").alias("payload_digest"), "record_type", "refers_to")
    return own.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").unionByName(joined)


def query(spark, sf_dir: str) -> DataFrame:
    """Every page from archives written and read again."""
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(spread(table(spark, sf_dir, "pages")), path)
    return resolved(read_archives(spark, path, with_payload=False))


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM (SELECT *, payload_bytes >= {REVISIT_BYTES} AND page_id IS DISTINCT FROM first AS again FROM f)
"""
