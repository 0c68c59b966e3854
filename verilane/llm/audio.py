"""MPEG audio as a media column: writing, resynchronising and indexing frames.

Stored form. A payload is carried by MPEG-1 Layer III frames at 48 kHz, stereo, each with a checksum. The side information says
that no frame has any main data, so all of them are silent, and the payload lies in the frames' ancillary bytes. An
ID3v2.4 tag names the payload's length; the first frame holds a variable-bitrate table (frames, bytes, a hundred
seek points). Full frames have the highest bitrate, the last one the lowest that holds the rest.

Reading. Tags at both ends are parsed. From the first byte after them, a frame header counts if its fields are valid and another
valid header of the same stream, or the end, follows at the distance it names; else the reader moves on to the next sync
byte and counts what it skipped. Checksums of all frames are verified at once. Durations are exact numbers of samples;
the frames' offsets are the seek table.

Contract: a null text counts as empty. The payload is the text's UTF-8 bytes and zero bytes up to a positive multiple of 64. Equal texts
give equal bytes and values; repeated rows are stored each by themselves. One text's memory is a few times its own length.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, spread, table

UNIT = 64
#: kbit/s by index of MPEG-1 Layer III, and of MPEG-2 and 2.5; sampling rates by index of MPEG-1. Fixed values of the format.
BITRATES_1 = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
BITRATES_2 = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
RATES = (44100, 48000, 32000)
_HEAD, _CRC = 4, 2
TABLE_POINTS = 100
LENGTH_TAG = "payload_bytes"


@dataclass(frozen=True)
class Header:
    mpeg1: bool
    quarter: bool
    protected: bool
    bitrate: int
    rate: int
    padded: bool
    mono: bool

    @property
    def samples(self) -> int:
        return 1152 if self.mpeg1 else 576

    @property
    def size(self) -> int:
        return self.samples // 8 * self.bitrate * 1000 // self.rate + self.padded

    @property
    def side(self) -> int:
        """Bytes of side information."""
        return (17 if self.mono else 32) if self.mpeg1 else (9 if self.mono else 17)

    def same_stream(self, other: Header) -> bool:
        return (self.mpeg1, self.quarter, self.rate, self.mono) == (other.mpeg1, other.quarter, other.rate, other.mono)


@lru_cache(1 << 14)
def header(word: bytes) -> Header | None:
    """The fields of four bytes, or None if they are no Layer III header with a length."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer, index, rate = word[1] >> 3 & 3, word[1] >> 1 & 3, word[2] >> 4, word[2] >> 2 & 3
    if version == 1 or layer != 1 or index in (0, 15) or rate == 3:
        return None
    mpeg1 = version == 3
    return Header(mpeg1, version == 0, not word[1] & 1, (BITRATES_1 if mpeg1 else BITRATES_2)[index], RATES[rate] >> (0 if mpeg1 else 1 if version == 2 else 2), bool(word[2] >> 1 & 1), word[3] >> 6 == 3)


@cache
def _crc_steps() -> np.ndarray:
    """One step of CRC-16 with polynomial 0x8005 for every high byte."""
    out = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        out = np.where(out & 0x8000, out << 1 ^ 0x8005, out << 1) & 0xFFFF
    return out


def checksums(rows: np.ndarray) -> np.ndarray:
    """The frame checksum of each row of covered bytes: the header's last two and the side information."""
    steps, crc = _crc_steps(), np.full(len(rows), 0xFFFF, np.uint32)
    for column in rows.T:
        crc = (crc << 8 & 0xFFFF) ^ steps[crc >> 8 ^ column]
    return crc


# --- writing


def _header_bytes(index: int) -> bytes:
    return bytes([0xFF, 0xFA, index << 4 | 1 << 2, 0x00])


@cache
def _frame_start(index: int) -> bytes:
    """Header, checksum and silent side information of a frame of a bitrate."""
    head = _header_bytes(index)
    side = bytes(header(head).side)
    crc = int(checksums(np.frombuffer(head[2:] + side, np.uint8)[None])[0])
    return head + crc.to_bytes(2, "big") + side


@cache
def _room(index: int) -> int:
    return header(_header_bytes(index)).size - len(_frame_start(index))


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def id3(values: dict[str, str]) -> bytes:
    """An ID3v2.4 tag of user text frames in UTF-8."""
    frames = b""
    for name, value in values.items():
        body = b"\x03" + name.encode() + b"\0" + value.encode()
        frames += b"TXXX" + _syncsafe(len(body)) + b"\0\0" + body
    return b"ID3\x04\0\0" + _syncsafe(len(frames)) + frames


def payload_of(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode("utf-8", "replace")
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data)), len(data)


def store(payload: bytes) -> bytes:
    """The payload as a whole file."""
    top = len(BITRATES_1) - 1
    start, room = _frame_start(top), _room(top)
    whole = len(payload) // room
    parts = [x for k in range(whole) for x in (start, payload[k * room : (k + 1) * room])]
    sizes = [header(_header_bytes(top)).size] * whole
    if rest := payload[whole * room :]:
        index = next(k for k in range(1, top + 1) if _room(k) >= len(rest))
        parts += [_frame_start(index), rest, bytes(_room(index) - len(rest))]
        sizes.append(header(_header_bytes(index)).size)
    first = next(k for k in range(1, top + 1) if _room(k) >= 4 + 4 + 4 + 4 + TABLE_POINTS)
    first_size = header(_header_bytes(first)).size
    total = first_size + sum(sizes)
    offsets = first_size + np.concatenate([[0], np.cumsum(sizes)])
    at = np.minimum(np.arange(TABLE_POINTS) * len(sizes) // TABLE_POINTS, len(sizes) - 1)
    toc = (offsets[at] * 256 // total).astype(np.uint8).tobytes()
    table_body = b"Xing" + (7).to_bytes(4, "big") + len(sizes).to_bytes(4, "big") + total.to_bytes(4, "big") + toc
    return id3({LENGTH_TAG: str(len(payload))}) + _frame_start(first) + table_body + bytes(_room(first) - len(table_body)) + b"".join(parts)


# --- reading


@dataclass
class Audio:
    """What a file holds. offsets has one entry for each audio frame; the frame of the table is not among them."""

    tags: dict[str, str] = field(default_factory=dict)
    table: dict[str, object] | None = None
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    skipped: int = 0
    checked: int = 0
    failed: int = 0

    @property
    def samples(self) -> int:
        return sum(h.samples for h in self.headers)

    @property
    def rate(self) -> int:
        return self.headers[0].rate if self.headers else 0

    @property
    def seconds(self) -> float:
        return self.samples / self.rate if self.rate else 0.0

    def seek(self, sample: int) -> int:
        """The offset of the frame with that sample."""
        return self.offsets[min(sample // self.headers[0].samples, len(self.offsets) - 1)]


def _read_id3(data: bytes) -> tuple[dict[str, str], int]:
    """The text frames of a leading tag, and where it ends."""
    if data[:3] != b"ID3" or len(data) < 10:
        return {}, 0
    number = lambda b: sum((x & 0x7F) << s for x, s in zip(b, (21, 14, 7, 0), strict=True))
    end, at, out = 10 + number(data[6:10]) + 10 * bool(data[5] & 0x10), 10, {}
    if data[5] & 0x40 and len(data) >= 14:
        at += number(data[10:14]) if data[3] == 4 else 4 + int.from_bytes(data[10:14], "big")
    while at + 10 <= min(end, len(data)) and data[at] != 0:
        name, size = data[at : at + 4].decode("latin-1"), number(data[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        body = data[at + 10 : at + 10 + size]
        if name[0] == "T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace")
            key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
            out[key] = value.rstrip("\0")
        at += 10 + size
    return out, min(end, len(data))


def _read_id3v1(data: bytes) -> tuple[dict[str, str], int]:
    """The fields of a trailing tag, and where it begins."""
    if len(data) < 128 or data[-128:-125] != b"TAG":
        return {}, len(data)
    own = data[-128:]
    cut = {"title": own[3:33], "artist": own[33:63], "album": own[63:93], "year": own[93:97]}
    return {f"v1.{k}": v.rstrip(b"\0 ").decode("latin-1") for k, v in cut.items() if v.strip(b"\0 ")}, len(data) - 128


def _read_table(frame: bytes, head: Header) -> dict[str, object] | None:
    """A variable-bitrate table, of either kind."""
    at = _HEAD + _CRC * head.protected + head.side
    for start in (at, _HEAD + head.side):
        if frame[start : start + 4] in (b"Xing", b"Info"):
            flags, p, out = int.from_bytes(frame[start + 4 : start + 8], "big"), start + 8, {"kind": frame[start : start + 4].decode()}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name], p = int.from_bytes(frame[p : p + 4], "big"), p + 4
            if flags & 4:
                out["toc"] = list(frame[p : p + TABLE_POINTS])
            return out
    if frame[36:40] == b"VBRI":
        entries, scale, width = (int.from_bytes(frame[p : p + 2], "big") for p in (54, 56, 58))
        points = [scale * int.from_bytes(frame[62 + k * width : 62 + (k + 1) * width], "big") for k in range(entries)]
        return {"kind": "VBRI", "bytes": int.from_bytes(frame[46:50], "big"), "frames": int.from_bytes(frame[50:54], "big"), "toc": points}
    return None


def read(data: bytes) -> Audio:
    """Parse a whole file; bytes between frames are skipped and counted. What looks like a trailing tag but lies in a frame is the frame's."""
    out = Audio()
    out.tags, at = _read_id3(data)
    more, tag = _read_id3v1(data)
    end, last = len(data), at
    first, started = None, False
    while at + _HEAD <= end:
        head = header(data[at : at + 4])
        if head is not None and (first is None or head.same_stream(first)):
            after = at + head.size
            follow = header(data[after : after + 4]) if after + _HEAD <= end else None
            if after in (end, tag) or follow is not None and follow.same_stream(head):
                first = first or head
                if not started and (found := _read_table(data[at:after], head)):
                    out.table = found | {"offset": at}
                else:
                    out.offsets.append(at)
                    out.sizes.append(head.size)
                    out.headers.append(head)
                started, at, last = True, after, after
                if at == tag:
                    break
                continue
        move = data.find(b"\xff", at + 1, end)
        move = end if move < 0 else move
        out.skipped += move - at
        at = move
    out.skipped += max(0, end - at)
    if last <= tag < end:
        out.tags.update(more)
        out.skipped -= end - tag
    _verify(data, out)
    return out


def _verify(data: bytes, audio: Audio) -> None:
    by_side: dict[int, list[int]] = {}
    for at, head in zip(audio.offsets, audio.headers, strict=True):
        if head.protected:
            by_side.setdefault(head.side, []).append(at)
    raw = np.frombuffer(data, np.uint8)
    for side, starts in by_side.items():
        at = np.array(starts)[:, None]
        covered = raw[np.concatenate([at + 2 + np.arange(2), at + _HEAD + _CRC + np.arange(side)], axis=1)]
        stored = raw[at[:, 0] + 4].astype(np.uint32) << 8 | raw[at[:, 0] + 5]
        audio.checked += len(starts)
        audio.failed += int((checksums(covered) != stored).sum())


def payload(data: bytes, audio: Audio) -> bytes:
    """The carried payload, from the frames' ancillary bytes; all of them in a file that doesn't name its payload's length."""
    parts = [data[at + _HEAD + _CRC * h.protected + h.side : at + size] for at, size, h in zip(audio.offsets, audio.sizes, audio.headers, strict=True)]
    named = audio.tags.get(LENGTH_TAG, "")
    return b"".join(parts)[: int(named) if named.isdecimal() else None]


def feature(audio: Audio) -> str:
    """Frames, exact duration, bitrates, checksums and the middle seek point, as one string."""
    n = len(audio.offsets)
    bits = sorted({h.bitrate for h in audio.headers})
    table_frames = audio.table["frames"] if audio.table else -1
    middle = audio.seek(audio.samples // 2) if n else -1
    return f"mpeg1-layer3 rate={audio.rate} frames={n} samples={audio.samples} kbps={bits[0] if bits else 0}-{bits[-1] if bits else 0} table={table_frames} crc={audio.checked - audio.failed}/{audio.checked} skipped={audio.skipped} middle={middle}"


# --- columns


def with_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media, the stored form, of every row."""

    def apply(batches):
        for batch in batches:
            made = [payload_of(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([n for _, n in made], pa.int64()), pa.array([store(p) for p, _ in made], pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), apply, "doc_id long, n_bytes long, media binary")


def frame_index(media: DataFrame) -> DataFrame:
    """doc_id, samples, sample_rate, duration (exact, in seconds as samples / rate), offsets (the seek table), tags, failed and skipped."""

    def apply(batches):
        for batch in batches:
            found = [read(m.as_py() or b"") for m in batch.column(1)]
            columns = [
                batch.column(0).cast(pa.int64()), pa.array([a.samples for a in found], pa.int64()), pa.array([a.rate for a in found], pa.int32()), pa.array([a.seconds for a in found], pa.float64()),
                pa.array([a.offsets for a in found], pa.list_(pa.int64())), pa.array([list(a.tags.items()) for a in found], pa.map_(pa.string(), pa.string())), pa.array([a.failed for a in found], pa.int64()), pa.array([a.skipped for a in found], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "samples", "sample_rate", "duration", "offsets", "tags", "failed", "skipped"])

    return map_batches(media.select("doc_id", "media"), apply, "doc_id long, samples long, sample_rate int, duration double, offsets array<long>, tags map<string,string>, failed long, skipped long")


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(media: DataFrame) -> DataFrame:
    """What the stored bytes of each row give when they are read back."""

    def apply(batches):
        for batch in batches:
            rows = []
            for key, size, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                blob = blob.as_py()
                audio = read(blob)
                back = payload(blob, audio)
                rows.append((key, size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(blob), hashlib.sha256(blob).hexdigest(), feature(audio)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [f.split()[0] for f in _DIGEST.split(", ")])

    return map_batches(media.select("doc_id", "n_bytes", "media"), apply, _DIGEST)


def query(spark, sf_dir: str) -> DataFrame:
    return digests(with_media(spread(table(spark, sf_dir, "documents"))))
