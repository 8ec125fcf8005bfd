"""MPEG audio as a media column: write payloads as frames, and parse any MPEG audio stream.

The parser skips or reads ID3v2 and ID3v1 tags, resynchronises on a chain of two frame headers, reads Xing/Info and
VBRI tables, verifies the CRC-16 of protected frames (of all layers), and gives exact durations (samples over rate) and the byte
offset of every frame, which is what a seek needs. The writer stores a payload losslessly in the ancillary data of
protected layer III frames: their side information says that no main data is coded, so players hear silence and every
byte after it belongs to the payload. An ID3v2 private frame holds its length and a Xing table makes the file seekable.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strandlake.llm.common import id_text, slices, written

# Fixed values of ISO/IEC 11172-3 and 13818-3, kbit/s by (version 1?, layer), and Hz by version.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {"1": (44100, 48000, 32000), "2": (22050, 24000, 16000), "2.5": (11025, 12000, 8000)}
OWNER = b"payload\0"


@dataclass(frozen=True)
class Header:
    version: str
    layer: int
    protected: bool
    bitrate: int
    rate: int
    length: int
    samples: int
    side: int  # bytes of side information (layer III)
    channels: int = 1
    bound: int = 32  # the first subband that both channels share (layers I and II)


@lru_cache(1 << 16)
def header(b: bytes) -> Header | None:
    """The frame header in four bytes, or None where they are none (free-format bit rates count as none)."""
    if len(b) < 4 or b[0] != 0xFF or b[1] & 0xE0 != 0xE0:
        return None
    version = {0: "2.5", 2: "2", 3: "1"}.get(b[1] >> 3 & 3)
    layer = 4 - (b[1] >> 1 & 3)
    if version is None or layer == 4 or b[2] >> 4 in (0, 15) or b[2] >> 2 & 3 == 3 or b[3] & 3 == 2:
        return None
    one = version == "1"
    bitrate, rate, pad = BITRATES[one, layer][b[2] >> 4] * 1000, RATES[version][b[2] >> 2 & 3], b[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or one else 576
    length = (12 * bitrate // rate + pad) * 4 if layer == 1 else samples // 8 * bitrate // rate + pad
    mode = b[3] >> 6
    mono, bound = mode == 3, 4 + 4 * (b[3] >> 4 & 3) if mode == 1 else 32
    return Header(version, layer, not b[1] & 1, bitrate, rate, length, samples, (17 if mono else 32) if one else (9 if mono else 17), 1 if mono else 2, bound)


@lru_cache(1 << 16)
def crc16(data: bytes) -> int:
    """CRC-16 of MPEG audio: polynomial x^16 + x^15 + x^2 + 1, all ones at the start."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def crc16_bits(data: bytes, n: int, crc: int = 0xFFFF) -> int:
    """The same over the first ``n`` bits."""
    for i in range(n):
        bit = data[i >> 3] >> (7 - (i & 7)) & 1
        crc = (crc << 1 ^ (0x8005 if (crc >> 15) ^ bit else 0)) & 0xFFFF
    return crc


# Fixed values of ISO/IEC 11172-3 and 13818-3: bits of a layer II allocation per subband, as (subbands, bits) in order.
ALLOCATION = {
    "a": ((11, 4), (12, 3), (4, 2)),
    "b": ((11, 4), (12, 3), (7, 2)),
    "c": ((2, 4), (6, 3)),
    "d": ((2, 4), (10, 3)),
    "low": ((4, 4), (7, 3), (19, 2)),
}


def _allocation_bits(h: Header) -> list[int]:
    """Bits of each subband's allocation in a layer I or II frame."""
    if h.layer == 1:
        return [4] * 32
    each = h.bitrate // h.channels // 1000
    table = "low" if h.version != "1" else ("d" if h.rate == 32000 else "c") if each <= 48 else "a" if each <= 80 or h.rate == 48000 else "b"
    return [bits for n, bits in ALLOCATION[table] for _ in range(n)]


def protected_bits(data: bytes, at: int, h: Header) -> int:
    """How many bits after the checksum it covers: side information, or allocations and (layer II) scale factor choices."""
    if h.layer == 3:
        return 8 * h.side
    widths = [bits for sb, bits in enumerate(_allocation_bits(h)) for _ in range(h.channels if sb < h.bound else 1)]
    if h.layer == 1:
        return sum(widths)
    body = data[at + 6 : at + 6 + (sum(widths) + 7) // 8]
    value, left, chosen = int.from_bytes(body, "big"), 8 * len(body), 0
    shares = [1 if sb < h.bound else h.channels for sb, bits in enumerate(_allocation_bits(h)) for _ in range(h.channels if sb < h.bound else 1)]
    for bits, share in zip(widths, shares, strict=True):
        left -= bits
        if left >= 0 and value >> left & ((1 << bits) - 1):
            chosen += share  # two bits for each channel of a subband that is coded
    return sum(widths) + 2 * chosen


def checksum_holds(data: bytes, at: int, h: Header) -> bool:
    """Whether the CRC-16 of a protected frame agrees with what it covers."""
    want = int.from_bytes(data[at + 4 : at + 6], "big")
    if h.layer == 3:
        return crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]) == want
    n = protected_bits(data, at, h)
    return 6 + (n + 7) // 8 <= h.length and crc16_bits(data[at + 6 : at + h.length], n, crc16_bits(data[at + 2 : at + 4], 16)) == want


@dataclass
class Stream:
    """What a stream holds; offsets are of the audio frames, without the table's frame."""

    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    crc_checked: int = 0
    crc_wrong: int = 0
    skipped: int = 0  # bytes between frames that belong to none
    tags: dict[str, bytes] = field(default_factory=dict)
    table: dict = field(default_factory=dict)

    @property
    def samples(self) -> int:
        return sum(h.samples for h in self.headers)

    @property
    def seconds(self) -> float:
        return sum(h.samples / h.rate for h in self.headers) if len({h.rate for h in self.headers}) > 1 else self.samples / self.headers[0].rate if self.headers else 0.0

    def seek(self, second: float) -> int:
        """The byte offset of the frame that sounds at ``second``."""
        at = 0.0
        for o, h in zip(self.offsets, self.headers, strict=True):
            at += h.samples / h.rate
            if second < at:
                return o
        return self.offsets[-1] if self.offsets else 0


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _id3v2(data: bytes, s: Stream) -> int:
    """Read the frames of a tag at the start and return its end."""
    if len(data) < 10 or data[:3] != b"ID3" or max(data[6:10]) > 127:
        return 0
    major, end = data[3], min(len(data), 10 + _synchsafe(data[6:10]) + (10 if data[5] & 0x10 else 0))
    at = 10
    if data[5] & 0x40 and major >= 3 and len(data) >= 14:  # extended header
        at += _synchsafe(data[10:14]) if major == 4 else 4 + int.from_bytes(data[10:14], "big")
    while major >= 3 and at + 10 <= end and data[at : at + 4].isalnum():
        size = _synchsafe(data[at + 4 : at + 8]) if major == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        s.tags[data[at : at + 4].decode("latin-1")] = data[at + 10 : min(end, at + 10 + size)]
        at += 10 + size
    return end


def _table(data: bytes, at: int, h: Header) -> dict:
    """A Xing, Info or VBRI table in the frame at ``at``."""
    frame = data[at : at + h.length]
    x = 4 + h.side + 2 * h.protected
    if h.layer == 3 and frame[x : x + 4] in (b"Xing", b"Info") and len(frame) >= x + 8:
        flags, p, out = int.from_bytes(frame[x + 4 : x + 8], "big"), x + 8, {"kind": frame[x : x + 4].decode()}
        for bit, name, size in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
            if flags & bit and p + size <= len(frame):
                out[name] = list(frame[p : p + 100]) if name == "toc" else int.from_bytes(frame[p : p + 4], "big")
                p += size
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        _, _, quality, size, frames, entries, scale, width, each = struct.unpack(">HHHIIHHHH", frame[40:62])
        toc = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(entries)] if 1 <= width <= 4 else []
        return {"kind": "VBRI", "frames": frames, "bytes": size, "quality": quality, "toc": toc, "frames_per_entry": each}
    return {}


def parse(data: bytes) -> Stream:
    """Parse a stream; broken input gives what could be read of it (an empty one: no frames)."""
    s = Stream()
    at, end = _id3v2(data, s), len(data)
    locked, first, done = None, True, at
    while at + 4 <= end:
        h = header(data[at : at + 4])
        if h and at + h.length > end:
            h = None
        if h and h is not locked and not (at == done and _is_end(data, at + h.length)):
            # a new kind of frame counts if another one follows it, or if it ends a stream without a gap before it
            after = header(data[at + h.length : at + h.length + 4])
            if not (after and (after.version, after.layer, after.rate) == (h.version, h.layer, h.rate)):
                h = None
        if h is None:
            found = data.find(b"\xff", at + 1, end)
            s.skipped += (end if found < 0 else found) - at
            at, locked = (end if found < 0 else found), None
            continue
        if h.protected:
            s.crc_checked += 1
            s.crc_wrong += not checksum_holds(data, at, h)
        table = _table(data, at, h) if first else {}
        first = False
        if table:
            s.table = table
        else:
            s.offsets.append(at)
            s.headers.append(h)
        locked, at = h, at + h.length
        done = at
    s.skipped += max(0, end - at)
    if end - done >= 128 and data[end - 128 : end - 125] == b"TAG":  # after the last whole frame only: frames may hold anything
        s.tags["TAG"] = data[end - 128 :]
        s.skipped -= 128
    return s


def _is_end(data: bytes, at: int) -> bool:
    """Whether the audio ends at ``at``: with the stream, or before an ID3v1 tag."""
    return at == len(data) or at + 128 == len(data) and data[at : at + 3] == b"TAG"


def _frame(index: int, protected: bool = True) -> tuple[bytes, int]:
    """Header, checksum and side information of a mono layer III frame at 44.1 kHz, and the frame's length."""
    head = bytes([0xFF, 0xFA if protected else 0xFB, index << 4, 0xC0])
    side = bytes(17)
    return head + (crc16(head[2:] + side).to_bytes(2, "big") if protected else b"") + side, header(head).length


_WRITERS = [(p, n) for p, n in (_frame(i) for i in range(1, 15))]


def write(payload: bytes) -> bytes:
    """A stream that holds ``payload`` in the ancillary data of its frames: the largest ones, then the smallest that fits."""
    lead, length = _WRITERS[-1]
    room = length - len(lead)
    whole = len(payload) // room
    frames = [lead + payload[i * room : (i + 1) * room] for i in range(whole)]
    rest = payload[whole * room :]
    if rest:
        lead, length = next((p, n) for p, n in _WRITERS if n - len(p) >= len(rest))
        frames.append((lead + rest).ljust(length, b"\0"))
    body = b"".join(frames)
    ends = np.cumsum([0, *map(len, frames)])
    lead, length = _frame(5, protected=False)
    total = length + len(body)
    points = ends[np.arange(100) * len(frames) // 100] + length
    table = lead + b"Xing" + struct.pack(">III", 7, len(frames), total) + bytes(np.minimum(255, points * 256 // total).astype(np.uint8))
    private = OWNER + struct.pack(">Q", len(payload))
    tag = b"PRIV" + struct.pack(">IH", len(private), 0) + private
    size = len(tag)
    return b"ID3\x03\0\0" + bytes([size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127]) + tag + table.ljust(length, b"\0") + body


def payload_of(data: bytes, s: Stream) -> bytes:
    """What ``write`` stored."""
    private = s.tags.get("PRIV", b"")
    if not private.startswith(OWNER):
        raise ValueError("the stream holds no payload")
    size = int.from_bytes(private[len(OWNER) : len(OWNER) + 8], "big")
    skip = [4 + 2 * h.protected + h.side for h in s.headers]
    return b"".join([data[o + k : o + h.length] for o, k, h in zip(s.offsets, skip, s.headers, strict=True)])[:size]


def feature(s: Stream) -> str:
    """Duration, bit rates, checksums, table and seek offsets of a stream, as one string."""
    rates = ",".join(f"{k // 1000}x{n}" for k, n in sorted(Counter(h.bitrate for h in s.headers).items()))
    seek = zlib.crc32(np.asarray(s.offsets, "<u4").tobytes())
    rate = s.headers[0].rate if s.headers else 0
    return f"frames={len(s.headers)};samples={s.samples};rate={rate};kbps={rates};crc={s.crc_checked - s.crc_wrong}/{s.crc_checked};table={s.table.get('kind', '-')}:{s.table.get('frames', 0)};skipped={s.skipped};seek={seek:08x}"


def padded(text: bytes, unit: int = 64) -> bytes:
    """``text`` with zero bytes up to a positive multiple of ``unit``."""
    return text.ljust(max(1, -(-len(text) // unit)) * unit, b"\0")


def store_audio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: each text's UTF-8 bytes, padded, as an MPEG audio stream (null: as an empty text).

    Every row is stored by itself, so repeated rows, other columns and an empty table need no care.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([write(padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return id_text(docs, id_col, text_col).mapInArrow(store, "doc_id long, n_bytes long, media binary")


def audio_features(media: DataFrame) -> DataFrame:
    """Parse stored streams (doc_id, n_bytes, media): digests of payload and media, exact duration, offsets of the frames.

    Each stream is parsed by itself: repeated rows and ties agree, a null doc_id stays, an empty table gives one, and
    memory is that of the streams of 500 rows. A stream that ``store_audio`` didn't write is an error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 500):
                b = big.slice(at, 500)
                rows = []
                for doc, n, data in zip(b.column("doc_id").to_pylist(), b.column("n_bytes").to_pylist(), b.column("media").to_pylist(), strict=True):
                    s = parse(data)
                    p = payload_of(data, s)
                    rows.append((doc, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(s), s.seconds, s.offsets))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], NAMES)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seconds double, frame_offsets array<long>")


NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "seconds", "frame_offsets"]


def op5_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_features(written(store_audio(spark.read.parquet(f"{sf_dir}/documents.parquet")), "audio"))
