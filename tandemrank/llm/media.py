"""MPEG audio columns: frames, tags, variable-bitrate tables, checksums, durations and seek offsets."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemrank.llm.common import table
from tandemrank.llm.registry import query

# Fixed values of the format. Bit rates in kbit/s by (MPEG version 1 or 2, layer) and index; index 0 is a free format.
BITRATES = {
    (1, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (2, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
# Sample rates in Hz by version code (3: MPEG 1, 2: MPEG 2, 0: MPEG 2.5) and index.
RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}
CRC_POLYNOMIAL, CRC_START = 0x8005, 0xFFFF

UNIT = 576  # payload bytes come in multiples of a granule's number of samples
_ONE, _TWO = b"\xff\xfa\xa8\xc0", b"\xff\xfa\xe8\xc0"  # MPEG 1 layer III, mono, 32 kHz, protected, 160 and 320 kbit/s
_TABLE_HEADER = b"\xff\xfb\xa8\xc0"  # the same at 160 kbit/s without a checksum


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    protected: bool
    kbits: int
    rate: int
    channels: int
    length: int
    samples: int
    side: int  # bytes of side information, layer III only


@lru_cache(maxsize=4096)
def header_of(four: bytes) -> Header | None:
    """The frame header in ``four`` bytes, or None if it is not a valid one. Free-format frames have no stated length: None."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    code, layer, index, rate = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3), four[2] >> 4, four[2] >> 2 & 3
    if code == 1 or layer == 4 or index in (0, 15) or rate == 3 or four[3] & 3 == 2:
        return None
    version = 1 if code == 3 else 2
    kbits, hz, padding = BITRATES[version, layer][index], RATES[code][rate], four[2] >> 1 & 1
    channels = 1 if four[3] >> 6 == 3 else 2
    samples = 384 if layer == 1 else 576 if layer == 3 and version == 2 else 1152
    slot = 4 if layer == 1 else 1
    length = (samples // 8 // slot * kbits * 1000 // hz + padding) * slot
    side = 0 if layer != 3 else (17 if channels == 1 else 32) if version == 1 else (9 if channels == 1 else 17)
    return Header(version if code else 25, layer, not four[1] & 1, kbits, hz, channels, length, samples, side)


@lru_cache(maxsize=65536)
def crc16(data: bytes) -> int:
    crc = CRC_START
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ CRC_POLYNOMIAL if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def _audio_frame(header: bytes, payload: bytes) -> bytes:
    """A silent frame whose ancillary bytes, which follow the empty main data, carry ``payload``."""
    side = bytes(17)
    body = header + struct.pack(">H", crc16(header[2:] + side)) + side + payload
    return body + bytes(header_of(header).length - len(body))


def pad(data: bytes, unit: int = UNIT) -> bytes:
    """``data`` with bytes 255 appended up to a positive multiple of ``unit``."""
    return data + b"\xff" * (max(1, -(-len(data) // unit)) * unit - len(data))


def encode(payload: bytes) -> bytes:
    """A playable (silent) variable-bitrate stream that carries ``payload``, a multiple of 576 bytes, losslessly.

    Two units share a frame of 320 kbit/s, an odd last one has a frame of 160 kbit/s. A version-2 tag and a table frame
    with frame count, byte count and 100 seek points come first, a version-1 tag last.
    """
    if not payload or len(payload) % UNIT:
        raise ValueError(f"the payload must be a positive multiple of {UNIT} bytes")
    frames = [
        _audio_frame(_TWO if len(piece) > UNIT else _ONE, piece)
        for piece in (payload[i : i + 2 * UNIT] for i in range(0, len(payload), 2 * UNIT))
    ]
    title = b"\x03payload"
    text = b"TIT2" + struct.pack(">IH", len(title), 0) + title
    tag = b"ID3\x03\x00\x00" + bytes(len(text) >> s & 127 for s in (21, 14, 7, 0)) + text
    starts, at = [], header_of(_TABLE_HEADER).length
    for f in frames:
        starts.append(at)
        at += len(f)
    toc = bytes(min(255, starts[i * len(frames) // 100] * 256 // at) for i in range(100))
    kind = b"Xing" if len({len(f) for f in frames}) > 1 else b"Info"
    first = _TABLE_HEADER + bytes(17) + kind + struct.pack(">III", 7, len(frames), at) + toc
    first += bytes(header_of(_TABLE_HEADER).length - len(first))
    return tag + first + b"".join(frames) + b"TAG" + b"payload".ljust(125, b"\0")


@dataclass
class Stream:
    """What a walk over the bytes of a stream finds."""

    version: int = 0
    layer: int = 0
    rate: int = 0
    channels: int = 0
    samples: int = 0
    seek: list[int] = field(default_factory=list)  # byte offset of each audio frame
    headers: list[Header] = field(default_factory=list)
    bitrates: set[int] = field(default_factory=set)
    checked: int = 0
    bad: int = 0
    resyncs: int = 0
    skipped: int = 0
    tag2: int = 0  # bytes of version-2 tags
    tag1: bool = False
    title: str | None = None
    table: str | None = None  # kind of the variable-bitrate table
    table_frames: int | None = None
    table_bytes: int | None = None
    table_true: bool | None = None  # whether its counts are those found


def _tag(data: bytes, at: int, out: Stream) -> int:
    """Bytes of a version-2 tag at ``at`` (0 if there is none); keeps its title."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or max(data[at + 6 : at + 10]) > 127:
        return 0
    size = 0
    for byte in data[at + 6 : at + 10]:
        size = size << 7 | byte
    end, p = min(len(data), at + 10 + size), at + 10
    while p + 10 <= end and data[p] and out.title is None:
        raw = data[p + 4 : p + 8]
        n = struct.unpack(">I", raw)[0] if data[at + 3] < 4 else (raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3])
        if data[p : p + 4] == b"TIT2" and n > 1 and p + 10 < end:
            code = ("latin-1", "utf-16", "utf-16-be", "utf-8")[data[p + 10] & 3]
            out.title = data[p + 11 : min(end, p + 10 + n)].decode(code, "replace").rstrip("\0")
        p += 10 + n
    return end - at + (10 if data[at + 5] & 16 else 0)


def _next_frame(data: bytes, at: int, end: int, like: Header | None) -> int:
    """Next offset of a header that the stream can go on with: a frame that ends with the stream or before another header."""
    while 0 <= (at := data.find(b"\xff", at, end)):
        h = header_of(data[at : at + 4])
        if h and (like is None or (h.version, h.layer, h.rate) == (like.version, like.layer, like.rate)):
            after = at + h.length
            g = header_of(data[after : after + 4])
            if after == end or after < end and g and (g.version, g.layer, g.rate) == (h.version, h.layer, h.rate):
                return at
        at += 1
    return end


def _table(data: bytes, at: int, h: Header, out: Stream) -> bool:
    """Read a variable-bitrate table in the frame at ``at``: true if there is one, and then the frame holds no audio.

    A table whose announced counts do not fit into its frame is none.
    """
    frame = data[at : at + h.length]
    for p in (4 + h.side, 6 + h.side):
        if frame[p : p + 4] in (b"Xing", b"Info") and len(frame) >= p + 8:
            flags = int.from_bytes(frame[p + 4 : p + 8], "big")
            counts = frame[p + 8 : p + 8 + 4 * ((flags & 1) + (flags >> 1 & 1))]
            if len(counts) < 4 * ((flags & 1) + (flags >> 1 & 1)):
                continue
            if flags & 1:
                out.table_frames = int.from_bytes(counts[:4], "big")
            if flags & 2:
                out.table_bytes = int.from_bytes(counts[-4:], "big")
            out.table = frame[p : p + 4].decode()
            return True
    if frame[36:40] == b"VBRI" and len(frame) >= 54:
        out.table_bytes, out.table_frames = struct.unpack(">II", frame[46:54])
        out.table = "VBRI"
        return True
    return False


def probe(data: bytes) -> Stream:
    """Walk all of ``data``: tags, resynchronised frames, tables and layer III checksums (others have no fixed extent).

    Bytes that are no frame are skipped up to the next header that another header or the end confirms.
    """
    out, at, end, like, first = Stream(), 0, len(data), None, None
    if end >= 128 and data[-128:-125] == b"TAG":
        out.tag1, end = True, end - 128
    while at < end and (n := _tag(data, at, out)):
        out.tag2, at = out.tag2 + n, at + n
    while at < end:
        h = header_of(data[at : at + 4])
        if h is None or at + h.length > end or like and (h.version, h.layer, h.rate) != (like.version, like.layer, like.rate):
            to = _next_frame(data, at + (h is not None), end, like)
            out.resyncs, out.skipped, at = out.resyncs + (to < end), out.skipped + to - at, to
            continue
        if like is None:
            like, first = h, at
            out.version, out.layer, out.rate, out.channels = h.version, h.layer, h.rate, h.channels
            if h.layer == 3 and _table(data, at, h, out):
                at += h.length
                continue
        if h.protected and h.layer == 3:
            out.checked += 1
            said = data[at + 4 : at + 6]
            out.bad += crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]) != int.from_bytes(said, "big")
        out.seek.append(at)
        out.headers.append(h)
        out.bitrates.add(h.kbits)
        out.samples += h.samples
        at += h.length
    if out.table:
        out.table_true = out.table_frames in (None, len(out.seek)) and out.table_bytes in (None, end - first)
    return out


def payload_of(data: bytes, stream: Stream) -> bytes:
    """The bytes that ``encode`` stored, read back from the frames that ``probe`` found."""
    parts = []
    for at, h in zip(stream.seek, stream.headers):
        start = at + 6 + h.side
        parts.append(data[start : start + (h.length - 6 - h.side) // UNIT * UNIT])
    return b"".join(parts)


def feature(s: Stream) -> str:
    """Exact facts of a stream as text. The duration is a fraction: samples over samples a second."""
    seek = zlib.crc32(struct.pack(f">{len(s.seek)}Q", *s.seek))
    return (
        f"mpeg{s.version}.layer{s.layer}.{s.rate}Hz.{s.channels}ch frames={len(s.seek)} duration={s.samples}/{s.rate} "
        f"kbits={'+'.join(map(str, sorted(s.bitrates)))} table={s.table}:{s.table_true} crc={s.checked - s.bad}/{s.checked} "
        f"resync={s.resyncs} skipped={s.skipped} tags={s.tag2},{int(s.tag1)} seek_crc32={seek}"
    )


_SLICE = 32 << 20


def _mapped(schema: pa.Schema, rows: Iterator[tuple], sizes_at: int) -> Iterator[pa.RecordBatch]:
    """Rows to record batches of bounded bytes."""
    held: list[tuple] = []
    size = 0
    for r in rows:
        held.append(r)
        size += 100 + len(r[sizes_at] or b"")
        if size >= _SLICE or len(held) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def store_texts(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes`` and ``media``: each whole text (null: empty) as a stream. Other columns are not read."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches):
        def rows():
            for b in batches:
                for i, t in zip(b.column("doc_id"), b.column("text")):
                    data = t.as_buffer().to_pybytes() if t.is_valid else b""
                    yield i.as_py(), len(data), encode(pad(data))

        yield from _mapped(schema, rows(), 2)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def probe_media(media: DataFrame) -> DataFrame:
    """Facts of each ``media`` stream next to ``doc_id`` and ``n_bytes``: digests, exact duration and seek offsets.

    A null or unreadable stream has no frames, an empty payload and duration 0; nothing fails on damaged bytes.
    """
    spec = (
        "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, "
        "media_bytes bigint, media_sha256 string, feature string, samples bigint, rate int, seek array<bigint>"
    )
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(),
             pa.int64(), pa.int32(), pa.list_(pa.int64())]
    schema = pa.schema(list(zip([x.split()[0] for x in spec.split(", ")], kinds)))

    def run(batches):
        def rows():
            for b in batches:
                for i, n, m in zip(b.column("doc_id"), b.column("n_bytes"), b.column("media")):
                    data = m.as_py() or b""
                    s = probe(data)
                    load = payload_of(data, s)
                    yield (
                        i.as_py(), n.as_py(), len(load), hashlib.sha256(load).hexdigest(), zlib.crc32(load[-32:]), len(data),
                        hashlib.sha256(data).hexdigest(), feature(s), s.samples, s.rate, s.seek,
                    )

        yield from _mapped(schema, rows(), 7)

    return media.mapInArrow(run, spec)


@query("op2_mpeg_audio")
def op2(spark, sf_dir):
    facts = probe_media(store_texts(table(spark, sf_dir, "documents")))
    return facts.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature",
        F.col("samples").cast("bigint").alias("n_samples"), F.size("seek").alias("n_frames"),
    )
