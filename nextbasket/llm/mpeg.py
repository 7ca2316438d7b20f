"""Media columns: MPEG audio. Parses tags, frame headers, variable-bitrate tables and checksums; gives exact durations and seek offsets.

A payload is stored losslessly in the ancillary bytes of silent Layer III frames, 576 bytes a frame.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, slices, table

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by (MPEG-1, layer), and Hz of MPEG-1.
KBITS = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = (44100, 48000, 32000)
#: Fixed values of Layer II: bits of an allocation by subband, as (subbands, bits) runs, for MPEG-1 at high and low rates a channel, and for MPEG-2.
HIGH, LOW, LSF = ((11, 4), (12, 3), (7, 2)), ((2, 4), (10, 3)), ((4, 4), (7, 3), (19, 2))
#: The header bits that all frames of a stream share: sync, version, layer, sample rate.
SAME = 0xFFFE0C00


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = (c << 1) ^ 0x8005 if c & 0x8000 else c << 1
        out.append(c & 0xFFFF)
    return out


CRC = _crc_table()


def crc16(data: bytes, c: int = 0xFFFF) -> int:
    """The frame checksum: polynomial 0x8005, start 0xFFFF."""
    for b in data:
        c = (c << 8 & 0xFFFF) ^ CRC[c >> 8 ^ b]
    return c


def crc16_bits(data: bytes, bits: int, c: int = 0xFFFF) -> int:
    """Of the first so many bits."""
    c = crc16(data[: bits // 8], c)
    for k in range(bits // 8 * 8, bits):
        high = c >> 15 ^ data[k // 8] >> (7 - k % 8) & 1
        c = c << 1 & 0xFFFF ^ (0x8005 if high else 0)
    return c


@dataclass(frozen=True)
class Header:
    word: int
    layer: int
    kbits: int
    hertz: int
    samples: int
    size: int
    side: int  # bytes of Layer III side information
    protected: bool

    @classmethod
    def parse(cls, data: bytes, at: int) -> Header | None:
        if at + 4 > len(data):
            return None
        w = int.from_bytes(data[at : at + 4], "big")
        version, layer, rate, hz = w >> 19 & 3, 4 - (w >> 17 & 3), w >> 12 & 15, w >> 10 & 3
        if w >> 21 != 0x7FF or version == 1 or layer == 4 or rate in (0, 15) or hz == 3 or w & 3 == 2:
            return None
        first = version == 3
        kbits, hertz = KBITS[first, layer][rate - 1], HERTZ[hz] >> (0, 1, 2)[{3: 0, 2: 1, 0: 2}[version]]
        pad = w >> 9 & 1
        samples = 384 if layer == 1 else 576 if layer == 3 and not first else 1152
        size = (12000 * kbits // hertz + pad) * 4 if layer == 1 else samples * 125 * kbits // hertz + pad
        mono = w >> 6 & 3 == 3
        return cls(w, layer, kbits, hertz, samples, size, (17 if mono else 32) if first else (9 if mono else 17), not w >> 16 & 1)

    @property
    def channels(self) -> int:
        return 1 if self.word >> 6 & 3 == 3 else 2

    def protected_bits(self, body: bytes) -> int:
        """Bits behind the checksum that it covers besides the header: side information, allocations, and in Layer II what selects scale factors."""
        if self.layer == 3:
            return 8 * self.side
        bound = 4 * ((self.word >> 4 & 3) + 1) if self.word >> 6 & 3 == 1 else 32  # joint stereo shares the allocations from there on
        if self.layer == 1:
            widths = [4] * 32
        elif self.word >> 19 & 3 != 3:
            widths = [w for n, w in LSF for _ in range(n)]
        else:
            rate = self.kbits // self.channels
            low = rate <= 48
            limit = (12 if self.hertz == 32000 else 8) if low else 27 if rate <= 80 or self.hertz == 48000 else 30
            widths = [w for n, w in (LOW if low else HIGH) for _ in range(n)][:limit]
        at = used = 0
        whole = int.from_bytes(body, "big")
        for k, w in enumerate(widths):
            both = self.channels == 2 and k < bound
            for _ in range(1 + both):
                given = whole >> (8 * len(body) - at - w) & ((1 << w) - 1) if 8 * len(body) >= at + w else 0
                used += (given > 0) * (1 if both else self.channels)
                at += w
        return at + 2 * used if self.layer == 2 else at

    @property
    def body(self) -> int:
        """Where the main data begin in a Layer III frame."""
        return 4 + 2 * self.protected + self.side


@dataclass
class Parsed:
    frames: list[tuple[int, Header]] = field(default_factory=list)  # audio frames, without the table frame
    gaps: list[tuple[int, int]] = field(default_factory=list)  # bytes that are neither tag nor frame
    tags: dict[str, str] = field(default_factory=dict)
    vbr: dict[str, object] | None = None
    crc_ok: int = 0
    crc_bad: int = 0
    unchecked: int = 0

    @property
    def samples(self) -> int:
        """Those of all frames, without the delay and padding that an encoder says it added."""
        added = int((self.vbr or {}).get("delay", 0)) + int((self.vbr or {}).get("padding", 0))
        return max(0, sum(h.samples for _, h in self.frames) - added)

    def seconds(self) -> str:
        """The exact duration as a fraction."""
        hertz = self.frames[0][1].hertz if self.frames else 1
        return f"{self.samples}/{hertz}"

    def seeks(self, every: int) -> list[tuple[int, int]]:
        """(sample, byte offset) of every so many frames."""
        out, sample = [], 0
        for i, (at, h) in enumerate(self.frames):
            if i % every == 0:
                out.append((sample, at))
            sample += h.samples
        return out


def id3v2(data: bytes, at: int) -> tuple[int, dict[str, str]]:
    """The end of the tag at this place (the place itself if there is none), its footer included, and its text frames. Versions 2.2 to 2.4, also unsynchronised."""
    if data[at : at + 3] != b"ID3" or at + 10 > len(data) or any(b & 0x80 for b in data[at + 6 : at + 10]):
        return at, {}
    sync = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    plain = lambda b: int.from_bytes(b, "big")
    version, flags = data[at + 3], data[at + 5]
    end = min(len(data), at + 10 + sync(data[at + 6 : at + 10]))
    body = data[at + 10 : end]
    if version >= 4 and flags & 0x10:
        end = min(len(data), end + 10)
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\0", b"\xff")
    names, sizes = (3, 3) if version == 2 else (4, 4)
    head = names + sizes + (2 if version > 2 else 0)
    p = 0
    if flags & 0x40 and version > 2 and len(body) >= 4:  # an extended header; from 2.4 on its size counts itself
        p = sync(body[:4]) if version >= 4 else 4 + plain(body[:4])
    tags = {}
    while p + head <= len(body) and body[p : p + names].isalnum():
        size = (sync if version >= 4 else plain)(body[p + names : p + names + sizes])
        name, value = body[p : p + names].decode("latin-1"), body[p + head : p + head + size]
        if version >= 4 and body[p + head - 1] & 2:
            value = value.replace(b"\xff\0", b"\xff")
        if version >= 4 and body[p + head - 1] & 1:
            value = value[4:]  # the length before what was done to it
        if name[0] == "T" and value:
            text = value[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[value[0] & 3], "replace").split("\0")
            own = name in ("TXXX", "TXX")
            tags[f"TXXX:{text[0]}" if own else name] = text[1 if own and len(text) > 1 else 0]
        p += head + size
    return end, tags


def ape(data: bytes, end: int) -> tuple[int, dict[str, str]]:
    """The start of the APE tag that ends here (the place itself if there is none), and its text items."""
    if end < 32 or data[end - 32 : end - 24] != b"APETAGEX":
        return end, {}
    num = lambda i: int.from_bytes(data[i : i + 4], "little")
    size, items, flags = num(end - 20), num(end - 16), num(end - 12)
    begin = end - size - (32 if flags >> 31 else 0)
    if size < 32 or begin < 0:
        return end, {}
    tags, p = {}, end - size
    for _ in range(items):
        stop = data.find(b"\0", p + 8, end - 32)
        if p + 8 > end - 32 or stop < 0:
            break
        if num(p + 4) >> 1 & 3 == 0:
            tags[f"APE:{data[p + 8 : stop].decode('latin-1')}"] = data[stop + 1 : min(end - 32, stop + 1 + num(p))].decode("utf-8", "replace")
        p = stop + 1 + num(p)
    return begin, tags


def vbr_table(data: bytes, at: int, h: Header) -> dict[str, object] | None:
    """The Xing, Info or VBRI table that a first Layer III frame may hold in place of audio."""
    p = at + h.body
    if (kind := data[p : p + 4]) in (b"Xing", b"Info"):
        flags, p, out = int.from_bytes(data[p + 4 : p + 8], "big"), p + 8, {"kind": kind.decode()}
        for bit, name, size in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
            if flags & bit:
                out[name] = [*data[p : p + size]] if name == "toc" else int.from_bytes(data[p : p + size], "big")
                p += size
        if data[p : p + 4].isalnum() and len(data) >= p + 24:  # the encoder's name; its delay and padding are twelve bits each
            added = int.from_bytes(data[p + 21 : p + 24], "big")
            out |= {"encoder": data[p : p + 9].rstrip(b"\0 ").decode("latin-1"), "delay": added >> 12, "padding": added & 0xFFF}
        return out
    p = at + 36
    if data[p : p + 4] == b"VBRI":
        num = lambda i, n: int.from_bytes(data[p + i : p + i + n], "big")
        entries, scale, size = num(18, 2), num(20, 2), num(22, 2)
        return {"kind": "VBRI", "bytes": num(10, 4), "frames": num(14, 4), "toc": [scale * num(26 + i * size, size) for i in range(entries)]}
    return None


def parse(data: bytes) -> Parsed:
    """All frames of a stream. After a broken frame the search goes on byte by byte for a header that the next frame, or the end, confirms."""
    out, end = Parsed(), len(data)
    if data[-128:-125] == b"TAG":
        end -= 128
        out.tags["TIT2"] = data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1")
    end, items = ape(data, end)
    out.tags |= items
    at, gap = 0, -1
    locked: int | None = None
    while at < end:
        if data[at : at + 3] == b"ID3" and (after := id3v2(data, at))[0] > at:
            out.tags |= after[1]
            if gap >= 0:
                out.gaps.append((gap, at))
                gap = -1
            at = after[0]
            continue
        h = Header.parse(data, at)
        if h and at + h.size <= end and (locked is None or h.word & SAME == locked):
            after = at + h.size
            follows = after == end or data[after : after + 3] == b"ID3" or ((n := Header.parse(data, after)) is not None and n.word & SAME == h.word & SAME)
            # inside the stream the place is known, so a good header is enough; else the next header has to agree
            if follows or gap < 0 and locked is not None:
                if gap >= 0:
                    out.gaps.append((gap, at))
                    gap = -1
                good = None
                if h.protected:
                    body = data[at + 6 : min(after, at + 6 + 64)]
                    good = crc16_bits(body, h.protected_bits(body), crc16(data[at + 2 : at + 4])) == int.from_bytes(data[at + 4 : at + 6], "big") if 8 * len(body) >= h.protected_bits(body) else False
                    out.crc_ok += good
                    out.crc_bad += not good
                else:
                    out.unchecked += 1
                first = locked is None
                locked = h.word & SAME
                if first and h.layer == 3 and (t := vbr_table(data, at, h)):
                    out.vbr = t
                else:
                    out.frames.append((at, h))
                at = after
                continue
        if gap < 0:
            gap = at
        at = data.find(b"\xff", at + 1, end)
        at = end if at < 0 else at
        if (tag := data.find(b"ID3", gap + 1, at)) >= 0:
            at = tag
    if gap >= 0:
        out.gaps.append((gap, end))
    return out


UNIT, KB, HZ = 576, 192, 44100
SIDE = 17  # mono
LEAD = bytes([0xFF, 0xFA, 11 << 4, 0xC0])  # MPEG-1 Layer III with checksum, 192 kbit/s, 44.1 kHz, mono


def _frame_starts(n: int) -> np.ndarray:
    """Frames are padded so that the bitrate is met exactly on average."""
    return np.arange(n + 1, dtype=np.int64) * (144_000 * KB) // HZ


HEADS = []
for _pad in (0, 1):
    _h = LEAD[:2] + bytes([LEAD[2] | _pad << 1]) + LEAD[3:]
    HEADS.append(np.frombuffer(_h + crc16(_h[2:] + bytes(SIDE)).to_bytes(2, "big") + bytes(SIDE), np.uint8))


def encode(text: bytes) -> bytes:
    """The text, padded by bytes 255 to a positive multiple of 576, in silent frames; its length is in a tag."""
    units = max(1, -(-len(text) // UNIT))
    payload = np.full(units * UNIT, 255, np.uint8)
    payload[: len(text)] = np.frombuffer(text, np.uint8)
    start = _frame_starts(units + 1)
    out = np.zeros(start[-1], np.uint8)
    sizes = np.diff(start)
    heads = np.stack(HEADS)[sizes - sizes.min() if sizes.min() < sizes.max() else np.full(len(sizes), int(sizes[0] > 144_000 * KB // HZ))]
    out[start[:-1, None] + np.arange(heads.shape[1])] = heads
    body = heads.shape[1]
    out[start[1:-1, None] + body + np.arange(UNIT)] = payload.reshape(units, UNIT)
    toc = bytes((start[1:][np.arange(100) * units // 100] * 255 // start[-1]).astype(np.uint8))
    info = b"Info" + (15).to_bytes(4, "big") + units.to_bytes(4, "big") + int(start[-1]).to_bytes(4, "big") + toc + bytes(4)
    out[body : body + len(info)] = np.frombuffer(info, np.uint8)
    value = b"\3payload_bytes\0" + str(len(text)).encode()
    frame = b"TXXX" + len(value).to_bytes(4, "big") + bytes(2) + value  # under 128 bytes, so a plain size is syncsafe too
    return b"ID3\4\0\0" + bytes([0, 0, 0, len(frame)]) + frame + out.tobytes()


def decode(data: bytes, p: Parsed) -> bytes:
    """The payload of a stream that encode() wrote."""
    return b"".join(data[at + h.body : at + h.body + UNIT] for at, h in p.frames)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, media: each text as an MPEG stream. Null texts are empty, null doc_ids and repeated rows stay, other columns are dropped. An empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, _, _ in slices(b["text"], BATCH_BYTES):
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([encode(x or b"") for x in part["text"].cast(pa.binary()).to_pylist()], pa.binary())], ["doc_id", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, media binary")


#: Bytes of texts or streams that are turned at a time.
BATCH_BYTES = 4 << 20
FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "frames long, samples long, sample_rate int, duration string, crc_ok long, crc_bad long, gap_bytes long, seek array<struct<sample:long,offset:long>>"
)


def features(media: DataFrame, every: int = 50) -> DataFrame:
    """One row per row of media(doc_id, media): the payload's and the stream's digests, exact duration and seek offsets.

    Works on any MPEG audio bytes: null or broken media give no frames, their bytes count as gaps; a payload is the
    first 576 bytes of each frame's main data. n_bytes is the length in the tag, or else the payload's. Null doc_ids and repeated
    rows stay, other columns are dropped, an empty table gives no rows.
    """

    def row(i: int | None, data: bytes) -> dict[str, object]:
        p = parse(data)
        payload, seek = decode(data, p), p.seeks(every)
        n = p.tags.get("TXXX:payload_bytes", "")
        gaps, hertz = sum(b - a for a, b in p.gaps), p.frames[0][1].hertz if p.frames else 0
        media = hashlib.sha256(data).hexdigest()
        rates = sorted({h.kbits for _, h in p.frames})
        feature = {"duration": p.seconds(), "frames": len(p.frames), "kbits": rates, "crc": [p.crc_ok, p.crc_bad, p.unchecked], "gaps": len(p.gaps), "table": p.vbr and [p.vbr["kind"], p.vbr.get("frames")], "seek_crc32": zlib.crc32(repr(seek).encode())}
        return {
            "doc_id": i, "n_bytes": int(n) if n.isdigit() else len(payload), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]),
            "media_bytes": len(data), "media_sha256": media, "feature": json.dumps(feature, separators=(",", ":")), "frames": len(p.frames), "samples": p.samples, "sample_rate": hertz, "duration": p.seconds(),
            "crc_ok": p.crc_ok, "crc_bad": p.crc_bad, "gap_bytes": gaps, "seek": [{"sample": s, "offset": o} for s, o in seek],
        }

    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(n, types.get(t) or pa.list_(pa.struct([("sample", pa.int64()), ("offset", pa.int64())]))) for n, t in (x.split(" ", 1) for x in FEATURES.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, _, _ in slices(b["media"], BATCH_BYTES):
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_pylist([row(d, m or b"") for d, m in zip(part["doc_id"].to_pylist(), part["media"].to_pylist(), strict=True)], schema)

    return media.select("doc_id", "media").mapInArrow(run, FEATURES)


def op1_media_mpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streams are written to the shared folder and read back."""
    return features(saved(store(table(spark, sf_dir, "documents"))))
