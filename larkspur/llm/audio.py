"""Media columns of MPEG audio.

``encode`` stores bytes losslessly in MPEG-2 Layer III frames: each block of 576
bytes, as many as the frame has samples, lies in the ancillary part of one silent
mono frame of 648 bytes, behind header, checksum and side information. An ID3v2
tag names the length without padding and a first frame holds the table of
variable-bitrate files. ``parse`` reads any MPEG audio: it skips and reads tags,
resynchronises on frame headers that are confirmed by the next one, reads the
variable-bitrate table, verifies Layer III checksums, and gives the exact
duration as samples over rate, and the offset of each frame for seeking.

Null and empty texts become one block of padding; texts of any length are kept
whole, and batches are cut by bytes, so that a worker holds about 8 MB or one text
at a time; equal texts have equal media, so ties do not arise; repeated rows are
kept; an empty table gives an empty one. Only the id and text columns are read, so
the names of others do not matter.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import slabs

BLOCK = 576
# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by bitrate index, and sampling rates.
BITRATES = {
    (1, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (2, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}


@dataclass(frozen=True)
class Header:
    version: int  # 1, or 2 for MPEG-2 and 2.5
    layer: int
    rate: int
    samples: int
    bytes: int
    protected: bool
    side: int  # bytes of Layer III side information


def header(b: bytes) -> Header | None:
    """The header in four bytes, or None if they are not one."""
    if len(b) < 4 or b[0] != 255 or b[1] & 0xE0 != 0xE0:
        return None
    kind, layer, index, rate = b[1] >> 3 & 3, 4 - (b[1] >> 1 & 3), b[2] >> 4, b[2] >> 2 & 3
    if kind == 1 or layer == 4 or index in (0, 15) or rate == 3:
        return None
    version = 1 if kind == 3 else 2
    bits, hertz, pad = BITRATES[version, layer][index] * 1000, RATES[kind][rate], b[2] >> 1 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and version == 2 else 1152
    size = (12 * bits // hertz + pad) * 4 if layer == 1 else samples // 8 * bits // hertz + pad
    mono = b[3] >> 6 == 3
    side = 0 if layer < 3 else (17 if mono else 32) if version == 1 else (9 if mono else 17)
    return Header(version, layer, hertz, samples, size, not b[1] & 1, side)


def crc16(data: bytes) -> int:
    """The checksum of MPEG audio: polynomial 0x8005 from 0xFFFF, highest bit first."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


_START = bytes([0xFF, 0xF2, 0xD8, 0xC0])  # MPEG-2 Layer III, protected, 144 kbit/s, 16 kHz, mono
_SIDE = bytes(9)
_HEAD = _START + crc16(_START[2:] + _SIDE).to_bytes(2, "big") + _SIDE
FRAME = header(_START).bytes
_DATA = len(_HEAD)


def encode_bytes(text: bytes) -> bytes:
    """The media form of a text."""
    payload = text + b"\xff" * (-len(text) % BLOCK or BLOCK * (not text))
    n = len(payload) // BLOCK
    frames = np.zeros((n + 1, FRAME), np.uint8)
    frames[:, :_DATA] = np.frombuffer(_HEAD, np.uint8)
    frames[1:, _DATA : _DATA + BLOCK] = np.frombuffer(payload, np.uint8).reshape(n, BLOCK)
    checks = [zlib.crc32(payload[k : k + BLOCK]) for k in range(0, len(payload), BLOCK)]
    frames[1:, _DATA + BLOCK : _DATA + BLOCK + 8] = np.array([np.arange(n), checks], "<u4").T.copy().view(np.uint8)
    total = frames.size
    # for each hundredth of the duration, the place of its frame in 256ths of the stream
    table = bytes(256 * min(k * n // 100 + 1, n) * FRAME // total for k in range(100))
    info = b"Info" + (15).to_bytes(4, "big") + n.to_bytes(4, "big") + total.to_bytes(4, "big") + table + bytes(4)
    frames[0, _DATA : _DATA + len(info)] = np.frombuffer(info, np.uint8)
    value = b"\0payload_bytes\0" + str(len(text)).encode()
    tag = b"TXXX" + len(value).to_bytes(4, "big") + b"\0\0" + value
    return b"ID3\3\0\0" + _syncsafe(len(tag)) + tag + frames.tobytes()


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    table: dict[str, object] = field(default_factory=dict)  # frames, bytes and places of a variable-bitrate header
    offsets: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    samples: int = 0
    rate: int = 0
    checked: int = 0
    wrong: int = 0
    skipped: int = 0


def _tags(data: bytes) -> tuple[dict[str, str], int, int]:
    """ID3 tags, and where audio begins and ends."""
    tags, start, end = {}, 0, len(data)
    while data[start : start + 3] == b"ID3" and len(data) >= start + 10:
        size = sum((b & 127) << s for b, s in zip(data[start + 6 : start + 10], (21, 14, 7, 0)))
        at, stop, major = start + 10, min(start + 10 + size, len(data)), data[start + 3]
        while major in (3, 4) and at + 10 <= stop and data[at] and data[at : at + 4].isalnum():
            length = int.from_bytes(data[at + 4 : at + 8], "big") if major == 3 else sum((b & 127) << s for b, s in zip(data[at + 4 : at + 8], (21, 14, 7, 0)))
            body, name = data[at + 10 : at + 10 + length], data[at : at + 4].decode("latin-1")
            if name[0] == "T" and body:
                text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1"), "replace")
                key, _, value = text.rstrip("\0").partition("\0") if name == "TXXX" else (name, "", text.rstrip("\0"))
                tags[key] = value
            at += 10 + length
        start = min(start + 10 + size + 10 * (data[start + 5] >> 4 & 1), len(data))
    if end - start >= 128 and data[end - 128 : end - 125] == b"TAG":
        for key, a, b in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93), ("TYER", 93, 97)):
            if value := data[end - 128 + a : end - 128 + b].split(b"\0")[0].strip():
                tags.setdefault(key, value.decode("latin-1"))
        end -= 128
    return tags, start, end


def _table(frame: bytes, h: Header) -> dict[str, object] | None:
    """A Xing, Info or VBRI header in a frame."""
    for at in (4 + h.side + 2 * h.protected, 4 + h.side):
        if frame[at : at + 4] in (b"Xing", b"Info"):
            flags, p = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
            out: dict[str, object] = {"kind": frame[at : at + 4].decode()}
            for bit, key in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[key] = int.from_bytes(frame[p : p + 4], "big")
                    p += 4
            if flags & 4:
                out["places"] = list(frame[p : p + 100])
            return out
    if frame[36:40] == b"VBRI":
        return {"kind": "VBRI", "bytes": int.from_bytes(frame[46:50], "big"), "frames": int.from_bytes(frame[50:54], "big")}
    return None


def parse(data: bytes) -> Stream:
    """Frames of any MPEG audio, found through junk, tags and changes of bitrate."""
    out = Stream()
    out.tags, at, end = _tags(data)
    raw = np.frombuffer(data, np.uint8)
    offsets, sizes, first = [], [], True
    while at + 4 <= end:
        h = header(data[at : at + 4])
        fits = h is not None and at + h.bytes <= end
        if fits and at + h.bytes + 4 <= end:
            after = header(data[at + h.bytes : at + h.bytes + 4])
            fits = after is not None and (after.version, after.layer, after.rate) == (h.version, h.layer, h.rate)
        elif fits:
            fits = at + h.bytes == end or bool(offsets)
        if not fits:
            skip = data.find(b"\xff", at + 1, end)
            skip = end if skip < 0 else skip
            out.skipped += skip - at
            at = skip
            continue
        count = 1
        if not first or (found := _table(data[at : at + h.bytes], h)) is None:
            # all following frames with this very header, at once
            rows = raw[at : at + (end - at) // h.bytes * h.bytes].reshape(-1, h.bytes)
            same = (rows[:, :4] == rows[0, :4]).all(1)
            count = len(same) if same.all() else int(same.argmin())
            if count < len(same) or (end - at) % h.bytes:
                count = max(1, count - 1)  # the last of them is confirmed by what follows it
            if h.layer == 3 and h.protected:
                kinds, members = np.unique(rows[:count, : 6 + h.side], axis=0, return_counts=True)
                for kind, n in zip(kinds, members.tolist()):
                    b = kind.tobytes()
                    out.checked += n
                    out.wrong += n * (crc16(b[2:4] + b[6:]) != int.from_bytes(b[4:6], "big"))
            offsets.append(at + np.arange(count) * h.bytes)
            sizes.append(np.full(count, h.bytes))
            out.samples += count * h.samples
            out.rate = out.rate or h.rate
        else:
            out.table = found
        first = False
        at += count * h.bytes
    out.skipped += max(0, end - at)
    if offsets:
        out.offsets, out.sizes = np.concatenate(offsets), np.concatenate(sizes)
    return out


def decode_bytes(data: bytes, stream: Stream | None = None) -> tuple[bytes, int]:
    """The padded payload read back from media, and the length without padding. Raises ValueError if a block fails its checks."""
    s = stream or parse(data)
    at = s.offsets[s.sizes == FRAME]
    frames = np.frombuffer(data, np.uint8)[at[:, None] + np.arange(FRAME)] if len(at) else np.empty((0, FRAME), np.uint8)
    payload = frames[:, _DATA : _DATA + BLOCK].tobytes()
    marks = frames[:, _DATA + BLOCK : _DATA + BLOCK + 8].copy().view("<u4").reshape(-1, 2)
    checks = [zlib.crc32(payload[k : k + BLOCK]) for k in range(0, len(payload), BLOCK)]
    if s.wrong or not len(at) or (marks[:, 0] != np.arange(len(at))).any() or marks[:, 1].tolist() != checks:
        raise ValueError("the media does not hold the blocks it should")
    return payload, int(s.tags["payload_bytes"])


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and media (binary) of every row."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slabs(whole):
                media = [encode_bytes(t.as_py() or b"") for t in batch.column(1).cast(pa.large_binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, media binary")


DESCRIBED = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, duration_samples bigint, sample_rate int, frame_offsets array<bigint>"


def describe(media: DataFrame) -> DataFrame:
    """From doc_id and media: what the stored bytes hold, with exact duration (samples over rate) and the offset of every frame."""
    kind = media.schema["doc_id"].dataType.simpleString()

    def row(data: bytes) -> tuple:
        s = parse(data)
        payload, n = decode_bytes(data, s)
        seek = zlib.crc32(s.offsets.astype("<i8").tobytes())
        feature = f"mpeg2-layer3 {s.rate} Hz mono, {len(s.offsets)} frames, {s.samples}/{s.rate} s, {s.checked - s.wrong} of {s.checked} checksums, {s.skipped} bytes skipped, {s.table.get('kind')} {s.table.get('frames')}, seek {seek:08x}"
        return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature, s.samples, s.rate, s.offsets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
        names = ["doc_id", *[c.split()[0] for c in DESCRIBED.split(", ")]]
        for batch in (part for whole in batches for part in slabs(whole)):
            rows = [row(m.as_py()) for m in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]], names)

    return media.select("doc_id", "media").mapInArrow(run, f"doc_id {kind}, {DESCRIBED}")
