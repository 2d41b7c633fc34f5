"""Media columns: texts as AVI motion-JPEG, read back into samples, shots and clips.

The form that texts are stored in is lossless: a payload byte becomes two grey
8x8 blocks, one per nibble, the first in the range 70-85, the next in 117-132.
The DC step is 8, so a block's DC value is its sample less 128, and
neighbouring blocks always differ by 32 to 62: every difference is of category
6. With a one-bit code for that category and a one-bit end-of-block, a block
takes exactly one byte of the scan. Any baseline JPEG decoder yields the same
samples.

The reader takes any AVI of baseline grey JPEG frames: quantisation and Huffman
tables (the standard ones if a frame has none), restart intervals and AC
coefficients are read from the frames, and blocks go through the inverse
transform. Frames whose tables make every block one byte are decoded by array
operations and yield one sample per block, which all of its 64 share.

A text is UTF-8 (null: empty) with bytes 0 up to a positive multiple of 64.
Frames are 128 samples wide and hold up to 2048 payload bytes each; the AVI
has a header, an INFO comment with the payload's length, the frames and idx1.
Shots are cut where the difference of neighbouring frames' histograms is above
their running mean plus three deviations.

Defined results: equal texts give equal rows; an empty text is one unit of
bytes 0; a very long text is one file in its task's memory; rows with null ids
are kept; an empty table gives no rows; extra columns are ignored, whatever
their names; a file without a payload comment has an empty payload; files that
are no AVI, and frames that are not baseline grey JPEG or not of one size, raise
ValueError.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT, FRAME, WIDTH, FRAME_MS = 64, 2048, 128, 40
#: Bytes of files that are handed back at once, unless one is larger.
BATCH_BYTES = 1 << 22
# The standard Huffman tables for luminance, as numbers of codes by length and their values.
DC_TABLE = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12))
AC_TABLE = bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]), bytes.fromhex(
    "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a"
    "434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
    "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
)
LOW, HIGH, GREY = 70, 117, 128
#: A cut needs this difference at least, and this many deviations above the mean of the last WINDOW differences.
LEAST_CUT, DEVIATIONS, WINDOW, BINS = 0.15, 3.0, 12, 256
#: Equal sources of up to 32 values differ by chance by less than this over the root of a frame's samples; full frames are far below LEAST_CUT.
CHANCE = 4.5


def payload_of(data: bytes) -> bytes:
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _jpeg_head(height: int) -> bytes:
    return b"".join([
        b"\xff\xd8",
        _segment(0xDB, b"\x00" + bytes([8] + [1] * 63)),
        _segment(0xC0, struct.pack(">BHHB", 8, height, WIDTH, 1) + b"\x01\x11\x00"),
        _segment(0xC4, b"\x00" + bytes([1] + [0] * 15) + b"\x06" + b"\x10" + bytes([1] + [0] * 15) + b"\x00"),
        _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ])


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


def _list(name: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", name + body)


def encode(payload: bytes) -> bytes:
    """The AVI file of a payload."""
    per = min(len(payload), FRAME)
    frames = -(-len(payload) // per)
    data = np.zeros(frames * per, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    data = data.reshape(frames, per)
    samples = np.empty((frames, 2 * per), np.int16)
    samples[:, 0::2] = LOW + (data >> 4)
    samples[:, 1::2] = HIGH + (data & 15)
    diff = np.diff(samples, axis=1, prepend=np.int16(GREY))
    scan = ((diff + 63 * (diff < 0)) << 1).astype(np.uint8)
    head = _jpeg_head(per)
    size = len(head) + 2 * per + 2
    one = _chunk(b"00dc", head + scan[0].tobytes() + b"\xff\xd9")
    movi = b"".join([one, *(_chunk(b"00dc", head + s.tobytes() + b"\xff\xd9") for s in scan[1:])])
    index = b"".join(b"00dc" + struct.pack("<III", 0x10, 4 + i * len(one), size) for i in range(frames))
    avih = struct.pack("<14I", FRAME_MS * 1000, 0, 0, 0x10, frames, 0, 1, size, WIDTH, per, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<10I", 0, 0, 0, FRAME_MS, 1000, 0, frames, size, 0xFFFFFFFF, 0) + struct.pack("<4H", 0, 0, WIDTH, per)
    strf = struct.pack("<IiiHH4s5I", 40, WIDTH, per, 1, 8, b"MJPG", WIDTH * per, 0, 0, 0, 0)
    body = b"AVI " + _list(b"hdrl", _chunk(b"avih", avih) + _list(b"strl", _chunk(b"strh", strh) + _chunk(b"strf", strf))) + _list(b"INFO", _chunk(b"ICMT", b"payload=%d" % len(payload))) + _list(b"movi", movi) + _chunk(b"idx1", index)
    return _chunk(b"RIFF", body)


def _chunks(data: bytes, lo: int, hi: int) -> Iterator[tuple[bytes, int, int]]:
    while lo + 8 <= hi:
        n = struct.unpack_from("<I", data, lo + 4)[0]
        yield data[lo : lo + 4], lo + 8, lo + 8 + n
        lo += 8 + n + n % 2


def parse(media: bytes) -> tuple[int, int, list[tuple[int, int]]]:
    """Payload length, milliseconds per frame and the frames' spans, by the file's index."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    length, ms, movi, index = -1, FRAME_MS, 0, b""
    for name, lo, hi in _chunks(media, 12, len(media)):
        kind = media[lo : lo + 4] if name == b"LIST" else b""
        if kind == b"hdrl":
            ms = next(struct.unpack_from("<I", media, a)[0] // 1000 for n, a, _ in _chunks(media, lo + 4, hi) if n == b"avih")
        elif kind == b"INFO":
            length = next((int(media[a:b].partition(b"=")[2]) for n, a, b in _chunks(media, lo + 4, hi) if n == b"ICMT"), -1)
        elif kind == b"movi":
            movi = lo
        elif name == b"idx1":
            index = media[lo:hi]
    spans = []
    for entry in range(0, len(index) - 15, 16):
        _, _, offset, size = struct.unpack_from("<4sIII", index, entry)
        spans.append((movi + offset + 8, movi + offset + 8 + size))
    return length, ms, spans


@lru_cache(maxsize=64)
def _codes(counts: bytes, values: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For every 16 bits: the length of the code that they begin with (0: none), and its value."""
    length, value = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    code = at = 0
    for bits, n in enumerate(counts, 1):
        for v in values[at : at + n]:
            lo = code << (16 - bits)
            length[lo : lo + (1 << (16 - bits))], value[lo : lo + (1 << (16 - bits))] = bits, v
            code += 1
        at += n
        code <<= 1
    return length, value


def _zigzag() -> np.ndarray:
    """Place in the block, row by row, of each coefficient of a scan."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()
_COSINES = np.array([[(0.125**0.5 if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


class _Head:
    """What a frame says before its scan: size, tables, restart interval, and where the scan begins."""

    def __init__(self, frame: bytes):
        if frame[:2] != b"\xff\xd8":
            raise ValueError("a frame is no JPEG")
        self.quant: dict[int, np.ndarray] = {}
        self.huffman = {0x00: DC_TABLE, 0x10: AC_TABLE}
        self.height = self.width = self.restart = 0
        at = 2
        while True:
            if len(frame) < at + 4 or frame[at] != 0xFF:
                raise ValueError("a frame's headers are cut off")
            marker, n = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
            body, at = frame[at + 4 : at + 2 + n], at + 2 + n
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    total = sum(body[1:17])
                    self.huffman[body[0]] = bytes(body[1:17]), bytes(body[17 : 17 + total])
                    body = body[17 + total :]
            elif marker in (0xC0, 0xC1):
                depth, self.height, self.width, parts = struct.unpack_from(">BHHB", body)
                if depth != 8 or parts != 1 or not self.width * self.height:
                    raise ValueError("a frame is not 8-bit grey")
                self.table = body[8]
            elif 0xC2 <= marker <= 0xCF and marker != 0xCC:
                raise ValueError("a frame is not baseline")
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                if not self.height or self.table not in self.quant:
                    raise ValueError("a frame lacks its size or quantisation")
                self.dc, self.ac = (_codes(*self.huffman[k]) for k in (body[2] >> 4, 0x10 | body[2] & 15))
                self.scan = at
                return


def _plain_samples(head: _Head, scan: bytes) -> np.ndarray | None:
    """One sample per block, if every block is one byte: a difference of category 6 by a one-bit code, and the end of the block."""
    blocks = -(-head.height // 8) * -(-head.width // 8)
    one_bit = all(length[0] == 1 and value[0] == v for (length, value), v in ((head.dc, 6), (head.ac, 0)))
    if not one_bit or head.restart or len(scan) != blocks or head.quant[head.table][0] != 8:
        return None
    bits = np.frombuffer(scan, np.uint8)
    if (bits & 0x81).any():
        return None
    bits = bits.astype(np.int16) >> 1
    dc = np.cumsum(np.where(bits >= 32, bits, bits - 63), dtype=np.int32)
    return np.clip(dc + GREY, 0, 255).astype(np.uint8)


def _samples(head: _Head, scan: bytes) -> np.ndarray:
    """All samples of a frame, row by row."""
    rows, columns = -(-head.height // 8), -(-head.width // 8)
    found = np.zeros((rows * columns, 64), np.int64)
    parts = re.split(rb"\xff[\xd0-\xd7]", scan) if head.restart else [scan]
    each = head.restart or rows * columns
    (dc_length, dc_value), (ac_length, ac_value) = head.dc, head.ac
    for k, part in enumerate(parts):
        data = part.replace(b"\xff\x00", b"\xff") + b"\xff" * 8
        at, dc, limit = 0, 0, 8 * (len(data) - 4)

        def take(n: int) -> int:
            nonlocal at
            got = int.from_bytes(data[at >> 3 : (at >> 3) + 4], "big") >> (32 - n - (at & 7)) & ((1 << n) - 1)  # noqa: B023
            at += n
            return got

        def code(length: np.ndarray, value: np.ndarray) -> int:
            nonlocal at
            top = take(16)
            at += int(length[top]) - 16
            if not length[top] or at > limit:  # noqa: B023
                raise ValueError("a frame's scan is broken")
            return int(value[top])

        def number(bits: int) -> int:
            got = take(bits) if bits else 0
            return got if not bits or got >> (bits - 1) else got - (1 << bits) + 1

        for block in range(k * each, min((k + 1) * each, len(found))):
            dc += number(code(dc_length, dc_value))
            found[block, 0] = dc
            place = 1
            while place < 64:
                pair = code(ac_length, ac_value)
                if not pair & 15:
                    if pair != 0xF0:
                        break
                    place += 16
                    continue
                place += pair >> 4
                if place > 63:
                    raise ValueError("a frame's scan is broken")
                found[block, ZIGZAG[place]] = number(pair & 15)
                place += 1
    steps = np.zeros(64, np.int64)
    steps[ZIGZAG] = head.quant[head.table]
    values = np.einsum("ux,nuv,vy->nxy", _COSINES, (found * steps).reshape(-1, 8, 8), _COSINES)
    image = np.clip(np.rint(values + GREY), 0, 255).astype(np.uint8).reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(8 * rows, 8 * columns)
    return image[: head.height, : head.width].ravel()


def frame_samples(frame: bytes) -> np.ndarray:
    """A frame's grey samples: one for each block where all blocks are plain, else one for each pixel."""
    head = _Head(frame)
    end = frame.rfind(b"\xff\xd9")
    scan = frame[head.scan : end if end >= head.scan else len(frame)]
    plain = _plain_samples(head, scan)
    return _samples(head, scan) if plain is None else plain


def decode(media: bytes) -> tuple[bytes, np.ndarray, int]:
    """The payload, the grey samples by frame, and milliseconds per frame."""
    length, ms, spans = parse(media)
    found = [frame_samples(media[a:b]) for a, b in spans]
    if len({len(f) for f in found}) != 1:
        raise ValueError("a file needs frames, all of one size")
    samples = np.stack(found)
    if length < 0:
        return b"", samples, ms
    data = ((samples[:, 0::2].astype(np.int16) - LOW) << 4 | (samples[:, 1::2] - np.int16(HIGH))).astype(np.uint8).tobytes()
    return data[:length], samples, ms


def shots(samples: np.ndarray) -> list[tuple[int, int]]:
    """First and end frame of each shot."""
    n, m = samples.shape
    hist = np.bincount((samples + BINS * np.arange(n)[:, None]).ravel(), minlength=BINS * n).reshape(n, BINS)
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1) / (2 * m)
    least = max(LEAST_CUT, CHANCE / m**0.5)
    cuts = [0]
    for i, d in enumerate(diff):
        past = diff[max(cuts[-1], i - WINDOW) : i]
        if d > max(least, past.mean() + DEVIATIONS * past.std() if len(past) else least):
            cuts.append(i + 1)
    return list(zip(cuts, [*cuts[1:], n], strict=True))


def _media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        media: list[bytes] = []
        sizes: list[int] = []
        first, held = 0, 0
        for i, text in enumerate(batch.column("text").cast(pa.large_binary()), 1):
            data = text.as_py() if text.is_valid else b""
            media.append(encode(payload_of(data)))
            sizes.append(len(data))
            held += len(media[-1])
            if held >= BATCH_BYTES or i == batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, i - first), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])
                media, sizes, first, held = [], [], i, 0


def to_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: its id, n_bytes and media (the AVI file)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_media, f"id {id_type}, n_bytes bigint, media binary").withColumnRenamed("id", id_col)


def _clips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for i, m in enumerate(batch.column("media")):
            _, samples, ms = decode(m.as_py())
            rows += [(i, k, a * ms, b * ms, float(np.round(samples[a:b].mean(), 3))) for k, (a, b) in enumerate(shots(samples))]
        which, clip, start, end, grey = zip(*rows, strict=True) if rows else ((),) * 5
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(which, pa.int64())), pa.array(clip, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(grey, pa.float64())], names=["id", "clip", "start_ms", "end_ms", "mean_grey"])


def clips(media: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Per shot of each file: id, clip, start_ms, end_ms and mean_grey."""
    id_type = media.schema[id_col].dataType.simpleString()
    return media.select(F.col(id_col).alias("id"), "media").mapInArrow(_clips, f"id {id_type}, clip int, start_ms bigint, end_ms bigint, mean_grey double").withColumnRenamed("id", id_col)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for m in batch.column("media"):
            media = m.as_buffer().to_pybytes()
            payload, samples, ms = decode(media)
            found = shots(samples)
            counts = np.bincount(samples.ravel(), minlength=256)
            p = counts[counts > 0] / samples.size
            feature = f"frames={len(samples)};shots={len(found)};grey={samples.mean():.3f};entropy={-(p * np.log2(p)).sum():.3f};clips=" + ",".join(f"{a * ms}-{b * ms}" for a, b in found)
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def digest(media: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Per file: what is read back from it."""
    id_type = media.schema[id_col].dataType.simpleString()
    return media.select(F.col(id_col).alias("id"), "n_bytes", "media").mapInArrow(_digest, f"id {id_type}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string").withColumnRenamed("id", id_col)
