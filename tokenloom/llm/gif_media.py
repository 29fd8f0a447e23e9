"""Operator 5: GIF media columns.

`decode()` reads any GIF87a or GIF89a: LZW code streams of growing width, global and local palettes, interlacing, and the disposal, delay and
transparency of each frame, composed on the logical screen. `frames()` stores timed frames as rows with a 64-bin colour histogram (2 bits of each of red, green, blue).

`encode()` stores bytes as 8-bit samples: frames of 64 columns and ROWS rows at most, shown for 100 ms each, with a grey palette so that a sample is its own colour. Codes are found one by
one, bits are packed and unpacked as arrays. A payload is the text's UTF-8 bytes and zero bytes up to a positive multiple of 64.

Nulls and empty texts: 64 zero bytes. A null media column gives null features; bytes that are no GIF raise ValueError. Memory grows with the longest text alone. Other columns stay as they are.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS, ROWS = 64, 1024
DELAY = 10  # hundredths of a second
GREY = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, 1)


@dataclass
class Frame:
    """A frame as shown: the whole screen after composing, and where the frame's own image lies in it."""

    rgb: np.ndarray
    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    transparent: int | None

    def own(self) -> np.ndarray:
        return self.rgb[self.top : self.top + self.height, self.left : self.left + self.width]

    def histogram(self) -> np.ndarray:
        q = self.own().reshape(-1, 3) >> 6
        return np.bincount(q[:, 0] * 16 + q[:, 1] * 4 + q[:, 2], minlength=64)


def _blocks(data: bytes) -> bytes:
    """data in sub-blocks of up to 255 bytes, with the empty one that ends them."""
    full = len(data) // 255
    out = np.empty((full, 256), np.uint8)
    out[:, 0] = 255
    out[:, 1:] = np.frombuffer(data, np.uint8, full * 255).reshape(full, 255)
    rest = data[full * 255 :]
    return out.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def _widths(size: int, n: int) -> np.ndarray:
    """Bits of the n codes that follow a clear code: as many as it takes to write the newest entry of the reader's table, 12 at most."""
    newest = np.minimum((1 << size) + 1 + np.arange(n), 4095)
    return np.maximum(np.frexp(newest.astype(float))[1], size + 1).astype(np.int64)


def lzw_compress(samples: bytes, size: int = 8) -> bytes:
    """A code stream with codes of strings: the longest known string each time, and a clear code when the table is full."""
    clear = 1 << size
    codes, table, free = [clear], {}, clear + 2
    put, find, have = codes.append, table.get, -1
    for value in samples:
        if have < 0:  # the first of all
            have = value
        elif code := find(have << 8 | value):
            have = code
        else:
            put(have)
            if free < 4096:
                table[have << 8 | value] = free
                free += 1
            else:
                put(clear)
                table.clear()
                free = clear + 2
            have = value
    if have >= 0:
        put(have)
    put(clear + 1)
    made = np.array(codes, np.int64)
    # a clear code has the width of its place in the run that it ends
    run = np.arange(len(made))
    marks = np.flatnonzero(made == clear)
    run -= np.append(0, marks + 1)[np.searchsorted(marks, run, "left")]
    bits = _widths(size, int(run.max()) + 1)[run]
    at = np.cumsum(bits) - bits
    out = np.zeros(int(at[-1] + bits[-1]) + 31 >> 3, np.uint8)
    made <<= at & 7
    for k in range(3):  # the bits of codes are apart, so their sum is their union
        out += np.bincount((at >> 3) + k, weights=made >> 8 * k & 255, minlength=len(out))[: len(out)].astype(np.uint8)
    return out[: int(at[-1] + bits[-1]) + 7 >> 3].tobytes()


def _runs(data: bytes, size: int) -> Iterator[list[int]]:
    """The codes between clear codes, up to the end code or the end of data."""
    raw = np.append(np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)).astype(np.int64)
    total, start, clear = 8 * len(data), 0, 1 << size
    while start + size < total:
        n = 4096
        while True:  # a run may go on after its table is full
            bits = _widths(size, n)
            ends = start + np.cumsum(bits)
            have = int(np.searchsorted(ends, total, "right"))
            at = (ends - bits)[:have]
            byte = at >> 3
            codes = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (at & 7) & (1 << bits[:have]) - 1
            stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
            if len(stop) or have < n:
                break
            n *= 4
        k = int(stop[0]) if len(stop) else have
        yield codes[:k].tolist()
        if not len(stop) or codes[k] == clear + 1:
            return
        start = int(ends[k])


def lzw_decode(data: bytes, size: int) -> np.ndarray:
    """Samples of a code stream; it may end without an end code. An entry is the string of the code before it and the next sample, which stand in the output already: so strings are copied from there."""
    first, out = (1 << size) + 2, bytearray()
    for codes in _runs(data, size):
        begins = []
        for code in codes:
            at = len(out)
            if code < first:
                out.append(code)
            else:
                k = code - first
                if k + 1 < len(begins):
                    out += out[begins[k] : begins[k + 1] + 1]
                elif k + 1 == len(begins):  # the entry that this very code completes
                    out += out[begins[k] : at]
                    out.append(out[begins[k]])
                else:
                    raise ValueError("LZW code beyond the table")
            begins.append(at)
    return np.frombuffer(bytes(out), np.uint8)


def pack(width: int, height: int, palette: np.ndarray, frames: list[dict]) -> bytes:
    """A GIF of frames: samples (rows by columns), and left, top, delay (hundredths), disposal, transparent if not 0, 0, 0, 0, none."""
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette.astype(np.uint8).tobytes()]
    for f in frames:
        samples, see = np.ascontiguousarray(f["samples"], np.uint8), f.get("transparent")
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, f.get("disposal", 0) << 2 | (see is not None), f.get("delay", 0), see or 0, 0))
        out.append(struct.pack("<BHHHHBB", 0x2C, f.get("left", 0), f.get("top", 0), samples.shape[1], samples.shape[0], 0, 8))
        out.append(_blocks(lzw_compress(samples.tobytes())))
    return b"".join([*out, b";"])


def encode(payload: bytes) -> bytes:
    """payload (a positive multiple of 64 bytes) as a GIF."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, COLUMNS)
    return pack(COLUMNS, min(ROWS, len(rows)), GREY, [{"samples": rows[k : k + ROWS], "delay": DELAY, "disposal": 1} for k in range(0, len(rows), ROWS)])


def decode(data: bytes) -> Iterator[Frame]:
    """Frames in order, composed. A screen of one is held at a time."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags, back, _ = struct.unpack_from("<HHBBB", data, 6)
    at = 13

    def colours(flags: int) -> np.ndarray | None:
        nonlocal at
        if not flags & 0x80:
            return None
        n = 2 << (flags & 7)
        table = np.zeros((256, 3), np.uint8)
        table[:n] = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
        return table

    def sub_blocks() -> bytes:
        nonlocal at
        parts = []
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += n + 1
        at += 1
        return b"".join(parts)

    common = colours(flags)
    screen = np.zeros((height, width, 3), np.uint8)
    screen[:] = 0 if common is None else common[back]
    empty = screen.copy()
    delay = disposal = 0
    see: int | None = None
    while True:
        if at >= len(data):
            raise ValueError("GIF without a trailer")
        kind = data[at]
        at += 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at]
            at += 1
            body = sub_blocks()
            if label == 0xF9:
                disposal, see, delay = body[0] >> 2 & 7, body[3] if body[0] & 1 else None, body[1] | body[2] << 8
            continue
        if kind != 0x2C:
            raise ValueError("unknown GIF block")
        left, top, w, h, own = struct.unpack_from("<HHHHB", data, at)
        at += 9
        local = colours(own)
        palette = local if local is not None else common
        size = data[at]
        at += 1
        samples = lzw_decode(sub_blocks(), size)
        if palette is None or len(samples) < w * h:
            raise ValueError("GIF frame without palette or samples")
        samples = samples[: w * h].reshape(h, w)
        if own & 0x40:
            order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            lines = np.empty_like(samples)
            lines[order] = samples
            samples = lines
        before = screen.copy() if disposal == 3 else None
        area = screen[top : top + h, left : left + w]
        image = palette[samples[: area.shape[0], : area.shape[1]]]
        if see is None:
            area[:] = image
        else:
            shown = samples[: area.shape[0], : area.shape[1]] != see
            area[shown] = image[shown]
        yield Frame(screen.copy(), left, top, area.shape[1], area.shape[0], delay * 10, disposal, see)
        if disposal == 2:
            area[:] = empty[top : top + h, left : left + w]
        elif before is not None:
            screen = before
        delay = disposal = 0
        see = None


def payload(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 or (0 if text else 64))


def add_media(df: DataFrame, *, text_col: str = "text", name: str = "media") -> DataFrame:
    """df with text_col stored as a GIF."""

    @F.arrow_udf("binary")
    def store(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([encode(payload((x.as_py() or "").encode())) for x in column], pa.binary())

    return df.withColumn(name, store(F.col(text_col)))


FEATURES = "struct<payload_bytes: long, payload_sha256: string, tail_crc32: long, media_bytes: long, media_sha256: string, frames: int, shown_ms: long, feature: string>"


def media_features(df: DataFrame, *, media_col: str = "media", name: str = "features") -> DataFrame:
    """df with what is read back from media_col: its samples' digests, size, frames and colour histogram (as a string)."""

    @F.arrow_udf(FEATURES)
    def features(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            out = []
            for x in column:
                data = x.as_py()
                if data is None:
                    out.append(None)
                    continue
                sha, size, tail, bins, n, shown = hashlib.sha256(), 0, b"", np.zeros(64, np.int64), 0, 0
                for frame in decode(data):
                    samples = frame.own()[:, :, 0].tobytes()
                    sha.update(samples)
                    size, tail, bins, n, shown = size + len(samples), (tail + samples)[-64:], bins + frame.histogram(), n + 1, shown + frame.delay_ms
                out.append({
                    "payload_bytes": size, "payload_sha256": sha.hexdigest(), "tail_crc32": zlib.crc32(tail), "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(),
                    "frames": n, "shown_ms": shown, "feature": " ".join(f"{k}:{v}" for k, v in enumerate(bins.tolist()) if v),
                })
            kinds = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("frames", pa.int32()), ("shown_ms", pa.int64()), ("feature", pa.string())]
            yield pa.array(out, pa.struct(kinds))

    return df.withColumn(name, features(F.col(media_col)))


def frames(df: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row for each frame: id_col, frame, start_ms, delay_ms, left, top, width, height, disposal, pixels (red, green, blue by row), histogram."""
    kind = dict(df.dtypes)[id_col]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column(0), batch.column(1), strict=True):
                at = 0
                for k, f in enumerate(decode(data.as_py()) if data.is_valid else ()):
                    one = [key.as_py()], [k], [at], [f.delay_ms], [f.left], [f.top], [f.width], [f.height], [f.disposal], [f.own().tobytes()], [f.histogram().tolist()]
                    types = batch.schema.types[0], pa.int32(), pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.binary(), pa.list_(pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(one, types, strict=True)], names=["id", "frame", "start_ms", "delay_ms", "left", "top", "width", "height", "disposal", "pixels", "histogram"])
                    at += f.delay_ms

    schema = f"id {kind}, frame int, start_ms long, delay_ms long, left int, top int, width int, height int, disposal int, pixels binary, histogram array<int>"
    return df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(rows, schema).withColumnRenamed("id", id_col)


def op5(spark, docs: DataFrame) -> DataFrame:
    rows = add_media(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text"))
    return media_features(rows).select("doc_id", "n_bytes", "features.*")
