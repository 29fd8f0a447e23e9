"""Vectorised text primitives on Arrow string buffers, shared by the operators of this subpackage.

A batch of texts is one byte array plus row offsets; words and pre-tokens are index ranges into it, and a
64-bit polynomial hash names each of them, so that no Python object is made per word.
"""

from __future__ import annotations

import ctypes
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19  # rows are handled in slices of about so many bytes; one longer text is a slice of its own
U64 = np.uint64
pa.set_memory_pool(pa.system_memory_pool())  # the other pools keep what batches have freed, in every worker

_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 2**62, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_tables: dict[str, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


kept: list[dict] = []  # what operators keep in a worker for their later tasks


def lean(rows, *, keep: bool = False):
    """The batch function rows, before which its worker forgets what other operators have kept (unless it keeps something itself), and after which it gives memory back: workers stay for later tasks
    and stages, and what they have freed would else count as theirs."""

    def run(batches):
        if not keep:
            forget()
        try:
            yield from rows(batches)
        finally:
            give_back()

    return run


def forget() -> None:
    for cache in kept:
        cache.clear()


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, one row at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, (to := min(to, n))
        at = to


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse modulo 2**64, for i up to n."""
    if "power" not in _tables or len(_tables["power"]) <= n:
        size = max(n + 1, SLICE_BYTES + 4096)
        for name, base in (("power", _BASE), ("inverse", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _tables[name] = np.multiply.accumulate(steps)
        if size > 16 * SLICE_BYTES:  # of one very long text: not kept
            return _tables.pop("power"), _tables.pop("inverse")
    return _tables["power"], _tables["inverse"]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(31))
    h = h * U64(0xBF58476D1CE4E5B9)
    return h ^ (h >> U64(29))


def prefix(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of codes[i] * _BASE**i, from 0, and the inverse powers: see span_hash()."""
    power, inverse = powers(len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * power[: len(codes)], out=sums[1:])
    return sums, inverse


def span_hash(sums: np.ndarray, inverse: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of [start, end) ranges, alike wherever the range lies."""
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, rows) of runs of bytes other than 0x20 and 0x09 to 0x0D, within rows."""
    gap = SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    before = edge[:-1].copy()
    before[1:] |= gap[:-1]
    after = edge[1:].copy()
    after[:-1] |= gap[1:]
    starts = np.flatnonzero(~gap & before)
    return starts, np.flatnonzero(~gap & after) + 1, np.searchsorted(offsets, starts, "right") - 1


def _classes() -> np.ndarray:
    """Of each code point: 0 white space, 1 letter, 2 number, 3 anything else."""
    if "class" not in _tables:
        kinds = {"L": 1, "N": 2}
        table = np.full(0x110000, 3, np.uint8)  # planes 4 to 16 hold no letters or numbers
        table[:0x40000] = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], 3) for c in range(0x40000)), np.uint8, 0x40000)
        table[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 0
        _tables["class"] = table
    return _tables["class"]


def byte_classes(buf: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to, as _classes() has it."""
    table = _classes()
    kinds = table[buf]  # right for ASCII
    for lead, size, bits in ((0xC0, 2, 0x1F), (0xE0, 3, 0x0F), (0xF0, 4, 0x07)):
        at = np.flatnonzero((buf >= lead) & (buf < (0xE0, 0xF0, 0xF8)[size - 2]))
        if len(at):
            code = (buf[at] & bits).astype(np.int64)
            for k in range(1, size):
                code = code << 6 | (buf[at + k] & 0x3F)
            own = table[code]
            for k in range(size):
                kinds[at + k] = own
    return kinds


def char_starts(buf: np.ndarray) -> np.ndarray:
    return (buf & 0xC0) != 0x80


def pretokens(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of the byte-level pattern: contractions, words, numbers and signs with one space before, white space."""
    n = len(buf)
    kind, lead = byte_classes(buf), char_starts(buf)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    head, last = first[:-1], first[1:]
    prev = np.empty(n, np.uint8)
    prev[0], prev[1:] = 9, kind[:-1]
    prev[head] = 9
    gap = kind == 0
    start = head | (lead & (kind != prev))
    # the last white-space character of a run before something else begins a token; a plain space takes what follows with it
    lead_at = np.flatnonzero(lead)
    following = np.append(lead_at[1:], n)
    ends_run = gap[lead_at] & ~last[following - 1]
    ends_run[:-1] &= ~gap[lead_at[1:]]
    tail = lead_at[ends_run]
    start[tail] = True
    taken = tail[buf[tail] == 32] + 1
    start[taken] = head[taken]
    quote = np.flatnonzero(buf == 39)
    if len(quote):
        free = (prev[quote] == 9) | (prev[quote] == 1) | (prev[quote] == 2) | ((prev[quote] == 0) & (buf[quote - 1] != 32))
        limit = offsets[np.searchsorted(offsets, quote, "right")]
        padded = np.concatenate([buf, np.zeros(3, np.uint8)])
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8)) & (quote + 2 <= limit)
        pair = (one.astype(np.int64) << 8 | two)
        long = np.isin(pair, [ord("r") << 8 | ord("e"), ord("v") << 8 | ord("e"), ord("l") << 8 | ord("l")]) & (quote + 3 <= limit) & ~short
        for hit, size in ((free & short, 2), (free & long, 3)):
            at = quote[hit]
            start[at] = True
            inner = (at[:, None] + np.arange(1, size)).ravel()
            start[inner] = False
            over = at + size
            start[over[over < n]] = True
            lone = over[over < n]  # a quote just after a contraction begins a token too: rare, told below
            if np.any(buf[lone] == 39):
                _chained(buf, offsets, start, lone[buf[lone] == 39])
    return np.flatnonzero(start)


def _chained(buf: np.ndarray, offsets: np.ndarray, start: np.ndarray, at: np.ndarray) -> None:
    """Contractions that follow contractions, one after another."""
    for q in at.tolist():
        limit = int(offsets[np.searchsorted(offsets, q, "right")])
        while q < limit and buf[q] == 39:
            rest = bytes(buf[q + 1 : min(q + 3, limit)])
            size = 3 if rest in (b"re", b"ve", b"ll") else 2 if rest[:1] in (b"s", b"t", b"m", b"d") and rest else 0
            if not size:
                break
            start[q] = True
            start[q + 1 : q + size] = False
            q += size
            if q < limit:
                start[q] = True


class HashIndex:
    """Open addressing from 64-bit hashes to numbers 0, 1, ...: every probe handles a whole array."""

    def __init__(self, bits: int = 16) -> None:
        self.n, self.bits = 0, bits
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        out, todo = np.full(len(h), -1, np.int32), np.arange(len(h))
        mask = U64((1 << self.bits) - 1)
        slot = (h & mask).astype(np.int64)
        while len(todo):
            value = self.values[slot]
            used = value >= 0
            hit = used & (self.keys[slot] == h[todo])
            out[todo[hit]] = value[hit]
            go = used & ~hit
            todo, slot = todo[go], (slot[go] + 1) & int(mask)
        return out

    def add(self, h: np.ndarray) -> None:
        """New, distinct hashes get the next numbers."""
        number = np.arange(self.n, self.n + len(h), dtype=np.int32)
        self.n += len(h)
        if self.n * 2 > len(self.keys):
            old = self.values >= 0
            keys, values = self.keys[old], self.values[old]
            while self.n * 2 > 1 << self.bits:
                self.bits += 1
            self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
            self._put(keys, values)
        self._put(h, number)

    def _put(self, h: np.ndarray, number: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        slot = (h & U64(mask)).astype(np.int64)
        while len(h):
            free = self.values[slot] < 0
            self.values[slot[free]] = number[free]  # of several for one slot, the last stays
            mine = self.values[slot] == number
            self.keys[slot[mine]] = h[mine]
            h, number, slot = h[~mine], number[~mine], (slot[~mine] + 1) & mask


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each range, one range after another."""
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)
