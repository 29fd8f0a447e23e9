"""Operator 1: token ids as Simple-8b words in shard files, and back.

File format: a Parquet table of blocks. A block has the ids of some documents in ascending doc_id order (ties by
text): `doc_ids`, `counts` (ids of each), `word_offsets` (where each document's 64-bit words begin) and `words`
(little-endian). `start` is the number of ids before the block in its shard. The top 4 bits of a word are its
selector; SELECTORS says how many ids of how many bits follow, lowest bits first. Selector 15 is an escape: the
next word is one id as it is. Documents begin on word boundaries, so any of them can be decoded alone, and
a block is decoded by one array operation for each selector and slot.

Ids may have any type that sorts. Nulls: a null text is an empty text (the end id alone), a null doc_id sorts first. Empty table: no blocks. Other
columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tokenloom.llm._text import BYTE_CODE, U64, HashIndex, buffers, kept, lean, prefix, pretokens, ragged, slices, span_hash
from tokenloom.sources.tables import scratch

#: (ids in a word, bits of each) by selector; two selectors for runs of zeros
SELECTORS = [(240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30)]
ESCAPE = 15
LANE = 240  # ids packed from one beginning; lanes are packed side by side
BLOCK_WORDS = 1 << 16
CACHE = 1_000_000  # distinct pre-tokens that a worker remembers
LEARNED = 4096  # pre-tokens that go to the library at once
ENCODED = 1 << 18  # bytes of text that are encoded at once
SHARD_BYTES = 128 << 20  # of the input, about, where that makes more shards than the session's shuffle partitions
BLOCK_SCHEMA = "shard int, block int, start long, doc_ids array<{kind}>, counts array<int>, word_offsets array<int>, words binary"

_COUNT = np.array([n for n, _ in SELECTORS] + [1])
_BITS = np.array([b for _, b in SELECTORS] + [60])
#: the selector that takes most of r remaining ids, by r; one remaining id is an escape of one raw word
_AT_MOST = np.array([ESCAPE] + [next((s for s, (n, _) in enumerate(SELECTORS) if n <= r), ESCAPE) for r in range(1, LANE + 1)])


def _fits(small: np.ndarray, n: int) -> np.ndarray:
    """Whether small holds at each place and the n - 1 places after it."""
    have, run = 1, small
    while have < n:
        step = min(have, n - have)
        joined = np.zeros(len(run), bool)
        joined[:-step] = run[:-step] & run[step:]
        run, have = joined, have + step
    return run


def encode(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, words of each sequence) of sequences laid one after another in ids."""
    if not len(ids):
        return np.zeros(0, np.uint64), np.zeros(len(counts), np.int64)
    ids = ids.astype(np.uint64)
    top = int(ids.max())
    best = np.full(len(ids), ESCAPE, np.int8)
    for s in range(len(SELECTORS) - 1, -1, -1):
        n, bits = SELECTORS[s]
        small = ids <= U64((1 << bits) - 1) if top >> bits else np.ones(len(ids), bool)
        if n > 8 and np.count_nonzero(small) < n:
            continue
        best[_fits(small, n)] = s
    lanes = -(-counts // LANE)
    owner = np.repeat(np.arange(len(counts)), lanes)
    begin = np.cumsum(counts) - counts
    within = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    at = begin[owner] + within * LANE
    left = np.minimum(counts[owner] - within * LANE, LANE)
    padded = np.concatenate([ids, np.zeros(LANE, np.uint64)])
    used, live = np.zeros(len(owner), np.int64), np.arange(len(owner))
    steps = []  # (lane, word in its lane, selector, place) of every word: the lanes step side by side
    while len(live):
        p, r = at[live], left[live]
        s = best[p]
        n = _COUNT[s]
        if (over := n > r).any():
            s = np.where(over, _AT_MOST[r], s)
            n = _COUNT[s]
        steps.append((live, used[live], s, p))
        used[live] += 1 + (s == ESCAPE)
        at[live] = p + n
        left[live] = r = r - n
        live = live[r > 0]
    lane, k, s, p = (np.concatenate(x) for x in zip(*steps, strict=True))
    to = (np.cumsum(used) - used)[lane] + k
    words = np.empty(int(used.sum()), np.uint64)
    padded = np.concatenate([ids, np.zeros(LANE, np.uint64)])
    for selector in np.unique(s).tolist():
        own = np.flatnonzero(s == selector)
        if selector == ESCAPE:
            words[to[own]] = U64(ESCAPE << 60)
            words[to[own] + 1] = padded[p[own]]
            continue
        size, bits = SELECTORS[selector]
        first, word = p[own], np.full(len(own), selector << 60, np.uint64)
        for j in range(size if bits else 0):
            word |= padded[first + j] << U64(j * bits)
        words[to[own]] = word
    sizes = np.bincount(owner, weights=used, minlength=len(counts)).astype(np.int64)
    return words, sizes


def decode(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids before each word): the inverse of encode(), for any run of whole sequences."""
    s = (words >> U64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if np.any(s == ESCAPE):  # an escaped word may look like an escape: read them in order
        at = 0
        marks = np.flatnonzero(s == ESCAPE)
        for m in marks.tolist():
            if m >= at:
                raw[m + 1] = True
                at = m + 2
    n = _COUNT[s].copy()
    n[raw] = 1
    mark = (s == ESCAPE) & ~raw
    n[mark] = 0
    before = np.cumsum(n) - n
    ids = np.zeros(int(n.sum()), np.uint64)
    ids[before[raw]] = words[raw]
    for k, (size, bits) in enumerate(SELECTORS):
        at = np.flatnonzero((s == k) & ~raw) if bits else ()
        if len(at):
            own, to, low = words[at], before[at], U64((1 << bits) - 1)
            for j in range(size):
                ids[to + j] = own >> U64(j * bits) & low
    return ids, before


def _room(held: np.ndarray, used: int, more: int) -> np.ndarray:
    """held, or the used part of it in a larger array, with room for more: what has not been written takes no memory."""
    if used + more <= len(held):
        return held
    wide = np.empty(max(2 * len(held), used + more), held.dtype)
    wide[:used] = held[:used]
    return wide


class Encoder:
    """Ids of whole texts: each distinct pre-token goes to the tokenizers library once, texts are put together from them."""

    def __init__(self, path: str) -> None:
        import json

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        pre = made.get("pre_tokenizer") or {}
        self.plain = made.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and made["model"].get("dropout") is None
        self.marks = [x["content"] for x in made.get("added_tokens", [])]
        self.clear()

    def clear(self) -> None:
        self.index, self.pool, self.used = HashIndex(), np.empty(1 << 16, np.uint32), 0
        self.begin, self.sizes = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int32)

    def _learn(self, texts: list[str], h: np.ndarray) -> None:
        for a in range(0, len(texts), LEARNED):  # what the library returns takes some hundred bytes a token until it is read
            made = [e.ids for e in self.library.encode_batch_fast(texts[a : a + LEARNED], add_special_tokens=False)]
            self._keep(made, h[a : a + LEARNED])

    def _keep(self, made: list[list[int]], h: np.ndarray) -> None:
        sizes = np.fromiter(map(len, made), np.int32, len(made))
        total, n = int(sizes.sum()), self.index.n
        self.pool = _room(self.pool, self.used, total)
        self.pool[self.used : self.used + total] = np.fromiter(chain.from_iterable(made), np.uint32, total)
        self.begin, self.sizes = _room(self.begin, n, len(made)), _room(self.sizes, n, len(made))
        self.begin[n : n + len(made)] = self.used + np.cumsum(sizes, dtype=np.int64) - sizes
        self.sizes[n : n + len(made)] = sizes
        self.used += total
        self.index.add(h)

    def __call__(self, buf: np.ndarray, offsets: np.ndarray, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each row)."""
        odd = np.zeros(len(offsets) - 1, bool)
        if not self.plain:
            odd[:] = True
        else:
            whole = buf.tobytes()
            for m in self.marks:
                at = whole.find(mark := m.encode())
                while at >= 0:
                    row = int(np.searchsorted(offsets, at, "right")) - 1
                    odd[row] |= at + len(mark) <= offsets[row + 1]
                    at = whole.find(mark, at + 1)
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        starts = pretokens(buf, offsets)
        ends = np.append(starts[1:], len(buf))
        h = span_hash(*prefix(BYTE_CODE[buf]), starts, ends)
        if self.index.n > CACHE:
            self.clear()
        number = self.index.find(h)
        new = np.flatnonzero(number < 0)
        if len(new):
            own, at = np.unique(h[new], return_index=True)
            at = new[at]
            whole = buf.tobytes()
            self._learn([whole[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], own)
            number[new] = self.index.find(h[new])
        sizes = self.sizes[number].astype(np.int64)
        ids = self.pool[ragged(self.begin[number], sizes)]
        rows = np.searchsorted(offsets, starts, "right") - 1
        counts = np.bincount(rows, weights=sizes, minlength=len(odd)).astype(np.int64)
        if odd.any():  # texts that hold special strings: by the library as they are
            parts, at = [], np.cumsum(counts) - counts
            for r in range(len(odd)):
                if odd[r]:
                    parts.append(np.array(self.library.encode(column[r].as_py() or "", add_special_tokens=False).ids, np.uint32))
                    counts[r] = len(parts[-1])
                else:
                    parts.append(ids[at[r] : at[r] + counts[r]])
            ids = np.concatenate(parts)
        return ids, counts


_encoders: dict[str, Encoder] = {}
kept.append(_encoders)


def encoder(path: str) -> Encoder:
    """One to a worker process; it stays for later tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    more = counts + 1
    out = np.full(int(more.sum()), end_id, np.uint32)
    last = np.cumsum(more) - 1
    keep = np.ones(len(out), bool)
    keep[last] = False
    out[keep] = ids
    return out, more


def write_tokens(docs: DataFrame, path: str, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, partitions: int | None = None) -> None:
    """Encode every text, append end_id, and write blocks to path in ascending id_col order: one range of ids to a shard."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard, block, start = encoder(vocabulary), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            buf, offsets = buffers(batch.column(1))
            keys = batch.column(0)
            for a, b in slices(offsets, ENCODED):
                at = offsets[a : b + 1]
                ids, counts = _with_end(*own(buf[at[0] : at[-1]], at - at[0], batch.column(1).slice(a, b - a)), end_id)
                words, sizes = encode(ids, counts)
                edges = np.concatenate([[0], np.cumsum(sizes)])
                run = np.concatenate([[0], np.cumsum(counts)])
                for i, j in slices(edges, BLOCK_WORDS):
                    part = words[edges[i] : edges[j]]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([start + int(run[i])], pa.int64()),
                        pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), keys.slice(a + i, j - i)), pa.array([counts[i:j]], pa.list_(pa.int32())),
                        pa.array([edges[i : j + 1] - edges[i]], pa.list_(pa.int32())), pa.array([part.astype("<u8").tobytes()], pa.binary()),
                    ], names=["shard", "block", "start", "doc_ids", "counts", "word_offsets", "words"])
                    block += 1
                start += int(run[-1])

    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # as the planner knows it: of the files
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(size, 2**50) // SHARD_BYTES)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(n, "id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    rows.mapInArrow(lean(blocks, keep=True), BLOCK_SCHEMA.format(kind=kind)).write.parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """One row for each document of the files: doc_id, start, n_tokens, ids array<int>."""
    return _read(spark, path, "doc_id {kind}, shard int, start long, n_tokens long, ids array<int>", lambda ids, edges: pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids.astype(np.int32))))


def token_digests(spark, path: str) -> DataFrame:
    """As read_tokens(), with ids_crc32 in place of ids: unsigned CRC-32 of the ids as little-endian 32-bit integers."""

    def crc(ids: np.ndarray, edges: np.ndarray) -> pa.Array:
        raw = memoryview(ids.astype("<u4").tobytes())
        return pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.int64())

    return _read(spark, path, "doc_id {kind}, shard int, start long, n_tokens long, ids_crc32 long", crc)


def _read(spark, path: str, schema: str, last) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("shard", "start", "counts", "word_offsets")}
                words, keys = np.frombuffer(batch.column("words")[k].as_buffer(), "<u8"), batch.column("doc_ids")[k].values
                ids, before = decode(words)
                counts = np.array(row["counts"], np.int64)
                at = np.append(before, len(ids))[np.array(row["word_offsets"][:-1], np.int64)] if len(counts) else counts
                if not np.array_equal(at, np.cumsum(counts) - counts) or len(ids) != counts.sum():
                    raise ValueError(f"shard {row['shard']}, block {row['block']}: words and counts disagree")
                edges = np.append(at, len(ids))
                yield pa.RecordBatch.from_arrays([
                    keys, pa.array([row["shard"]] * len(counts), pa.int32()),
                    pa.array(row["start"] + at, pa.int64()), pa.array(counts, pa.int64()), last(ids, edges),
                ], names=names)

    table = spark.read.parquet(path)
    kind = dict(table.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">")
    # ids of earlier shards: one row for each shard, of which there are as many as write partitions
    total = table.select("shard", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    base = total.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("base"))
    out = table.mapInArrow(lean(docs), schema.format(kind=kind)).join(F.broadcast(base), "shard", "left")
    return out.withColumn("start", F.col("start") + F.col("base")).drop("shard", "base")


def op1(spark, docs: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    path = scratch(spark, "tokens")
    write_tokens(docs, path, vocabulary, end_id=end_id)
    return token_digests(spark, path)
