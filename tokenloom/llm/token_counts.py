"""Operator 7: token counts by rank-synchronous array merging.

For a byte-pair model of the sentencepiece library. Each text gets the model's leading space and is cut before every run of spaces: no piece
of such a model spans "other character, space", so merges never cross a cut (checked when the model is loaded).
Distinct cuts are held as one ragged array of piece numbers; in each round every sequence merges its own lowest-rank
pair (the leftmost of equal ones), until no pair of any sequence is a piece. The symbols that survive are counted, a
character outside the vocabulary with its UTF-8 bytes. Sequences over LONG characters take the same merges one at
a time from a heap.

Nulls and empty texts: 0 tokens. Special strings inside texts are ordinary text, as in the library. Other columns stay as they are.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm._text import BYTE_CODE, U64, HashIndex, buffers, char_starts, give_back, kept, mix, prefix, slices, span_hash

LONG = 200
CACHE = 2_000_000  # distinct cuts that a worker remembers
MARK = "▁"


class Counter:
    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, kinds = model.normalizer_spec, pb.ModelProto.SentencePiece
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with an identity normaliser are counted by merging")
        pieces = {p.piece: p.score for p in model.pieces if p.type in (kinds.NORMAL, kinds.UNUSED)}
        if any(p.type == kinds.USER_DEFINED for p in model.pieces) or any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("user-defined pieces, or pieces that hold a space after another character, can't be cut")
        self.lead = spec.add_dummy_prefix
        self.bytes = any(p.type == kinds.BYTE for p in model.pieces)
        order = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        number = {p: i for i, p in enumerate(pieces)}
        self.chars = np.full(0x110000, -1, np.int32)
        left, right, into, rank = [], [], [], []
        for p, i in number.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
            for k in range(1, len(p)):
                a, b = number.get(p[:k]), number.get(p[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), into.append(i), rank.append(order[pieces[p]])
        self.chars[32] = self.chars[ord(MARK)]
        key = np.array(left, np.uint64) << U64(32) | np.array(right, np.uint64)
        self.pairs = HashIndex(19)
        self.pairs.add(mix(key + U64(1)))
        self.into, self.rank = np.array(into, np.int32), np.array(rank, np.int64)
        self.clear()

    def clear(self) -> None:
        self.index, self.known = HashIndex(), np.zeros(0, np.int32)

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Numbers of the pairs (a, b), -1 for what is no piece together."""
        out = np.full(len(a), -1, np.int32)
        ok = np.flatnonzero((a >= 0) & (b >= 0))
        out[ok] = self.pairs.find(mix((a[ok].astype(np.uint64) << U64(32) | b[ok].astype(np.uint64)) + U64(1)))
        return out

    def merge(self, sym: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Symbols left of each sequence; sequences lie one after another in sym."""
        out, ids = sizes.astype(np.int64), np.arange(len(sizes))
        while True:
            first = np.cumsum(sizes) - sizes
            pair = np.full(len(sym), -1, np.int32)
            pair[:-1] = self._pair(sym[:-1], sym[1:])
            pair[first + sizes - 1] = -1  # no pair across sequences
            none = np.iinfo(np.int64).max
            place = np.arange(len(sym)) - np.repeat(first, sizes)
            key = np.where(pair >= 0, self.rank[pair] << 20 | place, none)
            best = np.minimum.reduceat(key, first)
            on = best != none
            out[ids[~on]] = sizes[~on]
            if not on.any():
                return out
            at = first[on] + (best[on] & 0xFFFFF)
            keep = np.repeat(on, sizes)
            sym[at] = self.into[pair[at]]
            keep[at + 1] = False
            sym, sizes, ids = sym[keep], sizes[on] - 1, ids[on]

    def merge_long(self, text: str) -> int:
        """The same for one long sequence."""
        sym = self.chars[np.array([ord(c) for c in text])].tolist()
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(at: list[int]) -> None:
            a = [(i, after[i]) for i in at if 0 <= i and after[i] < n]
            found = self._pair(np.array([sym[i] for i, _ in a], np.int64), np.array([sym[j] for _, j in a], np.int64)).tolist() if a else []
            for (i, j), p in zip(a, found, strict=True):
                if p >= 0:
                    heapq.heappush(heap, (int(self.rank[p]), i, p, sym[i], sym[j]))

        offer(list(range(n - 1)))
        left = n
        while heap:
            _, i, p, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j], after[i] = int(self.into[p]), -2, after[j]
            if after[i] < n:
                before[after[i]] = i
            left -= 1
            offer([before[i], i])
        return left + sum(len(c.encode()) - 1 for c in text if self.chars[ord(c)] < 0) * self.bytes

    def _count(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        whole = buf.tobytes()
        texts = [whole[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        out = np.zeros(len(texts), np.int64)
        for i in np.flatnonzero(sizes > LONG).tolist():
            out[i] = self.merge_long(texts[i])
        short = np.flatnonzero(sizes <= LONG)
        if len(short):
            points = np.frombuffer("".join([texts[i] for i in short.tolist()]).encode("utf-32-le"), np.uint32)
            sym, sizes = self.chars[points], sizes[short]
            out[short] = self.merge(sym.copy(), sizes)
            if self.bytes and (sym < 0).any():  # a character that is no piece counts once for each byte
                extra = np.where(sym < 0, (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF), 0)
                out[short] += np.add.reduceat(extra, np.cumsum(sizes) - sizes)
        return out

    def __call__(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each row."""
        rows = len(offsets) - 1
        if not len(buf):
            return np.zeros(rows, np.int64)
        if self.lead:
            full = np.diff(offsets) > 0
            shift = np.cumsum(full)
            spread = np.full(len(buf) + int(shift[-1]), 32, np.uint8)
            spread[np.arange(len(buf)) + np.repeat(shift, np.diff(offsets))] = buf
            buf, offsets = spread, np.append(0, offsets[1:] + shift)
        own = (buf == 0xE2) if len(buf) else np.zeros(0, bool)
        if own.any():  # the mark itself counts as a space
            own[:-2] &= (buf[1:-1] == 0x96) & (buf[2:] == 0x81)
            own[-2:] = False
        gap = (buf == 32) | own
        head = np.zeros(len(buf) + 1, bool)
        head[offsets] = True
        ended = np.ones(len(buf), bool)  # whether the character before is no space
        ended[1:] = ~(buf[:-1] == 32)
        if own.any():
            at = np.flatnonzero(own)
            inner = np.zeros(len(buf), bool)
            inner[at + 1] = inner[at + 2] = True
            past = at + 3
            ended[past[past < len(buf)]] = False
            gap &= ~inner
        starts = np.flatnonzero(head[:-1] | (gap & ended & char_starts(buf)))
        ends = np.append(starts[1:], len(buf))
        h = span_hash(*prefix(BYTE_CODE[buf]), starts, ends)
        if self.index.n > CACHE:
            self.clear()
        number = self.index.find(h)
        new = np.flatnonzero(number < 0)
        if len(new):
            own_h, at = np.unique(h[new], return_index=True)
            self.known = np.concatenate([self.known, self._count(buf, starts[new[at]], ends[new[at]])])
            self.index.add(own_h)
            number[new] = self.index.find(h[new])
        return np.bincount(np.searchsorted(offsets, starts, "right") - 1, weights=self.known[number], minlength=rows).astype(np.int64)


_counters: dict[str, Counter] = {}
kept.append(_counters)


def counter(path: str) -> Counter:
    """One to a worker process; it stays for later tasks."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(df: DataFrame, model: str, *, text_col: str = "text", n_bytes: str = "n_bytes", n_tokens: str = "n_tokens") -> DataFrame:
    """df with UTF-8 bytes and tokens of text_col."""

    @F.arrow_udf(f"struct<{n_bytes}: long, {n_tokens}: long>")
    def counts(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = counter(model)
        for column in columns:
            buf, offsets = buffers(column)
            made = [own(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets)]
            yield pa.StructArray.from_arrays([pa.array(np.diff(offsets)), pa.array(np.concatenate([np.zeros(0, np.int64), *made]))], names=[n_bytes, n_tokens])
        give_back()

    found = "__counts"
    while found in df.columns:
        found += "_"
    drop = [c for c in (n_bytes, n_tokens) if c in df.columns]
    return df.withColumn(found, counts(F.col(text_col))).drop(*drop).select("*", f"{found}.*").drop(found)


def op7(spark, docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    out = count_tokens(docs.select("doc_id", "text"), model)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
