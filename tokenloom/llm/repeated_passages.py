"""Operator 2: removal of repeated passages by prefix-free parsing.

Every LENGTH-byte string that starts in more than one place of the corpus is repeated; its bytes are removed wherever it stands. All is judged on the input, and strings lie within one text.

Parse: a rolling hash of GRAM bytes runs over a text; a place is a trigger if its hash is the least of some run of RUN places. Triggers cut the text into phrases of
RUN bytes at most, and whether a place is a trigger depends on less than RUN bytes to either side. So the phrases inside equal strings are the same phrases, and the first trigger
at least RUN - 1 bytes into a string (its anchor) is the same in all its copies. An anchor stands for all strings that have it (as many as its phrase is long), so the corpus is ordered phrase by phrase, not byte by byte:

1. All strings of an anchor hold its core, the LENGTH - 2 RUN + 2 + ... bytes about it. Cores are counted; those that occur once end here: in text that is not repetitive, nearly all.
2. Anchors with a repeated core are classed by all bytes of their strings. A class of two or more is repeated as a whole.
3. Classes that share a core but differ further out (the borders of repeats) are told apart string by string, from the bytes beside the core alone: string x takes x bytes to the left and
   RUN - 1 - x to the right. They meet in groups of core, quarter of x and the bytes that all of the quarter have, so a frequent core is split by what stands beside it.
   Groups of more than KEY_ROWS rows are split again, by narrower ranges of x, which have more bytes in common, down to single strings: those Spark counts. A worker holds few groups at a time.

Equality is by 64-bit hashes of cores together with 64-bit hashes of the rest. Every count is a Spark aggregate with map-side sums; copies of a text are never paired.

Nulls: a null text is an empty text, nothing is removed from texts shorter than LENGTH. Rows repeated in full are two places. A null doc_id takes part. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm._text import BYTE_CODE, U64, buffers, lean, mix, prefix, ragged, slices, span_hash
from tokenloom.sources.tables import discard, written

LENGTH, GRAM, RUN = 400, 12, 128
QUARTER = RUN // 4
WIDTHS = (QUARTER, 8, 1)  # strings of a range, as groups get narrower
KEY_ROWS = 1 << 13
assert LENGTH >= 3 * RUN + GRAM - 3  # an anchor is decided within its string


def _slide(x: np.ndarray, n: int, f) -> np.ndarray:
    """f over n neighbours, from each place on."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = f(x[:-step], x[step:])
        have += step
    return x


def triggers(buf: np.ndarray, ends: np.ndarray, sums: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Places whose rolling hash is the least of RUN places in a row, all within one text; ends: where the text of each place ends."""
    places = len(buf) - GRAM + 1
    if places < RUN:
        return np.zeros(0, np.int64)
    at = np.arange(places)
    h = span_hash(sums, inverse, at, at + GRAM) | U64(1)
    least = _slide(h, RUN, np.minimum)
    least[np.arange(len(least)) + RUN + GRAM - 1 > ends[: len(least)]] = 0
    pad = np.zeros(RUN - 1, np.uint64)
    return np.flatnonzero(h == _slide(np.concatenate([pad, least, pad]), RUN, np.maximum))


def anchors(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Of each anchor: row, first (its first string's start in the text), reach (anchor minus first), strings, and the hashes of its core and of all its strings' bytes."""
    sums, inverse = prefix(BYTE_CODE[buf])
    ends = np.repeat(offsets[1:], np.diff(offsets))
    a = triggers(buf, ends, sums, inverse)
    row = np.searchsorted(offsets, a, "right") - 1
    start, end = offsets[row], offsets[row + 1]
    before = np.full(len(a), -(10**9))
    before[1:] = np.where(row[1:] == row[:-1], a[:-1], -(10**9))
    first = np.maximum(np.maximum(start, before - RUN + 2), a - 2 * RUN + 2)
    strings = np.minimum(a - RUN + 1, end - LENGTH) - first + 1
    keep = strings > 0
    a, row, first, strings, start = a[keep], row[keep], first[keep], strings[keep], start[keep]
    core = span_hash(sums, inverse, a - RUN + 1, a - 2 * RUN + 2 + LENGTH)
    whole = mix(span_hash(sums, inverse, first, first + strings - 1 + LENGTH) + (a - first).astype(np.uint64) * U64(0x9E3779B97F4A7C15))
    return {"row": row, "first": first - start, "reach": a - first, "strings": strings, "core": core, "whole": whole}


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """One row for each anchor of docs (id, th, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = buffers(batch.column(2))
            for a, b in slices(offsets):
                at = offsets[a : b + 1]
                x = anchors(buf[at[0] : at[-1]], at - at[0])
                own = pa.array(x["row"] + a)
                yield pa.RecordBatch.from_arrays([
                    pa.array(x["core"].view(np.int64)), pa.array(x["whole"].view(np.int64)), batch.column(0).take(own), batch.column(1).take(own),
                    pa.array(x["first"].astype(np.int32)), pa.array((x["reach"] << 16 | x["strings"]).astype(np.int32)),
                ], names=["core", "whole", "id", "th", "first", "shape"])

    kind = dict(docs.dtypes)["id"]
    return docs.select("id", "th", "text").mapInArrow(lean(rows), f"core long, whole long, id {kind}, th int, first int, shape int")


BORDER = ["key", "core", "n", "id", "th", "base", "range", "beside"]
ALIKE = ["key", "core", "range", "beside"]


def _border_schema(df: DataFrame) -> str:
    return f"key long, core long, n long, id {dict(df.dtypes)['id']}, th int, base int, range int, beside binary"


def _binaries(cells: np.ndarray) -> pa.Array:
    """Rows of bytes as binary values."""
    n, width = cells.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(cells.tobytes())])


def _beside_hashes(beside: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first 0, 1, ... width - 1 bytes to the left, and of those to the right."""
    codes = BYTE_CODE[beside]
    power = np.multiply.accumulate(np.full(width, 0x9E3779B97F4A7C15, np.uint64))[:-1]
    left, right = np.zeros((len(beside), width), np.uint64), np.zeros((len(beside), width), np.uint64)
    np.cumsum(codes[:, : width - 1] * power, 1, out=left[:, 1:])
    np.cumsum(codes[:, width - 1 :] * power, 1, out=right[:, 1:])
    return left, right


def _borders(joined: DataFrame) -> DataFrame:
    """For each class that shares its core with others (edges: core, n, first, shape of a text): one row for each quarter of its strings, with the bytes beside the core that they take."""

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = batch.column(3)
        flat = lists.flatten()
        doc = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        buf, offsets = buffers(batch.column(2))
        core, n, first, shape = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
        first = first.astype(np.int64) + offsets[doc]
        base = first + (shape >> 16) - RUN + 1  # where the core begins
        high = base - first  # bytes to the left of the first string, the one that reaches furthest
        low = high - (shape & 0xFFFF) + 1
        right = base + RUN - 1 - (2 * RUN - 2) + LENGTH  # where the core ends
        wide = np.concatenate([np.zeros(RUN, np.uint8), buf, np.zeros(RUN, np.uint8)])
        sums, inverse = prefix(BYTE_CODE[wide])
        for q in range(4):
            x0, x1 = q * QUARTER, (q + 1) * QUARTER - 1
            every = np.flatnonzero((low <= x1) & (high >= x0))
            for at in range(0, len(every), KEY_ROWS):
                use = every[at : at + KEY_ROWS]
                b, r = base[use] + RUN, right[use] + RUN
                left_all, right_all = np.full(len(use), x0), np.full(len(use), RUN - 1 - x1)
                key = mix(core[use].view(np.uint64) * U64(4) + U64(q) + span_hash(sums, inverse, b - left_all, b) * U64(0xC2B2AE3D27D4EB4F))
                key = mix(key + span_hash(sums, inverse, r, r + right_all) * U64(0x9E3779B97F4A7C15))
                lo, hi = np.maximum(low[use], x0), np.minimum(high[use], x1)
                step = np.arange(QUARTER - 1)
                beside = np.concatenate([wide[(b - x0 - 1)[:, None] - step], wide[(r + RUN - 1 - x1)[:, None] + step]], 1)
                beside[:, : QUARTER - 1][step[None, :] >= (hi - x0)[:, None]] = 0
                beside[:, QUARTER - 1 :][step[None, :] >= (x1 - lo)[:, None]] = 0
                own = pa.array(doc[use])
                yield pa.RecordBatch.from_arrays([
                    pa.array(key.view(np.int64)), pa.array(core[use]), pa.array(n[use]), batch.column(0).take(own), batch.column(1).take(own),
                    pa.array((base - offsets[doc])[use].astype(np.int32)), pa.array((x0 << 16 | lo << 8 | hi).astype(np.int32)), _binaries(beside),
                ], names=BORDER)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(buffers(batch.column(2))[1]):
                yield from of(batch.slice(a, b - a))

    return joined.mapInArrow(lean(rows), _border_schema(joined))


def _narrower(borders: DataFrame, width: int, narrow: int) -> DataFrame:
    """Rows of _borders() for ranges of width strings as rows for each range of narrow strings in them: what those have in common beyond the wider range goes from beside to the key."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, shape = batch.column(0).to_numpy().view(np.uint64), batch.column(6).to_numpy()
            beside = buffers(batch.column(7))[0].reshape(batch.num_rows, -1)
            x0, low, high = shape >> 16, shape >> 8 & 0xFF, shape & 0xFF
            left, right = _beside_hashes(beside, width)
            for y in range(0, width, narrow):
                use = np.flatnonzero((low <= x0 + y + narrow - 1) & (high >= x0 + y))
                if not len(use):
                    continue
                more = width - y - narrow  # bytes to the right that all of the range have
                made = mix(mix(key[use] + mix(left[use, y] + U64(y + 1))) + mix(right[use, more]) * U64(0xC2B2AE3D27D4EB4F))
                rest = np.concatenate([beside[use, y : y + narrow - 1], beside[use, width - 1 + more : width - 1 + more + narrow - 1]], 1)
                lo, hi = np.maximum(low, x0 + y)[use], np.minimum(high, x0 + y + narrow - 1)[use]
                kept = [batch.column(k).take(pa.array(use)) for k in range(1, 6)]
                yield pa.RecordBatch.from_arrays([pa.array(made.view(np.int64)), *kept, pa.array(((x0[use] + y) << 16 | lo << 8 | hi).astype(np.int32)), _binaries(rest)], names=BORDER)

    return borders.mapInArrow(lean(rows), _border_schema(borders))


def _border_spans(borders: DataFrame, width: int = QUARTER) -> DataFrame:
    """Spans of strings that two rows of one key share; a partition holds whole keys, one after another, and a worker few of them at a time."""

    def of(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        key, core, n, base, shape = (table.column(c).to_numpy() for c in ("key", "core", "n", "base", "range"))
        beside, _ = buffers(table.column("beside"))
        left, right = _beside_hashes(beside.reshape(len(key), -1), width)
        x0, lo, hi = shape >> 16, shape >> 8 & 0xFF, shape & 0xFF
        sizes = hi - lo + 1
        own = np.repeat(np.arange(len(key)), sizes)
        x = ragged(lo, sizes)
        j = x - x0[own]
        h = mix(mix(left[own, j]) * U64(0xD6E8FEB86659FD93) + mix(right[own, width - 1 - j]) + j.astype(np.uint64) + mix(core.view(np.uint64))[own])
        group = mix(key[own].view(np.uint64) + h)
        order = np.argsort(group, kind="stable")
        g, k, v = group[order], key[own][order], h[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1]) | (v[1:] != v[:-1])
        total = np.add.reduceat(n[own][order], np.flatnonzero(new))
        twice = np.zeros(len(g), bool)
        twice[order] = (total > 1)[np.cumsum(new) - 1]
        # strings x of a row are neighbours: runs of repeated ones become spans
        on = np.flatnonzero(twice)
        if not len(on):
            return
        cut = np.ones(len(on), bool)
        cut[1:] = (on[1:] != on[:-1] + 1) | (own[on[1:]] != own[on[:-1]])
        first, last = on[cut], on[np.append(np.flatnonzero(cut)[1:] - 1, len(on) - 1)]
        r = own[first]
        yield pa.RecordBatch.from_arrays([
            table.column("id").combine_chunks().take(pa.array(r)), table.column("th").combine_chunks().take(pa.array(r)),
            pa.array((base[r] - x[last]).astype(np.int32)), pa.array((base[r] - x[first] + LENGTH).astype(np.int32)),
        ], names=["id", "th", "s", "e"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < KEY_ROWS:
                continue
            table = pa.Table.from_batches(held)
            key = table.column("key").to_numpy()
            if cut := int(np.searchsorted(key, key[-1])):  # the last key may go on
                yield from of(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held:
            yield from of(pa.Table.from_batches(held))

    kind = dict(borders.dtypes)["id"]
    return borders.repartition("key").sortWithinPartitions("key").mapInArrow(lean(rows), f"id {kind}, th int, s int, e int")


def _shared_spans(borders: DataFrame, key_rows: int) -> DataFrame:
    """Spans of strings that two rows of borders share. Keys of more than key_rows rows go on as narrower ranges, at last as strings."""
    found = []
    for width, narrow in pairwise(WIDTHS):
        borders = written(borders, "borders")
        crowded = written(borders.groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") > key_rows).select("key"), "crowded")
        if crowded.isEmpty():
            discard(crowded)
            return reduce(DataFrame.union, [*found, _border_spans(borders, width)])
        found.append(_border_spans(borders.join(crowded, "key", "left_anti").select(BORDER), width))
        hot = borders.join(crowded, "key", "left_semi").select(BORDER)
        # rows that agree in all bytes are repeated as a whole; one of them goes on for all
        alike = written(hot.groupBy(*ALIKE).agg(F.sum("n").alias("n"), F.count("*").alias("c"), *(F.first(c).alias(c) for c in ("id", "th", "base"))), "alike")
        whole = hot.filter("n = 1").join(alike.filter("c > 1").select(ALIKE), ALIKE, "left_semi")  # classes of more are repeated as a whole before
        high, low = F.col("range").bitwiseAND(0xFF), F.shiftright("range", 8).bitwiseAND(0xFF)
        found.append(whole.select("id", "th", (F.col("base") - high).alias("s"), (F.col("base") - low + LENGTH).alias("e")))
        borders = _narrower(alike.select(BORDER), width, narrow)
    strings = written(borders.select("key", "core", "n", "id", "th", (F.col("base") - F.col("range").bitwiseAND(0xFF)).alias("s")), "strings")
    twice = written(strings.groupBy("key", "core").agg(F.sum("n").alias("n")).filter("n > 1").select("key", "core"), "twice")
    alone = strings.filter("n = 1").join(twice, ["key", "core"], "left_semi")
    return reduce(DataFrame.union, [*found, alone.select("id", "th", "s", (F.col("s") + LENGTH).alias("e"))])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.pmod(F.xxhash64(text), F.lit(2**31 - 1)).cast("int").alias("th"), text.alias("text"))


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", key_rows: int = KEY_ROWS) -> DataFrame:
    """(id, th, spans array<struct<s, e>>): byte ranges of repeated strings in each text that has any; they may overlap. th: 32 bits of the text's hash, beside the id. key_rows: the most rows that a group has in
    a worker; any number gives the same bytes."""
    keyed = _keyed(docs, id_col, text_col)
    rows = _anchor_rows(keyed)
    # written before they are joined: only then can adaptive skew handling split a frequent core
    shared = written(rows.groupBy("core").agg(F.count("*").alias("places")).filter("places > 1").select("core"), "cores")
    rows = written(rows.join(shared, "core"), "anchors")
    discard(shared)
    # the first of a class, in all columns the same row: any will do, since their strings are equal, and what is written stays
    classes = written(rows.groupBy("core", "whole").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("id", "th", "first", "shape"))), "classes")
    many = classes.filter("n > 1").select("core", "whole")
    strings = F.col("shape").bitwiseAND(0xFFFF)
    full = rows.join(many, ["core", "whole"], "left_semi").select("id", "th", F.col("first").alias("s"), (F.col("first") + strings - 1 + LENGTH).alias("e"))
    mixed = written(classes.groupBy("core").agg(F.count("*").alias("c")).filter("c > 1").select("core"), "mixed")
    edges = written(classes.join(mixed, "core").select("core", "n", "id", "th", "first", "shape"), "edges")
    discard(mixed)
    held = edges.groupBy("id", "th").agg(F.collect_list(F.struct("core", "n", "first", "shape")).alias("edges"))
    d, e = keyed.alias("d"), held.alias("e")
    # rows repeated in full have one set of edges: one of them is enough
    joined = d.join(e, F.col("d.id").eqNullSafe(F.col("e.id")) & (F.col("d.th") == F.col("e.th"))).select("d.id", "d.th", "d.text", "e.edges").dropDuplicates(["id", "th"])
    border = _shared_spans(_borders(joined), key_rows)
    discard(edges)
    return full.union(border).groupBy("id", "th").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def _cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """(bytes removed, maximal runs removed, rest)."""
    removed = runs = at = 0
    kept = []
    end = -1
    for s, e in sorted(spans):
        if s > end:
            runs += 1
            kept.append(text[at:s])
        if e > end:
            removed += e - max(s, end if end > s else s)
            end = at = e
    return removed, runs, b"".join([*kept, text[at:]])


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept binary (the rest, concatenated) for each row."""
    return _cuts(docs, id_col, text_col, "kept binary", lambda kept: pa.array(kept, pa.binary()))


def _cuts(docs: DataFrame, id_col: str, text_col: str, last: str, make) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = buffers(batch.column(1))
            lists, made = batch.column(2), []
            flat = lists.flatten()
            at = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).astype(np.int64)
            s, e = flat.field(0).to_numpy(zero_copy_only=False).tolist(), flat.field(1).to_numpy(zero_copy_only=False).tolist()
            for k in range(batch.num_rows):
                made.append(_cut(buf[offsets[k] : offsets[k + 1]].tobytes(), list(zip(s[at[k] : at[k + 1]], e[at[k] : at[k + 1]], strict=True))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int64()), make([m[2] for m in made])], names=["id", "n_bytes", "n_removed", "n_spans", last.split()[0]])

    kind = dict(docs.dtypes)[id_col]
    d, s = _keyed(docs, id_col, text_col).alias("d"), repeated_spans(docs, id_col=id_col, text_col=text_col).alias("s")
    joined = d.join(s, F.col("d.id").eqNullSafe(F.col("s.id")) & (F.col("d.th") == F.col("s.th")), "left").select("d.id", "d.text", "s.spans")
    return joined.mapInArrow(lean(rows), f"id {kind}, n_bytes long, n_removed long, n_spans long, {last}").withColumnRenamed("id", id_col)


def op2(spark, docs: DataFrame) -> DataFrame:
    return _cuts(docs, "doc_id", "text", "kept_sha256 string", lambda kept: pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()))
