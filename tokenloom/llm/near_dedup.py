"""Operator 8: near duplicates by Order MinHash.

A text is its words (A-Z in lower case); its k-mers are runs of SHINGLE words, labelled with their occurrence in the text. For each of SKETCHES seeded orders the PICK smallest
labelled k-mers are kept in text order: a sketch that changes with edits and with moved text. Texts that share a sketch are candidates, and candidates are verified: an alignment
of their k-mer sequences within the band that THRESHOLD allows gives the matched k-mers M, and they are near duplicates if M / (n1 + n2 - M) >= THRESHOLD.

Equal word sequences are one class before anything is compared, so copies are never paired. Each text of a bucket is compared with one hub, the member whose buckets hold most texts: of a
family of edited copies that is the least edited one. That makes as many pairs as there are texts in buckets, and links most of them. Pairs of a bucket that lie in different classes after that go to
an exact search, which works on differences from the hub: S(x) is the set of labelled k-mers that x or the hub has, but not both. Two texts of n1 and n2 k-mers are near duplicates only if
|S(x) - S(y)| + |S(y) - S(x)| <= (n1 + n2) (1 - THRESHOLD) / (1 + THRESHOLD), so they share (|S(x)| + |S(y)| - that) / 2 differences or more, and if this is above 0, one of the first few of
each in a common order, the rare ones first, and at places that leave enough of both. Edits that are not shared are rare in a family, so what the search pairs are texts with edits in common, not all pairs of
a family. Only where none need be shared (a text that has the hub's k-mers in another order) are the texts nearest the hub its candidates. No pair that shares a bucket is lost. Links become
classes by minimum labels with pointer jumping over tables in the shared folder. At similarity 0.8 a pair shares none of 16 sketches of 2 with a chance of about (1 - 0.64)**16, 8e-8.

Nulls: a null text is an empty one; texts without words are copies of each other. Texts of 1 to 4 words have one k-mer. A null doc_id takes part; the class id is the smallest doc_id of a
class. Rows repeated in full are copies. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm._text import BYTE_CODE, LOWER, U64, buffers, give_back, lean, mix, prefix, ragged, slices, span_hash, words
from tokenloom.sources.tables import discard, written

SHINGLE, SKETCHES, PICK, THRESHOLD = 5, 16, 2, 0.8
CELLS = 1 << 20  # counts that order differences by rarity, at most so many whatever the input
NONE_SHARED = -1  # the place of what texts near their hub have in common
_orders = np.random.default_rng(8).integers(1, 2**62, (SKETCHES, 2), dtype=np.uint64) * U64(2) + U64(1)
_LAST = U64(2**64 - 1)


def kmers(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(k-mer hashes, their number in each row, words of each row, two hashes of the word sequence of each row)."""
    rows = len(offsets) - 1
    low = LOWER[buf]
    starts, ends, own = words(low, offsets) if len(buf) else (np.zeros(0, np.int64),) * 3
    h = span_hash(*prefix(BYTE_CODE[low]), starts, ends) if len(starts) else np.zeros(0, np.uint64)
    n = np.bincount(own, minlength=rows)
    first = np.cumsum(n) - n
    keys = []
    for salt in (0x632BE59BD9B4E019, 0xD6E8FEB86659FD93):
        sums, inverse = prefix(mix(h * U64(salt)))
        keys.append(span_hash(sums, inverse, first, first + n))
    k = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    at = ragged(first, k)
    size = np.repeat(np.minimum(n, SHINGLE), k)
    sums, inverse = prefix(h)
    return span_hash(sums, inverse, at, at + size), k, n, keys[0], keys[1]


def sketches(shingles: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Order MinHash sketches, one row of SKETCHES for each text with k-mers."""
    own = np.repeat(np.arange(len(k)), k)
    tagged = mix(shingles + own.astype(np.uint64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(tagged, kind="stable")
    run = tagged[order]
    new = np.ones(len(run), bool)
    new[1:] = run[1:] != run[:-1]
    at = np.flatnonzero(new)
    label = np.empty(len(run), np.uint64)
    label[order] = np.arange(len(run)) - np.repeat(at, np.diff(np.append(at, len(run))))
    labelled = mix(shingles + label * U64(0xA24BAED4963EE407))
    full = np.flatnonzero(k)
    size = k[full]
    first = np.cumsum(size) - size
    out = np.empty((len(full), SKETCHES), np.uint64)
    for j, (a, b) in enumerate(_orders):
        v = mix(labelled * a + b)
        places = []
        for _ in range(PICK):
            best = np.minimum.reduceat(v, first)
            hit = np.flatnonzero(v == np.repeat(best, size))
            row = np.searchsorted(first, hit, "right") - 1
            once = np.ones(len(hit), bool)
            once[1:] = row[1:] != row[:-1]
            places.append(hit[once])
            v[hit[once]] = _LAST
        picked = np.sort(np.stack(places, 1), 1)  # text order
        s = np.full(len(full), j + 1, np.uint64)
        for c in range(PICK):
            s = mix(s * U64(0x9E3779B97F4A7C15) + labelled[picked[:, c]])
        out[:, j] = s
    return out


def aligned(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """M / (n1 + n2 - M), M: k-mers matched by the best alignment within the band; 0 where even all common k-mers would be too few."""
    n, m = len(a), len(b)
    need = threshold / (1 + threshold) * (n + m)  # rounded: for the band, which has one to spare, alone
    if not min(n, m) or min(n, m) / max(n, m) < threshold:
        return 0.0
    band = int(n + m - 2 * need) + 1
    low, most = 0, min(n, m)
    differ = np.flatnonzero(a[:most] != b[:most])
    low = int(differ[0]) if len(differ) else most
    differ = np.flatnonzero(a[n - (most - low) :][::-1] != b[m - (most - low) :][::-1])
    tail = int(differ[0]) if len(differ) else most - low
    x, y = a[low : n - tail], b[low : m - tail]
    order = np.argsort(y, kind="stable")
    sorted_y = y[order]
    left, right = np.searchsorted(sorted_y, x, "left"), np.searchsorted(sorted_y, x, "right")
    common = low + tail + int(np.count_nonzero(right > left))  # of x; may exceed what y has
    if common < n + m and common / (n + m - common) < threshold:
        return 0.0
    if int((right - left).sum()) <= 16 * (len(x) + len(y)) + 1024:
        # matches by place in x, then from the last place in y: the longest rise among them is the alignment
        i = np.repeat(np.arange(len(x)), right - left)
        j = order[ragged(left, right - left)]
        near = np.abs(i - j) <= band
        i, j = i[near], j[near]
        ends: list[int] = []
        for v in j[np.lexsort((-j, i))].tolist():
            at = bisect_left(ends, v)
            if at == len(ends):
                ends.append(v)
            else:
                ends[at] = v
        matched = len(ends)
    else:  # much repeated: one bit for each place of y
        places: dict[int, int] = {}
        for k, v in enumerate(y.tolist()):
            places[v] = places.get(v, 0) | 1 << k
        every = (1 << len(y)) - 1
        row, wide = every, (1 << 2 * band + 1) - 1
        for k, v in enumerate(x.tolist()):
            hits = places.get(v, 0) & (wide << k - band if k >= band else wide >> band - k)
            up = row & hits
            row = ((row + up) | (row - up)) & every
        matched = len(y) - row.bit_count()
    total = low + tail + matched
    return total / (n + m - total)


def text_keys(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, k1, k2 (of the word sequence), sketches array<long> (null for a text without words)."""
    kind = dict(docs.dtypes)[id_col]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = buffers(batch.column(1))
            for a, b in slices(offsets):
                at = offsets[a : b + 1]
                h, k, _, k1, k2 = kmers(buf[at[0] : at[-1]], at - at[0])
                edges = np.append(0, np.cumsum(np.where(k > 0, SKETCHES, 0)))
                made = sketches(h, k).ravel() if len(h) else h
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(made.view(np.int64))),
                ], names=["id", "k1", "k2", "sketches"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(rows), f"id {kind}, k1 long, k2 long, sketches array<long>")


def _sequences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k1, k2 and the k-mer sequence, as 32-bit hashes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = buffers(batch.column(0))
            for a, b in slices(offsets):
                at = offsets[a : b + 1]
                h, k, _, k1, k2 = kmers(buf[at[0] : at[-1]], at - at[0])
                low = (h & U64(0xFFFFFFFF)).astype("<u4")
                edges = (4 * np.append(0, np.cumsum(k))).astype(np.int32)
                held = pa.Array.from_buffers(pa.binary(), len(k), [None, pa.py_buffer(edges), pa.py_buffer(low.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), held], names=["k1", "k2", "seq"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(lean(rows), "k1 long, k2 long, seq binary")


def components(links: DataFrame) -> DataFrame:
    """(node, label: the smallest node of its component) for links (a, b). Every round halves distances: each node takes the least label about it, then that label's label."""
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.lit(None).cast("long").alias("was"), F.least("node", "least").alias("label"))
    after = written(labels, "labels")
    while True:
        before, labels = after, after.select("node", "label")
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("least"))
        taken = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "least").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        after = written(taken.join(up, "label", "left").select("node", "was", F.least("label", "up").alias("label")), "labels")
        discard(before)
        if after.filter("was <> label").isEmpty():
            discard(both)
            return after


def _labelled(seq: np.ndarray) -> np.ndarray:
    """k-mers of one text, repeats told apart by their occurrence."""
    order = np.argsort(seq, kind="stable")
    run = seq[order]
    at = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    label = np.arange(len(run)) - np.repeat(at, np.diff(np.append(at, len(run))))
    return mix(run.astype(np.uint64) + label.astype(np.uint64) * U64(0xA24BAED4963EE407))


def difference(x: np.ndarray, hub: np.ndarray) -> np.ndarray:
    """32-bit names of the k-mers that one of two lists of labelled k-mers has and the other has not."""
    return (np.setxor1d(x, hub, assume_unique=True) >> U64(32)).astype("<u4")


def _compared(pairs: DataFrame, sequences: DataFrame, threshold: float, *, hubs: bool) -> DataFrame:
    """Of pairs (a, b) those that are near duplicates; with hubs, all pairs with linked, n (k-mers of a), and their difference(), b being the hub."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, known = None, None
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            linked, sizes, gone = [], [], []
            for k in range(batch.num_rows):
                x, y = np.frombuffer(left[k].as_buffer(), "<u4"), np.frombuffer(right[k].as_buffer(), "<u4")
                linked.append(aligned(x, y, threshold) >= threshold)
                if hubs:
                    if batch.column(1)[k].as_py() != hub:  # rows of one hub are neighbours
                        hub, known = batch.column(1)[k].as_py(), _labelled(y)
                    sizes.append(len(x))
                    gone.append(difference(_labelled(x), known).tobytes())
            linked = pa.array(linked, pa.bool_())
            if hubs:
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], linked, pa.array(sizes, pa.int32()), pa.array(gone, pa.binary())], names=["a", "b", "linked", "n", "gone"])
            else:
                yield batch.select([0, 1]).filter(linked)

    # a hub's pairs are split by adaptive skew handling
    both = pairs.join(sequences.select(F.col("t").alias("a"), F.col("seq").alias("left")), "a").join(sequences.select(F.col("t").alias("b"), F.col("seq").alias("right")), "b")
    return both.select("a", "b", "left", "right").mapInArrow(lean(rows), "a long, b long" + ", linked boolean, n int, gone binary" * hubs)


def first_places(n: int, d: int, threshold: float) -> int:
    """How many differences from a hub, of d in the common order, must be looked up for a text of n k-mers: a near duplicate shares one of them, or none at all need be shared."""
    return min(d, int(n * (1 - threshold) / threshold + 1e-9) + 1)


def _rest_pairs(rest: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of different classes under one hub that may be near duplicates, from rest (t, hub, n, gone, label, open: not in the hub's class), and the written table that they come from."""

    def keyed(hub: int, gone) -> np.ndarray:
        return mix((np.frombuffer(gone, "<u4") if gone is not None else np.array([1 << 32])).astype(np.uint64) + U64(hub * 0x9E3779B97F4A7C15 & 2**64 - 1))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(CELLS, np.int64)
        for batch in batches:
            for hub, gone in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                np.add.at(sums, (keyed(hub, gone.as_buffer()) % U64(CELLS)).astype(np.int64), 1)
        used = np.flatnonzero(sums)
        for a in range(0, len(used), 1 << 16):
            some = used[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(sums[some])], names=["cell", "n"])

    spark = rest.sparkSession
    sums = rest.select("hub", "gone").mapInArrow(lean(cells), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    table = sums.filter("n > 1").toArrow()  # at most CELLS rows; what occurs once comes first anyway
    counts = np.zeros(CELLS, np.int32)
    counts[table.column(0).to_numpy()] = np.minimum(table.column(1).to_numpy(), 2**31 - 1)
    held = spark.sparkContext.broadcast(counts)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places, sizes, own = [], [], [], []
            for k, (hub, n, gone) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True)):
                key = keyed(hub, gone.as_buffer())
                d = len(key)
                key = key[np.lexsort((key, held.value[(key % U64(CELLS)).astype(np.int64)]))][: first_places(n, d, threshold)]
                keys.append(key)
                places.append(np.arange(len(key)))
                if near := d <= n * (1 - threshold) / threshold:  # may be a near duplicate of a text that shares no difference with it
                    keys.append(keyed(hub, None))
                    places.append(np.array([NONE_SHARED]))
                sizes.append(np.full(len(key) + near, d))
                own.append(np.full(len(key) + near, k))
            if own:
                at = np.concatenate(own)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(places), pa.int32()), pa.array(np.concatenate(sizes), pa.int32()),
                    *(batch.column(c).take(pa.array(at)) for c in (0, 2, 4, 5)),
                ], names=["key", "place", "d", "t", "n", "label", "open"])

    flat = rest.select("t", "hub", "n", "gone", "label", "open")
    rows = written(flat.mapInArrow(lean(firsts), "key long, place int, d int, t long, n int, label long, open boolean"), "firsts")
    x, y = rows.filter("open").alias("x"), rows.alias("y")
    sizes = F.col("x.n") + F.col("y.n")
    fit = F.least("x.n", "y.n") >= threshold * F.greatest("x.n", "y.n") - 1e-6
    need = (F.col("x.d") + F.col("y.d") - sizes * ((1 - threshold) / (1 + threshold))) / 2 - 1e-6  # differences that a near duplicate shares, at least
    may = F.when(F.col("x.place") < 0, need <= 0).otherwise(F.least(F.col("x.d") - F.col("x.place"), F.col("y.d") - F.col("y.place")) >= need)
    once = ~F.col("y.open") | (F.col("x.t") < F.col("y.t"))
    found = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.label") != F.col("y.label")) & once & fit & may)
    return found.select(F.least("x.t", "y.t").alias("a"), F.greatest("x.t", "y.t").alias("b")).distinct(), rows


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(id, k1, k2 of each row; k1, k2, label of the class, class_id, copies of each text)."""
    keys = written(text_keys(docs, id_col=id_col, text_col=text_col), "keys")
    texts = written(keys.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("sketches").alias("sketches")).withColumn("t", F.monotonically_increasing_id()), "texts")
    spread = texts.filter("size(sketches) > 0").select("t", F.explode("sketches").alias("s"))
    shared = spread.groupBy("s").agg(F.count("*").alias("n")).filter("n > 1")
    crowded = written(spread.join(shared, "s"), "crowded")  # members of buckets that hold several texts
    # the hub of a bucket: the member whose buckets hold most texts, which is the least edited text of a family
    crowd = crowded.groupBy("t").agg(F.sum("n").alias("crowd"))
    ranked = crowded.join(crowd, "t").select("s", "t", (F.col("crowd") * 2**20 + F.pmod(F.xxhash64("t"), F.lit(2**20))).alias("rank"))
    hubs = ranked.groupBy("s").agg(F.max_by("t", "rank").alias("hub"))
    pairs = written(crowded.join(hubs, "s").filter("t <> hub").select(F.col("t").alias("a"), F.col("hub").alias("b")).distinct(), "pairs")
    wanted = texts.select("k1", "k2", "t").join(crowd.select("t"), "t", "left_semi")
    sequences = written(_sequences(docs, id_col, text_col).join(wanted, ["k1", "k2"]).dropDuplicates(["t"]).select("t", "seq"), "sequences")
    tried = written(_compared(pairs, sequences, threshold, hubs=True), "tried")
    labels = components(tried.filter("linked").select("a", "b"))
    label_of = labels.select("node", "label")
    rows = tried.select(F.col("a").alias("t"), F.col("b").alias("hub"), "n", "gone")
    rows = rows.join(label_of.withColumnRenamed("node", "t"), "t", "left").join(label_of.select(F.col("node").alias("hub"), F.col("label").alias("hub_label")), "hub", "left")
    rows = rows.select("t", "hub", "n", "gone", F.coalesce("label", "t").alias("label"), F.coalesce("hub_label", "hub").alias("hub_label"))
    rows = written(rows.withColumn("open", F.col("label") != F.col("hub_label")), "members")
    apart = rows.groupBy("hub").agg(F.count("*").alias("n"), F.max("open").alias("some")).filter("some AND n > 1").select("hub")
    rest = written(rows.join(apart, "hub", "left_semi"), "rest")
    found, firsts = _rest_pairs(rest, threshold)
    more = written(found, "more")
    links = written(_compared(more, sequences, threshold, hubs=False), "links")
    # the classes that these links join are nodes of a second, smaller graph
    ends = links.join(label_of.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left").join(label_of.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
    ends = ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).filter("a <> b").distinct()
    after = components(ends)
    joined = texts.select("k1", "k2", "t", "rep", "copies").join(label_of.withColumnRenamed("node", "t"), "t", "left").withColumn("label", F.coalesce("label", "t"))
    joined = joined.join(after.select(F.col("node").alias("label"), F.col("label").alias("final")), "label", "left").withColumn("label", F.coalesce("final", "label"))
    classes = written(joined.join(joined.groupBy("label").agg(F.min("rep").alias("class_id")), "label").select("k1", "k2", "label", "class_id", "copies"), "classes")
    discard(texts, crowded, pairs, sequences, tried, labels, rows, rest, firsts, more, links, after)
    return keys.select("id", "k1", "k2"), classes


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id_col, class_id (smallest id of the class), copies (rows of this very word sequence), for each row of docs."""
    keys, classes = _classes(docs, id_col, text_col, threshold)
    return keys.join(classes, ["k1", "k2"]).select(F.col("id").alias(id_col), "class_id", "copies")


def op8(spark, docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)


def _text_key(text: pa.Array) -> pa.Array:
    made = [np.zeros((2, 0), np.int64)]
    buf, offsets = buffers(text)
    for a, b in slices(offsets):
        at = offsets[a : b + 1]
        made.append(np.stack(kmers(buf[at[0] : at[-1]], at - at[0])[3:]).view(np.int64))
    give_back()
    return pa.StructArray.from_arrays([pa.array(k) for k in np.concatenate(made, 1)], ["k1", "k2"])


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each class stays: the one with the smallest doc_id (a null one only where all are null), of several the one with the smallest text, once."""
    keys, classes = _classes(docs, "doc_id", "text", THRESHOLD)
    first = keys.join(classes, ["k1", "k2"]).filter(F.col("id").eqNullSafe(F.col("class_id"))).select(F.col("id").alias("_id"), F.struct("k1", "k2").alias("_key"), F.col("label").alias("_label")).distinct()
    # said to be not deterministic: else it runs twice, in two workers, once for a filter on nulls that the join asks for
    key = F.arrow_udf(_text_key, "k1 long, k2 long").asNondeterministic()
    rows = docs.select(F.struct(*docs.columns).alias("_row"), key("text").alias("_of"))
    kept = rows.join(first, F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (F.col("_of") == F.col("_key")))
    return kept.groupBy("_label").agg(F.min_by("_row", F.struct("_row.text")).alias("_row")).select("_row.*")
