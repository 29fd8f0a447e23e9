"""Operator 4: benchmark decontamination by template canonicalisation.

A text is its runs of letters and digits, in lower case; a run with a digit becomes <number>, a unit <unit> ('a' and 'in' right after a number only), a capitalised run inside a
sentence <name>: its template. Windows of WINDOW template words, or as many more as it takes to hold PLAIN that are no placeholders, are joined by hash with those of the benchmark. Matches of a document and an item that lie on one diagonal (document position minus item position) are
kept if their slots agree: each value of the item stands for one and the same value of the document there. An item leaks where such matches cover COVERAGE of its words (and LEAST
of them, or all), or RUN words on end on one diagonal, however long the item: so a question with other numbers, names or units is caught, or a part of a long passage, and a few
common words are not. Where slots on a diagonal don't agree, its matches with the item's own values still count for such a run.

Where the benchmark has at most FILTER windows, their hashes (8 bytes each) go to the workers, and only windows that match leave them; beyond that, all windows of the documents are
shuffled to the join. Nothing else depends on that size. A window begins at each word and ends at each word, so every word of an item lies in one, however dense its slots. Items
shorter than WINDOW, or with less than PLAIN words that are no placeholders, match as a whole by their full template; where that says next to nothing (no plain word, or one among two or
three words), slots must hold the item's own values. Of an item's windows beyond LONG words (slots in a row) those that hold a smaller one and don't touch its ends are not made: the others
cover the same words.

Nulls: a null or empty text has no windows; a null id is joined and reported as null. Documents of one id are one document. Empty tables: no rows. Other columns are ignored. Whole
texts are read, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm._text import BYTE_CODE, LOWER, U64, HashIndex, buffers, byte_classes, lean, mix, prefix, slices, span_hash

WINDOW, PLAIN = 5, 3
COVERAGE, LEAST = 0.5, 10
RUN = 25  # half of an item of 50 words: shorter ones leak by COVERAGE first
FILTER = 2_000_000
LONG = 64
CHUNK = 1 << 18  # words of the windows of one batch of rows, about
UNITS = """mm cm m km in ft yd mi mg g kg lb oz ml l s ms min h hr hrs hour hours minute minutes second seconds day days week weeks month months year years
inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres
dollar dollars cent cents euro euros usd eur percent degree degrees hz khz mhz ghz w kw v kv a ma j kj n pa kpa b kb mb gb tb""".split()
NUMBER, NAME, UNIT = U64(0x6E756D), U64(0x6E616D65), U64(0x756E6974)

_upper = np.array([chr(c).isupper() for c in range(0x800)])


def _word_hash(word: str) -> int:
    b = np.frombuffer(word.encode(), np.uint8)
    return int(span_hash(*prefix(BYTE_CODE[b]), np.array([0]), np.array([len(b)]))[0])


_units = np.sort(np.array([_word_hash(u) for u in UNITS], np.uint64))
_articles = np.array([_word_hash(u) for u in ("a", "in")], np.uint64)  # units only right after a number


class Template:
    """Words of some texts: where they lie, the hash of each (of its placeholder, if it is one), and which are slots."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray) -> None:
        self.low = low = LOWER[buf]
        latin = np.flatnonzero(buf == 0xC3)  # capital letters of the Latin-1 block
        latin = latin[latin + 1 < len(buf)]
        second = buf[latin + 1]
        low[latin[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)] + 1] += 0x20
        kind = byte_classes(buf)
        inside = (kind == 1) | (kind == 2)
        edge = np.zeros(len(buf) + 1, bool)
        edge[offsets] = True
        before = edge[:-1].copy()
        before[1:] |= ~inside[:-1]
        after = edge[1:].copy()
        after[:-1] |= ~inside[1:]
        self.starts, self.ends = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
        self.rows = np.searchsorted(offsets, self.starts, "right") - 1
        h = span_hash(*prefix(BYTE_CODE[low]), self.starts, self.ends)
        digits = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(kind == 2, out=digits[1:])
        number = digits[self.ends] > digits[self.starts]
        unit = _units[np.minimum(np.searchsorted(_units, h), len(_units) - 1)] == h
        # a capital letter is a name's unless a sentence, line or text begins there
        first = buf[self.starts].astype(np.int64)
        wide = (first >= 0xC0) & (first < 0xE0) & (self.starts + 1 < len(buf))
        first[wide] = (first[wide] & 0x1F) << 6 | (buf[self.starts[wide] + 1] & 0x3F)
        stop = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(np.isin(buf, np.frombuffer(b".!?:;\n\r\"|", np.uint8)), out=stop[1:])
        new = np.ones(len(h), bool)
        new[1:] = (self.rows[1:] != self.rows[:-1]) | (stop[self.starts[1:]] > stop[self.ends[:-1]])
        name = _upper[np.where(first < 0x800, first, 0)] & ~new & ~number
        after_number = np.zeros(len(h), bool)
        after_number[1:] = number[:-1] & ~new[1:]
        unit &= ~name & ~number & (after_number | ~np.isin(h, _articles))
        self.hash = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, h)))
        self.slot = number | unit | name

        self.plain = np.append(0, np.cumsum(~self.slot))  # words before each that are no placeholders
        self.begin, self.end = np.searchsorted(self.rows, self.rows), np.searchsorted(self.rows, self.rows, "right")  # of each word's text
        self.sums = prefix(mix(self.hash))

    def _spans(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return first, span_hash(*self.sums, first, last), last - first

    def windows(self, longest: int | None = None, prune: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first words, hashes, sizes) of the least windows from each word on and back from each word, of WINDOW words and PLAIN plain ones at least."""
        n, at = len(self.hash), np.flatnonzero(~self.slot)
        if n < WINDOW or len(at) < PLAIN:
            return self._spans(*(np.zeros(0, np.int64),) * 2)
        k = np.arange(n)
        third = self.plain[:-1] + PLAIN - 1
        last = np.maximum(k + WINDOW, np.where(third < len(at), at[np.minimum(third, len(at) - 1)] + 1, n + 1))
        last[last > self.end] = n + 1  # none
        third = self.plain[1:] - PLAIN
        first = np.minimum(k + 1 - WINDOW, np.where(third >= 0, at[np.maximum(third, 0)], -1))
        back = first >= self.begin
        back[back] = last[first[back]] != k[back] + 1  # the others are windows from a word on
        on = last <= n
        if prune:  # a window from a word on that holds a smaller one: the next word's ends there too
            inner = np.zeros(n, bool)
            inner[:-1] = last[1:] == last[:-1]
            on &= (last - k <= LONG) | ~inner | (k == self.begin)
            back &= (k + 1 - first <= LONG) | (k + 1 == self.end)
        first, last = np.append(k[on], first[back]), np.append(last[on], k[back] + 1)
        if longest is not None:
            fits = last - first <= longest
            first, last = first[fits], last[fits]
        return self._spans(first, last)

    def short_windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first words, hashes, sizes) of windows of size words that windows() has not: shorter than WINDOW, or with less than PLAIN plain words."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return self._spans(*(np.zeros(0, np.int64),) * 2)
        at = np.flatnonzero(self.rows[:n] == self.rows[size - 1 :])
        if size >= WINDOW:
            at = at[self.plain[at + size] - self.plain[at] < PLAIN]
        return self._spans(at, at + size)

    def whole(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first words, hashes, sizes) of whole texts that have no windows()."""
        at = np.flatnonzero(self.begin == np.arange(len(self.hash)))
        last = self.end[at]
        short = (last - at < WINDOW) | (self.plain[last] - self.plain[at] < PLAIN)
        return self._spans(at[short], last[short])

    def values(self, at: int, size: int) -> list[str]:
        return [self.low[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace") for i in range(at, at + size) if self.slot[i]]


ROW = "id {kind}, h long, pos int, size int, n_words int, slots array<string>, whole boolean, free boolean"


def _windows(df: DataFrame, id_col: str, text_col: str, *, items: bool = False, sizes: list[int] | None = None, longest: int | None = None, known=None) -> DataFrame:
    """One row for each window: id, h, pos, size, words of its text, slot values, whether it is a whole item, and whether its slots may hold other values. items: texts are items of
    the benchmark, else documents, with windows of sizes as well, those of whole items, and of no more than longest words; known: broadcast hashes, for no others."""
    kind = dict(df.dtypes)[id_col]
    cache: dict = {}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if known is not None and not cache:
            cache["index"] = HashIndex()
            cache["index"].add(np.unique(known.value))
        for batch in batches:
            ids = batch.column(0)
            buf, offsets = buffers(batch.column(1))
            for a, b in slices(offsets):
                at = offsets[a : b + 1]
                if at[0] == at[-1]:
                    continue
                t = Template(buf[at[0] : at[-1]], at - at[0])
                found = [(*t.windows(longest, items), False)]
                found += [(*t.whole(), True)] if items else [(*t.short_windows(s), True) for s in sizes or []]
                for first, h, size, whole in found:
                    if known is not None:
                        hit = cache["index"].find(h) >= 0
                        first, h, size = first[hit], h[hit], size[hit]
                    chunk = np.cumsum(size) // CHUNK
                    for part in np.split(np.arange(len(first)), np.flatnonzero(chunk[1:] != chunk[:-1]) + 1):
                        if not len(part):
                            continue
                        i, n = first[part], size[part]
                        plain = t.plain[i + n] - t.plain[i]
                        yield pa.RecordBatch.from_arrays([
                            ids.take(pa.array(t.rows[i] + a)), pa.array(h[part].view(np.int64)), pa.array((i - t.begin[i]).astype(np.int32)), pa.array(n.astype(np.int32)),
                            pa.array((t.end[i] - t.begin[i]).astype(np.int32)), pa.array([t.values(x, y) for x, y in zip(i.tolist(), n.tolist(), strict=True)], pa.list_(pa.string())),
                            pa.array(np.full(len(i), whole)), pa.array((plain > 0) & (plain + n >= 5) | (plain == n)),
                        ], names=["id", "h", "pos", "size", "n_words", "slots", "whole", "free"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(rows), ROW.format(kind=kind))


def _has_run(words: Column) -> Column:
    """Whether distinct places hold RUN on end."""
    at = F.array_sort(words)
    ends = F.slice(at, RUN, F.greatest(F.size(at) - (RUN - 1), F.lit(0)))
    return F.exists(F.zip_with(ends, at, lambda x, y: F.coalesce(x - y, F.lit(0))), lambda d: d == RUN - 1)


def leaks(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", filter_windows: int = FILTER) -> DataFrame:
    """One row for each document and item that leaks: doc_id, item_id, matched_words, item_words, coverage, same_values (no slot was changed)."""
    spark = docs.sparkSession
    items = _windows(benchmark, item_id, text_col, items=True)
    sizes = sorted(r[0] for r in items.filter("whole").select("size").distinct().collect())  # lengths of items
    longest = items.filter("not whole").agg(F.max("size")).first()[0] or 0
    hashes = items.select("h").distinct().limit(filter_windows + 1).toArrow()  # bounded by that limit
    known = spark.sparkContext.broadcast(hashes.column(0).to_numpy().view(np.uint64)) if hashes.num_rows <= filter_windows else None
    found = _windows(docs, doc_id, text_col, sizes=sizes, longest=longest, known=known)
    d = found.select(F.col("id").alias("doc_id"), "h", "size", F.col("pos").alias("d_pos"), F.col("slots").alias("d_slots"))
    b = items.select(F.col("id").alias("item_id"), "h", "size", F.col("pos").alias("b_pos"), F.col("slots").alias("b_slots"), F.col("n_words").alias("item_words"), "free")
    pairs = d.join(b, ["h", "size"]).filter(F.col("free") | (F.col("b_slots") == F.col("d_slots")))
    slots = F.zip_with("b_slots", "d_slots", lambda x, y: F.struct(x.alias("b"), y.alias("d")))
    places = F.sequence(F.col("b_pos"), F.col("b_pos") + F.col("size") - 1)
    line = pairs.groupBy("doc_id", "item_id", "item_words", (F.col("d_pos") - F.col("b_pos")).alias("diagonal")).agg(
        F.array_distinct(F.flatten(F.collect_set(slots))).alias("slots"), F.array_distinct(F.flatten(F.collect_set(places))).alias("words"),
        F.array_distinct(F.flatten(F.collect_set(F.when(F.col("b_slots") == F.col("d_slots"), places)))).alias("same"),
    )
    agree = F.size(F.array_distinct(F.transform("slots", lambda s: s["b"]))) == F.size("slots")
    changed = F.exists("slots", lambda s: s["b"] != s["d"])
    line = line.withColumn("words", F.when(agree, F.col("words")).otherwise(F.col("same"))).withColumn("run", _has_run("words")).filter(agree | F.col("run"))
    per = line.groupBy("doc_id", "item_id", "item_words").agg(F.size(F.array_distinct(F.flatten(F.collect_set("words")))).alias("matched_words"), F.min(~changed).alias("same_values"), F.max("run").alias("run"))
    per = per.withColumn("coverage", F.col("matched_words") / F.col("item_words"))
    enough = (F.col("coverage") >= COVERAGE) & (F.col("matched_words") >= F.least(F.lit(LEAST), "item_words"))
    return per.filter(enough | F.col("run")).select("doc_id", "item_id", "matched_words", "item_words", "coverage", "same_values")


def op4(spark, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return leaks(docs, benchmark)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold no item of the benchmark. Told by their texts alone, so ids may be null or repeated."""
    key = F.md5(F.col("text"))
    found = leaks(docs.select(key.alias("key"), "text"), benchmark, doc_id="key").select("doc_id").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key"))
    return rows.join(found, rows["key"] == found["doc_id"], "left_anti").select("row.*")
