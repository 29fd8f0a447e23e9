"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import math
import re
import sys
import zlib
from collections import Counter
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import chat, decontamination, gif_media, lm_scoring, mixing, near_dedup, repeated_passages, token_counts, token_output, toxicity
from tokenloom.llm.queries import vocabulary_file
from tokenloom.sources import tables

sys.path.insert(0, str(Path(__file__).parents[2]))
RNG = np.random.default_rng(5)
WORDS = ["".join(chr(97 + c) for c in RNG.integers(0, 26, RNG.integers(2, 9))) for _ in range(300)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, size string"


def prose(n, seed):
    r = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in r.integers(0, len(WORDS), n)).capitalize() + "."


BASE = prose(120, 1)
LONG = " ".join(prose(40, k) for k in range(100, 160))
NEAR = BASE.replace(BASE.split()[60], "changed", 1)
ROWS = [
    (1, BASE, "s1"), (2, BASE, "s1"), (2, BASE, "s1"), (3, NEAR, "s2"), (4, None, None), (5, "", "s2"), (6, "   \n\t ", "s3"), (7, LONG, "s3"), (8, "Start. " + BASE + " And an end.", None),
    (9, "a" * 1500, "s2"), (10, "ab" * 700 + "x" + "ab" * 300, "s1"), (None, "no id", "s1"), (12, "don't 'llé <|endoftext|> x 漢字 \U0001f642 ▁▁ </s>", "s4"), (13, prose(30, 9) + LONG[:900], "s1"),
    *[(20 + k, prose(60, 1000 + k), f"s{k % 5}") for k in range(12)],
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", s, None, "x", "y") for i, t, s in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_simple8b_round_trip():
    for seed in range(60):
        r = np.random.default_rng(seed)
        counts = r.integers(0, 600, r.integers(0, 5))
        ids = np.array([int(r.integers(0, 2**62)) >> int(r.integers(0, 62)) for _ in range(counts.sum())], np.uint64)
        if seed % 3 == 0 and len(ids):
            ids[:: 7] = 2**64 - 1
            ids[1 :: 2] = 0
        words, sizes = token_output.encode(ids, counts)
        assert np.array_equal(token_output.decode(words)[0], ids) and sizes.sum() == len(words)


def test_op1(spark, docs, none):
    from tokenizers import Tokenizer

    library, want, start = Tokenizer.from_file(vocabulary_file("byte_bpe_50k.json")), [], 0
    for i, t in sorted(((i, t) for i, t, _ in ROWS), key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    path = vocabulary_file("byte_bpe_50k.json")
    assert rows(token_output.op1(spark, docs, path), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    assert token_output.op1(spark, none, path).count() == 0


def test_encoder_grows_by_doubling():
    """What it remembers is not copied for each batch that it learns, and equals the library's ids however often it has grown."""
    own = token_output.Encoder(vocabulary_file("byte_bpe_50k.json"))
    held = {id(own.begin): own.begin}
    for k in range(40):
        text = " ".join("".join(chr(97 + (1000 * k + i) // 26**d % 26) for d in range(4)) for i in range(1000))
        column = pa.array([text])
        ids, counts = own(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), column)
        assert ids.tolist() == own.library.encode(text, add_special_tokens=False).ids and counts.tolist() == [len(ids)]
        held[id(own.begin)] = own.begin
    assert own.index.n > 1 << 15 and len(held) <= 4


def test_op2(spark, docs, none):
    seen = Counter()
    texts = [(i, (t or "").encode()) for i, t, _ in ROWS]
    for _, b in texts:
        seen.update(b[k : k + 400] for k in range(len(b) - 399))
    want = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[k : k + 400] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        want.append((i, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(b) else 0, hashlib.sha256(kept).hexdigest()))
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert rows(repeated_passages.op2(spark, docs), *names) == sorted(want, key=repr)
    assert repeated_passages.op2(spark, none).count() == 0


def test_op2_frequent_passages(spark):
    """A passage beside ever other text, some of which agree a little: however few rows of a group a worker may have, the bytes are those of every 400-byte window."""
    r = np.random.default_rng(8)
    passage, ends = prose(90, 40), [prose(40, k) for k in range(50, 56)]
    texts = [(k, prose(20, 300 + k) + ends[k % 6][-int(r.integers(1, 200)) :] + passage + ends[k % 5][: int(r.integers(1, 200))] + prose(20, 600 + k)) for k in range(60)]
    seen = Counter(t[k : k + 400] for _, t in texts for k in range(len(t) - 399))
    want = {(i, b) for i, t in texts for k in range(len(t) - 399) if seen[t[k : k + 400]] > 1 for b in range(k, k + 400)}
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    for key_rows in (1, 4, 10**6):
        found = repeated_passages.repeated_spans(docs, key_rows=key_rows).collect()
        assert {(x["id"], b) for x in found for s, e in x["spans"] for b in range(s, e)} == want


def test_op2_worker_holds_few_groups():
    """Groups come one after another; spans of the first are out long before the last is read."""

    class Rows:
        dtypes = [("id", "bigint")]
        repartition = sortWithinPartitions = lambda self, *columns: self
        mapInArrow = staticmethod(lambda rows, schema: rows)

    read = []

    def batches(n):
        for k in range(n):
            read.append(k)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(1000) // 2 + k * 500), pa.array(np.zeros(1000, np.int64)), pa.array(np.ones(1000, np.int64)), pa.array(np.arange(1000) + k * 1000), pa.array(np.zeros(1000, np.int32)),
                pa.array(np.full(1000, 40, np.int32)), pa.array(np.full(1000, 31, np.int32)), pa.array([b"x" * 62] * 1000, pa.binary()),
            ], names=["key", "core", "n", "id", "th", "base", "range", "beside"])

    made = repeated_passages._border_spans(Rows())(batches(60))
    first = next(made)
    assert len(read) < 20
    assert first.num_rows + sum(b.num_rows for b in made) == 60_000


def test_op3(spark, docs, none):
    low = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
    split = {i: [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(low)) if w] + ["\n"] for i, t, _ in ROWS}
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i in split}
    c = Counter(w for i, _, _ in ROWS if not held[i] for w in split[i])
    total, size = sum(c.values()), len(c)
    got = lm_scoring.op3(spark, docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        w = split[r["doc_id"]]
        base = sum(math.log10((c[x] + 0.5) / (total + 0.5 * (size + 1))) for x in w)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(w), sum(c[x] > 0 for x in w), total)
        assert abs(r["base_score"] - base) < 1e-6 * abs(base) and r["score"] < 0
    assert lm_scoring.op3(spark, none).count() == 0


def test_op3_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SHARD_TOKENS", 100)  # several shards of a small table
    texts = [(k, prose(40, 3000 + k % 50), k) for k in range(120)] + [(None, None, 0), (None, "x y", 1), (7, prose(40, 1), 2)]
    table = spark.createDataFrame(texts, "doc_id long, text string, score long")
    one, two = ({(r["doc_id"], r["n_tokens"], round(r["base_score"], 9), r["score"]) for r in lm_scoring.op3(spark, table.repartition(n)).collect()} for n in (2, 9))
    assert one == two


def test_op3_scores_are_the_models(spark):
    """Scores by a plain walk over the tokens of a table whose words are all classes of their own."""
    texts = [(k, " ".join(WORDS[(k * j + j) % 60] for j in range(50))) for k in range(60)] + [(100, "never seen here"), (101, None)]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    held = {}
    real = lm_scoring.Model.tables
    lm_scoring.Model.tables = lambda self: held.setdefault("m", self) and real(self)
    try:
        got = {r["doc_id"]: r for r in lm_scoring.op3(spark, table).collect()}
    finally:
        lm_scoring.Model.tables = real
    m = held["m"]
    out = {i for i, _ in texts if zlib.crc32(str(i).encode()) % 5 == 1}
    c = Counter(w for i, t in texts if i not in out for w in [*(t or "").lower().split(), "\n"])
    order = sorted(c, key=lambda w: (-c[w], int(_hash(w).view(np.int64))))
    number = {w: k for k, w in enumerate(order)}
    buckets = lambda w: int(lm_scoring.tokens(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[1][0])
    size = lm_scoring.CLASSES
    for i, t in texts:
        u = v = number["\n"]
        total = 0.0
        for w in [*(t or "").lower().split(), "\n"]:
            k = number.get(w, lm_scoring.FREQUENT + buckets(w) if w != "\n" else None)
            context = m.r[u].astype(float) * m.c[0] + m.r[v].astype(float) * m.c[1]
            logits = m.q.astype(float) @ context + m.b
            total += (logits[k] - np.log(np.exp(logits - logits.max()).sum()) - logits.max()) / np.log(10)
            u, v = k, u
        assert len(logits) == size and abs(total - got[i]["score"]) < 2e-3 * abs(total) + 1e-3, (i, total, got[i]["score"])


def _hash(word):
    if word == "\n":
        return lm_scoring.END[0]
    b = np.frombuffer(word.encode(), np.uint8)
    return lm_scoring.tokens(b, np.array([0, len(b)]))[0][0]


def test_lm_probabilities_add_up():
    m = lm_scoring.Model(np.arange(lm_scoring.CLASSES).astype(float))
    one, two, z = m.tables()
    p = 10.0 ** (one[5].astype(float) + two[9] - z[5, 9])
    assert abs(p.sum() - 1) < 1e-3


def test_op4(spark, docs, none):
    text = "If Ann buys 12 apples and 3 pears for 12 dollars, how many km must she walk in 5 hours to town?"
    more = spark.createDataFrame([(50, text), (51, "So: " + text.replace("12", "40").replace("Ann", "Bob")), (52, text.replace("12 apples", "40 apples")), (53, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, text, 0), (2, None, 0), (3, "", 0), (4, "two words", 0)], "item_id long, text string, h int")
    every = docs.select("doc_id", "text").unionByName(more)
    for limit in (1000, 2):
        assert {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(every, bench, filter_windows=limit).collect()} == {(50, 1), (51, 1)}
    assert decontamination.leaks(none, bench).count() == decontamination.leaks(every, bench.limit(0)).count() == 0
    assert decontamination.without_leaks(every, bench).count() == len(ROWS) + 2


def test_op4_finds_items_that_are_mostly_slots(spark):
    """(item, the same with other values): verbatim and re-parameterised copies are found, each in the document that holds it alone."""
    made = [
        ("A train travels 60 miles in 2 hours. How many miles in 5 hours?", "A train travels 70 miles in 3 hours. How many miles in 8 hours?"),
        ("In 2010, Alice earned 50 dollars a day for 20 days. In 2011, Bob earned 60 dollars a day for 30 days.", "In 1990, Carol earned 7 dollars a day for 9 days. In 1995, Dan earned 8 dollars a day for 11 days."),
        ("A car drives 120 km in 2 hours, then 90 km in 3 hours. What is its speed in km h?", "A car drives 150 km in 4 hours, then 70 km in 5 hours. What is its speed in km h?"),
        ("Solve 2x + 3 = 11 for x.", "Solve 5x + 7 = 22 for x."),
        ("Convert 5 km to miles.", "Convert 9 kg to pounds."),
        ("Fast facts say: 1 2 3 4 5 6 7 8 9 10 11 12", "Fast facts say: 21 22 23 24 25 26 27 28 29 30 31 32"),
        ("1 2 3 4 5 6 7 8 9 10 of them are odd ones", "21 22 23 24 25 26 27 28 29 30 of them are odd ones"),
    ]
    bench = spark.createDataFrame([(k, item) for k, (item, _) in enumerate(made)] + [(90, "17 19 23"), (91, ""), (92, None)], "item_id long, text string")
    texts = [(10 * k + c, f"{prose(12, 30 + k)} {text} {prose(12, 60 + k)}") for k, pair in enumerate(made) for c, text in enumerate(pair)]
    texts += [(900, "Primes. 17 19 23"), (901, "Years. 18 20 24"), (902, " ".join(map(str, range(3000, 6000)))), (903, prose(50, 8))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for limit in (1000, 2):
        got = {(r["doc_id"], r["item_id"]): r["matched_words"] == r["item_words"] for r in decontamination.leaks(docs, bench, filter_windows=limit).collect()}
        assert got == {(10 * k + c, k): True for k in range(len(made)) for c in range(2)} | {(900, 90): True}


def test_op4_finds_a_part_of_a_long_item(spark):
    passage = " ".join(prose(50, 900 + k) + f" It cost {k + 2} dollars." for k in range(6)).split()
    part = " ".join(passage[60:140])
    made = [
        (1, " ".join(passage)), (2, prose(30, 1) + " " + part), (3, " ".join(passage[100:124])), (4, " ".join(passage[100:125])), (5, " ".join(passage[:12] + ["x"] + passage[14:26] + ["y"] + passage[28:40])),
        (6, part.replace(" 3 dollars", " 30 dollars")), (7, " ".join(passage[55:] + ["It cost 2 dollars"]).replace(" 3 dollars", " 30 dollars", 1) + " " + prose(20, 2)), (8, prose(300, 3)),
    ]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    assert {r["doc_id"] for r in decontamination.leaks(docs, spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string")).collect()} == {1, 2, 4, 6, 7}
    # a value that stands for two others: no agreement on the diagonal, but a run as it is
    item = " ".join(["He paid 5 dollars", *passage[:40], "and later paid 5 dollars to the man", *(prose(120, 950).split())])
    docs = spark.createDataFrame([(1, item.replace("5", "9", 1)), (2, item.replace("5", "9", 1)[:60])], "doc_id long, text string")
    got = decontamination.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["same_values"]) for r in got] == [(1, False)]


def test_op4_against_brute_force(spark):
    """Windows of template words, joined by hand: items with several values, copies with consistent and with mixed-up values, halves, and texts that share a few words."""
    r = np.random.default_rng(21)
    units = ["km", "dollars", "hours"]

    def item(k):
        out = prose(int(r.integers(14, 40)), 4000 + k).lower().rstrip(".").split()
        for at in sorted(r.integers(1, len(out), 3).tolist()):
            out[at:at] = [str(int(r.integers(2, 90))), units[int(r.integers(3))]]
        return out

    items = [item(k) for k in range(12)]
    docs = []
    for k, words in enumerate(items):
        numbers = sorted({w for w in words if w.isdigit()})
        other = {n: str(1000 + 7 * k + j) for j, n in enumerate(numbers)}
        spoiled = [str(5000 + j) if w.isdigit() else w for j, w in enumerate(words)]  # one value for each place
        half = len(words) // 2
        for j, body in enumerate((words, [other.get(w, w) for w in words], spoiled, words[: half + 2], words[: max(4, len(words) // 3)])):
            docs.append((10 * k + j, " ".join([*prose(15, 100 * k + j).lower().rstrip(".").split(), *body, *prose(9, 90 * k + j).lower().rstrip(".").split()])))
    docs += [(1000 + k, prose(80, 8000 + k).lower()) for k in range(10)]

    def slot(w):
        return "#" if w.isdigit() else "@" if w in units else w

    def found(text, words):
        t, spots = text.rstrip(".").split(), {}
        a, b = [slot(w) for w in t], [slot(w) for w in words]
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0  # the longest equal stretch from here on
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                plain, end = 0, 0
                while end < n and (end < 5 or plain < 3):
                    plain += b[j + end] not in "#@"
                    end += 1
                if end >= 5 and plain >= 3:
                    spots.setdefault(i - j, set()).update(range(j, j + end))
        matched, run = set(), False
        for d, places in spots.items():
            pairs = {(words[p], t[p + d]) for p in places if b[p] in "#@"}
            same = {p for p in places if words[p] == t[p + d]}
            agree = len({x for x, _ in pairs}) == len(pairs)
            use = places if agree else same
            longest = max((len(list(g)) for _, g in __import__("itertools").groupby(sorted(use), lambda p, c=__import__("itertools").count(): p - next(c))), default=0)
            if agree or longest >= 25:
                matched |= use
                run |= longest >= 25
        return run or (len(matched) >= 0.5 * len(words) and len(matched) >= min(10, len(words)))

    want = {(i, k) for i, t in docs for k, words in enumerate(items) if found(t, words)}
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(table, bench).collect()}
    assert {(10 * k + j, k) for k in range(12) for j in (0, 1)} <= want
    assert got == want


def test_windows_hold_every_word_of_an_item():
    r = np.random.default_rng(4)
    for _ in range(200):
        words = [str(r.integers(100)) if r.random() < 0.8 else WORDS[r.integers(300)] for _ in range(r.integers(1, 200))]
        b = " ".join(words).encode()
        t = decontamination.Template(np.frombuffer(b, np.uint8), np.array([0, len(b)]))
        first, h, size = (np.concatenate(x) for x in zip(t.windows(prune=True), t.whole(), strict=True))
        assert {w for x, n in zip(first.tolist(), size.tolist(), strict=True) for w in range(x, x + n)} == set(range(len(words)))
        assert {*h.tolist()} <= {*t.windows()[1].tolist(), *t.short_windows(len(words))[1].tolist()}


def test_op5(spark, docs, none):
    got = {(r["doc_id"], r["payload_sha256"]): r for r in gif_media.op5(spark, docs).collect()}
    for i, t, _ in ROWS:
        b = (t or "").encode()
        p = gif_media.payload(b)
        r = got[i, hashlib.sha256(p).hexdigest()]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(b), len(p), zlib.crc32(p[-64:])) and len(p) % 64 == 0 and p
        data = gif_media.encode(p)
        assert (r["media_bytes"], r["media_sha256"]) == (len(data), hashlib.sha256(data).hexdigest())
    assert gif_media.op5(spark, none).count() == 0
    stored = gif_media.frames(gif_media.add_media(docs.filter("doc_id = 7"))).orderBy("frame").collect()
    assert b"".join(r["pixels"][::3] for r in stored) == gif_media.payload(LONG.encode()) and all(sum(r["histogram"]) == r["width"] * r["height"] for r in stored)


def _lzw_by_the_book(data, size):
    """A plain reader of code streams, bit by bit."""
    bits = "".join(f"{b:08b}"[::-1] for b in data)
    clear, out, at = 1 << size, b"", 0
    table, width, last = [], size + 1, None
    while at + width <= len(bits):
        code, at = int(bits[at : at + width][::-1], 2), at + width
        if code == clear:
            table, width, last = [bytes([i]) for i in range(clear)] + [b"", b""], size + 1, None
            continue
        if code == clear + 1:
            break
        word = table[code] if code < len(table) else last + last[:1]
        if last is not None and len(table) < 4096:
            table.append(last + word[:1])
            width += len(table) == 1 << width and width < 12
        out, last = out + word, word
    return out


def test_lzw():
    r = np.random.default_rng(2)
    for n, top, size in ((1, 256, 8), (64, 1, 8), (5000, 256, 8), (9000, 2, 8), (20000, 30, 8), (3000, 4, 2), (12000, 16, 4)):
        samples = r.integers(0, top, n).astype(np.uint8).tobytes()
        data = gif_media.lzw_compress(samples, size)
        assert _lzw_by_the_book(data, size) == samples == gif_media.lzw_decode(data, size).tobytes()
    # a writer that never clears a full table
    codes = [256, *r.integers(0, 256, 9000).tolist(), 257]
    bits = "".join(f"{c:0{w}b}"[::-1] for c, w in zip(codes, [9, *gif_media._widths(8, len(codes) - 1).tolist()], strict=True))
    data = bytes(int(bits[k : k + 8][::-1], 2) for k in range(0, len(bits), 8))
    assert _lzw_by_the_book(data, 8) == bytes(codes[1:-1]) == gif_media.lzw_decode(data, 8).tobytes()
    with pytest.raises(ValueError):
        gif_media.lzw_decode(gif_media.lzw_compress(b"aaaa")[:1] + b"\xff\xff\xff", 8)


def test_gif_composition():
    red, blue = np.full((4, 4), 1), np.array([[2, 0], [0, 2]])
    palette = np.zeros((256, 3), np.uint8)
    palette[1], palette[2] = (255, 0, 0), (0, 0, 255)
    for disposal, after in ((1, (0, 0, 255)), (2, (0, 0, 0)), (3, (255, 0, 0))):
        data = gif_media.pack(4, 4, palette, [{"samples": red}, {"samples": blue, "left": 1, "top": 1, "transparent": 0, "disposal": disposal, "delay": 7}, {"samples": np.array([[1]]), "delay": 1}])
        a, b, c = gif_media.decode(data)
        assert tuple(b.rgb[1, 1]) == (0, 0, 255) and tuple(b.rgb[1, 2]) == (255, 0, 0) and b.delay_ms == 70
        assert tuple(c.rgb[1, 1]) == after and tuple(a.rgb[0, 0]) == (255, 0, 0)
    with pytest.raises(ValueError):
        list(gif_media.decode(b"no gif"))


def test_op6(spark, none):
    bad, made = ["vile", "nasty", "awful"], []
    for k in range(600):
        toxic = k % 5 == 0
        words = prose(40, 5000 + k).split()
        words[10:10] = bad if toxic else []
        made.append((k, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in made] + [(9000, None), (9001, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in made] + [(3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.op6(spark, docs, labels).collect()}
    held = [i for i, _, _ in made if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] for i in held) and np.mean([got[i]["predicted"] == made[i][2] for i in held]) > 0.97
    assert len(got) == 603 and all(0 <= r["score"] <= 1 for r in got.values()) and got[9000]["score"] == got[9001]["score"]
    assert toxicity.op6(spark, none, labels).count() == 0
    assert {r["score"] for r in toxicity.op6(spark, docs, labels.limit(0)).collect()} == {0.0}


def test_op6_repeats_ties_and_extra_columns(spark):
    made = [(k % 40, prose(20, k % 40) + (" vile words" if k % 40 < 12 else ""), "x", 1.5) for k in range(120)]  # every row three times
    docs = spark.createDataFrame(made, "doc_id long, text string, row string, _toxic_score double").repartition(3)
    labels = spark.createDataFrame([(k, int(k < 12)) for k in range(40)] + [(3, 0), (3, 1), (30, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    again = toxicity.train(docs.repartition(7), labels)
    assert np.array_equal(model.places, again.places) and np.array_equal(model.weights, again.weights) and model.bias == again.bias
    got = toxicity.op6(spark, docs, labels).collect()
    assert len(got) == 120 and all(len({r["score"] for r in got if r["doc_id"] == k}) == 1 for k in range(40))
    clean = toxicity.without_toxic(docs, model)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == set(range(12, 40)) and clean.count() == 84
    with pytest.raises(ValueError):
        toxicity.score(docs.withColumn("score", F.lit(1)), model)
    # very long and null texts are learned from
    long = spark.createDataFrame([(k, "vile " * 60_000 if k < 30 else None) for k in range(60)], "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in toxicity.op6(spark, long, spark.createDataFrame([(k, int(k < 30)) for k in range(60)], "doc_id long, toxic int")).collect()}
    assert min(scores[k] for k in range(30)) > 0.6 > 0.4 > max(scores[k] for k in range(30, 60))


def test_pipeline_stages_keep_rows_and_columns(spark):
    """Null and repeated ids, columns named as the operators' own, empty tables: each stage drops what it should, and nothing else."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, place string, _times int, _copy int, score double, key string, _id long"
    leak = prose(40, 71)
    made = [(None, prose(30, 1)), (None, prose(30, 2)), (None, leak), (4, prose(30, 3)), (4, prose(30, 4)), (4, leak + " and more"), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "s" if i else None, 0, "r", "p", 7, 8, 0.5, "k", 9) for i, t in made], schema).repartition(2)
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    kept = decontamination.without_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(map(repr, (r["text"] for r in kept.collect()))) == sorted(repr(t) for _, t in made if not (t or "").startswith(leak[:-1]))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and all((r["_times"], r["_copy"], r["place"]) == (7, 8, "p") for r in mixed.collect())
    plan = {}
    for r in mixing.mix(docs).collect():
        plan.setdefault((r["doc_id"], r["size"]), []).append(r)
    assert {r["doc_id"] for r in mixed.collect()} <= {i for i, _ in made}
    for stage in (lambda d: decontamination.without_leaks(d, bench), mixing.mixed_documents, near_dedup.without_near_duplicates, lambda d: toxicity.without_toxic(d, toxicity.Model(np.zeros(0, np.int64), np.zeros(0), 0.0, False))):
        empty = stage(docs.limit(0))
        assert empty.columns == docs.columns and empty.count() == 0
    assert toxicity.without_toxic(docs, toxicity.Model(np.zeros(0, np.int64), np.zeros(0), 0.0, False)).count() == len(made)
    assert corpus_pipeline.ORACLE_SQL is None


def test_op7(spark, docs, none):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary_file("piece_bpe_32k.model"))
    want = sorted(((i, len((t or "").encode()), len(library.encode(t or ""))) for i, t, _ in ROWS), key=repr)
    path = vocabulary_file("piece_bpe_32k.model")
    assert rows(token_counts.op7(spark, docs, path), "doc_id", "n_bytes", "n_tokens") == want
    assert token_counts.op7(spark, none, path).count() == 0
    wide = token_counts.count_tokens(docs.withColumn("n_tokens", F.lit("old")), path)
    assert wide.columns.count("n_tokens") == 1 and "score" in wide.columns


def test_op8(spark, docs, none):
    def grams(t):
        w = (t or "").lower().split()
        return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()

    distinct = sorted({tuple((t or "").lower().split()) for _, t, _ in ROWS})
    name = {d: k for k, d in enumerate(distinct)}
    up = list(range(len(distinct)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in distinct:
        for b in distinct:
            x, y = grams(" ".join(a)), grams(" ".join(b))
            common, every = sum((x & y).values()), sum((x | y).values())
            if every and common / every >= 0.8:
                up[root(name[a])] = root(name[b])
    least = {}
    for i, t, _ in ROWS:
        k = root(name[tuple((t or "").lower().split())])
        least[k] = min(least.get(k, math.inf), math.inf if i is None else i)
    want = sorted(((i, least[root(name[tuple((t or "").lower().split())])]) for i, t, _ in ROWS), key=repr)
    got = sorted(((i, math.inf if c is None else c) for i, c in rows(near_dedup.op8(spark, docs), "doc_id", "class_id")), key=repr)
    assert got == want
    assert near_dedup.op8(spark, none).count() == 0
    kept = [r["doc_id"] for r in near_dedup.without_near_duplicates(docs).collect()]
    assert len(kept) == len(set(kept)) == len(least)


def test_alignment_equals_longest_common_subsequence():
    def lcs(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                d[i + 1][j + 1] = d[i][j] + 1 if a[i] == b[j] else max(d[i][j + 1], d[i + 1][j])
        return d[-1][-1]

    for seed in range(150):
        r = np.random.default_rng(seed)
        a = r.integers(0, 2 if seed % 3 == 0 else 30, r.integers(1, 60)).astype(np.uint32)
        b = np.delete(a, r.integers(0, len(a), 2)) if len(a) > 3 else a.copy()
        b[r.integers(0, len(b))] = 99
        m = lcs(a.tolist(), b.tolist())
        true, got = m / (len(a) + len(b) - m), near_dedup.aligned(a, b)
        assert (got >= 0.8) == (true >= 0.8) and (true < 0.8 or abs(got - true) < 1e-12)


def test_one_document_of_each_class_stays(spark):
    """Null ids and ids of several texts: the survivor is chosen by class, not by id."""
    a, b, c, d, e = (prose(50, 400 + k) for k in range(5))
    near = a.replace(a.split()[25], "changed", 1)
    made = [(None, a, 1), (None, b, 2), (None, b, 2), (7, near, 3), (8, c, 4), (8, d, 5), (9, d, 6), (8, d.upper(), 7), (None, e, 8), (None, e.upper(), 9), (None, None, 10), (11, "", 11)]
    table = spark.createDataFrame(made, "doc_id long, text string, extra int").repartition(3)
    kept = near_dedup.without_near_duplicates(table)
    assert kept.columns == table.columns
    assert {*map(tuple, kept.collect())} == {(None, b, 2), (7, near, 3), (8, c, 4), (8, d.upper(), 7), (None, e.upper(), 9), (11, "", 11)} and kept.count() == 6
    assert near_dedup.without_near_duplicates(table.limit(0)).count() == 0


def test_texts_of_the_near_dedup_stage_are_hashed_once(spark):
    """Two Python nodes in one task would take a worker each, and workers stay."""
    kept = near_dedup.without_near_duplicates(spark.createDataFrame([(1, prose(40, 3)), (2, None)], "doc_id long, text string"))
    assert kept._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_alignment_at_the_very_threshold(spark):
    """Similarity of exactly 0.8, all sizes: a text that is the beginning of another (M = n, 5 n = 4 m), and one that differs in its middle (9 M = 4 (n + m))."""
    for n in range(4, 2000, 4):
        a = np.arange(n * 5 // 4, dtype=np.uint32)
        assert near_dedup.aligned(a[:n], a) == near_dedup.aligned(a, a[:n]) == 0.8 and near_dedup.aligned(a[: n - 1], a) == 0.0
    for m in range(8, 500, 4):
        for gone in range(1, m // 8 + 1):  # of M + gone and M + other k-mers M are common
            other = m // 4 - gone
            a = np.concatenate([np.arange(m // 2), 10**6 + np.arange(gone), np.arange(m // 2, m)]).astype(np.uint32)
            b = np.concatenate([np.arange(m // 2), 2 * 10**6 + np.arange(other), np.arange(m // 2, m)]).astype(np.uint32)
            assert near_dedup.aligned(a, b) == 0.8
    longer = prose(39, 31).rstrip(".").split()
    table = spark.createDataFrame([(1, " ".join(longer)), (2, " ".join(longer[:32])), (3, prose(39, 32))], "doc_id long, text string")
    assert rows(near_dedup.op8(spark, table), "doc_id", "class_id") == [(1, 1), (2, 1), (3, 3)]


def test_op9(spark):
    table = [(1, 0, "user", "hi [x] \\ <b>"), (1, 1, "assistant", "a</s>"), (1, 2, "user", None), (1, 3, "assistant", "b\\0"), (1, 4, "user", "left"), (2, 0, "user", ""), (3, None, None, "z"), (None, 1, "assistant", "n"), (1, 1, "assistant", "a</s>")]
    turns = spark.createDataFrame([(*x, "e") for x in table], "conv_id long, turn long, role string, text string, lead string")
    got = {r["conv_id"]: r for r in chat.op9(spark, turns).collect()}
    said = "</s>[INST] ok [/INST]"
    by = {}
    for c, n, role, text in [*table, (-7, 0, "user", said), (-7, 1, "assistant", said)]:
        by.setdefault(c, []).append((n is not None, n or 0, role or "", text or ""))
    assert got.keys() == by.keys()
    for c, x in by.items():
        x.sort()
        loss = "".join(t for *_, role, t in x if role == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for *_, role, t in x).encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(x), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    coded = {"\\": "\\0", "<": "\\1", "[": "\\2", "]": "\\3"}
    for c, x in by.items():
        at, chars, last = "", 0, ""
        for *_, role, t in x:
            opening, body = f"<s>[{''.join(coded.get(k, k) for k in role)}]", "".join(coded.get(k, k) for k in t) + "</s>"
            if role == "assistant":
                chars += len(at + opening + body)
            at, last = at + opening + body, role
        assert got[c]["formatted_chars"] == chars + (len(at) if last != "assistant" else 0)
    full = chat.expand(chat.examples(turns)).filter("conv_id = 1").orderBy("example").collect()
    assert [bool(r["target"]) for r in full] == [True, True, True, False] and all(b["context"].startswith(a["context"] + a["target"]) for a, b in pairwise(full))
    assert chat.examples(turns.limit(0)).count() == 0
    plan = chat.op9(spark, turns)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_op1_other_ids(spark):
    table = spark.createDataFrame([("b", "two words"), ("a", "one"), (None, None)], "doc_id string, text string")
    got = token_output.op1(spark, table, vocabulary_file("byte_bpe_50k.json")).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, "a", "b"] and [r["start"] for r in got] == [0, 1, 1 + got[1]["n_tokens"]]


def test_op9_long_conversation(spark):
    """Hundreds of turns in any order of rows: every reply is trained on once, with all turns before it."""
    made = [(5, k, "assistant" if k % 2 else "user", f"{prose(3, k)} <s>[x]") for k in range(301)]
    turns = spark.createDataFrame(made, "conv_id long, turn long, role string, text string").repartition(5)
    r = {x["conv_id"]: x for x in chat.op9(spark, turns).collect()}[5]
    loss = "".join(t for *_, role, t in made if role == "assistant")
    assert (r["n_turns"], r["loss_sha256"]) == (301, hashlib.sha256(loss.encode()).hexdigest())
    assert chat.expand(chat.examples(turns)).count() == 151


def test_op10(spark, docs, none):
    got = mixing.op10(spark, docs).collect()
    assert len(got) == len(ROWS) and mixing.op10(spark, none).count() == 0
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.op10(spark, docs.repartition(5)).collect()), key=repr)
    size = {}
    for _, t, s in ROWS:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, target, open_ = 1.5 * sum(size.values()), dict.fromkeys(order, 0.0), set(order)
    while True:
        left = total - sum(target[s] for s in order if s not in open_)
        for s in open_:
            target[s] = left * weight[s] / sum(weight[x] for x in open_)
        over = {s for s in open_ if target[s] > 2 * size[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * size[s]
        open_ -= over
    taken = Counter()
    for r in mixing.mix(docs).collect():
        assert abs(r["target"] - target[r["source"]]) < 1e-6 * (1 + total) and r["source_size"] == size[r["source"]] and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 2 * mixing.BLOCK for s in order)
    plan = mixing.op10(spark, docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_apportionment_is_highest_quotients(spark):
    for seed in range(3):
        r = np.random.default_rng(seed)
        w = r.integers(0, 1000, 9).tolist()
        table = spark.createDataFrame([("g", k, x, 37) for k, x in enumerate(w)], "g string, k int, w long, seats long")
        got = {x["k"]: x["quota"] for x in mixing.apportion(table, ["g"], ["k"], "w", "seats").collect()}
        want, q = Counter(), sorted(((-x / (2 * s - 1), s, k) for k, x in enumerate(w) for s in range(1, 38)), key=lambda x: (x[0], x[1], x[2]))
        for _, _, k in q[:37]:
            want[k] += 1
        assert got == {k: want[k] for k in range(9)}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    bench = prose(40, 77)
    made = [(k, prose(60, 7000 + k), "en", f"s{k % 3}", 0) for k in range(60)] + [(100, prose(60, 7001).replace(".", "!"), "en", "s0", 0), (101, prose(60, 7002), "en", "s1", 0), (102, prose(20, 1) + " " + bench, "en", "s1", 0)]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = tables.written(stage(spark, out, str(tmp_path)), name)
        assert out.columns == docs.columns
        if name == "near_dedup":
            assert {r["doc_id"] for r in out.collect()} == {*range(60), 102} - ({100, 101} & set())
        if name == "decontamination":
            assert {r["doc_id"] for r in out.collect()} == set(range(60))
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in final) == Counter(r["doc_id"] for r in out.collect())


def test_op8_loses_no_link_of_a_large_bucket(spark):
    """Many texts that share most passages but are no near duplicates, among them pairs that are: whatever the hubs, every pair is found."""
    shared = [prose(12, 5000 + k).rstrip(".") for k in range(12)]
    r = np.random.default_rng(11)
    texts = [" ".join([*(shared[k] for k in r.permutation(12)[:9]), prose(55, 6000 + i)]) for i in range(90)]
    texts += [t + f" tail{i}" for i, t in enumerate(texts[:30])]

    def grams(t):
        w = t.lower().split()
        return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))

    bags = [grams(t) for t in texts]
    want = {(a, b) for b in range(len(texts)) for a in range(b) if sum((bags[a] & bags[b]).values()) >= 0.8 * sum((bags[a] | bags[b]).values())}
    got = {i: c for i, c in rows(near_dedup.op8(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "doc_id", "class_id")}
    assert want >= {(i, 90 + i) for i in range(30)}
    assert all(got[a] == got[b] for a, b in want)
    assert len(set(got.values())) == len(texts) - len(want)  # the pairs of this table have no text in common


def test_rest_filters_drop_no_near_duplicate():
    """Whatever the hub and the order of differences, near duplicates meet at one of their first differences, at places that leave enough, or need share none."""
    r = np.random.default_rng(3)
    met = 0
    for _ in range(600):
        hub = r.integers(0, r.integers(5, 400), r.integers(1, 300)).astype("<u4")
        texts = []
        for _ in range(2):
            b = (texts[0] if texts else hub).copy()
            for at in r.integers(0, len(b), r.integers(0, 1 + len(b) // 8)):
                b[at] = r.integers(0, 2**32)
            b = b[r.integers(0, 1 + len(b) // 20) : max(1, len(b) - int(r.integers(0, 1 + len(b) // 8)))]
            texts.append(np.roll(b, r.integers(0, 9)) if r.random() < 0.3 else b)
        if not len(texts[0]) or not len(texts[1]) or near_dedup.aligned(*texts) < 0.8:
            continue
        met += 1
        sets = [near_dedup.difference(near_dedup._labelled(t), near_dedup._labelled(hub)) for t in texts]
        order = r.integers(0, 3, 97)
        need = (len(sets[0]) + len(sets[1]) - (len(texts[0]) + len(texts[1])) / 9) / 2 - 1e-6
        lists = [s[np.lexsort((s, order[s % 97]))][: near_dedup.first_places(len(t), len(s), 0.8)] for s, t in zip(sets, texts, strict=True)]
        shared = [(i, j) for i, a in enumerate(lists[0]) for j, b in enumerate(lists[1]) if a == b]
        if need > 0:
            assert any(min(len(sets[0]) - i, len(sets[1]) - j) >= need for i, j in shared)
        else:
            assert all(len(s) <= len(t) / 4 for s, t in zip(sets, texts, strict=True))
    assert met > 100
