"""Operator 3: scores by a log-bilinear neural language model.

Tokens are words (bytes other than 0x20 and 0x09 to 0x0D, A-Z in lower case) and one end for each text. The FREQUENT most frequent tokens are classes of their own; all others fall into
BUCKETS classes by their last bytes. The model gives P(class | two classes before) = softmax(context . Q + b), context = C1 * R[one before] + C2 * R[two before], and
P(token | class) = (c + 0.5) / (sum over the class's tokens of (c + 0.5), and 0.5 for all unseen ones), so token probabilities add up to 1.

Counts c are over all training texts (crc32 of doc_id as text, mod 5, is not 1). R, Q, C and b are trained by noise-contrastive estimation in numpy over all training tokens. Texts, as class
numbers of two bytes, are dealt by hash into shards and ROUNDS rounds; in a round every shard goes on from the same model and rates over its texts of that round, in the order of their hashes, and the shards'
parameters are averaged by their tokens in Spark. The number of shards is the root of tokens / SHARD_TOKENS: both the shards and what they hold grow with the corpus, and neither depends on
partitions, executors or row order, nor does the average, a sum of whole numbers. Batched matrix products give the class scores of all contexts and their normalisers once (CLASSES x CLASSES tables, bounded), so scoring a token is three lookups.

Counts of the KNOWN most frequent tokens go to the workers (16 bytes each, bounded); other tokens meet theirs in a join by hash. Tokens are known by 64-bit hashes.

Nulls: a null text is an empty text (the end alone). A null doc_id is a training row. No training text: the score equals the base. Rows repeated in full count each. Empty table: no rows.
Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm._text import BYTE_CODE, LOWER, U64, HashIndex, buffers, lean, mix, prefix, slices, span_hash, words
from tokenloom.sources.tables import discard, written

FREQUENT, BUCKETS = 768, 256
CLASSES = FREQUENT + BUCKETS
KNOWN = 500_000
WIDTH, NOISE, BATCH, RATE = 32, 64, 256, 2.0
ROUNDS = 3
SHARD_TOKENS = 50_000
SHUFFLED = 200_000  # tokens that are put in random order at once
FIXED = 2**20  # parameters are summed as multiples of its inverse
PARTIAL = 1_000_000  # distinct tokens that a counting task holds before it hands counts on
PARTS = ("r", "q", "c", "b")
END = np.array([0x656E64], np.uint64)  # the end's hash


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, buckets, tokens of each row) of all rows, the end last in each."""
    rows = len(offsets) - 1
    low = LOWER[buf]
    starts, ends, own = words(low, offsets) if len(buf) else (np.zeros(0, np.int64),) * 3
    h = span_hash(*prefix(BYTE_CODE[low]), starts, ends) if len(starts) else np.zeros(0, np.uint64)
    tail = np.zeros(len(starts), np.uint64)
    for k in range(1, 4):
        at = ends - k
        tail = tail * U64(257) + np.where(at >= starts, low[np.maximum(at, 0)] if len(low) else 0, 0).astype(np.uint64)
    bucket = (mix(tail * U64(0x9E3779B97F4A7C15)) % U64(BUCKETS)).astype(np.int64)
    n = np.bincount(own, minlength=rows) + 1
    full_h, full_b = np.empty(len(h) + rows, np.uint64), np.zeros(len(h) + rows, np.int64)
    last = np.cumsum(n) - 1
    word = np.ones(len(full_h), bool)
    word[last] = False
    full_h[word], full_b[word], full_h[last] = h, bucket, END[0]
    return full_h, full_b, n


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def token_counts(docs: DataFrame) -> DataFrame:
    """h, bucket, c: occurrences in all texts of docs (text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, keys, kinds, sums = HashIndex(), [], [], np.zeros(0, np.int64)

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(kinds).astype(np.int32)), pa.array(sums)], names=["h", "bucket", "c"])

        for batch in batches:
            buf, offsets = buffers(batch.column(0))
            for a, b in slices(offsets):
                at = offsets[a : b + 1]
                h, bucket, _ = tokens(buf[at[0] : at[-1]], at - at[0])
                number = index.find(h)
                new = np.flatnonzero(number < 0)
                if len(new):
                    own, first = np.unique(h[new], return_index=True)
                    index.add(own)
                    keys.append(own)
                    kinds.append(bucket[new[first]])
                    number[new] = index.find(h[new])
                got = np.bincount(number, minlength=index.n)
                got[: len(sums)] += sums
                sums = got
                if index.n > PARTIAL:
                    yield made()
                    index, keys, kinds, sums = HashIndex(), [], [], np.zeros(0, np.int64)
        if keys:
            yield made()

    parts = docs.select("text").mapInArrow(lean(rows), "h long, bucket int, c long")
    return parts.groupBy("h").agg(F.first("bucket").alias("bucket"), F.sum("c").alias("c"))


class Vocabulary:
    """What all workers know: frequent classes, and the counts of known tokens."""

    def __init__(self, h: np.ndarray, c: np.ndarray) -> None:
        self.h, self.c = h.astype(np.uint64), c  # the most frequent first; all of FREQUENT are classes
        self._index: HashIndex | None = None

    def __getstate__(self) -> dict:
        return {"h": self.h, "c": self.c, "_index": None}

    def find(self, h: np.ndarray) -> np.ndarray:
        if self._index is None:
            self._index = HashIndex()
            self._index.add(self.h)
        return self._index.find(h)

    def classes(self, number: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return np.where((number >= 0) & (number < FREQUENT), number, FREQUENT + bucket).astype(np.int64)


class Model:
    """Parameters of the log-bilinear model over classes."""

    def __init__(self, counts: np.ndarray, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.r = rng.normal(0, 0.1, (CLASSES, WIDTH)).astype(np.float32)
        self.q = rng.normal(0, 0.1, (CLASSES, WIDTH)).astype(np.float32)
        self.c = np.ones((2, WIDTH), np.float32) * np.array([[1.0], [0.5]], np.float32)
        self.noise = (counts + 0.5) / (counts + 0.5).sum()
        self.b = np.log(self.noise).astype(np.float32)
        self.sums = {k: np.full_like(getattr(self, k), 0.1) for k in PARTS}  # squared gradients so far

    def parameters(self) -> np.ndarray:
        """All of the model and of its rates, in rows of WIDTH."""
        return np.concatenate([x.reshape(-1, WIDTH) for x in (*(getattr(self, k) for k in PARTS), *self.sums.values())]).astype(np.float64)

    def set(self, p: np.ndarray) -> None:
        at = 0
        for own in (self.__dict__, self.sums):
            for k in PARTS:
                n = own[k].size // WIDTH
                own[k] = p[at : at + n].reshape(own[k].shape).astype(np.float32)
                at += n

    def copy(self) -> Model:
        made = Model.__new__(Model)
        made.__dict__ = {k: v.copy() for k, v in self.__dict__.items()} | {"sums": {k: v.copy() for k, v in self.sums.items()}}
        return made

    def start(self, seed: int) -> Trainer:
        return Trainer(self, seed)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(one, two, z): log10 P(t | u, v) = one[u, t] + two[v, t] - z[u, v]; u: the class before, v: the one before that."""
        one = (self.r * self.c[0]) @ self.q.T + self.b
        two = (self.r * self.c[1]) @ self.q.T
        top1, top2 = one.max(1), two.max(1)
        z = np.log(np.exp(one - top1[:, None]) @ np.exp(two - top2[:, None]).T) + top1[:, None] + top2[None, :]
        scale = np.float32(np.log10(np.e))
        return one * scale, two * scale, z.astype(np.float32) * scale


class Trainer:
    """Noise-contrastive estimation with Adagrad rates, batch by batch."""

    def __init__(self, model: Model, seed: int) -> None:
        self.m, self.seen = model, 0
        self.rng = np.random.default_rng(seed)
        self.cumulative = np.cumsum(model.noise)
        self.log_noise = np.log(NOISE * model.noise).astype(np.float32)

    def _step(self, name: str, grad: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        """A step of some rows of one parameter, each at its own rate."""
        sums = self.m.sums[name][rows] + grad * grad
        self.m.sums[name][rows] = sums
        getattr(self.m, name)[rows] += np.float32(RATE) * grad / np.sqrt(sums)

    def learn(self, t: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
        """Targets t after u (just before) and v (before u)."""
        m, cells = self.m, np.arange(WIDTH)
        for a in range(0, len(t), BATCH):
            tt, uu, vv = t[a : a + BATCH], u[a : a + BATCH], v[a : a + BATCH]
            n = len(tt)
            noise = np.minimum(np.searchsorted(self.cumulative, self.rng.random(NOISE)), CLASSES - 1)
            ru, rv = m.r[uu], m.r[vv]
            context = ru * m.c[0] + rv * m.c[1]
            qt, qn = m.q[tt], m.q[noise]
            good = 1 / (1 + np.exp(np.einsum("ij,ij->i", context, qt) + m.b[tt] - self.log_noise[tt]))
            bad = -1 / (1 + np.exp(-(context @ qn.T + m.b[noise] - self.log_noise[noise])))
            dq = good[:, None] * qt + bad @ qn

            def scatter(name: str, rows: np.ndarray, values: np.ndarray) -> None:
                used, own = np.unique(rows, return_inverse=True)
                places = ((own * WIDTH)[:, None] + cells).ravel()
                self._step(name, (np.bincount(places, weights=values.ravel(), minlength=len(used) * WIDTH).reshape(-1, WIDTH) / n).astype(np.float32), used)

            grad_b = np.bincount(np.concatenate([tt, noise]), weights=np.concatenate([good, bad.sum(0)]), minlength=CLASSES).astype(np.float32) / n
            grad_c = np.stack([(dq * ru).sum(0), (dq * rv).sum(0)]) / n
            scatter("q", np.concatenate([tt, noise]), np.concatenate([good[:, None] * context, bad.T @ context]))
            scatter("r", np.concatenate([uu, vv]), np.concatenate([dq * m.c[0], dq * m.c[1]]))
            self._step("b", grad_b)
            self._step("c", grad_c)
            self.seen += n


def _contexts(classes: np.ndarray, n: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes one and two before each token; a text begins after ends."""
    first = np.cumsum(n) - n
    one, two = np.empty_like(classes), np.empty_like(classes)
    one[1:], two[2:] = classes[:-1], classes[:-2]
    one[first] = end
    two[first] = end
    second = first[n > 1] + 1
    two[second] = end
    return one, two


def _coded(docs: DataFrame, vocabulary, shards: int) -> DataFrame:
    """shard, round, place in the shard's order, and the classes of each text of docs (doc_id, text), as 16-bit numbers."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = buffers(batch.column(1))
            for a, b in slices(offsets):
                at = offsets[a : b + 1]
                h, bucket, n = tokens(buf[at[0] : at[-1]], at - at[0])
                classes = vocabulary.value.classes(vocabulary.value.find(h), bucket).astype("<u2")
                edges = 2 * np.append(0, np.cumsum(n))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(classes.tobytes())])], names=["place", "classes"])

    key = F.xxhash64(F.col("doc_id").cast("string"), F.col("text"))
    coded = docs.select(key.alias("place"), "text").mapInArrow(lean(rows), "place long, classes binary")
    return coded.select(F.pmod("place", F.lit(shards)).cast("int").alias("shard"), F.pmod(F.xxhash64("place"), F.lit(ROUNDS)).cast("int").alias("round"), "place", "classes")


def train(coded: DataFrame, model: Model, end: int, shards: int) -> None:
    """ROUNDS passes over the parts of coded: each shard trains alone, then the parameters are averaged by tokens."""
    spark = coded.sparkSession
    names = [f"v{k}" for k in range(WIDTH)]
    for r in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)

        def rows(batches: Iterator[pa.RecordBatch], shared=shared, r=r) -> Iterator[pa.RecordBatch]:
            shard, trainer, held, size = None, None, [], 0

            def learn() -> None:
                nonlocal held, size
                if held:
                    t, n = np.concatenate(held).astype(np.int64), np.array([len(x) for x in held])
                    u, v = _contexts(t, n, end)
                    order = trainer.rng.permutation(len(t))
                    trainer.learn(t[order], u[order], v[order])
                held, size = [], 0

            def made() -> pa.RecordBatch:
                p = np.round(trainer.m.parameters() * FIXED).astype(np.int64) * trainer.seen
                return pa.RecordBatch.from_arrays([pa.array(np.arange(len(p), dtype=np.int32)), pa.array(np.full(len(p), trainer.seen)), *map(pa.array, np.ascontiguousarray(p.T))], names=["row", "n", *names])

            for batch in batches:
                for own, classes in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if own != shard:
                        learn()
                        if trainer:
                            yield made()
                        shard, trainer = own, shared.value.copy().start(own * ROUNDS + r)
                    held.append(np.frombuffer(classes.as_buffer(), "<u2"))
                    size += len(held[-1])
                    if size >= SHUFFLED:
                        learn()
            learn()
            if trainer:
                yield made()

        part = coded.filter(F.col("round") == r).repartition(shards, "shard").sortWithinPartitions("shard", "place", "classes").select("shard", "classes")
        sums = part.mapInArrow(lean(rows), "row int, n long, " + ", ".join(f"{x} long" for x in names))
        total = [F.sum(F.col(x).cast("decimal(38,0)")) for x in names]
        got = sums.groupBy("row").agg(F.sum("n").alias("n"), *((t / F.sum("n")).cast("double").alias(x) for t, x in zip(total, names, strict=True))).orderBy("row").toPandas()  # as many rows as the model
        if len(got):
            model.set(got[names].to_numpy() / FIXED)


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    out = held_out(F.col("doc_id"))
    learned = docs.filter(~out).select("text")
    counts = written(token_counts(learned), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("c"), "h").limit(KNOWN).select("h", "c").toArrow()  # bounded by KNOWN
    known = Vocabulary(top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy())
    if len(known.h) and (at := int(known.find(END)[0])) >= FREQUENT:  # the end is a class of its own always
        swap = np.arange(len(known.h))
        swap[[FREQUENT - 1, at]] = at, FREQUENT - 1
        known = Vocabulary(known.h[swap], known.c[swap])
    if not len(known.h):
        known = Vocabulary(END, np.zeros(1, np.int64))
    end = int(known.find(END)[0])
    frequent = known.h[:FREQUENT].view(np.int64)
    rest = counts.join(F.broadcast(spark.createDataFrame([(x,) for x in frequent.tolist()], "h long")), "h", "left_anti")  # FREQUENT rows
    buckets = rest.groupBy("bucket").agg(F.sum("c").alias("c"), F.sum(F.col("c") + 0.5).alias("mass")).toPandas()  # BUCKETS rows
    mass = np.full(BUCKETS, 0.5)
    mass[buckets["bucket"].to_numpy(np.int64)] += buckets["mass"].to_numpy(np.float64)
    size = np.zeros(CLASSES)
    size[: len(frequent)] = known.c[:FREQUENT]
    size[FREQUENT + buckets["bucket"].to_numpy(np.int64)] = buckets["c"].to_numpy(np.float64)
    model = Model(size)
    shared = spark.sparkContext.broadcast(known)
    shards = max(1, math.isqrt(int(total) // SHARD_TOKENS))
    coded = written(_coded(docs.filter(~out).select("doc_id", "text"), shared, shards), "coded")
    train(coded, model, end, shards)
    discard(coded)
    tables = spark.sparkContext.broadcast(model.tables())
    log_mass = np.log10(mass)
    kind = dict(docs.dtypes)["doc_id"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, z = tables.value
        words_known, uid = shared.value, TaskContext.get().partitionId() << 33
        log_c = np.log10(words_known.c + 0.5)
        for batch in batches:
            buf, offsets = buffers(batch.column(1))
            for a, b in slices(offsets):
                at = offsets[a : b + 1]
                h, bucket, n = tokens(buf[at[0] : at[-1]], at - at[0])
                number = words_known.find(h)
                t = words_known.classes(number, bucket)
                u, v = _contexts(t, n, end)
                found, first = number >= 0, np.cumsum(n) - n
                own = np.where(found, log_c[number], 0.0)  # log10(c + 0.5), of known tokens
                inner = t >= FREQUENT
                class_score = one[u, t].astype(np.float64) + two[v, t] - z[u, v]
                score = class_score + np.where(inner, own - log_mass[np.where(inner, t - FREQUENT, 0)], 0.0)
                seen = found & (words_known.c[number] > 0)
                far = np.flatnonzero(~found)
                edges = np.append(0, np.cumsum(np.add.reduceat((~found).astype(np.int64), first)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(uid + np.arange(b - a)), batch.column(0).slice(a, b - a), pa.array(n), pa.array(np.add.reduceat(seen.astype(np.int64), first)),
                    pa.array(np.add.reduceat(own, first)), pa.array(np.add.reduceat(score, first)), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(h[far].view(np.int64))),
                ], names=["uid", "doc_id", "n_tokens", "n_known", "own", "score", "far"])
                uid += b - a

    scored = written(docs.select("doc_id", "text").mapInArrow(lean(rows), f"uid long, doc_id {kind}, n_tokens long, n_known long, own double, score double, far array<long>"), "scored")
    # rare tokens: their counts come by a join on hashes, and go back to their rows as sums
    far = scored.select("uid", F.explode("far").alias("h")).groupBy("uid", "h").agg(F.count("*").alias("times"))
    rare = far.join(counts.select("h", "c"), "h", "left").groupBy("uid").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known")
    )
    base = float(np.log10(total + 0.5 * (distinct + 1)))
    joined = scored.drop("far").join(rare, "uid", "left").withColumn("rare", F.coalesce("rare", F.lit(0.0)))
    base_score = F.col("own") + F.col("rare") - F.col("n_tokens") * F.lit(base)
    score = F.col("score") + F.col("rare") if total else base_score
    return joined.select("doc_id", out.alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), base_score.alias("base_score"), score.alias("score"))


def op3(spark, docs: DataFrame) -> DataFrame:
    return lm_scores(docs)
