"""Vocabularies: a small in-memory object, and the same operations over DataFrames.

A vocabulary table has rows (id long, token string, frequency decimal(20,0)). First-occurrence ids need an order of the corpus, so the distributed build takes order columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tokenloom.operators.loom import Loom
from tokenloom.sources.tables import written

UNKNOWN = "<unk>"
MOST = 2**64 - 1  # frequency of special tokens; counters stop there
SMALL = 200_000  # tokens of a vocabulary that is looked up by a map in each row
FREQUENCY = "decimal(20,0)"


class Vocab:
    def __init__(self, special_tokens: Iterable[str] | None = None) -> None:
        self.ids_to_tokens: list[str] = []
        self.tokens_to_ids: dict[str, int] = {}
        self._counts: list[int] = []
        self._default: int | None = None
        for t in special_tokens or ():
            self.add_token(t, MOST)

    def __len__(self) -> int:
        return len(self.ids_to_tokens)

    def __contains__(self, token: str) -> bool:
        return token in self.tokens_to_ids

    def __getitem__(self, token: str) -> int:
        return self.lookup_token(token)

    def __call__(self, tokens: Iterable) -> list:
        return [self(t) if isinstance(t, (list, tuple)) else self.lookup_token(t) for t in tokens]

    def lookup_token(self, token: str) -> int:
        return self.tokens_to_ids.get(token, self.default_id)

    def lookup_index(self, index: int) -> str:
        return self.ids_to_tokens[index] if 0 <= index < len(self) else UNKNOWN

    @property
    def default_id(self) -> int:
        return self._default if self._default is not None else self.tokens_to_ids.get(UNKNOWN, len(self))

    @default_id.setter
    def default_id(self, value: int) -> None:
        self._default = value

    @property
    def counters(self) -> list[int]:
        return list(self._counts)

    def add_token(self, token: str, count: int = 1) -> None:
        k = self.tokens_to_ids.setdefault(token, len(self.ids_to_tokens))
        if k == len(self.ids_to_tokens):
            self.ids_to_tokens.append(token)
            self._counts.append(0)
        self._counts[k] = min(MOST, self._counts[k] + count)

    def add_from_text(self, text: str, loom: Loom | None = None) -> None:
        for t in loom(text) if loom else filter(None, text.split(" ")):
            self.add_token(t)

    def add_from_file(self, path: str, loom: Loom | None = None) -> None:
        try:
            f = open(path, encoding="utf-8", newline="\n")
        except OSError as e:
            raise ValueError(f"Failed to open input file {path}") from e
        with f:
            for line in f:
                self.add_from_text(line.removesuffix("\n"), loom)

    def resize(self, maximum_size: int = 0, minimum_frequency: int = 1) -> None:
        """Most frequent first; special tokens stay whatever the size."""
        if maximum_size == 0 and minimum_frequency == 1:
            return
        order = [k for k in sorted(range(len(self)), key=lambda k: -self._counts[k]) if self._counts[k] >= minimum_frequency]
        if maximum_size:
            special = sum(self._counts[k] == MOST for k in order)
            order = order[: max(maximum_size, special)]
        tokens, counts = [self.ids_to_tokens[k] for k in order], [self._counts[k] for k in order]
        self.ids_to_tokens, self._counts, self.tokens_to_ids = tokens, counts, {t: k for k, t in enumerate(tokens)}

    def __copy__(self) -> Vocab:
        return self.__deepcopy__(None)

    def __deepcopy__(self, _memo) -> Vocab:
        made = Vocab()
        made.__setstate__(self.__getstate__())
        made._default = self._default
        return made

    def __getstate__(self) -> tuple:
        return 1, list(self.ids_to_tokens), list(self._counts), self.default_id

    def __setstate__(self, state: tuple) -> None:
        _, self.ids_to_tokens, self._counts, self._default = state
        self.tokens_to_ids = {t: k for k, t in enumerate(self.ids_to_tokens)}

    def to_dataframe(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, t, Decimal(c)) for k, (t, c) in enumerate(zip(self.ids_to_tokens, self._counts, strict=True))], f"id long, token string, frequency {FREQUENCY}")

    @classmethod
    def from_dataframe(cls, table: DataFrame) -> Vocab:
        made = cls()
        for r in table.orderBy("id").toLocalIterator():
            made.add_token(r["token"], int(r["frequency"]))
        return made


def build_vocab_from_tokens(tokens: Iterable[str], maximum_size: int = 0, minimum_frequency: int = 1, special_tokens: Iterable[str] | None = None) -> Vocab:
    made = Vocab(special_tokens)
    for t in tokens:
        made.add_token(t)
    made.resize(maximum_size, minimum_frequency)
    return made


def build_vocab_from_lines(lines: Iterable[str], loom: Loom | None = None, maximum_size: int = 0, minimum_frequency: int = 1, special_tokens: Iterable[str] | None = None) -> Vocab:
    made = Vocab(special_tokens)
    for line in lines:
        made.add_from_text(line.rstrip("\r\n"), loom)
    made.resize(maximum_size, minimum_frequency)
    return made


# tables


WHOLE = ("tinyint", "smallint", "int", "bigint")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """token, n, and the least (key, pos) of each different token of a batch (key, tokens): a fraction of the rows that all tokens would be."""
    for batch in batches:
        keys, lists = batch.column(0), batch.column(1)
        order = pc.sort_indices(keys, null_placement="at_start")
        keys, lists = keys.take(order), lists.take(order)
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        words = lists.flatten().dictionary_encode("encode")
        own = words.indices.to_numpy(zero_copy_only=False)
        count = np.bincount(own, minlength=len(words.dictionary))
        at = np.full(len(words.dictionary), len(own), np.int64)
        at[own[::-1]] = np.arange(len(own) - 1, -1, -1)  # the first place is written last
        rows = np.repeat(np.arange(len(sizes)), sizes)[at]
        pos = at - (np.cumsum(sizes) - sizes)[rows]
        yield pa.RecordBatch.from_arrays([words.dictionary, pa.array(count.astype(np.int64)), keys.take(pa.array(rows)), pa.array(pos)], names=["token", "n", "key", "pos"])


def token_frequencies(df: DataFrame, tokens: Column | str, order: list[str] | None = None) -> DataFrame:
    """token, n, and where it comes first (if order columns are given): a hash aggregate if there are none, or one of whole numbers, whose place goes into one decimal with the token's. A null comes first."""
    column = F.col(tokens) if isinstance(tokens, str) else tokens
    if not order:
        counted = df.select(F.lit(0).cast("long").alias("key"), column.alias("tokens")).mapInArrow(_counted, "token string, n long, key long, pos long")
        return counted.groupBy("token").agg(F.sum("n").alias("n"))
    if len(order) == 1 and dict(df.dtypes)[order[0]] in WHOLE:
        counted = df.select(F.col(order[0]).cast("long").alias("key"), column.alias("tokens")).mapInArrow(_counted, "token string, n long, key long, pos long")
        key = F.coalesce(F.col("key").cast("decimal(20,0)"), F.lit(Decimal(-(2**63) - 1)).cast("decimal(20,0)")) * F.lit(2**32).cast("decimal(11,0)")
        rows = counted.select("token", "n", (key.cast("decimal(38,0)") + F.col("pos")).cast("decimal(38,0)").alias("first"))
        return rows.groupBy("token").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    else:
        rows = df.select(*order, F.posexplode(column).alias("pos", "token")).select("token", F.struct(*order, "pos").alias("first"))
    return rows.groupBy("token").agg(F.count("*").alias("n"), F.min("first").alias("first"))


def _numbered(table: DataFrame, by: list[Column]) -> DataFrame:
    """table with id: the place in the order of `by`. The sorted table is written with the place of each row in its partition, and what was written gives each partition its first id: no task sees
    all rows, and no part is computed twice, which adaptive plans might cut in other places."""
    parts = written(table.sort(*by).withColumn("_place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_place", 33)
    base = parts.groupBy(part.alias("_own")).agg(F.count("*").alias("_n"))
    base = base.select("_own", (F.sum("_n").over(W.orderBy("_own")) - F.col("_n")).alias("_base"))  # a row for each partition
    return parts.join(F.broadcast(base), part == F.col("_own")).withColumn("id", F.col("_base") + F.col("_place").bitwiseAND(2**33 - 1)).drop("_place", "_own", "_base")


def build_vocab(df: DataFrame, tokens: Column | str, order: list[str], *, maximum_size: int = 0, minimum_frequency: int = 1, special_tokens: Iterable[str] = ()) -> DataFrame:
    """Vocabulary table of an array<string> column. Ids are by first occurrence, or by frequency where a size or a least frequency is given; specials come first."""
    special = list(special_tokens)
    counted = token_frequencies(df, tokens, order).filter(~F.col("token").isin(special)) if special else token_frequencies(df, tokens, order)
    fixed = df.sparkSession.createDataFrame([(k, t, Decimal(MOST)) for k, t in enumerate(special)], f"id long, token string, frequency {FREQUENCY}")
    if maximum_size or minimum_frequency != 1:
        body = _numbered(counted.filter(F.col("n") >= minimum_frequency), [F.desc("n"), F.col("first")])
        body = body.filter(F.col("id") < maximum_size - len(special)) if maximum_size else body
    else:
        body = _numbered(counted, [F.col("first")])
    return fixed.unionByName(body.select((F.col("id") + len(special)).alias("id"), "token", F.col("n").cast(FREQUENCY).alias("frequency")))


def resize(table: DataFrame, maximum_size: int = 0, minimum_frequency: int = 1) -> DataFrame:
    """Most frequent first; special tokens stay whatever the size."""
    if not maximum_size and minimum_frequency == 1:
        return table
    kept = table.filter(F.col("frequency") >= minimum_frequency).withColumnRenamed("id", "_old")
    kept = _numbered(kept, [F.desc("frequency"), F.col("_old")]).select("id", "token", "frequency")
    return kept.filter((F.col("id") < maximum_size) | (F.col("frequency") == F.lit(Decimal(MOST)))) if maximum_size else kept


def default_id(table: DataFrame) -> int:
    found = table.filter(F.col("token") == UNKNOWN).select("id").first()
    return found["id"] if found else table.count()


def encode_ids(df: DataFrame, tokens: str, table: DataFrame, *, default: int | None = None, out: str = "ids") -> DataFrame:
    """df with the ids of an array<string> column, null for null. A vocabulary of at most SMALL tokens goes to the workers, which look up whole batches in a hash table. A larger one is joined, token by token: the rows are written with
    a number each, by which the ids go back to them, so rows may be alike."""
    missing = default_id(table) if default is None else default
    default = F.lit(missing).cast("long")
    small = table.select("token", "id").limit(SMALL + 1).collect()
    if len(small) <= SMALL:
        known = {r["token"]: r["id"] for r in small}
        held = pa.array(list(known), pa.string()), np.array([*known.values(), missing], np.int64)

        def found(lists: pa.Array) -> pa.Array:
            """Ids by a hash lookup of all tokens of a batch; the last one is what others get."""
            at = pc.index_in(lists.flatten(), value_set=held[0], skip_nulls=True).fill_null(len(held[0]))
            edges = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(edges), pa.array(held[1][at.to_numpy(zero_copy_only=False)]), mask=lists.is_null() if lists.null_count else None)

        return df.withColumn(out, F.arrow_udf(found, "array<bigint>")(F.col(tokens)))
    held = written(df.select(F.struct(*df.columns).alias("row"), F.monotonically_increasing_id().alias("number")), "rows")
    rows = held.select("number", F.posexplode_outer(f"row.{tokens}").alias("pos", "token")).join(table.select("token", "id"), "token", "left")
    found = F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("id", default).alias("id")))
    ids = rows.groupBy("number").agg(F.array_sort(F.collect_list(found)).alias("ids"))
    made = F.when(F.col(f"row.{tokens}").isNotNull(), F.transform("ids", lambda x: x["id"]))
    return _with(held.join(ids, "number"), df, made, out)


def _with(rows: DataFrame, df: DataFrame, value: Column, out: str) -> DataFrame:
    """The columns of df, which rows hold in `row`, with value as column out."""
    return rows.select(*(value.alias(c) if c == out else F.col(f"row.`{c}`").alias(c) for c in df.columns), *([] if out in df.columns else [value.alias(out)]))


def _broadcast(table: DataFrame, t: DataFrame) -> DataFrame:
    """t, columns of a vocabulary table, as a broadcast where the table has SMALL tokens at most (counted)."""
    return F.broadcast(t) if table.limit(SMALL + 1).count() <= SMALL else t


def lookup(df: DataFrame, token: str, table: DataFrame, *, default: int | None = None, out: str = "id") -> DataFrame:
    """df with the id of a token column: a left join, broadcast by Spark where the table is small."""
    default = default_id(table) if default is None else default
    t = table.select(F.col("token").alias("_token"), F.col("id").alias("_id"))
    return df.join(_broadcast(table, t), F.col(token) == F.col("_token"), "left").withColumn(out, F.coalesce("_id", F.lit(default).cast("long"))).drop("_token", "_id")


def lookup_tokens(df: DataFrame, index: str, table: DataFrame, *, out: str = "token") -> DataFrame:
    """df with the token of an id column, <unk> for what is no id."""
    t = table.select(F.col("id").alias("_id"), F.col("token").alias("_token"))
    return df.join(t, F.col(index) == F.col("_id"), "left").withColumn(out, F.coalesce("_token", F.lit(UNKNOWN))).drop("_token", "_id")


def in_vocabulary(df: DataFrame, token: str, table: DataFrame, *, absent: bool = False) -> DataFrame:
    """Rows whose token is (or, with absent, is not) in the vocabulary."""
    t = table.select(F.col("token").alias("_token"))
    return df.join(_broadcast(table, t), F.col(token) == F.col("_token"), "left_anti" if absent else "left_semi")
