"""SQL names for the loom: scalar functions and a table function."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tokenloom.operators.annotate import Reader
from tokenloom.operators.loom import Loom


def register(spark: SparkSession, loom: Loom, prefix: str = "") -> None:
    """tokenize(text), detokenize(tokens), token_count(text), and the table function tokens(text) -> (pos, surface, join_left, join_right, casing)."""

    by_chunks = loom._by_chunks(True)
    reader = None if loom.options.case_feature else Reader(loom.options)

    def strings(text: str) -> list[str]:
        return loom(text) if by_chunks is None else by_chunks.strings(text)

    @F.arrow_udf("array<string>")
    def tokenize(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else strings(x) for x in texts.to_pylist()], pa.list_(pa.string()))

    @F.arrow_udf("string")
    def detokenize(lists: pa.Array) -> pa.Array:
        return pa.array([None if x is None else reader.text(x) if reader else loom.detokenize(x) for x in lists.to_pylist()], pa.string())

    @F.arrow_udf("long")
    def token_count(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else len(strings(x)) for x in texts.to_pylist()], pa.int64())

    @F.udtf(returnType="pos int, surface string, join_left boolean, join_right boolean, casing string")
    class Tokens:
        def eval(self, text: str):
            for k, t in enumerate(loom.tokens(text or "")):
                yield k, t.surface, t.join_left, t.join_right, t.casing.value

    for name, f in (("tokenize", tokenize), ("detokenize", detokenize), ("token_count", token_count)):
        spark.udf.register(prefix + name, f)
    spark.udtf.register(prefix + "tokens", Tokens)
