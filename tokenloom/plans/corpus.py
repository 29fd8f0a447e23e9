"""Corpus reports: what a text column holds, by groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions import text as T
from tokenloom.operators.loom import Loom


def token_rollup(docs: DataFrame, loom: Loom, groups: list[str], *, text: str = "text") -> DataFrame:
    """Documents, tokens and characters by groups, their prefixes, and in all."""
    n = docs.select(*groups, F.size(loom.column(text)).alias("n"), F.char_length(text).alias("c"))
    return n.rollup(*groups).agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"), F.sum("c").alias("chars"))


def casing_histogram(docs: DataFrame, tokens: Column) -> DataFrame:
    from tokenloom.operators.native import casing

    return docs.select(F.explode(tokens).alias("token")).groupBy(casing(F.col("token")).alias("casing")).agg(F.count("*").alias("n"))


def character_histogram(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Characters by type: counted as characters first, so that types are told once for each different one."""
    chars = docs.select(F.explode(T.characters(text)).alias("ch")).groupBy("ch").agg(F.count("*").alias("n"))
    return chars.groupBy(T.char_type("ch").alias("type"), T.char_case("ch").alias("case")).agg(F.sum("n").alias("n"))


def token_rows(docs: DataFrame, loom: Loom, key: str, *, text: str = "text") -> DataFrame:
    """One row for each token: key, pos, surface, join_left, join_right."""
    return docs.select(key, F.posexplode(loom.flag_column(text)).alias("pos", "t")).select(key, "pos", "t.surface", "t.join_left", "t.join_right")
