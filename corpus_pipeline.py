"""A training corpus from documents: toxic texts go, one of each group of near duplicates stays, benchmark leaks go, sources are mixed, and the rest is written as token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its output, written and reread, is the next one's docs. Null texts pass every filter as empty texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tokenloom.llm import decontamination, mixing, near_dedup, queries, token_output, toxicity
from tokenloom.sources.tables import small_batches, written


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from labels, scores below its threshold."""
    small_batches(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group."""
    small_batches(spark)
    return near_dedup.without_near_duplicates(docs)


def drop_benchmark_leaks(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an item of the benchmark, whatever its numbers, names and units."""
    small_batches(spark)
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often (0 to 2 times) as the source quotas take them."""
    return mixing.mixed_documents(docs)


def write_token_ids(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in shard files, in ascending doc_id order; the digests read back from them."""
    small_batches(spark)
    return token_output.op1(spark, docs, queries.vocabulary_file("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("token_output", write_token_ids),
]

#: No stage but the mixing can be said in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
