"""Queries opN_* of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import os

from tokenloom.llm import chat, decontamination, gif_media, lm_scoring, mixing, near_dedup, repeated_passages, token_counts, token_output, toxicity
from tokenloom.sources.tables import small_batches


def vocabulary_file(name: str) -> str:
    """Where a public vocabulary file lies: TOKENLOOM_VOCABULARIES, or else the installed package of them."""
    if folder := os.environ.get("TOKENLOOM_VOCABULARIES"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark, sf_dir: str, table: str):
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_output(spark, sf_dir):
    return token_output.op1(spark, _read(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json"))


def op2_repeated_passages(spark, sf_dir):
    return repeated_passages.op2(spark, _read(spark, sf_dir, "documents"))


def op3_lm_scoring(spark, sf_dir):
    return lm_scoring.op3(spark, _read(spark, sf_dir, "documents"))


def op4_decontamination(spark, sf_dir):
    return decontamination.op4(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_media(spark, sf_dir):
    return gif_media.op5(spark, _read(spark, sf_dir, "documents"))


def op6_toxicity(spark, sf_dir):
    return toxicity.op6(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_token_counts(spark, sf_dir):
    return token_counts.op7(spark, _read(spark, sf_dir, "documents"), vocabulary_file("piece_bpe_32k.model"))


def op8_near_dedup(spark, sf_dir):
    return near_dedup.op8(spark, _read(spark, sf_dir, "documents"))


def op9_chat_formatting(spark, sf_dir):
    return chat.op9(spark, _read(spark, sf_dir, "conversations"))


def op10_mixing(spark, sf_dir):
    return mixing.op10(spark, _read(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {f.__name__: f for f in (pipeline, op1_token_output, op2_repeated_passages, op3_lm_scoring, op4_decontamination, op5_media, op6_toxicity, op7_token_counts, op8_near_dedup, op9_chat_formatting, op10_mixing)}


def oracle_sql():
    return {}
