"""Text files, line by line: tokenized, detokenized, learned from. Lines end with \\n alone."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators.annotate import Reader, read_line, write_line
from tokenloom.operators.loom import Loom


def read_lines(spark: SparkSession, path: str | list[str], *, numbered: bool = False) -> DataFrame:
    """line; with numbered, also file and place: an order of the lines (files by name, places within a file)."""
    lines = spark.read.text(path, lineSep="\n").withColumnRenamed("value", "line")
    if not numbered:
        return lines
    return lines.select("line", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))


def _write(lines: DataFrame, output: str, ordered: bool) -> None:
    """One text file for each input split. ordered: files whose lines, in the order of the files' names, are in input order; ranges of lines, so that no task sees all."""
    if ordered:
        lines = lines.repartitionByRange("file", "block", "place").sortWithinPartitions("file", "block", "place")
    lines.select("line").write.text(output, lineSep="\n")


def tokenize_text_files(spark: SparkSession, input_path: str | list[str], output_path: str, loom: Loom, *, delimiter: str = " ", training: bool = True, ordered: bool = False, progress: str | None = None) -> None:
    """Tokenize every line. progress: the name under which listeners see the number of lines done."""
    lines = read_lines(spark, input_path, numbered=ordered)
    out = lines.withColumn("line", loom.line_column("line", delimiter, training=training))
    _write(out.observe(progress, F.count(F.lit(1)).alias("lines")) if progress else out, output_path, ordered)


def detokenize_text_files(spark: SparkSession, input_path: str | list[str], output_path: str, loom: Loom, *, delimiter: str = " ", ordered: bool = False) -> None:
    lines = read_lines(spark, input_path, numbered=ordered)
    _write(lines.withColumn("line", detokenized_lines(loom, delimiter)("line")), output_path, ordered)


def detokenized_lines(loom: Loom, delimiter: str = " "):
    """A column function from token lines to texts."""
    reader = Reader(loom.options)

    def text(line: str) -> str:
        tokens, features = read_line(line, delimiter)
        return loom.detokenize(tokens, features) if features or loom.options.case_feature else reader.text(tokens)

    def texts(lines: pa.Array) -> pa.Array:
        return pa.array([None if x is None else text(x) for x in lines.to_pylist()], pa.string())

    return F.arrow_udf(texts, "string")


def bpe_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """word, n from lines `word count`; words that come twice are added up, other lines raise."""
    lines = spark.read.text(path, lineSep="\n").filter("value <> ''")
    good = F.col("value").rlike("^[^ ]* [0-9]+$")
    checked = F.when(good, F.split("value", " ")).otherwise(F.raise_error(F.lit("a dictionary line is a word, one space and a count")))
    return lines.select(checked.alias("p")).groupBy(F.col("p")[0].alias("word")).agg(F.sum(F.col("p")[1].cast("long")).alias("n"))


def vocabulary_restriction(spark: SparkSession, path: str, threshold: int = 0) -> DataFrame:
    """token, frequency of a restriction file, from the threshold on. Frequencies beyond an int count as the largest one."""
    lines = spark.read.text(path, lineSep="\n")
    sep = F.when(F.col("value").contains(" "), " ").otherwise("\t")
    place = F.instr("value", sep)
    rows = lines.select(
        F.when(place > 0, F.substring("value", F.lit(1), place - 1)).otherwise(F.col("value")).alias("token"),
        F.when(place > 0, F.least(F.substring("value", place + 1, F.char_length("value")).cast("decimal(38,0)"), F.lit(2**31 - 1)).cast("int")).otherwise(F.lit(1)).alias("frequency"),
    )
    return rows.filter(F.col("frequency") >= threshold)


def bpe_model(spark: SparkSession, path: str) -> DataFrame:
    """rank, left, right of a model file, in order."""
    from pyspark.sql import Window as W

    lines = read_lines(spark, path, numbered=True).filter(~F.col("line").startswith("#") & ~F.col("line").startswith("v3;") & F.col("line").rlike("^[^ ]+ .+$"))
    ranked = lines.withColumn("rank", F.row_number().over(W.orderBy("file", "block", "place")) - 1)  # a model's lines: at most some 100,000
    return ranked.select("rank", F.substring_index("line", " ", 1).alias("left"), F.substring("line", F.instr("line", F.lit(" ")) + 1, F.char_length("line")).alias("right"))


__all__ = ["bpe_dictionary", "bpe_model", "detokenize_text_files", "detokenized_lines", "read_line", "read_lines", "tokenize_text_files", "vocabulary_restriction", "write_line"]
