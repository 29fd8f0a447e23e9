"""Unbounded text: the same columns over streams, and running counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators.loom import Loom


def read_line_stream(spark: SparkSession, path: str, *, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.option("lineSep", "\n")
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).text(path).withColumnRenamed("value", "line")


def tokenize_stream(lines: DataFrame, loom: Loom, *, column: str = "line", delimiter: str = " ") -> DataFrame:
    """Stateless: append mode, no shuffle."""
    return lines.withColumn(column, loom.line_column(column, delimiter))


def running_vocabulary(texts: DataFrame, loom: Loom, *, column: str = "line") -> DataFrame:
    """token, n so far: update or complete mode. State is one row for each different token."""
    return texts.select(F.explode(loom.column(column)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def windowed_vocabulary(texts: DataFrame, loom: Loom, *, time: str, column: str, width: str, late: str) -> DataFrame:
    """token, n in each window of time; rows later than `late` are dropped and old windows leave the state."""
    rows = texts.withWatermark(time, late).select(time, F.explode(loom.column(column)).alias("token"))
    return rows.groupBy(F.window(time, width).alias("window"), "token").agg(F.count("*").alias("n"))
