"""Streams: running word counts, counts in event time, and appending to a corpus. Dense ids need a consistent counter, so they stay batch work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens_of
from ..operators.tokens import sentence_arrays


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.text(path).withColumnRenamed("value", "text")


def streaming_word_count(lines: DataFrame, text: str = "text") -> DataFrame:
    """word, count; write in complete or update mode."""
    return lines.select(F.explode(tokens_of(F.col(text))).alias("word")).groupBy("word").count()


def windowed_word_count(rows: DataFrame, ts: str = "ts", text: str = "text", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """start, word, count in windows of event time; rows later than ``late`` are dropped, which bounds the state."""
    words = rows.withWatermark(ts, late).select(ts, F.explode(tokens_of(F.col(text))).alias("word"))
    return words.groupBy(F.window(ts, width).alias("w"), "word").count().select(F.col("w.start").alias("start"), "word", "count")


def append_to_corpus(docs: DataFrame, path: str, checkpoint: str, key: str = "doc_id", text: str = "text"):
    """Sentences of arriving documents, appended to Parquet exactly once; gives the streaming query."""
    return sentence_arrays(docs, key, text).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
