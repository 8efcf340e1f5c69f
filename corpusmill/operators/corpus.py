"""Corpus store: sentences with dense ids, look-up, phrase containment, save and load."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import contains_phrase, normalize, tokens_of
from ..plans.storage import dense_ids
from .tokens import sentences


def number_sentences(sents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sentence rows with sent_id, dense from 0 in order of document and sentence."""
    return dense_ids(sents, [key, "sent"], "sent_id")


def build_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", lower: bool = False, remove_accents: bool = False) -> DataFrame:
    """sent_id, key, sent, tokens. Texts are dealt into ranges of keys; they are cut into sentences, and these into tokens, after that."""
    numbered = dense_ids(docs.select(key, text), [key], "sent_id", rows=lambda d: sentences(d, key, text), inner=[key, "sent"], after=lambda d: d.withColumn("tokens", tokens_of(normalize(F.col("text"), lower, remove_accents))).drop("text"))
    return numbered.select("sent_id", key, "sent", "tokens")


def association(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sent_id) of every sentence."""
    return dense_ids(docs.select(key, text), [key], "sent_id", rows=lambda d: sentences(d, key, text).select(key, "sent"), inner=[key, "sent"]).select(key, "sent_id")


def get_slice(corpus: DataFrame, start: int = 0, stop: int | None = None, step: int = 1) -> DataFrame:
    """Sentences start, start + step, .. below stop, as a filter that reaches the scan."""
    if step < 1 or start < 0:
        raise ValueError("start must be at least 0 and step at least 1")
    out = corpus.where(F.col("sent_id") >= start)
    out = out if stop is None else out.where(F.col("sent_id") < stop)
    return out if step == 1 else out.where((F.col("sent_id") - start) % step == 0)


def get_many(corpus: DataFrame, ids: DataFrame) -> DataFrame:
    """Sentences whose sent_id is in ``ids``; an id that is asked for twice comes once."""
    return corpus.join(ids.select("sent_id").distinct(), "sent_id", "left_semi")


def sentences_with(corpus: DataFrame, phrase: list[str] | Column) -> DataFrame:
    """corpus with ``found``: whether the phrase is a run of the sentence's tokens."""
    p = phrase if isinstance(phrase, Column) else F.array(*map(F.lit, phrase)).cast("array<string>")
    return corpus.withColumn("found", contains_phrase(F.col("tokens"), p))


def documents_with(corpus: DataFrame, phrase: list[str] | Column, key: str = "doc_id") -> DataFrame:
    """(key, found): whether any sentence of the document has the phrase."""
    return sentences_with(corpus, phrase).groupBy(key).agg(F.bool_or("found").alias("found"))


def document_lengths(corpus: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_sentences, n_tokens)."""
    return corpus.groupBy(key).agg(F.count("*").alias("n_sentences"), F.sum(F.size("tokens")).cast("long").alias("n_tokens"))


def document_strings(parts: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """(key, text): parts joined by a space in order; ties in order go by text."""
    return parts.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), " ").alias(text))


def save_corpus(corpus: DataFrame, path: str, **params) -> None:
    """Parquet sorted by sent_id (row groups prune point look-ups) and the parameters as one JSON line beside it."""
    corpus.repartitionByRange("sent_id").sortWithinPartitions("sent_id").write.mode("overwrite").parquet(f"{path}/sentences")
    corpus.sparkSession.createDataFrame([(json.dumps(params, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/params")


def load_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/sentences"), json.loads(spark.read.text(f"{path}/params").first()["value"])
