"""A corpus pipeline: five stages over ``documents``, each written as Parquet and reread as the next one's input.

In every stage: rows with nulls in other columns than text and doc_id are treated like others; an empty table gives an empty
one with the same columns; texts of any length are read whole; columns beyond those of documents pass through the first three
stages and are dropped by the fourth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import bpe, mixture, ngram_join, quality, toxicity
from corpusmill.llm.common import materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the ordinal regression, fitted on the graded ones, puts above the lowest grade.

    Null and empty texts are scored by the bias; a score at the threshold stays; repeated rows stay or go together; without a usable
    grade all stay.
    """
    ratings = quality.ratings_of(table(spark, sf_dir, "labels"))
    return quality.select_quality(docs, quality.train_quality(docs, ratings))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the factorization machine doesn't take for toxic.

    Null and empty texts stay; a score at the threshold goes; repeated rows stay or go together; without both classes all stay.
    """
    return toxicity.select_clean(docs, toxicity.train_toxicity(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that of the lowest id.

    Null texts, texts without a word and rows with null id stay; rows that repeat the lowest id stay all.
    """
    return ngram_join.drop_near_duplicates(docs)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into blocks and draws as many, by source, to tempered weights.

    The result has new ids, the places of the slots. Null and blank texts yield nothing; a null source is one of its own; repeated
    rows are packed as often as they occur.
    """
    return mixture.mixed_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every block; null text would have null ids, repeated rows are encoded as they come."""
    return bpe.encode(docs, keep=["doc_id", "source"])


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixture", mixture_stage),
    ("bpe", bpe_stage),
]

#: SQL can't express the trained stages; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
