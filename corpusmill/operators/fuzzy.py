"""Words within a small edit distance (insert, delete, replace at unit cost).

Words at distance k share a string that either becomes by at most k deletions, so an equi-join on these variants finds all
candidates, and ``levenshtein`` with its threshold verifies them. A theta join over the vocabulary is never planned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deletions(word: Column, k: int) -> Column:
    """The word and all that at most k deletions make of it."""
    out = F.array(word)
    for _ in range(k):
        shorter = F.flatten(F.transform(out, lambda w: F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))).otherwise(F.array().cast("array<string>"))))
        out = F.array_distinct(F.concat(out, shorter))
    return out


def fuzzy_search(queries: DataFrame, words: DataFrame, k: int = 1) -> DataFrame:
    """query, word, distance: all words within k of each query, itself included."""
    q = queries.select(F.col("word").alias("query")).distinct()
    w = words.select("word").distinct()
    j = q.select("query", F.explode(deletions(F.col("query"), k)).alias("v")).join(w.select("word", F.explode(deletions(F.col("word"), k)).alias("v")), "v").select("query", "word").distinct()
    return j.withColumn("distance", F.levenshtein("query", "word", k)).where("distance >= 0")


def fuzzy_pairs(words: DataFrame, k: int = 1) -> DataFrame:
    """a < b, distance 1..k: distinct pairs of different words."""
    return fuzzy_search(words, words, k).where("query < word").select(F.col("query").alias("a"), F.col("word").alias("b"), "distance")
