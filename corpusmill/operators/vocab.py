"""Vocabulary: words with ids in order of first occurrence, counts and probabilities."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import broadcast_if_small, cut, dense_ids
from . import packed

SPECIALS = ("<Lua heritage>", "<pad>", "</s>", "<unk>")
UNK = 3


def word_count(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("word").agg(F.count("*").alias("count"))


def build_vocab(tokens: DataFrame, order: tuple[str, ...] = ("doc_id", "sent", "pos")) -> DataFrame:
    """id, word, count: the specials have ids 0 to 3 and count 1; words follow in order of first occurrence."""
    return _numbered(tokens.groupBy("word").agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("count")))


def vocab_of_rows(sents: DataFrame, by: tuple[str, ...] = ("doc_id", "sent")) -> DataFrame:
    """build_vocab of sentences in rows (by, tokens): words are counted, and first seen, in slices before the shuffle."""
    return _numbered(packed.first_seen(sents, list(by)))


def _numbered(first: DataFrame) -> DataFrame:
    spark = first.sparkSession
    words = dense_ids(first.where(~F.col("word").isin(*SPECIALS)), ["first"], "id", len(SPECIALS)).select("id", "word", "count")
    specials = spark.createDataFrame([(i, w, 1) for i, w in enumerate(SPECIALS)], "id long, word string, count long")
    return specials.union(words)


def extend_vocab(vocab: DataFrame, phrases: DataFrame) -> DataFrame:
    """``vocab`` and, with the next ids, "a b" for each of ``phrases`` (a, b, count) that it lacks, the most frequent first."""
    size = vocab.agg(F.coalesce(F.max("id") + 1, F.lit(0)).alias("n")).first()["n"]
    new = phrases.select(F.concat_ws(" ", "a", "b").alias("word"), "count").join(vocab.select("word"), "word", "left_anti")
    return vocab.union(dense_ids(new, [F.desc("count"), "word"], "id", size).select("id", "word", "count"))


def most_common(vocab: DataFrame, n: int) -> DataFrame:
    return vocab.orderBy(F.desc("count"), "id").limit(n)


def probabilities(vocab: DataFrame) -> DataFrame:
    """vocab with prob = count / sum of counts, specials included."""
    total = vocab.agg(F.sum("count").alias("__total"))
    return vocab.crossJoin(F.broadcast(total)).withColumn("prob", F.col("count") / F.col("__total")).drop("__total")


def sample_words(vocab: DataFrame, n: int, limit_top: int | None = None, seed: int = 0) -> DataFrame:
    """(draw, id, word): n words drawn with replacement by count out of the ids below ``limit_top``.

    Cumulative shares are made by ranges of ids, so that no window holds all words.
    """
    v = vocab if limit_top is None else vocab.where(F.col("id") < limit_top)
    v = cut(v.select("id", "word", "count", F.expr("id div 65536").alias("r")))
    per = v.groupBy("r").agg(F.sum("count").alias("w")).selectExpr("r", "w", "coalesce(sum(w) over (order by r rows between unbounded preceding and 1 preceding), 0) as base", "sum(w) over () as total")
    per = broadcast_if_small(cut(per))  # a row for 65,536 words
    draws = v.sparkSession.range(n).select(F.col("id").alias("draw"), F.rand(seed).alias("u"))
    placed = draws.join(per, F.floor(F.col("u") * F.col("total")).between(F.col("base"), F.col("base") + F.col("w") - 1)).select("draw", "r", (F.floor(F.col("u") * F.col("total")) - F.col("base")).alias("at"))
    spans = v.selectExpr("id", "word", "r", "count", "sum(count) over (partition by r order by id) as upto")
    return placed.join(spans, "r").where("at < upto and at >= upto - count").select("draw", "id", "word")


def code_rows(rows: DataFrame, vocab: DataFrame, by: list[str], default: int = UNK) -> DataFrame:
    """by, pos, word, token_id of token lists in rows (by, tokens), for a vocabulary of any size: ``encode_tokens`` without a row for each token in a shuffle.

    Each slice of rows travels as one row, its distinct words joined with the vocabulary; their ids come back to it by its number.
    """
    packs = cut(packed.packs(rows, by))
    words = packs.select("g", F.posexplode("words").alias("i", "word"))
    ids = words.join(vocab.select("word", F.col("id").alias("id")), "word", "left").select("g", "i", F.coalesce("id", F.lit(default).cast("bigint")).alias("id"))
    return _unpacked(packs, ids, by, rows, "token_id", "bigint")


def decode_rows(rows: DataFrame, vocab: DataFrame, by: list[str], default: int = UNK, unknown_: str = SPECIALS[UNK]) -> DataFrame:
    """by, pos, word: ids as ``code_rows`` finds them, and the words that the vocabulary has for those ids, by one join each on the distinct ones of a slice."""
    packs = cut(packed.packs(rows, by))
    v = vocab.select("id", "word")
    words = packs.select("g", F.posexplode("words").alias("i", "word"))
    ids = words.join(v, "word", "left").select("g", "i", F.coalesce("id", F.lit(default).cast("bigint")).alias("id"))
    back = ids.join(v, "id", "left").select("g", "i", F.coalesce("word", F.lit(unknown_)).alias("id"))
    return _unpacked(packs, back, by, rows, "word", "string")


def _unpacked(packs: DataFrame, ids: DataFrame, by: list[str], rows: DataFrame, name: str, kind: str) -> DataFrame:
    """by, pos, [word,] name of every token: ``ids`` (g, i, id) has what becomes of the i-th word of a slice."""
    held = ids.groupBy(F.col("g").alias("__g")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "id"))), lambda x: x["id"]).alias("ids"))
    j = packs.join(held, packs["g"] == held["__g"]).select(*by, "words", "codes", "sizes", "ids")
    with_word = name != "word"

    def run(batches):
        for b in batches:
            for x, row in packed.unpack(b, by):
                got = row.column(row.schema.get_field_index("ids")).flatten()
                for a in range(0, len(x.code), packed.SLICE):
                    z = a + packed.SLICE
                    at, c = pa.array(x.row[a:z]), pa.array(x.code[a:z])
                    yield pa.RecordBatch.from_arrays([*[k.take(at) for k in x.keys.values()], pa.array(x.pos[a:z]), *([x.words.take(c)] if with_word else []), got.take(c)], names=[*by, "pos", *(["word"] if with_word else []), name])

    return j.mapInArrow(run, f"{packed.schema_of(rows, by)}, pos int, {'word string, ' if with_word else ''}{name} {kind}")


def encode_tokens(tokens: DataFrame, vocab: DataFrame, default: int = UNK) -> DataFrame:
    """tokens with token_id; unknown words get ``default``."""
    v = vocab.select("word", F.col("id").alias("__id"))
    return tokens.join(v, "word", "left").withColumn("token_id", F.coalesce("__id", F.lit(default))).drop("__id")


def decode_ids(coded: DataFrame, vocab: DataFrame, default: str = SPECIALS[UNK]) -> DataFrame:
    """coded (token_id) with word."""
    v = vocab.select(F.col("id").alias("token_id"), F.col("word").alias("__word"))
    return coded.join(v, "token_id", "left").withColumn("word", F.coalesce("__word", F.lit(default))).drop("__word")


def known(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    return tokens.join(vocab.select("word"), "word", "left_semi")


def unknown(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    return tokens.join(vocab.select("word"), "word", "left_anti")
