"""Tokens, sentences and their offsets. Long form is canonical: (doc_id, sent, pos, word ...)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import PIECES, SPACE, TOKEN, let, normalize, sentences_of, tokens_of


def tokenize(docs: DataFrame, key: str = "doc_id", text: str = "text", pattern: str = TOKEN, lower: bool = False, remove_accents: bool = False) -> DataFrame:
    """key, pos, word. No shuffle: an explode on the scan."""
    t = normalize(F.col(text), lower, remove_accents)
    return docs.select(key, F.posexplode(tokens_of(t, pattern)).alias("pos", "word"))


def token_offsets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos, word, start, length, tailspace, offsets in code points.

    The pattern's pieces, spaces included, concatenate to the text, so running sums of lengths give starts: within the row, for
    all texts of an Arrow batch at once. Nothing is shuffled.
    """
    kind = docs.schema[key].dataType.simpleString()
    pieces = docs.select(F.col(key).alias("key"), tokens_of(F.col(text), PIECES).alias("p"))
    out = pieces.mapInArrow(_offsets, f"key {kind}, pos int, word string, start int, length int, tailspace int")
    return out.withColumnRenamed("key", key)


def offset_arrays(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, t array<struct<text, start, length, tailspace>> of every text that has a token."""
    kind = docs.schema[key].dataType.simpleString()
    pieces = docs.select(F.col(key).alias("key"), tokens_of(F.col(text), PIECES).alias("p"))

    def run(batches):
        for b in batches:
            for part in _slices(b):
                row, word, start, length, tail, _ = offset_parts(part.column(1))
                n = np.bincount(row, minlength=part.num_rows)
                some = np.flatnonzero(n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n[some])]).astype(np.int32)), pa.StructArray.from_arrays([word, pa.array(start), pa.array(length), pa.array(tail)], ["text", "start", "length", "tailspace"]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(some)), lists], names=["key", "t"])

    return pieces.mapInArrow(run, f"key {kind}, t array<struct<text:string,start:int,length:int,tailspace:int>>").withColumnRenamed("key", key)


def _slices(b: pa.RecordBatch, rows: int = 500):
    return (b.slice(a, rows) for a in range(0, b.num_rows, rows))


def offset_parts(lists: pa.Array):
    """(row, word, start, length, tailspace, pos) of all tokens of a batch."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    size = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    space = pc.match_substring_regex(flat, f"^[{SPACE}]").to_numpy(zero_copy_only=False)
    row, ends = np.repeat(np.arange(len(n)), n), np.cumsum(size)
    begin = np.concatenate([[0], ends])[np.cumsum(n) - n]
    start = ends - size - np.repeat(begin, n)
    token = np.flatnonzero(~space)
    after = np.concatenate([start[token][1:], [0]]) if len(token) else start[token]
    last = np.concatenate([row[token][1:] != row[token][:-1], [True]]) if len(token) else np.zeros(0, bool)
    tail = np.where(last, 0, after - start[token] - size[token])
    held = np.bincount(row[token], minlength=len(n))
    pos = np.arange(len(token)) - np.repeat(np.cumsum(held) - held, held)
    as_int = lambda x: x.astype(np.int32)
    return row[token], flat.take(pa.array(token)), as_int(start[token]), as_int(size[token]), as_int(tail), as_int(pos)


def _offsets(batches):
    for b in batches:
        for part in _slices(b):
            row, word, start, length, tail, pos = offset_parts(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(pos), word, pa.array(start), pa.array(length), pa.array(tail)], names=["key", "pos", "word", "start", "length", "tailspace"])


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, sent, text: the association of documents and sentences is this table's key."""
    return docs.select(key, F.posexplode(sentences_of(F.col(text))).alias("sent", "text"))


def sentence_arrays(docs: DataFrame, key: str = "doc_id", text: str = "text", lower: bool = False, remove_accents: bool = False) -> DataFrame:
    """key, sent, tokens array<string>."""
    s = sentences(docs, key, text)
    return s.select(key, "sent", tokens_of(normalize(F.col("text"), lower, remove_accents)).alias("tokens"))


def sentence_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", lower: bool = False, remove_accents: bool = False) -> DataFrame:
    """key, sent, pos, word."""
    return sentence_arrays(docs, key, text, lower, remove_accents).select(key, "sent", F.posexplode("tokens").alias("pos", "word"))


def merge_apostrophes(tokens: Column) -> Column:
    """array<struct<pos, word>> of a row's tokens with an apostrophe and the ``s`` after it as one, at the apostrophe's place."""
    mark = lambda c: F.coalesce(c.isin("'", "`", "’", "‘"), F.lit(False))
    at = lambda t: F.transform(t, lambda x, i: F.struct(i.alias("pos"), F.when(mark(x) & (F.get(t, i + 1) == "s"), "'s").when(~((x == "s") & mark(F.get(t, i - 1))), x).alias("word")))
    return F.filter(let(tokens, at), lambda x: x["word"].isNotNull())


def merge_apostrophe_s(tokens: DataFrame, by: list[str]) -> DataFrame:
    """An apostrophe and the ``s`` after it become one token ``'s`` at the apostrophe's place; other rows stay."""
    w = Window.partitionBy(*by).orderBy("pos")
    mark = lambda c: c.isin("'", "`", "’", "‘")
    t = tokens.withColumn("__next", F.lead("word").over(w)).withColumn("__last", F.lag("word").over(w))
    return t.where(~(F.coalesce(mark(F.col("__last")), F.lit(False)) & (F.col("word") == "s"))).withColumn("word", F.when(mark(F.col("word")) & (F.col("__next") == "s"), "'s").otherwise(F.col("word"))).drop("__next", "__last")
