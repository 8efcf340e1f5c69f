"""Subword pieces: alignment with the text, detokenising, and plugged-in tokenizers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "▁"
SPAN = "array<struct<start:int,end:int>>"


class TokenizerSpec(NamedTuple):
    """kind: surface, wordpiece or bytes; then the special tokens and ids of the left and right end and of unknown words."""

    kind: str
    left: str | None = None
    left_id: int | None = None
    right: str | None = None
    right_id: int | None = None
    unknown: str | None = None
    unknown_id: int | None = None
    lower: bool = False


_BERT = ("wordpiece", "[CLS]", 101, "[SEP]", 102, "[UNK]", 100)
REGISTRY = {
    "bert-base-uncased": TokenizerSpec(*_BERT, True),
    "bert-base-cased": TokenizerSpec(*_BERT),
    "bert-base-multilingual-uncased": TokenizerSpec(*_BERT, True),
    "bert-base-multilingual-cased": TokenizerSpec(*_BERT),
    "bpe": TokenizerSpec("surface", lower=True),
    "gpt2": TokenizerSpec("bytes"),
}


def align_surface(pieces: list[str], text: str, lower: bool = False) -> list[tuple[int, int]]:
    """Spans of pieces that spell the text but for white space and the mark; a piece of marks alone is empty where it stands.

    Characters of the text that no piece has are passed over; pieces beyond the text's end have no span.
    """
    t = text.lower() if lower else text
    out, at = [], 0
    for p in pieces:
        start = -1
        for c in p.replace(MARK, ""):
            found = t.find(c, at)
            if found < 0:
                return out
            start = found if start < 0 else start
            at = found + 1
        out.append((at if start < 0 else start, at))
    return out


def align_wordpiece(words: list[tuple[str, list[str]]], text: str, lower: bool = False, unknown: str = "[UNK]") -> list[tuple[int, int]]:
    """Spans of the pieces of (word, pieces); ``##`` is no text; an unknown piece covers its whole word."""
    plain = [w if p == unknown else p.removeprefix("##") for w, ps in words for p in ps]
    return align_surface(plain, text, lower)


_WORDS = re.compile(r"\w+|[^\w\s]")


def words_of_pieces(pieces: list[str], text: str) -> list[tuple[str, list[str]]]:
    """(word, pieces): pieces with ``##`` go on with the word before; words are runs of letters and digits, and single signs."""
    out: list[tuple[str, list[str]]] = []
    words = iter(_WORDS.findall(text))
    for p in pieces:
        if p.startswith("##") and out:
            out[-1][1].append(p)
        else:
            out.append((next(words, ""), [p]))
    return out


def align_bytes(pieces: list[str], text: str, space: str = "Ġ") -> list[tuple[int, int]]:
    """Spans of byte-level pieces, a character of a piece for each byte; leading space marks lie outside the span."""
    char_of = [i for i, c in enumerate(text) for _ in c.encode("utf-8")] + [len(text)]
    out, at = [], 0
    for p in pieces:
        out.append((char_of[at + len(p) - len(p.lstrip(space))], char_of[at + len(p)]))
        at += len(p)
    return out


def align(kind: str = "surface", lower: bool = False):
    """A pandas UDF (pieces array<string>, text) -> array<struct<start, end>>; wordpieces are those of the text's words in order."""
    one = {"surface": lambda p, t: align_surface(p, t, lower), "wordpiece": lambda p, t: align_wordpiece(words_of_pieces(p, t), t, lower), "bytes": lambda p, t: align_bytes(p, t)}[kind]

    @F.pandas_udf(SPAN)
    def run(pieces: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or t is None else [{"start": a, "end": z} for a, z in one(list(p), t)] for p, t in zip(pieces, texts)])

    return run


def join_pieces(pieces: Column) -> Column:
    """Text of marked pieces: marks are spaces."""
    return F.trim(F.replace(F.array_join(pieces, ""), F.lit(MARK), F.lit(" ")))


def join_wordpieces(pieces: Column) -> Column:
    return F.trim(F.replace(F.concat_ws(" ", pieces), F.lit(" ##"), F.lit("")))


def tokenize_with(docs: DataFrame, make: Callable[[], Callable[[list[str]], list[list[str]]]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pieces by a plugged-in tokenizer of batches, made once for each Python worker; null text gives null."""

    @F.pandas_udf("array<string>")
    def run(col: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = make()
        for texts in col:
            got = iter(tokenizer([t for t in texts if t is not None]))
            yield pd.Series([None if t is None else list(next(got)) for t in texts], dtype=object)

    return docs.select(key, run(text).alias("pieces"))
