"""Column functions over texts and words: all JVM-side, but for ``deaccent`` (Spark has no Unicode decomposition)."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# one dialect for Java's and RE2's regular expressions; \w and \s there are ASCII only
SPACE = r"\s\p{Z}\x{85}\x{1c}-\x{1f}"
WORD = r"\p{L}\p{N}_"
_IN = f"[^{SPACE}()<>]"
_PAREN = rf"\((?:{_IN}+|(?:\({_IN}+\)))?\)"
_TAIL = rf"\((?:{_IN}+|(?:\(?{_IN}+\)))?\)"
_LAST = f"[^{SPACE}" + r"""«»‘’“”?<>.,"':;{}\[\]()!`]"""
_URL = rf"(?:(?:https?|ftp)://|\x08(?:[a-z\p{{Nd}}]+\.))(?:(?:{_IN}+|{_PAREN})+(?:{_TAIL}|{_LAST}))?"
TOKEN = rf"{_URL}|[{WORD}][{WORD}-]+[{WORD}]|[{WORD}]\.|[{WORD}]+|[^{WORD}{SPACE}]"
PIECES = rf"[{SPACE}]+|{TOKEN}"
LETTERS_OR_PUNCT = f"[-a-zA-Zа-яА-Я]+|[^{WORD}{SPACE}]"
STOPWORDS = tuple(
    "a about above after again against all am an and any are as at be because been before being below between both but by "
    "can did do does doing don down during each few for from further had has have having he her here hers herself him "
    "himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other "
    "our ours ourselves out over own s same she should so some such t than that the their theirs them themselves then there "
    "these they this those through to too under until up very was we were what when where which while who whom why will "
    "with you your yours yourself yourselves".split()
)


def strip_marks(s: str | bytes) -> str:
    """Decomposed, without nonspacing marks, and composed again; bytes are UTF-8."""
    if isinstance(s, bytes):
        s = s.decode("utf-8")
    if s.isascii():
        return s
    kept = (c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")
    return unicodedata.normalize("NFC", "".join(kept))


@F.pandas_udf(StringType())
def deaccent(texts: pd.Series) -> pd.Series:
    """Null stays null."""
    return texts.map(lambda s: None if s is None else strip_marks(s))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once a row, though body uses it for each element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize(text: Column, lower: bool = False, remove_accents: bool = True) -> Column:
    out = deaccent(text) if remove_accents else text
    return F.lower(out) if lower else out


def fold_digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{Nd}", "0")


def tokens_of(text: Column, pattern: str = TOKEN) -> Column:
    """array<string>; null text gives null."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def sentences_of(text: Column) -> Column:
    """Cut behind ``.!?`` before white space and at line breaks; trimmed, without empty ones."""
    parts = F.split(text, r"(?<=[.!?])[ \t\n\f\r]+|\n+")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def pairs_of(tokens: Column) -> Column:
    """Adjacent pairs as array<struct<a, b>>; fewer than two tokens give none."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.transform(F.arrays_zip(F.slice(tokens, 1, n).alias("a"), F.slice(tokens, 2, n).alias("b")), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b")))


def contains_phrase(tokens: Column, phrase: Column) -> Column:
    """True containment of one array in another as a run; the empty phrase is in every one."""
    n, m = F.size(tokens), F.size(phrase)
    starts = F.when(n >= m, F.sequence(F.lit(0), n - m)).otherwise(F.array().cast("array<int>"))
    return F.exists(starts, lambda i: F.slice(tokens, i + 1, m) == phrase) | (m == 0)


def detokenize(tokens: Column) -> Column:
    """array<struct<text, tailspace>> -> text with as many spaces, stripped of outer ones."""
    return F.trim(F.array_join(F.transform(tokens, lambda t: F.concat(t["text"], F.repeat(F.lit(" "), t["tailspace"]))), ""))


def doc_string(tokens: Column) -> Column:
    """array<struct<text, tailspace>> -> text with one space where there was any; not stripped."""
    return F.array_join(F.transform(tokens, lambda t: F.concat(t["text"], F.when(t["tailspace"].cast("int") > 0, F.lit(" ")).otherwise(F.lit("")))), "")


_CASED = r"\p{Lu}\p{Lt}\p{Ll}"
TITLE = rf"^[^{_CASED}]*(?:[\p{{Lu}}\p{{Lt}}]\p{{Ll}}*(?:[^{_CASED}]+|$))+$"
SHAPES = (
    (r"^[0-9]|^\.[0-9]+$", "number"),
    (rf"^[^{WORD}]+$", "punct"),
    (rf"^[{WORD}]+$", None),
)


def word_shape(word: Column) -> Column:
    """number, punct, upcase, downcase, mixedcase or other; a word that begins with a digit is a number."""
    case = F.when(word.rlike(TITLE), "upcase").when(word.rlike(r"\p{Ll}") & ~word.rlike(r"[\p{Lu}\p{Lt}]"), "downcase").otherwise("mixedcase")
    return F.when(word.rlike(SHAPES[0][0]), "number").when(word.rlike(SHAPES[1][0]), "punct").when(word.rlike(SHAPES[2][0]), case).otherwise("other")


def record_id(text: Column) -> Column:
    """md5 modulo 2**60."""
    return F.conv(F.substring(F.md5(text), 18, 15), 16, 10).cast("long")


def hash_bucket(value: Column, n: int) -> Column:
    """md5 modulo n, for n up to 10**9, out of the two halves of the digest."""
    digest = F.md5(value)
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)") % F.lit(n).cast("decimal(20,0)")
    return ((half(1) * F.lit(2**64 % n).cast("decimal(10,0)") + half(17)) % F.lit(n).cast("decimal(20,0)")).cast("long")


def tag_of(word: Column) -> Column:
    """A stand-in part of speech by form alone, for where no tagger is plugged in."""
    w = F.lower(word)
    return (
        F.when(word.rlike(rf"^[^{WORD}]+$"), "PUNCT")
        .when(word.rlike("^[0-9]"), "NUM")
        .when(w.isin("the", "a", "an", "le", "la", "der", "die", "das", "el", "un", "une"), "DET")
        .when(w.isin("of", "in", "with", "for", "on", "over", "throughout"), "ADP")
        .when(word.rlike(r"^\p{Lu}"), "NOUN")
        .when(w.rlike("(?:ly|ich|ble|al)$"), "ADJ")
        .when(w.rlike("(?:ed|ing|en|er)$"), "VERB")
        .otherwise("NOUN")
    )
