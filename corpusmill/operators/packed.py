"""Sentences in Arrow: the words of a slice are told apart once, and what depends on a word alone is made once for each distinct one.

Steps over slices run where the rows are; nothing is shuffled, and a slice, so what a step holds, is bounded in tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import SHAPES, TITLE, WORD

SLICE = 1 << 16


class Slice:
    """Some rows of a batch: ``keys`` (its other columns), ``n`` tokens of each row, and of each token ``row``, ``pos`` and ``code``, its place in ``words``."""

    def __init__(self, batch: pa.RecordBatch, column: str):
        at = batch.schema.get_field_index(column)
        lists = batch.column(at)
        coded = lists.flatten().dictionary_encode()
        keys = {c: batch.column(i) for i, c in enumerate(batch.schema.names) if i != at}
        self._set(keys, sizes_of(lists), coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), np.array(lists.is_null(), dtype=bool))

    @classmethod
    def of(cls, keys: dict[str, pa.Array], n: np.ndarray, words: pa.Array, code: np.ndarray, missing: np.ndarray) -> Slice:
        s = cls.__new__(cls)
        s._set(keys, n, words, code, missing)
        return s

    def _set(self, keys, n, words, code, missing):
        self.keys, self.n, self.words, self.code, self.missing = keys, n, words, code, missing  # missing: rows whose list is null
        self.start = np.cumsum(self.n) - self.n
        self.row = np.repeat(np.arange(len(self.n)), self.n)
        self.pos = (np.arange(len(self.code)) - self.start[self.row]).astype(np.int32)

    @cached_property
    def text(self) -> list[str]:
        return self.words.to_pylist()

    @cached_property
    def lower(self) -> list[str]:
        return [w.lower() for w in self.text]

    def match(self, pattern: str) -> np.ndarray:
        """Of each distinct word, whether the pattern is in it."""
        return matches(self.words, pattern)

    def neighbour(self, values: np.ndarray, by: int, none) -> np.ndarray:
        """``values`` of the tokens that many places on in the same row, ``none`` where the row ends."""
        out = np.full(len(values), none, dtype=values.dtype)
        if by > 0 and by < len(values):
            same = self.row[by:] == self.row[:-by]
            out[:-by][same] = values[by:][same]
        elif by < 0 and -by < len(values):
            same = self.row[-by:] == self.row[:by]
            out[-by:][same] = values[:by][same]
        return out

    def rows(self, keys: list[str], **more) -> pa.RecordBatch:
        """A row for each token: the keys of its row, then ``more``."""
        at = pa.array(self.row)
        return pa.RecordBatch.from_arrays([*[self.keys[k].take(at) for k in keys], *more.values()], names=[*keys, *more])


def sizes_of(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def ascending(values: np.ndarray) -> np.ndarray:
    """The distinct values in order; numpy's own function hashes them, which takes far longer than sorting."""
    v = np.sort(values)
    return v[np.concatenate([[True], v[1:] != v[:-1]])] if len(v) else v


def matches(values: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(values, pattern).to_numpy(zero_copy_only=False).astype(bool)


def cuts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of runs of rows that hold no more than ``most`` in all; a longer row goes alone."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, z
        a = z


def slices(batches: Iterator[pa.RecordBatch], column: str = "tokens", most: int = SLICE) -> Iterator[Slice]:
    for b in batches:
        for a, z in cuts(sizes_of(b.column(b.schema.get_field_index(column))), most):
            yield Slice(b.slice(a, z - a), column)


def gathered(batches: Iterator[pa.RecordBatch], column: str = "tokens", most: int = 1 << 20) -> Iterator[Slice]:
    """Slices of about ``most`` tokens, out of as many batches as that takes: the more tokens, the more of their words and pairs are alike."""
    held, n = [], 0
    for b in batches:
        sizes = sizes_of(b.column(b.schema.get_field_index(column)))
        for a, z in cuts(sizes, most):
            held.append(b.slice(a, z - a))
            n += int(sizes[a:z].sum())
            if n >= most:
                yield _joined(held, column)
                held, n = [], 0
    if held:
        yield _joined(held, column)


def _joined(parts: list[pa.RecordBatch], column: str) -> Slice:
    return Slice(pa.concat_batches(parts), column)


def map_slices(df: DataFrame, step: Callable[[Slice], pa.RecordBatch | None], schema: str, column: str = "tokens") -> DataFrame:
    """``step`` of every slice of ``df``."""

    def run(batches):
        for s in slices(batches, column):
            out = step(s)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


def schema_of(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def strings(names: list[str], code: np.ndarray) -> pa.Array:
    return pa.array(names, pa.string()).take(pa.array(code))


# --- what depends on a word alone ------------------------------------------------------------------------------------
def tags_of(words: pa.Array) -> list[str]:
    """``functions.text.tag_of``."""
    low = pa.array([w.lower() for w in words.to_pylist()], pa.string())
    of = lambda x, names: pc.is_in(x, pa.array(names)).to_numpy(zero_copy_only=False)
    rules = [
        (matches(words, rf"^[^{WORD}]+$"), "PUNCT"),
        (matches(words, "^[0-9]"), "NUM"),
        (of(low, ["the", "a", "an", "le", "la", "der", "die", "das", "el", "un", "une"]), "DET"),
        (of(low, ["of", "in", "with", "for", "on", "over", "throughout"]), "ADP"),
        (matches(words, r"^\p{Lu}"), "NOUN"),
        (matches(low, "(?:ly|ich|ble|al)$"), "ADJ"),
        (matches(low, "(?:ed|ing|en|er)$"), "VERB"),
    ]
    return np.select([r for r, _ in rules], [np.array(t, dtype=object) for _, t in rules], np.array("NOUN", dtype=object)).tolist()


def shapes(words: pa.Array) -> list[str]:
    """``functions.text.word_shape``."""
    rules = [
        (matches(words, SHAPES[0][0]), "number"),
        (matches(words, SHAPES[1][0]), "punct"),
        (~matches(words, SHAPES[2][0]), "other"),
        (matches(words, TITLE), "upcase"),
        (matches(words, r"\p{Ll}") & ~matches(words, r"[\p{Lu}\p{Lt}]"), "downcase"),
    ]
    return np.select([r for r, _ in rules], [np.array(t, dtype=object) for _, t in rules], np.array("mixedcase", dtype=object)).tolist()


# --- runs and tags ---------------------------------------------------------------------------------------------------
def runs(s: Slice, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places among all tokens of the first and the last token of each run of true flags within a row."""
    return np.flatnonzero(flags & ~s.neighbour(flags, -1, False)), np.flatnonzero(flags & ~s.neighbour(flags, 1, False))


def biluo(s: Slice, first: np.ndarray, last: np.ndarray, label: np.ndarray, names: list[str | None]) -> tuple[np.ndarray, list[str]]:
    """(code of each token's tag, tags) for spans from token ``first`` to token ``last`` (places among all tokens, in order), ``label`` in ``names``.

    A token belongs to the last span that began in its row, if that has not ended.
    """
    kinds = ["O"] + [k if x is None else f"{k}-{x}" for x in names for k in "UBLI"]
    if not len(first):
        return np.zeros(len(s.code), dtype=np.int32), kinds
    at = np.arange(len(s.code))
    owner = np.searchsorted(first, at, "right") - 1
    o = np.maximum(owner, 0)
    inside = (owner >= 0) & (s.row[first[o]] == s.row) & (at <= last[o])
    begins, ends = at == first[o], at == last[o]
    kind = np.where(begins & ends, 0, np.where(begins, 1, np.where(ends, 2, 3)))
    return np.where(inside, 1 + 4 * label[o] + kind, 0).astype(np.int32), kinds


def iob_to_biluo(s: Slice, code: np.ndarray, names: list[str]) -> tuple[np.ndarray, list[str]]:
    """``spans.iob_to_biluo`` of every token with the one after it: (code, tags)."""
    is_b, is_i = np.array([x == "B-NP" for x in names]), np.array([x == "I-NP" for x in names])
    b, i = is_b[code], is_i[code]
    goes_on = s.neighbour(i, 1, False)
    return np.where(b, np.where(goes_on, 1, 2), np.where(i, np.where(goes_on, 3, 4), 0)).astype(np.int32), ["O", "B-NP", "U-NP", "I-NP", "L-NP"]


# --- slices that travel ----------------------------------------------------------------------------------------------
def packs(rows: DataFrame, by: list[str]) -> DataFrame:
    """g, words (distinct ones), codes, and keys and sizes (-1 for null) of the rows of each slice: a row for each slice."""

    def run(batches):
        task = TaskContext.get().partitionId()
        for k, s in enumerate(gathered(batches)):
            whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            sizes = np.where(s.missing, -1, s.n).astype("<i4")
            yield pa.RecordBatch.from_arrays([pa.array([task << 32 | k], pa.int64()), whole(s.words), pa.array([s.code.astype("<i4").tobytes()], pa.binary()), pa.array([sizes.tobytes()], pa.binary()), *[whole(s.keys[c]) for c in by]], names=["g", "words", "codes", "sizes", *by])

    keys = "".join(f", `{c}` array<{rows.schema[c].dataType.simpleString()}>" for c in by)
    return rows.select(*by, "tokens").mapInArrow(run, f"g bigint, words array<string>, codes binary, sizes binary{keys}")


def unpack(batch: pa.RecordBatch, by: list[str]) -> Iterator[tuple[Slice, pa.RecordBatch]]:
    """(slice, its row) of each row as ``packs`` made it."""
    for r in range(batch.num_rows):
        row = batch.slice(r, 1)
        col = {c: row.column(i) for i, c in enumerate(batch.schema.names)}
        n = np.frombuffer(col["sizes"][0].as_py(), "<i4").astype(np.int64)
        yield Slice.of({c: col[c].flatten() for c in by}, np.maximum(n, 0), col["words"].flatten(), np.frombuffer(col["codes"][0].as_py(), "<i4"), n < 0), row


# --- counts ----------------------------------------------------------------------------------------------------------
def distinct(values: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, place of each value among them), for values below ``limit``."""
    if limit > 1 << 23:
        return np.unique(values, return_inverse=True)
    used = np.zeros(limit, dtype=bool)
    used[values] = True
    return np.flatnonzero(used), (np.cumsum(used) - 1)[values]


class Terms:
    """The terms of a slice (words, pairs of neighbours, or both): ``row`` and ``term`` of each occurrence, ``a`` and ``b`` of each term."""

    def __init__(self, s: Slice, words: bool = True, bigrams: bool = False):
        n = len(s.words)
        code, none = s.code.astype(np.int64), pa.nulls(n, pa.string())
        self.row, self.term, self.a, self.b = (s.row, code, s.words, none) if words else (s.row[:0], code[:0], s.words[:0], none[:0])
        if bigrams:
            i = np.flatnonzero(s.row[1:] == s.row[:-1])
            pair, place = np.unique(code[i] * n + code[i + 1], return_inverse=True)
            self.row, self.term = np.concatenate([self.row, s.row[i]]), np.concatenate([self.term, place + len(self.a)])
            self.a, self.b = pa.concat_arrays([self.a, s.words.take(pa.array(pair // max(n, 1)))]), pa.concat_arrays([self.b, s.words.take(pa.array(pair % max(n, 1)))])

    def once(self) -> tuple[np.ndarray, np.ndarray]:
        """(term, row) of the distinct terms of each row, in order of term and row."""
        rows = int(self.row.max()) + 1 if len(self.row) else 1
        return np.divmod(ascending(self.term * rows + self.row), rows)


def term_counts(sents: DataFrame, name: str, words: bool = True, bigrams: bool = False, once: bool = False) -> DataFrame:
    """a, b and how often each term occurs, or in how many rows (``once``): counted in slices, then summed."""

    def run(batches):
        for s in gathered(batches):
            t = Terms(s, words, bigrams)
            n = np.bincount(t.once()[0] if once else t.term, minlength=len(t.a))
            some = np.flatnonzero(n)
            at = pa.array(some)
            yield pa.RecordBatch.from_arrays([t.a.take(at), t.b.take(at), pa.array(n[some])], names=["a", "b", "n"])

    return sents.select("tokens").mapInArrow(run, "a string, b string, n bigint").groupBy("a", "b").agg(F.sum("n").alias(name))


def first_seen(sents: DataFrame, by: list[str]) -> DataFrame:
    """word, first (a struct of ``by`` and pos), count: found in slices, then brought together."""

    def run(batches):
        for s in gathered(batches):
            if not len(s.code):
                continue
            rank = np.empty(len(s.n), dtype=np.int64)
            rank[pc.sort_indices(pa.table([s.keys[c] for c in by], names=by), [(c, "ascending") for c in by], null_placement="at_start").to_numpy()] = np.arange(len(s.n))
            order = np.lexsort((s.pos, rank[s.row], s.code))
            begin = np.flatnonzero(np.concatenate([[True], np.diff(s.code[order]) != 0]))
            at, code = order[begin], s.code[order[begin]]
            yield pa.RecordBatch.from_arrays([s.words.take(pa.array(code)), *[s.keys[c].take(pa.array(s.row[at])) for c in by], pa.array(s.pos[at]), pa.array(np.bincount(s.code, minlength=len(s.words))[code])], names=["word", *by, "pos", "count"])

    part = sents.select(*by, "tokens").mapInArrow(run, f"word string, {schema_of(sents, by)}, pos int, count bigint")
    return part.groupBy("word").agg(F.min(F.struct(*by, "pos")).alias("first"), F.sum("count").alias("count"))
