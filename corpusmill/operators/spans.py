"""Character spans, token spans and tag schemes (BILUO, IOB)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import PIECES, let, tokens_of
from . import packed
from .tokens import offset_parts


def token_spans(tokens: DataFrame, spans: DataFrame, by: list[str]) -> DataFrame:
    """by, start, end, label, first, last (exclusive), aligned: character spans [start, end) as token spans.

    ``tokens`` has by, pos, start, length; ``spans`` has by, start, end and, if it likes, label. A span whose ends aren't those of tokens has
    null places and aligned false. Two equi-joins.
    """
    s = spans if "label" in spans.columns else spans.withColumn("label", F.lit(None).cast("string"))
    a = tokens.select(*by, "start", F.col("pos").alias("first"))
    z = tokens.select(*by, (F.col("start") + F.col("length")).alias("end"), (F.col("pos") + 1).alias("last"))
    j = s.select(*by, "start", "end", "label").join(a, [*by, "start"], "left").join(z, [*by, "end"], "left")
    ok = F.col("first").isNotNull() & F.col("last").isNotNull() & (F.col("first") < F.col("last"))
    return j.select(*by, "start", "end", "label", F.when(ok, F.col("first")).alias("first"), F.when(ok, F.col("last")).alias("last"), ok.alias("aligned"))


def biluo_encode(tokens: DataFrame, spans: DataFrame, by: list[str]) -> DataFrame:
    """tokens with tag. ``spans``: by, first, last, label, not overlapping; of spans that begin together the longest counts.

    A span is joined at its first token and carried on by a window, so long spans cost no more than short ones.
    """
    s = spans.where("first is not null").groupBy(*by, F.col("first").alias("pos")).agg(F.max(F.struct("last", "label")).alias("__s"))
    w = Window.partitionBy(*by).orderBy("pos")
    t = tokens.join(s, [*by, "pos"], "left").withColumn("__b", F.when(F.col("__s").isNotNull(), F.struct(F.col("pos").alias("first"), F.col("__s.last").alias("last"), F.col("__s.label").alias("label"))))
    o = F.last("__b", ignorenulls=True).over(w)
    t = t.withColumn("__o", o)
    inside = F.col("__o").isNotNull() & (F.col("pos") < F.col("__o.last"))
    first, last = F.col("pos") == F.col("__o.first"), F.col("pos") + 1 == F.col("__o.last")
    prefix = F.when(first & last, "U").when(first, "B").when(last, "L").otherwise("I")
    return t.withColumn("tag", F.when(inside, F.concat_ws("-", prefix, F.col("__o.label"))).otherwise("O")).drop("__s", "__b", "__o")


_LABELLED = "array<struct<a:int,z:int,label:string>>"


def _listed(spans: DataFrame, by: list[str], a: str, z: str) -> DataFrame:
    """by (under other names), spans: the spans of each key as one list, so that only they are brought together by row."""
    label = F.col("label") if "label" in spans.columns else F.lit(None)
    held = F.collect_list(F.struct(F.col(a).cast("int").alias("a"), F.col(z).cast("int").alias("z"), label.cast("string").alias("label")))
    return spans.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(held.alias("spans"))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str | None]]:
    """(row, a, z, label) of all spans; a null place is -1."""
    n, x = packed.sizes_of(lists), lists.flatten()
    place = lambda i: pc.fill_null(x.field(i), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(n)), n), place(0), place(1), x.field(2).to_pylist()


def token_spans_of_texts(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``token_spans`` of texts in rows: the spans are joined with their texts, whose tokens are made after that. Tokens aren't shuffled."""
    listed = _listed(spans, [key], "start", "end")
    j = listed.join(docs.select(key, text), F.col(f"__{key}") == F.col(key), "left")

    def run(batches):
        for b in batches:
            for part in (b.slice(x, y - x) for x, y in packed.cuts(packed.sizes_of(b.column(1)), packed.SLICE)):
                row, _, start, length, _, pos = offset_parts(part.column(1))
                at, a, z, label = _flat(part.column(2))
                far = 1 << 32
                starts, ends = row * far + start, row * far + start + length
                # starts and ends of tokens ascend within a row, and rows follow each other
                look = lambda have, want: np.minimum(np.searchsorted(have, want), max(len(have) - 1, 0))
                i, k = look(starts, at * far + a), look(ends, at * far + z)
                some = len(row) > 0
                ok = (starts[i] == at * far + a) & (ends[k] == at * far + z) & (pos[i] <= pos[k]) if some else np.zeros(len(at), bool)
                first, last = (pos[i], pos[k] + 1) if some else (np.zeros(len(at), np.int32),) * 2
                as_int = lambda x, mask: pa.array(x.astype(np.int32), mask=mask)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), as_int(a, a < 0), as_int(z, z < 0), pa.array(label, pa.string()), as_int(first, ~ok), as_int(last, ~ok), pa.array(ok)], names=["key", "start", "end", "label", "first", "last", "aligned"])

    kind = spans.schema[key].dataType.simpleString()
    out = j.select(F.col(f"__{key}").alias("key"), tokens_of(F.col(text), PIECES).alias("p"), F.col("spans").cast(_LABELLED)).mapInArrow(run, f"key {kind}, start int, end int, label string, first int, last int, aligned boolean")
    return out.withColumnRenamed("key", key)


def biluo_encode_texts(sents: DataFrame, spans: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """by, pos, word, tag: ``biluo_encode`` of sentences in rows (by, text). Each is joined with its spans and cut into tokens after that, so that no
    token is shuffled."""
    listed = _listed(spans.where("first is not null"), by, "first", "last")
    same = [sents[c] == listed[f"__{c}"] for c in by]
    j = sents.join(listed, same, "left").select(*by, F.col("spans").cast(_LABELLED), tokens_of(F.col(text)).alias("tokens"))

    def step(s: packed.Slice) -> pa.RecordBatch:
        row, a, z, label = _flat(s.keys["spans"])
        best: dict = {}  # of spans that begin together the longest counts
        for r, x, y, name in zip(row.tolist(), a.tolist(), z.tolist(), label):
            if 0 <= x < s.n[r]:
                at = int(s.start[r]) + x
                best[at] = max(best.get(at, (-1, False, "")), (y - x, name is not None, name or ""))
        first = np.array(sorted(best), dtype=np.int64)
        names = {x: i for i, x in enumerate(dict.fromkeys(best[f][2] if best[f][1] else None for f in first.tolist()))}
        code = np.array([names[best[f][2] if best[f][1] else None] for f in first.tolist()], dtype=np.int64)
        last = first + np.array([best[f][0] for f in first.tolist()], dtype=np.int64) - 1
        return _tag_rows(s, by, *packed.biluo(s, first, last, code, list(names)))

    return packed.map_slices(j, step, f"{packed.schema_of(sents, by)}, pos int, word string, tag string")


def _tag_rows(s: packed.Slice, by: list[str], code: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return s.rows(by, pos=pa.array(s.pos), word=s.words.take(pa.array(s.code)), tag=packed.strings(names, code))


def run_tags(s: packed.Slice, pattern: str, label) -> tuple[np.ndarray, list[str]]:
    """(code of each token's BILUO tag, tags) of the runs of words with ``pattern``; ``label(length of the shortest word)`` gives a run its name."""
    first, last, low = _shortest(s, pattern)
    names = {x: i for i, x in enumerate(dict.fromkeys(map(label, low.tolist())))}
    return packed.biluo(s, first, last, np.array([names[label(x)] for x in low.tolist()], dtype=np.int64), list(names))


def run_spans(s: packed.Slice, pattern: str, label) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(row, first, last (exclusive), label) of the same runs."""
    first, last, low = _shortest(s, pattern)
    return s.row[first], s.pos[first], s.pos[last] + 1, [label(x) for x in low.tolist()]


def _shortest(s: packed.Slice, pattern: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flags = s.match(pattern)[s.code]
    first, last = packed.runs(s, flags)
    size = pc.utf8_length(s.words).to_numpy(zero_copy_only=False)[s.code[flags]]
    begin = (np.cumsum(flags) - 1)[first]
    return first, last, np.minimum.reduceat(size, begin) if len(first) else size


def run_spans_of_texts(docs: DataFrame, pattern: str, label: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start, end, label: the character spans of the runs of words with ``pattern``."""

    def run(batches):
        for b in batches:
            for part in (b.slice(x, y - x) for x, y in packed.cuts(packed.sizes_of(b.column(1)), packed.SLICE)):
                row, word, start, length, _, _ = offset_parts(part.column(1))
                flag = packed.matches(word, pattern)
                same = np.concatenate([row[1:] == row[:-1], [False]]) if len(row) else np.zeros(0, bool)
                first = np.flatnonzero(flag & ~np.concatenate([[False], (flag[:-1] & same[:-1])])[: len(flag)])
                last = np.flatnonzero(flag & ~(np.concatenate([flag[1:], [False]]) & same)) if len(row) else first
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row[first])), pa.array(start[first]), pa.array(start[last] + length[last]), pa.array([label] * len(first), pa.string())], names=["key", "start", "end", "label"])

    kind = docs.schema[key].dataType.simpleString()
    pieces = docs.select(F.col(key).alias("key"), tokens_of(F.col(text), PIECES).alias("p"))
    return pieces.mapInArrow(run, f"key {kind}, start int, end int, label string").withColumnRenamed("key", key)


def parse_biluo(tags: Column) -> Column:
    """array<string> -> array<struct<first, last, label>>; illegal sequences are dropped.

    An open span takes I and L of its own label only. Anything else closes it without a span and is itself skipped.
    """
    kind = lambda t: F.substring(t, 1, 1)
    label = lambda t: F.regexp_extract(t, "^[^-]*-([^-]*)", 1)
    zero = F.struct(F.lit(0).alias("i"), F.lit(-1).alias("open"), F.lit("").alias("label"), F.array().cast("array<struct<first:int,last:int,label:string>>").alias("spans"))

    def step(s, t):
        is_open = s["open"] >= 0
        same = is_open & (label(t) == s["label"])
        ends = same & (kind(t) == "L")
        unit = ~is_open & (kind(t) == "U")
        begin = ~is_open & (kind(t) == "B")
        new = F.struct(F.when(unit, s["i"]).otherwise(s["open"]).alias("first"), (s["i"] + 1).alias("last"), label(t).alias("label"))
        stay = same & (kind(t) == "I")
        return F.struct(
            (s["i"] + 1).alias("i"),
            F.when(begin, s["i"]).when(stay, s["open"]).otherwise(-1).alias("open"),
            F.when(begin, label(t)).when(stay, s["label"]).otherwise("").alias("label"),
            F.when(ends | unit, F.concat(s["spans"], F.array(new))).otherwise(s["spans"]).alias("spans"),
        )

    return F.aggregate(tags, zero, step, lambda s: s["spans"])


def without_place(tag: Column) -> Column:
    """B-x and U-x -> x, all else -> O."""
    return F.when(tag.rlike("^[BU]-"), F.substring(tag, F.lit(3), F.length(tag))).otherwise("O")


def runs_of(flags: Column, label) -> Column:
    """array<struct<first, last, label>>: the runs of true flags of a sentence; ``label(first, last)`` gives each its name."""
    kind = "array<struct<first:int,last:int>>"
    zero = F.struct(F.lit(0).alias("i"), F.array().cast(kind).alias("runs"))

    def step(s, f):
        before = F.try_element_at(s["runs"], F.lit(-1))
        goes_on = F.coalesce(before["last"] == s["i"], F.lit(False))
        longer = F.concat(F.slice(s["runs"], F.lit(1), F.greatest(F.size(s["runs"]) - 1, F.lit(0))), F.array(F.struct(before["first"].alias("first"), (s["i"] + 1).alias("last"))))
        new = F.concat(s["runs"], F.array(F.struct(s["i"].alias("first"), (s["i"] + 1).alias("last"))))
        return F.struct((s["i"] + 1).alias("i"), F.when(~F.coalesce(f, F.lit(False)), s["runs"]).when(goes_on, longer).otherwise(new).cast(kind).alias("runs"))

    runs = F.aggregate(flags, zero, step, lambda s: s["runs"])
    return F.transform(runs, lambda r: F.struct(r["first"].alias("first"), r["last"].alias("last"), label(r["first"], r["last"]).alias("label")))


def biluo_tags(n: Column, spans: Column) -> Column:
    """array<string> of n tags for spans (first, last, label) of one sentence, within the row; the first span that covers a token counts."""

    def tag(i, s):
        first, last = i == s["first"], i + 1 == s["last"]
        return F.when(s.isNull(), "O").otherwise(F.concat_ws("-", F.when(first & last, "U").when(first, "B").when(last, "L").otherwise("I"), s["label"]))

    def tags(x):
        one = lambda i: tag(i, F.get(F.filter(x["s"], lambda s: (s["first"] <= i) & (i < s["last"])), F.lit(0)))
        return F.when(x["n"] > 0, F.transform(F.sequence(F.lit(0), x["n"] - 1), one)).otherwise(F.array().cast("array<string>"))

    return let(F.struct(n.alias("n"), spans.alias("s")), tags)


def iob_tags_to_biluo(tags: Column) -> Column:
    """The tags of one sentence, within the row."""
    return let(tags, lambda x: F.transform(x, lambda t, i: iob_to_biluo(t, F.get(x, i + 1))))


def dash_to_o(tag: Column) -> Column:
    return F.when(tag == "-", "O").otherwise(tag)


def iob_to_biluo(tag: Column, following: Column) -> Column:
    """NP tags only, others become O; ``following`` is the next tag of the sentence (null at its end)."""
    clean = lambda t: F.when(F.coalesce(t, F.lit("")).isin("PRT", "LATN", ""), "O").otherwise(t)
    goes_on = clean(following) == "I-NP"
    return F.when(clean(tag) == "B-NP", F.when(goes_on, "B-NP").otherwise("U-NP")).when(clean(tag) == "I-NP", F.when(goes_on, "I-NP").otherwise("L-NP")).otherwise("O")


def iob_rows_to_biluo(rows: DataFrame, by: list[str], tag: str = "iob") -> DataFrame:
    w = Window.partitionBy(*by).orderBy("pos")
    return rows.withColumn("biluo", iob_to_biluo(F.col(tag), F.lead(tag).over(w)))


def biluo_to_iob(tag: Column) -> Column:
    return F.when(tag == "U-NP", "B-NP").when(tag == "L-NP", "I-NP").otherwise(tag)
