"""Fields of records as codes: labelled tokens, mappers from fields to encoded fields, one text at a time, and a signature of settings."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import let
from ..plans.storage import BROADCAST_BYTES, cut, measured
from .encode import encode_values
from .spans import biluo_tags
from .tokens import offset_arrays

ENTS = "array<struct<start:int,end:int,label:string>>"


@dataclass(frozen=True)
class MapperSpec:
    """``field`` of a record becomes ``target``: its elements' codes (kind seq), its own code (item), or what a function of its column gives.

    codes: a table (value, code); values it lacks get ``default``. ``preproc`` is applied to each element or value first.
    """

    field: str
    target: str
    codes: DataFrame | None = None
    kind: str | Callable[[Column], Column] = "seq"
    default: int | None = None
    preproc: Callable[[Column], Column] | None = None
    dtype: str = "int"


def word_mapper(codes: DataFrame, size: int, field: str = "tokens", target: str = "tok_ids") -> MapperSpec:
    """Unknown words get the size of the word map, which is the padding too."""
    return MapperSpec(field, target, codes, default=size)


def tag_mapper(codes: DataFrame, field: str = "tags", target: str = "tags") -> MapperSpec:
    """Unknown tags, and padding, are O."""
    row = codes.where(F.col("value") == "O").first()
    return MapperSpec(field, target, codes, default=None if row is None else row["code"])


def apply_mappers(records: DataFrame, specs: list[MapperSpec]) -> DataFrame:
    """records with the targets of all mappers whose field they have. A target may have the name of its field.

    Code tables that fit in ``BROADCAST_BYTES`` are sent to the rows; larger ones are joined with the elements, which are numbered
    by row for that.
    """
    out, done = records, {}
    for k, s in enumerate(specs):
        if s.field not in records.columns:
            continue
        name, pre = f"__m{k}", s.preproc or (lambda x: x)
        done[s.target] = name
        if callable(s.kind):
            out = out.withColumn(name, s.kind(pre(F.col(s.field))).cast(s.dtype))
            continue
        if s.kind not in ("seq", "item") or s.codes is None:
            raise ValueError("kind must be seq or item, with codes, or a function")
        codes = cut(s.codes.select("value", "code"))
        if s.kind == "item":
            v = f"__v{k}"
            out = encode_values(out.withColumn(v, pre(F.col(s.field))), codes, v, name, s.default).withColumn(name, F.col(name).cast(s.dtype)).drop(v)
        elif measured(codes) <= BROADCAST_BYTES:
            v = f"__v{k}"
            out = _look_up(out.withColumn(v, F.transform(s.field, pre)), codes, s, v, name)
        else:
            numbered = cut(out.withColumn("__row", F.monotonically_increasing_id()))
            e = numbered.select("__row", F.posexplode(F.transform(s.field, pre)).alias("__p", "__e"))
            got = encode_values(e, codes, "__e", "__code", s.default).groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("__p", F.col("__code").cast(s.dtype).alias("c")))).alias("__l"))
            got = got.select(F.col("__row").alias("__r"), F.transform("__l", lambda x: x["c"]).alias(name))
            none = F.when(F.col(s.field).isNotNull(), F.array().cast(f"array<{s.dtype}>"))
            out = numbered.join(got, numbered["__row"] == got["__r"], "left").withColumn(name, F.coalesce(name, none)).drop("__row", "__r")
    plain = [c for c in out.columns if c not in done and c not in done.values()]
    return out.select(*plain, *[F.col(n).alias(t) for t, n in done.items()])


def _look_up(records: DataFrame, codes: DataFrame, s: MapperSpec, column: str, name: str) -> DataFrame:
    """records with ``name`` in place of ``column``, an array of values; an Arrow step of its own, as Catalyst inlines arguments of UDFs."""
    shared, default = codes.sparkSession.sparkContext.broadcast({r["value"]: r["code"] for r in codes.toLocalIterator()}), s.default
    kept = [f for f in records.schema.fields if f.name != column]
    wanted = to_arrow_type(T.DataType.fromDDL(s.dtype))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(column)
            e = values.flatten().dictionary_encode(null_encoding="encode")
            got = pa.array([shared.value.get(w, default) for w in e.dictionary.to_pylist()], type=wanted).take(e.indices)
            ends = np.cumsum(values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            coded = pa.ListArray.from_arrays(offsets, got, mask=values.is_null())
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + [coded], names=[*names, name])

    names = [f.name for f in kept]
    return records.mapInArrow(run, T.StructType([*kept, T.StructField(name, T.ArrayType(T.DataType.fromDDL(s.dtype)))]))


def labelled_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", ents: str = "ents") -> DataFrame:
    """docs with tokens, tags (BILUO, of the spans whose ends are those of tokens) and n_tokens, made within the row."""
    t = offset_arrays(docs, key, text)
    spans = docs.select(F.col(key).alias("__k"), *[F.col(c) for c in docs.columns if c != key])
    j = spans.join(t, spans["__k"] == t[key], "left").drop("__k")
    sides = F.struct(F.transform("t", lambda x: x["start"]).alias("a"), F.transform("t", lambda x: x["start"] + x["length"]).alias("z"))
    place = lambda x, e: F.struct((F.array_position(x["a"], e["start"]) - 1).alias("first"), F.array_position(x["z"], e["end"]).alias("last"), e["label"].alias("label"))
    places = let(sides, lambda x: F.transform(F.coalesce(F.col(ents), F.array().cast(ENTS)), lambda e: place(x, e)))
    found = F.filter(places, lambda s: (s["first"] >= 0) & (s["last"] > s["first"]))
    none = F.array().cast("array<string>")
    words = F.coalesce(F.transform("t", lambda x: x["text"]), none)
    return j.withColumn("tokens", words).withColumn("tags", F.coalesce(biluo_tags(F.size("tokens"), found), none)).withColumn("n_tokens", F.size("tokens")).drop("t")


def annotate(spark: SparkSession, text: str, ents: list[tuple[int, int, str]] = (), specs: list[MapperSpec] = ()) -> DataFrame:
    """One text, cut into tokens, tagged and encoded."""
    one = spark.createDataFrame([(0, text, [tuple(e) for e in ents])], f"doc_id long, text string, ents {ENTS}")
    return apply_mappers(labelled_tokens(one), list(specs))


def signature(settings: dict) -> int:
    """A number of 60 bits that settings of the same content share, by which what was made with them may be kept."""
    return int(hashlib.md5(json.dumps(settings, sort_keys=True).encode()).hexdigest(), 16) % 2**60
