"""Value codes, hash buckets, deduplication by content, and encoded, padded batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hash_bucket, record_id
from ..plans.storage import dense_ids


def value_codes(df: DataFrame, column: str) -> DataFrame:
    """value, code: 0.. in sorted order; null is no value."""
    return dense_ids(df.select(F.col(column).alias("value")).where("value is not null").distinct(), ["value"], "code")


def first_seen_codes(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """value, code: 0.. in order of first occurrence."""
    first = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(F.struct(*order)).alias("first"))
    return dense_ids(first, ["first"], "code").select("value", "code")


def encode_values(df: DataFrame, codes: DataFrame, column: str, name: str = "code", default: int | None = None) -> DataFrame:
    """df with the code of a column; unknown values get ``default``."""
    c = codes.select(F.col("value").alias("__v"), F.col("code").alias("__c"))
    return df.join(c, F.col(column) == F.col("__v"), "left").withColumn(name, F.coalesce("__c", F.lit(default).cast("long"))).drop("__v", "__c")


def decode_values(df: DataFrame, codes: DataFrame, column: str = "code", name: str = "value") -> DataFrame:
    c = codes.select(F.col("value").alias("__v"), F.col("code").alias("__c"))
    return df.join(c, F.col(column) == F.col("__c"), "left").withColumn(name, F.col("__v")).drop("__v", "__c")


def hashed_value(value: Column, buckets: int) -> Column:
    """Bucket 0 .. buckets - 2; the last one is left for padding."""
    return hash_bucket(value, max(buckets - 1, 1))


def shifted_code(tag: Column, code: Column) -> Column:
    """O is 0, other codes are moved up by one."""
    return F.when(tag == "O", F.lit(0)).otherwise(code + 1)


def o_mask(tag: Column) -> Column:
    return tag == "O"


def affix_buckets(word: Column, buckets: int = 2000, n: int = 3) -> tuple[Column, Column]:
    return hash_bucket(F.substring(word, 1, n), buckets), hash_bucket(F.right(word, F.lit(n)), buckets)


def dedup_by_content(df: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """The first row in ``order`` of each text, with record_id; null texts are one text. A min-by aggregate, combined before the shuffle.

    Texts are told apart by the whole of a 256-bit digest; record_id, 60 bits of another one, is only shown.
    """
    rest = [c for c in df.columns]
    first = df.select(F.sha2(text, 256).alias("k"), record_id(F.col(text)).alias("record_id"), F.struct(*rest).alias("r"))
    return first.groupBy("k").agg(F.first("record_id").alias("record_id"), F.min_by("r", F.col(f"r.{order}")).alias("r")).select("record_id", "r.*")


def new_records(df: DataFrame, seen: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """Incremental work: rows as dedup_by_content gives them whose text is not among the texts of ``seen`` (text or digest column ``k``)."""
    old = seen.select(F.col("k") if "k" in seen.columns else F.sha2(text, 256).alias("k")).distinct()
    fresh = dedup_by_content(df, text, order).withColumn("__k", F.sha2(text, 256))
    return fresh.join(old, fresh["__k"].eqNullSafe(old["k"]), "left_anti").drop("__k")


def union_values(codes: DataFrame, df: DataFrame, column: str) -> DataFrame:
    """value, code: the values of an earlier run keep their codes, new ones follow in sorted order."""
    size = codes.agg(F.coalesce(F.max("code") + 1, F.lit(0)).alias("n")).first()["n"]
    new = df.select(F.col(column).alias("value")).where("value is not null").distinct().join(codes.select("value"), "value", "left_anti")
    return codes.select("value", "code").union(dense_ids(new, ["value"], "code", size))


def pad(values: Column, width: Column | int, with_: int) -> Column:
    """Cut or filled to ``width``."""
    w = F.lit(width) if isinstance(width, int) else width
    return F.slice(F.concat(values, F.array_repeat(F.lit(with_).cast("long"), F.greatest(w - F.size(values), F.lit(0)))), 1, w)


def mask(n: Column, width: Column) -> Column:
    return F.when(width > 0, F.transform(F.sequence(F.lit(1), width), lambda i: i <= n)).otherwise(F.array().cast("array<boolean>"))


def length_batches(df: DataFrame, size: int, max_len: int | None = None, length: str = "n_tokens", key: str = "doc_id", by_length: bool = True) -> DataFrame:
    """df with batch: rows shorter than ``max_len`` in order of length (or key), ``size`` to a batch, the last one short."""
    rows = df if max_len is None else df.where(F.col(length) < max_len)
    return dense_ids(rows, [length, key] if by_length else [key], "__row").withColumn("batch", F.expr(f"__row div {size}")).drop("__row")


def pad_batches(rows: DataFrame, ids: str = "ids", pad_id: int = 1, max_len: int | None = None) -> DataFrame:
    """rows (batch, ids) with ids padded to the longest of the batch, at most ``max_len``, and mask."""
    n = F.size(ids)
    width = rows.groupBy("batch").agg(F.max(n).alias("__width"))
    if max_len is not None:
        width = width.withColumn("__width", F.least("__width", F.lit(max_len)))
    j = rows.join(width, "batch")
    return j.withColumn("mask", mask(n, F.col("__width"))).withColumn(ids, pad(F.col(ids), F.col("__width"), pad_id)).drop("__width")


def batch_count(df: DataFrame, size: int, max_len: int | None = None, length: str = "n_tokens") -> DataFrame:
    rows = df if max_len is None else df.where(F.col(length) < max_len)
    return rows.agg(F.ceil(F.count("*") / F.lit(size)).cast("long").alias("n_batches"))


def shuffled(df: DataFrame, seed: int, key: str = "doc_id") -> DataFrame:
    """A pseudorandom order that depends on seed and key only, by a range-partitioned sort."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)


def embedding_lookup(ids: DataFrame, vectors: DataFrame, dim: int, id_: str = "idx", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """ids with vector: index 0 and unknown ones are zero, index i is vector i - 1."""
    v = vectors.select((F.col(key) + 1).alias("__i"), F.col(vector).alias("__v"))
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return ids.join(v, F.col(id_) == F.col("__i"), "left").withColumn("vector", F.coalesce("__v", zero)).drop("__i", "__v")
