"""Generic map and reduce: a built-in aggregate where there is one, else Arrow batches and an associative fold."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 64


def map_reduce(df: DataFrame, key: Column, value: Column, reduce: Callable[[Column], Column]) -> DataFrame:
    """key, value with a built-in aggregate, such as F.sum. Null keys are dropped."""
    return df.select(key.alias("key"), value.alias("value")).where("key is not null").groupBy("key").agg(reduce(F.col("value")).alias("value"))


def map_fold(df: DataFrame, map_fn: Callable[[dict], Iterable[tuple]], reduce_fn: Callable, schema: str) -> DataFrame:
    """key, value with Python functions: ``map_fn(row)`` yields pairs, ``reduce_fn(acc or None, value)`` folds them.

    The fold must be associative: it runs in each batch first, then over the partial results of a key. ``schema`` is that
    of (key, value).
    """
    names = [c.strip().split()[0] for c in schema.split(",", 1)]

    def fold(pairs):
        acc: dict = {}
        for k, v in pairs:
            if k is not None:
                acc[k] = reduce_fn(acc.get(k), v)
        return acc

    def frame(keys, values):  # objects, so that no key or value changes its type, nor does an empty batch
        return pd.DataFrame({names[0]: pd.Series(list(keys), dtype=object), names[1]: pd.Series(list(values), dtype=object)})

    def partial(batches):
        for b in batches:
            rows = (dict(zip(b.columns, r)) for r in zip(*(b[c].tolist() for c in b.columns)))
            acc = fold(p for row in rows for p in map_fn(row))
            yield frame(acc.keys(), acc.values())

    def final(keys, pdf):
        acc = None
        for v in pdf[names[1]].tolist():
            acc = reduce_fn(acc, v)
        return frame([keys[0]], [acc])

    # a hot key's partial results are folded in SALTS parts before they meet
    part = df.mapInPandas(partial, schema).withColumn("__salt", F.spark_partition_id() % SALTS)
    once = part.groupBy(names[0], "__salt").applyInPandas(final, schema)
    return once.groupBy(names[0]).applyInPandas(final, schema)
