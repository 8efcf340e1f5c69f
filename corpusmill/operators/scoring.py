"""Precision, recall and F1 out of counts; averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-8


def prf1(df: DataFrame, truth: Column, guess: Column, mask: Column | None = None, by: list[str] | None = None, eps: float = EPS) -> DataFrame:
    """by, tp, fp, fn, precision, recall, f1 of boolean columns; rows outside ``mask`` don't count, nulls are false."""
    t, g = F.coalesce(truth, F.lit(False)), F.coalesce(guess, F.lit(False))
    rows = (df if mask is None else df.where(mask)).select(*(by or []), t.alias("t"), g.alias("g"))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    c = rows.groupBy(*(by or [])).agg(n(F.col("t") & F.col("g")).alias("tp"), n(~F.col("t") & F.col("g")).alias("fp"), n(F.col("t") & ~F.col("g")).alias("fn"))
    c = c.withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp") + eps)).withColumn("recall", F.col("tp") / (F.col("tp") + F.col("fn") + eps))
    return c.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + eps))


def mean_scores(df: DataFrame, columns: list[str], by: list[str] | None = None, mask: Column | None = None) -> DataFrame:
    rows = df if mask is None else df.where(mask)
    return rows.groupBy(*(by or [])).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])
