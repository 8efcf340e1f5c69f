"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import BROADCAST_BYTES, measured, shared_folder

def materialize(df: DataFrame, compression: str = "zstd", packed: str = "") -> DataFrame:
    """Cut lineage with a written table in the shared folder; its readers survive lost executors.

    ``packed``: a binary column that is dense already, for which a dictionary would be tried in vain.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    w = df.write.option("compression", compression)
    (w.option(f"parquet.enable.dictionary#{packed}", "false") if packed else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    """The session's shuffle width, which its owner sizes with the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


class Memo(dict):
    """word -> value, computed once per worker; emptied beyond ``limit`` words so that memory stays bounded."""

    def __init__(self, fn, limit: int = 1_000_000):
        super().__init__()
        self.fn, self.limit = fn, limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        v = self[word] = self.fn(word)
        return v


def h64(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass"))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Bijective 64-bit mixing (splitmix finalizer), vectorised."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def fits(df: DataFrame, limit_bytes: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` (already written, so that measuring is cheap) may be broadcast: the bytes of its values are counted."""
    return measured(df) <= limit_bytes


def drop_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose key is in ``ids`` (materialised): broadcast behind a size check, else shuffled.

    Rows with a null key stay.
    """
    ids = ids.select(F.col(ids.columns[0]).alias("__drop"))
    if fits(ids):
        ids = F.broadcast(ids)
    return docs.join(ids, docs[key] == ids["__drop"], "left_anti")
