"""Tables that cut lineage, and dense numbering without a single task."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 << 20
_LOCAL: list[str] = []
_USED: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, in one of the application's own.

    Where a session in local mode (as in tests) names none, a temporary one stands in; on a cluster that is an error, as each
    executor would write to a disk of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="corpusmill-"))
            atexit.register(shutil.rmtree, _LOCAL[0][7:], ignore_errors=True)
        base = _LOCAL[0]
    own = f"{base.rstrip('/')}/corpusmill-{spark.sparkContext.applicationId}"
    _USED[own] = spark
    return f"{own}/table-{uuid.uuid4().hex}"


def release() -> None:
    """Deletes the intermediate tables of this application; results that read them must be written or collected before."""
    for own, spark in list(_USED.items()):
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        del _USED[own]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later reads survive lost executors and recompute nothing."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured(df: DataFrame) -> int:
    """Bytes of the values of ``df`` (already written, so that this is cheap), with 16 for each value."""
    size = F.lit(0).cast("long")
    for f in df.schema:
        text = F.col(f.name) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.to_json(F.struct(f.name)) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.lit("")
        size = size + F.coalesce(F.sum(F.octet_length(text)), F.lit(0)) + F.count("*") * F.lit(16)
    return df.agg(size.alias("n")).first()["n"]


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (already written) with a broadcast hint if its measured bytes fit in ``limit``."""
    return F.broadcast(df) if measured(df) <= limit else df


Step = Callable[[DataFrame], DataFrame]


def dense_ids(df: DataFrame, order: list[Column | str], name: str, start: int = 0, rows: Step | None = None, inner: list[Column | str] | None = None, after: Step | None = None) -> DataFrame:
    """``df`` with ``name`` = start + rank in ``order``: sorted ranges are numbered apart and shifted by the counts before them.

    The window runs over one row for each range, not over the rows. ``rows`` makes the rows that are numbered, in the order ``inner``, out of
    those that are dealt; ``after`` adds columns to them once they are sorted: what is dealt and sorted stays small.
    """
    low = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(*order)
    ranged = (rows(dealt) if rows else dealt).sortWithinPartitions(*(inner or order))
    ranged = cut((after(ranged) if after else ranged).withColumn("__p", F.spark_partition_id()).withColumn("__i", low % (1 << 33)))
    shift = ranged.groupBy("__p").agg(F.count("*").alias("__n")).selectExpr("__p", "coalesce(sum(__n) over (order by __p rows between unbounded preceding and 1 preceding), 0) as __before")
    return ranged.join(F.broadcast(shift), "__p").withColumn(name, F.col("__i") + F.col("__before") + F.lit(start)).drop("__p", "__i", "__before")
