"""Cutting lineage through the shared folder, and fixed-size bitmaps of hashes."""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

_WRITTEN: list[tuple[SparkSession, str]] = []
#: Spark's own switch to remove an execution's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and read it again: lost executors cost no recomputation
    of what lies before.  Its shuffle files go when it is written; the table goes when the program ends, or with settle()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/geoloom-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    _WRITTEN.append((spark, path))
    # Executors hold a finished execution's broadcasts until the driver collects garbage, and no public call frees them: it is asked to
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def settle(make: Callable[[], DataFrame]) -> DataFrame:
    """cut() what `make` plans, and delete the tables that were written on the way to it."""
    before = len(_WRITTEN)
    out = cut(make())
    kept = _WRITTEN.pop()
    while len(_WRITTEN) > before:
        _delete(*_WRITTEN.pop())
    _WRITTEN.append(kept)
    return out


#: Rows of one or two numbers that may be broadcast (16 MB at most).
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """A written table of one or two numbers a row, marked for broadcast if it has few rows; else joined as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_written() -> None:
    """Delete the tables cut() wrote.  Only for when no result built on them is still to be read."""
    while _WRITTEN:
        try:
            _delete(*_WRITTEN.pop())
        except Exception:  # the session has ended; the folder is then the cluster's to clean
            return


atexit.register(drop_written)


def bitmap(df: DataFrame, name: str, bits: int = 24) -> np.ndarray:
    """2**bits bits, set where the low bits of a hash in df[name] point.  Its size (2 MB at 24 bits) does not
    depend on the data; with more hashes it only lets more false positives through."""
    word = F.shiftrightunsigned(F.col(name), 6).bitwiseAND(F.lit((1 << (bits - 6)) - 1)).cast("int").alias("w")
    bit = F.expr(f"shiftleft(1L, cast({name} & 63 as int))").alias("b")
    rows = df.select(word, bit).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def hit(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    h = hashes.view(np.uint64)
    return ((bits[(h >> np.uint64(6)) & np.uint64(len(bits) - 1)] >> (h & np.uint64(63))) & np.uint64(1)).astype(bool)
