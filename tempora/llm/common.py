"""What several of these operators need: shared tables, name-safe columns, bounded chunks of text."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; where that is unset, a local one in a local session and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='tempora-')}"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path for it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage and survives lost executors.

    The table is there as long as the application runs, or until it is discarded.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, at = file_system(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no plan will read again."""
    for t in tables:
        fs, at = file_system(t.sparkSession, t.stored_at)
        fs.delete(at, True)


def lower_ascii(text: Column) -> Column:
    """A-Z only, so that every engine agrees."""
    return F.translate(text, UPPER, LOWER)


def packed(df: DataFrame, name: str = "row") -> Column:
    """All columns of ``df`` as one struct: no name of the input can clash with a name used inside an operator."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def chunks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges whose sizes sum to at most ``most`` (one larger row stands alone)."""
    first, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and total + n > most:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def give_back() -> None:
    """Return the memory that a Python worker has freed to the system: idle workers stay beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply) over uint64."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bounded_sample(rows: DataFrame, most: int) -> pa.Table:
    """At most ``most`` distinct rows, those with the smallest hashes of about twice as many that pass a hash cut.

    The cut keeps what reaches the driver near 2 * ``most`` rows, however many tasks there are.  If it leaves too
    few, there are few distinct rows, and the smallest hashes of all are taken.
    """
    cut = min(1 << 32, (1 << 32) * 2 * most // max(1, rows.count()) + 1)
    hashed = rows.withColumn("__h", F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 32)))

    def smallest(some: DataFrame) -> pa.Table:
        return some.distinct().orderBy("__h", *rows.columns).limit(most).drop("__h").toArrow()

    drawn = smallest(hashed.where(F.col("__h") < cut))
    return drawn if len(drawn) == most or cut == 1 << 32 else smallest(hashed)
