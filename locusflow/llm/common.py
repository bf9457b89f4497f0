"""Shared folder, written intermediate tables and id filters of checked size for the text operators."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as all operators here see them are separated by these code points only.
SPACE = r"[\x20\x09-\x0D]+"
#: Most bits of an id filter that is broadcast: two million words of 64, for 8 million ids.
FILTER_BITS = 27


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where all run on one machine and it is unset, a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="locusflow-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


_MADE: list[list[str]] = []
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, name: str, rows: int = 1000, by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it again: later steps neither recompute it nor depend on one executor.

    by: a column by whose values the table is divided, so that a filter on it reads only its share. Meanwhile no more than so many rows go to a Python worker at once, since their texts may be long.
    """
    spark = df.sparkSession
    path, batch = new_path(spark, name), spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, min(int(batch), rows))
    try:
        out = df.write.option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(path)
    finally:
        spark.conf.set(_BATCH, batch)
    for scope in _MADE:
        scope.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def deleted(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def dropped(*frames: DataFrame) -> None:
    """Delete tables made by written() which nothing that is still to run reads."""
    for df in frames:
        deleted(df.sparkSession, [df.written_at])


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """Tables made by written() meanwhile are deleted at the end, but for those taken out of the list."""
    made: list[str] = []
    _MADE.append(made)
    try:
        yield made
    finally:
        _MADE.remove(made)
    deleted(spark, made)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after which a Python worker gives the memory it no longer uses back to the system. Unlike trimmed(), arrays are reused meanwhile, which
    is faster where there are many of middling size."""

    @functools.wraps(run)
    def tidy(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return tidy


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, whose Python worker gives memory back to the system when it no longer uses it, for other workers and the JVM.

    Arrow takes its memory from the C library, which with glibc maps all larger blocks by themselves and is trimmed at the end.
    """

    @functools.wraps(run)
    def tidy(batches: Iterator) -> Iterator:
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):
            pa.set_memory_pool(pa.system_memory_pool())
            libc.mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return tidy


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_filter(ids: DataFrame, id_col: str) -> tuple[DataFrame, int] | None:
    """Rows (__w, __b) of a bitmap over hashes of ids, about 16 bits an id, and its bits as a power of two; None if that is above FILTER_BITS."""
    n = ids.count()
    bits = max(10, (16 * n).bit_length())
    if bits > FILTER_BITS:
        return None
    h = F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(1 << bits))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))
    return ids.where(F.col(id_col).isNotNull()).groupBy(F.shiftright(h, 6).alias("__w")).agg(F.bit_or(one).alias("__b")), bits


def maybe_in(df: DataFrame, col: str, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of df whose integer col may be among ids: all that are, and about one in 16 of the others; all rows where ids are too
    many for a filter of bounded size. It only saves shuffling: an exact join must follow. Columns of df may have any names."""
    made = id_filter(ids, id_col)
    return df if made is None else _tested(df, col, *made).where(F.coalesce("in", F.lit(False))).select("row.*")


def split_by(df: DataFrame, col: str, ids: DataFrame, id_col: str) -> tuple[DataFrame | None, DataFrame]:
    """(rows whose col is surely not among ids, rows for which an exact join must tell). Null is left to the join."""
    made = id_filter(ids, id_col)
    if made is None:
        return None, df
    tested = _tested(df, col, *made)
    out = F.col("in").eqNullSafe(False)
    return tested.where(out).select("row.*"), tested.where(~out).select("row.*")


def _tested(df: DataFrame, col: str, made: DataFrame, bits: int) -> DataFrame:
    """row, a struct of df's columns, and in: whether col may be in the filter, null where col is null."""
    h = F.pmod(F.xxhash64(F.col(col).cast("long")), F.lit(1 << bits))
    met = df.select(F.struct("*").alias("row"), F.col(col).isNotNull().alias("given"), h.alias("h")).withColumn("__w", F.shiftright("h", 6)).join(F.broadcast(made), "__w", "left")
    bit = F.call_function("getbit", F.col("__b"), F.pmod(F.col("h"), F.lit(64)).cast("int")) == 1
    return met.select("row", F.when(F.col("given"), F.coalesce(bit, F.lit(False))).alias("in"))
