"""Helpers that the corpus operators share: scratch tables, worker imports, safe column names."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import os
import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes per Arrow batch: whole texts travel in batches, so a batch must stay small.
ARROW_ROWS, ARROW_BYTES = 512, 16 << 20

_scratch: list[tuple[SparkSession, str]] = []


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package and keep Arrow batches of whole texts small."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def scratch_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Where that is unset a temporary folder is used and set as checkpoint folder, on one machine only, as in tests.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="weftline-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below scratch_dir; removed when the driver's Python ends."""
    if not _scratch:
        atexit.register(drop_scratch)
    path = f"{scratch_dir(spark)}/weftline-{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def drop_scratch() -> None:
    """Delete the scratch tables of sessions that are still alive."""
    while _scratch:
        spark, path = _scratch.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session has ended, its folder goes with it
            continue


#: Writer options for rows of megabytes: readers and writers hold a row group at once, so it has few rows.
LARGE_ROWS = {"parquet.block.row.count.limit": "4"}


def stored(df: DataFrame, name: str, few: int = 0, **options: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors.

    few: one file for so many shuffle partitions, for tables that are small beside the corpus; never fewer files than cores. options: of the writer.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (in_files(df, few) if few else df).write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_files(df: DataFrame, few: int) -> DataFrame:
    """A shuffled df in one partition for `few` shuffle partitions; never fewer than cores."""
    spark = df.sparkSession
    return df.coalesce(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // few))


def in_splits(df: DataFrame, source: DataFrame) -> DataFrame:
    """df, made from source without a shuffle, in as many partitions as source's bytes fill whole input splits; at least two a core."""
    spark = df.sparkSession
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.coalesce(min(max(2 * spark.sparkContext.defaultParallelism, -(-size // max(1, split))), 1_000_000))


def trim() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if (give_back := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        give_back(0)


def lean(step, *held):
    """A function over a task's Arrow batches that gives freed memory back when the task ends: workers live on between tasks.

    held: broadcasts, whose values are read again from the executor's file by the next task, and caches, which are cleared.
    """

    @functools.wraps(step)
    def run(batches):
        try:
            yield from step(batches)
        finally:
            for x in held:
                if isinstance(x, Broadcast):
                    x.__dict__.pop("_value", None)
                else:
                    x.clear()
            trim()

    return run


def need(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Exactly these columns, cast; columns that a table lacks are null. Others are left out, so names can't clash."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()])


def join_counted(rows: DataFrame, counts: DataFrame, *key: str, n: str = "n", most: int = 1000, how: str = "inner") -> DataFrame:
    """rows and the columns of counts (a stored table, one row per key; n: how often a key occurs) by key, for keys that may be hot. how: inner or left.

    Keys with at least one in `most` of all occurrences, of which there are no more than `most`, are broadcast: their rows stay where they are.
    """
    total = counts.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) * most >= total
    near = F.broadcast(counts.where(hot))
    far = rows.join(near.select(*key), [*key], "left_anti").join(counts.where(~hot), [*key], how)
    return rows.join(near, [*key]).unionByName(far)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, mod: int):
    """crc32 of the column's text, modulo mod."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(mod))


def key_hash(*columns: str):
    """A row's 64-bit identity over these columns; nulls count."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in columns])


def blocks(rows: Iterable, size: int):
    """Lists of at most size items."""
    out = []
    for x in rows:
        out.append(x)
        if len(out) == size:
            yield out
            out = []
    if out:
        yield out
