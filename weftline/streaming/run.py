"""Running streams: to their end or on and on, with supervision; scratch folders; checkpoint tables."""

from __future__ import annotations

import hashlib
import tempfile
import time
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import schema

T = TypeVar("T")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder. Only on one machine, as in tests, a temporary one may stand in where none is set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-"))
        at = spark.sparkContext.getCheckpointDir()
    return f"{at.rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"


def read_table_stream(spark: SparkSession, sf_dir: str, name: str, files: int | None = None) -> DataFrame:
    """A table's Parquet files as a stream: single files by pattern, folders as they are."""
    table_schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(table_schema).option("pathGlobFilter", "*.parquet")
    if files:
        reader = reader.option("maxFilesPerTrigger", str(files))
    return reader.parquet(f"{sf_dir}/{name}*.parquet")


def run_to_end(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", timeout_s: int = 600) -> list[str]:
    """Run until everything there is at the start has been handled; raise what made it fail. Returns the sources' positions, as JSON."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).outputMode(mode)
    return _await(writer.trigger(availableNow=True).start(), timeout_s)


def for_each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, timeout_s: int = 600, mode: str = "append") -> list[str]:
    """As run_to_end, with a function that is called with each micro-batch; in complete mode with the whole result of an aggregate."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint)
    return _await(writer.trigger(availableNow=True).start(), timeout_s)


def _await(q: StreamingQuery, timeout_s: int) -> list[str]:
    if not q.awaitTermination(timeout_s):
        q.stop()
        raise TimeoutError(f"not caught up after {timeout_s} s: {q.lastProgress}")
    return positions(q)


def positions(q: StreamingQuery) -> list[str]:
    """Where each source of the query's last micro-batch with rows ended, as JSON; none before the first."""
    done = [p for p in q.recentProgress if p["numInputRows"]]
    return [s["endOffset"] for s in done[-1]["sources"]] if done else []


def retry(step: Callable[[], T], wait_s: Callable[[int], float] = lambda k: min(30.0, 0.1 * 2**k), timeout_s: float = 60.0) -> T:
    """Call step until it succeeds, with growing waits; after timeout_s its error is raised."""
    until, k = time.monotonic() + timeout_s, 0
    while True:
        try:
            return step()
        except Exception:
            if time.monotonic() + wait_s(k) > until:
                raise
            time.sleep(wait_s(k))
            k += 1


class Tail:
    """A stream that goes on behind its tail: a micro-batch every interval_s; a failed query is started again from its checkpoint after a wait.

    handle gets each micro-batch. A micro-batch's wait grows with the failures that followed each other; with more than max_failures of them the
    error ends the tail. supervise() does what is due and says whether the tail is alive; await_caught_up() and wait() call it meanwhile.
    """

    def __init__(self, stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, interval_s: float = 1.0, wait_s: Callable[[int], float] = lambda k: min(30.0, 2.0**k), max_failures: int = 10):
        self.stream, self.handle, self.checkpoint, self.interval_s = stream, handle, checkpoint, interval_s
        self.wait_s, self.max_failures, self.failures, self.stopped = wait_s, max_failures, 0, False
        self._due: float | None = None
        self.query = self._start()

    def _start(self) -> StreamingQuery:
        writer = self.stream.writeStream.foreachBatch(self.handle).option("checkpointLocation", self.checkpoint)
        return writer.trigger(processingTime=f"{int(self.interval_s * 1000)} milliseconds").start()

    def supervise(self) -> bool:
        if self.stopped:
            return False
        if self.query.isActive:
            if self.failures and self.query.lastProgress:
                self.failures = 0
            return True
        if self._due is None:
            if self.failures >= self.max_failures:
                self.stopped = True
                raise self.query.exception() or RuntimeError("the query ended by itself")
            self._due = time.monotonic() + self.wait_s(self.failures)
            self.failures += 1
        elif time.monotonic() >= self._due:
            self._due, self.query = None, self._start()
        return True

    def await_caught_up(self, timeout_s: float = 60.0, fully: bool = False, linger_s: float = 0.0) -> list[str]:
        """Wait until all that was there at the call is handled; fully: until a micro-batch finds nothing new. Then stay for linger_s. Returns the positions."""
        until = time.monotonic() + timeout_s
        while time.monotonic() < until:
            if not self.supervise():
                raise RuntimeError("the tail has been stopped")
            if self.query.isActive:
                try:
                    self.query.processAllAvailable()
                except Exception:  # noqa: BLE001 - supervise() deals with a failed query
                    continue
                status = self.query.status
                if not fully or not (status["isDataAvailable"] or status["isTriggerActive"]):
                    time.sleep(linger_s)
                    return positions(self.query)
            time.sleep(0.05)
        raise TimeoutError(f"not caught up after {timeout_s} s: {self.query.lastProgress}")

    def wait(self, timeout_s: float) -> bool:
        """Supervise for so long. Whether the tail is still alive."""
        until = time.monotonic() + timeout_s
        while time.monotonic() < until:
            if not self.supervise():
                return False
            time.sleep(min(0.05, self.interval_s))
        return True

    def stop(self) -> None:
        self.stopped = True
        self.query.stop()

    def __enter__(self) -> Tail:
        return self

    def __exit__(self, *_) -> None:
        self.stop()


class CheckpointTable:
    """Positions per (source, tranche, group) as an append-only table of Parquet folders; what was written last counts.

    commit is idempotent by writer and batch id: a folder for each, by the sources and groups in it, written anew when the batch is repeated. Rows are ordered by
    seq, microseconds of the clock, but always beyond all that this object has read or written. compact() folds the table into one row a key.
    """

    COLUMNS = "source string, tranche string, consumer_group string, position long, at timestamp, seq long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._last = spark, path, None

    def _next(self) -> int:
        if self._last is None:
            self._last = self._rows().agg(F.max("seq")).first()[0] or 0
        self._last = max(self._last + 1, time.time_ns() // 1000)
        return self._last

    def commit(self, rows: DataFrame, batch_id: int, writer: str = "") -> None:
        """rows: source, tranche, consumer_group, position. writer: what batch ids count for, such as the query's checkpoint folder."""
        key = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source", "consumer_group")]
        out = rows.select(
            "source", "tranche", "consumer_group", F.col("position").cast("long"), F.current_timestamp().alias("at"), F.lit(self._next()).alias("seq")
        )
        parts = out.withColumn("of", F.md5(F.concat_ws("\x00", *key))).withColumn(
            "writer", F.lit(hashlib.md5(writer.encode()).hexdigest())
        ).withColumn("batch", F.lit(batch_id))
        parts.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("of", "writer", "batch").parquet(self.path)

    def override(self, source: str, tranche: str, group: str, position: int) -> None:
        rows = self.spark.createDataFrame([(source, tranche, group, position)], "source string, tranche string, consumer_group string, position long")
        self.commit(rows, self._next(), "override")

    def _rows(self) -> DataFrame:
        kind = schema(self.COLUMNS)
        try:
            return self.spark.read.schema(kind).option("recursiveFileLookup", "true").parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], kind)
            raise

    def positions(self) -> DataFrame:
        return self._rows().groupBy("source", "tranche", "consumer_group").agg(F.max_by("position", "seq").alias("position"))

    def history(self) -> DataFrame:
        """All that is stored, in the order of writing; legacy series read it."""
        return self._rows().orderBy("seq", "source", "tranche")

    def start(self, source: str, tranche: str, group: str, origin: Callable[[], int] | None = None) -> int:
        """The stored position, else the origin's, else 0."""
        row = self.positions().where((F.col("source") == source) & (F.col("tranche") == tranche) & (F.col("consumer_group") == group)).first()
        return row["position"] if row else origin() if origin else 0

    def compact(self) -> None:
        """One row a key: a snapshot with the rows' own seq is written first, then the folders that it covers go. Readers meanwhile see rows twice at most."""
        fs_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        root = fs_path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        old = [str(s.getPath()) for s in fs.listStatus(root) if s.isDirectory()] if fs.exists(root) else []
        last = self._rows().groupBy("source", "tranche", "consumer_group").agg(F.max_by(F.struct("position", "at", "seq"), "seq").alias("x"))
        rows = last.select("source", "tranche", "consumer_group", "x.*")
        rows.coalesce(1).write.mode("append").parquet(f"{self.path}/snapshot={uuid.uuid4().hex}")
        for folder in old:
            fs.delete(fs_path(folder), True)


class JdbcCheckpoints(CheckpointTable):
    """The same in a database table of COLUMNS, which is made if it is missing: rows are appended, the one written last counts. options: of Spark's JDBC source."""

    def __init__(self, spark: SparkSession, options: dict[str, str], table: str):
        super().__init__(spark, table)
        self.options = options | {"dbtable": table}

    def commit(self, rows: DataFrame, batch_id: int, writer: str = "") -> None:
        """As there; a repeated batch is appended again, which changes no position."""
        out = rows.select(
            "source", "tranche", "consumer_group", F.col("position").cast("long"), F.current_timestamp().alias("at"), F.lit(self._next()).alias("seq")
        )
        names = ", ".join(f"{c} VARCHAR(400)" for c in ("source", "tranche", "consumer_group"))
        out.coalesce(1).write.format("jdbc").options(**self.options).option("createTableColumnTypes", names).mode("append").save()

    def _rows(self) -> DataFrame:
        try:
            return self.spark.read.format("jdbc").options(**self.options).load()
        except Exception as e:  # noqa: BLE001 - databases say in many ways that a table is missing
            if "does not exist" not in str(e).lower():
                raise
            return self.spark.createDataFrame([], schema(self.COLUMNS))

    def compact(self) -> None:
        raise NotImplementedError("rows of a database are deleted there")
