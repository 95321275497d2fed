"""The append index kept by micro-batches: exactly once, in epochs that close by bytes, batches or streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS = "partition long, epoch long, p string, index long, event_type string, batch long"
VERSIONS = "partition long, p string, version long, epoch long, batch long"
EPOCHS = "partition long, epoch long, bytes long, versions long, streams long, closed boolean, batch long"


class GapError(Exception):
    """A span begins behind the end of what is recorded."""


class IndexTable:
    """Recorded events (partition, epoch, p, index, event_type), and beside them two logs: each batch's streams with their versions, and its epochs.

    A batch reads the logs only, never recorded events. It is judged against the other batches and replaces its own folders when it is repeated, so that
    it counts once. A batch goes to the open epoch of its partition; that is closed once it holds more than epoch_bytes (a stream's name and 2 bytes, and its types and 3 bytes
    each), epoch_versions batches or epoch_streams streams, and what comes then goes to the next one. Events behind a gap are left out (on_gap "error": raise).
    """

    def __init__(
        self, spark: SparkSession, path: str, epoch_bytes: int = 1 << 20, epoch_versions: int = 5_000, epoch_streams: int = 100_000,
        on_gap: str = "leave"
    ):
        self.spark, self.path, self.on_gap = spark, path, on_gap
        self.epoch_bytes, self.epoch_versions, self.epoch_streams = epoch_bytes, epoch_versions, epoch_streams

    def _log(self, name: str, kind: str, but: int | None = None) -> DataFrame:
        # The folders' batch is a partition column, so that a repeated batch doesn't read the files that it replaces.
        try:
            every = self.spark.read.schema(kind).parquet(f"{self.path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            every = self.spark.createDataFrame([], kind)
        return every if but is None else every.where(F.col("batch") != but)

    def rows(self, partition: int | None = None, epoch: int | None = None) -> DataFrame:
        out = self._log("rows", ROWS)
        out = out if partition is None else out.where(F.col("partition") == partition)
        return out if epoch is None else out.where(F.col("epoch") == epoch)

    def versions(self, but: int | None = None) -> DataFrame:
        """p, version (the index behind the last recorded event), epoch (in which that is)."""
        return self._log("versions", VERSIONS, but).groupBy("p").agg(F.max("version").alias("version"), F.max("epoch").alias("epoch"))

    def epochs(self, but: int | None = None) -> DataFrame:
        """partition and its last epoch: epoch, bytes, versions, streams, closed."""
        last = self._log("epochs", EPOCHS, but).groupBy("partition").agg(F.max_by(
            F.struct("epoch", "bytes", "versions", "streams", "closed"), "batch"
        ).alias("x"))
        return last.select("partition", "x.*")

    def ingest(self, events: DataFrame, batch_id: int) -> None:
        """Record events (partition, p, index, event_type) that aren't recorded yet; the usable form of foreachBatch."""
        once = events.select("partition", "p", "index", "event_type").dropDuplicates(["p", "index"])
        known = self.versions(batch_id).withColumnRenamed("epoch", "last")
        fresh = once.join(known, "p", "left").withColumn("version", F.coalesce("version", F.lit(0))).where(F.col("index") >= F.col("version"))
        ordinal = F.row_number().over(Window.partitionBy("p").orderBy("index")) - 1
        fresh = fresh.withColumn("gap", F.col("index") - F.col("version") > ordinal)
        if self.on_gap == "error" and (row := fresh.where("gap").orderBy("p", "index").first()) is not None:
            raise GapError(f"{row['p']}: {row['index']} after {row['version']}")
        # The open epoch of each partition: few rows, one a partition.
        open_ = self.epochs(batch_id).withColumnRenamed("partition", "of")
        placed = fresh.where("not gap").join(open_, F.col("partition") == F.col("of"), "left")
        zero = lambda c: F.coalesce(F.when(~F.col("closed"), F.col(c)), F.lit(0))
        now = (F.coalesce("epoch", F.lit(0)) + F.coalesce(F.col("closed"), F.lit(False)).cast("int")).cast("long")
        placed = placed.select(
            "partition", now.alias("epoch"), "p", "index", "event_type", "last", *[zero(c).alias(c) for c in ("bytes", "versions", "streams")]
        )
        self._write(placed.select("partition", "epoch", "p", "index", "event_type"), "rows", batch_id)
        mine = placed.groupBy("partition", "epoch", "p", "last", "bytes", "versions", "streams").agg(
            (F.max("index") + 1).alias("version"), F.sum(F.octet_length("event_type") + 3).alias("size")
        )
        self._write(mine.select("partition", "p", "version", "epoch"), "versions", batch_id)
        new = F.col("last").isNull() | (F.col("last") < F.col("epoch"))
        grown = mine.groupBy("partition", "epoch", "bytes", "versions", "streams").agg(
            F.sum(F.col("size") + F.octet_length("p") + 2).alias("size"), F.sum(new.cast("int")).alias("more")
        )
        state = grown.select(
            "partition", "epoch", (F.col("bytes") + F.col("size")).cast("long").alias("bytes"),
            (F.col("versions") + 1).cast("long").alias("versions"), (F.col("streams") + F.col("more")).cast("long").alias("streams")
        )
        full = (F.col("bytes") > self.epoch_bytes) | (F.col("versions") >= self.epoch_versions) | (F.col("streams") >= self.epoch_streams)
        self._write(state.select("*", full.alias("closed")), "epochs", batch_id)

    def _write(self, df: DataFrame, name: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch_id}")
