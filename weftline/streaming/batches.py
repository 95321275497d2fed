"""Per-stream buffers for large micro-batches: what streams there are and what waits is joined as tables, handlers are called over sorted rows of many streams.

The semantics are those of buffers.project. There each stream is a group of a stateful operator, which suits small micro-batches and costs a call
per stream; here a micro-batch costs a scan of the state's snapshot and logs, and a stream next to nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .buffers import RESULT_COLUMNS, Handler, Malformed
from .run import for_each_batch

#: What a micro-batch leaves behind: handlers' results, each touched stream's state, and the events that wait (i is their index).
LOG = "stream string, i long, index_next long, outcome string, n_events long, write_pos long, malformed boolean, event_type string, data string, kind string"
_COLUMNS = [x.split(" ")[0] for x in LOG.split(", ")]
_KINDS = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[x.split(" ")[1]] for x in LOG.split(", ")]


def _frame(batch: pa.RecordBatch) -> pd.DataFrame:
    """A batch with nulls as None."""
    texts = {c: np.array(batch.column(c).to_pylist(), object) for c in ("stream", "event_type", "data")}
    pos = batch.column("write_pos").to_numpy(zero_copy_only=False).astype(float)
    return pd.DataFrame(
        {**texts, "index": batch.column("index").to_numpy(), "write_pos": pos, "malformed": batch.column("malformed").to_numpy(zero_copy_only=False)}
    )


class _Walk:
    """Sorted rows of many streams: contiguous runs go to the handler, what it doesn't take is left."""

    def __init__(self, handle: Handler, require_all: bool, max_events: int):
        self.handle, self.require_all, self.max_events = handle, require_all, max_events
        self.stream: str | None = None
        self.pos: int | None = None
        self.malformed = self.stopped = False
        self.out: list[tuple] = []
        self.left: list[pd.DataFrame] = []

    def begin(self, stream: str, pos: float | None, malformed: bool) -> None:
        self.end()
        self.stream, self.pos = stream, None if pos is None or pos != pos else int(pos)
        self.malformed = self.stopped = bool(malformed)

    def end(self) -> None:
        if self.stream is not None:
            self.out.append((self.stream, None, None, None, None, self.pos, self.malformed, None, None, "state"))
        self.stream = None

    def run(self, rows: pd.DataFrame, head: int) -> None:
        """Rows of the stream, contiguous from head."""
        at, n = 0, len(rows)
        while at < n and not self.stopped:
            at = max(at, min(n, (self.pos or 0) - head))
            if at == n:
                return
            if self.require_all and head + at != (self.pos or 0):
                self.stopped = True
                break
            part = rows.iloc[at : at + self.max_events]
            try:
                outcome, after = self.handle(self.stream, part)
            except Malformed:
                outcome, after, self.malformed = "malformed", head + at, True
            except Exception as e:  # noqa: BLE001 - a handler's failure is an outcome
                outcome, after = f"failed: {type(e).__name__}", head + at
            done = max(0, min(after - head - at, len(part)))
            self.out.append((self.stream, head + at, after, outcome, done, None, None, None, None, "result"))
            if after <= head + at:
                self.stopped = True
            else:
                self.pos = max(self.pos or 0, after)
                at += done
        if at < n:
            self.left.append(rows.iloc[at:])

    def taken(self) -> Iterator[pa.RecordBatch]:
        if self.out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.out, strict=True), _KINDS, strict=True)], _COLUMNS)
        for rows in self.left:
            given = {"stream": rows["stream"].tolist(), "i": rows["index"].tolist(), "event_type": rows["event_type"].tolist(), "data": rows["data"].tolist(), "kind": ["waiting"] * len(rows)}
            yield pa.RecordBatch.from_arrays(
                [pa.array(given[c], t) if c in given else pa.nulls(len(rows), t) for c, t in zip(_COLUMNS, _KINDS, strict=True)], _COLUMNS
            )
        self.out, self.left = [], []


def walk(rows: DataFrame, handle: Handler, require_all: bool = False, max_events: int = 16384) -> DataFrame:
    """LOG of rows stream, index, event_type, data, write_pos, malformed: one copy of each index, at or behind the write position."""

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = _Walk(handle, require_all, max_events)
        held: pd.DataFrame | None = None  # a run that may go on in the next frame
        for frame in map(_frame, (x for x in parts if x.num_rows)):
            if held is not None:
                frame = pd.concat([held, frame], ignore_index=True)
            name, index = frame["stream"].to_numpy(), frame["index"].to_numpy()
            pos, malformed = frame["write_pos"].to_numpy(), frame["malformed"].to_numpy()
            breaks = np.flatnonzero((name[1:] != name[:-1]) | (index[1:] != index[:-1] + 1)) + 1
            edges = [0, *breaks.tolist()]
            last = edges[-1] + (len(frame) - edges[-1]) // max_events * max_events
            for a, b in zip(edges, [*edges[1:], last], strict=True):
                if a < b:
                    if name[a] != w.stream:
                        w.begin(name[a], pos[a], malformed[a])
                    w.run(frame.iloc[a:b], int(index[a]))
            held = frame.iloc[last:] if last < len(frame) else None
            yield from w.taken()
        if held is not None:
            if held["stream"].iloc[0] != w.stream:
                w.begin(held["stream"].iloc[0], held["write_pos"].iloc[0], held["malformed"].iloc[0])
            w.run(held, int(held["index"].iloc[0]))
        w.end()
        yield from w.taken()

    ordered = rows.select("stream", "index", "event_type", "data", "write_pos", "malformed").repartition("stream").sortWithinPartitions("stream", "index")
    return ordered.mapInArrow(step, LOG)


class StreamTable:
    """The state of streams as tables in a folder: a log folder by micro-batch, and a snapshot after every so many of them."""

    def __init__(self, spark: SparkSession, path: str, snapshot_every: int = 50):
        self.spark, self.path, self.snapshot_every = spark, path, snapshot_every

    def _read(self, name: str) -> DataFrame:
        kind = f"{LOG}, batch long"
        try:
            return self.spark.read.schema(kind).parquet(f"{self.path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], kind)

    def _before(self, batch_id: int) -> DataFrame:
        """Rows of the newest snapshot and of the logs behind it, before a micro-batch."""
        snapshots = self._read("snapshots").where(F.col("batch") < batch_id)
        newest = snapshots.agg(F.max("batch")).first()[0]
        logs = self._read("log").where((F.col("batch") < batch_id) & (F.col("kind") != "result"))
        if newest is None:
            return logs
        return snapshots.where(F.col("batch") == newest).unionByName(logs.where(F.col("batch") > newest))

    def state(self, batch_id: int) -> tuple[DataFrame, DataFrame]:
        """Before a micro-batch: stream, write_pos, malformed, batch (the last that touched the stream); and the events that wait."""
        rows = self._before(batch_id)
        last = rows.where("kind = 'state'").groupBy("stream").agg(F.max_by(
            F.struct("write_pos", "malformed", "batch"), "batch"
        ).alias("x")).select("stream", "x.*")
        waiting = rows.where("kind = 'waiting'").join(last.select("stream", "batch"), ["stream", "batch"], "left_semi")
        return last, waiting

    def handle(self, events: DataFrame, batch_id: int, handle: Handler, require_all: bool, max_events: int) -> None:
        """Handle a micro-batch (stream, index, event_type, data, and arrival if there is one) and write what it leaves; a repeated one is written anew."""
        last, waiting = self.state(batch_id)
        arrival = F.col("arrival").cast("long") if "arrival" in events.columns else F.lit(0).cast("long")
        new = events.select("stream", "index", "event_type", "data", F.lit(1).alias("turn"), arrival.alias("arrival"))
        touched = new.select("stream").distinct()
        old = waiting.join(touched, "stream", "left_semi").select(
            "stream", F.col("i").alias("index"), "event_type", "data", F.lit(0).alias("turn"), F.lit(0).cast("long").alias("arrival")
        )
        rows = new.unionByName(old).join(last.drop("batch"), "stream", "left").where(F.col("index") >= F.coalesce("write_pos", F.lit(0)))
        first = F.row_number().over(Window.partitionBy("stream", "index").orderBy("turn", "arrival", "event_type", "data"))
        once = rows.repartition("stream").withColumn("copy", first).where("copy = 1").withColumn("malformed", F.coalesce("malformed", F.lit(False)))
        self._write(walk(once, handle, require_all, max_events), "log", batch_id)
        if (batch_id + 1) % self.snapshot_every == 0:
            last, waiting = self.state(batch_id + 1)
            states = last.withColumn("kind", F.lit("state"))
            kept = [states.select(*[F.col(c) if c in states.columns else F.lit(None).alias(c) for c in _COLUMNS]), waiting.select(*_COLUMNS)]
            # In a snapshot every stream is as of this batch.
            self._write(kept[0].unionByName(kept[1]), "snapshots", batch_id)

    def _write(self, rows: DataFrame, name: str, batch_id: int) -> None:
        typed = rows.select(*[F.col(c).cast(t).alias(c) for c, t in (x.split(" ") for x in LOG.split(", "))])
        typed.write.mode("overwrite").partitionBy("kind").parquet(f"{self.path}/{name}/batch={batch_id}")

    def results(self) -> DataFrame:
        """All results of handlers: buffers.RESULT."""
        return self._read("log").where("kind = 'result'").select(*RESULT_COLUMNS)


def project(
    stream: DataFrame, handle: Handler, path: str, checkpoint: str, require_all: bool = False, max_events: int = 16384, snapshot_every: int = 50
) -> DataFrame:
    """Run a stream of events to its end; the results of its handlers, as buffers.project gives them."""
    table = StreamTable(stream.sparkSession, path, snapshot_every)
    for_each_batch(stream, lambda df, batch_id: table.handle(df, batch_id, handle, require_all, max_events), checkpoint)
    return table.results()
