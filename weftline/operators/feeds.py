"""Feed bookkeeping as tables: start positions, stripes, pages, pending work, compaction, purge, ingest decisions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.positions import chunk, chunk_base


def start_position(
    stored: Column, origin: Column | None = None, override: Column | None = None, from_tail: Column | None = None, tail: Column | None = None
) -> Column:
    """Override, else the stored position, else the tail if wanted, else the origin, else 0."""
    options = [override] if override is not None else []
    options.append(stored)
    if from_tail is not None and tail is not None:
        options.append(F.when(from_tail, tail))
    return F.coalesce(*options, *([origin] if origin is not None else []), F.lit(0).cast("long"))


def stripe(position: Column) -> tuple[Column, Column]:
    """Number of the chunk that a reader of its own reads, and where it begins."""
    return chunk(position), chunk_base(chunk(position))


def pull_stream(events: DataFrame, stream: str, position: int, limit: int | None = None) -> DataFrame:
    """One stream forward from a position."""
    rows = events.where((F.col("stream") == stream) & (F.col("index") >= position)).orderBy("index")
    return rows.limit(limit) if limit is not None else rows


def pending_work(starts: DataFrame, completed: DataFrame) -> DataFrame:
    """Tranches (tranche, start) whose completed position hasn't passed where they stood at the start."""
    return starts.join(completed, "tranche").where(F.col("completed") <= F.col("start"))


def compact(updates: DataFrame, keys: list[str], at: str, every_s: int, *ties: str) -> DataFrame:
    """updates with kind: of each key's plain updates, in order of time, the first is an event, and then each one that comes every_s or more after the last event;
    all others only change the snapshot, of which the last one (kind snapshot) stays, unless it is an event itself. Folded ones are left out.

    Rows reach a task in order and are judged as they come.
    """
    kind = T.StructType([*updates.schema.fields, T.StructField("kind", T.StringType())])

    def judge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row, which is its key's snapshot if another key follows
        last_key, event_s = None, 0.0
        for part in parts:
            if not part.num_rows:
                continue
            names = list(zip(*(part.column(k).to_pylist() for k in keys), strict=True))
            seconds = part.column(at).cast(pa.timestamp("us")).cast(pa.int64()).to_pylist()
            kinds: list[str | None] = []
            if held is not None and names[0] != last_key and held.column("kind")[0].as_py() is None:
                yield _of_kind(held.drop_columns(["kind"]), ["snapshot"])
            for name, us in zip(names, seconds, strict=True):
                if name != last_key:
                    if kinds and kinds[-1] is None:
                        kinds[-1] = "snapshot"
                    last_key, event_s = name, us / 1e6
                    kinds.append("event")
                elif us / 1e6 >= event_s + every_s:
                    event_s = us / 1e6
                    kinds.append("event")
                else:
                    kinds.append(None)
            whole = _of_kind(part, kinds)
            yield whole.filter(whole.column("kind").is_valid())
            held = whole.slice(part.num_rows - 1)
        if held is not None and held.column("kind")[0].as_py() is None:
            yield _of_kind(held.drop_columns(["kind"]), ["snapshot"])

    return updates.repartition(*keys).sortWithinPartitions(*keys, at, *ties).mapInArrow(judge, kind)


def _of_kind(rows: pa.RecordBatch, kinds: list[str | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*rows.columns, pa.array(kinds, pa.string())], [*rows.schema.names, "kind"])


def purge(states: DataFrame, now: Column, idle_s: int) -> DataFrame:
    """States that stay: with events waiting, or touched within the interval."""
    return states.where((F.col("waiting") > 0) | (F.unix_seconds("touched") > F.unix_seconds(now) - idle_s))


def choose_unwritten(i: Column, n: Column, write_pos: Column) -> tuple[Column, Column]:
    """(from, n) of a span beyond a write position; n is 0 if nothing is left."""
    begin = F.greatest(i, F.coalesce(write_pos, F.lit(0)))
    return begin, F.greatest(F.lit(0), i + n - begin)


def decide_ingest(spans: DataFrame, versions: DataFrame, closed: DataFrame) -> DataFrame:
    """p, i, n, accepted, residual: an open epoch takes what isn't recorded, a closed one leaves it to the next. closed: partition, closed."""
    from .index import classify

    kinds = classify(spans.select("p", "i", "n"), versions)
    placed = kinds.join(spans.select("p", "i", "n", "partition").distinct(), ["p", "i", "n"]).join(closed, "partition", "left")
    fresh = F.col("kind").isin("start", "append")
    shut = F.coalesce("closed", F.lit(False))
    return placed.select(
        "partition", "p", "i", "n", "kind", F.when(fresh & ~shut, F.col("n_new")).otherwise(0).alias("accepted"),
        F.when(fresh & shut, F.col("n_new")).otherwise(0).alias("residual")
    )


def last_unfolds(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Events, and of a batch's unfolds only the last set: those at the index of the last."""
    top = F.max(F.when(F.col("is_unfold"), F.col("index"))).over(Window.partitionBy(*keys))
    return rows.withColumn("__top", top).where(~F.col("is_unfold") | (F.col("index") == F.col("__top"))).drop("__top")


def handled_prefix(events: DataFrame, results: DataFrame) -> DataFrame:
    """Events before the index that their stream's handler returned."""
    return events.join(results.select("stream", "index_next"), "stream").where(F.col("index") < F.col("index_next")).drop("index_next")
