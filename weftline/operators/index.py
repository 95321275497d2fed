"""The append index: which events each stream has, by epochs; classification, deduplication, hydration."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def classify(spans: DataFrame, versions: DataFrame) -> DataFrame:
    """Spans p, i, n against versions p, version: start, append, discard or gap, with the part not yet recorded (from, n_new)."""
    v = F.coalesce("version", F.lit(0))
    end = F.col("i") + F.col("n")
    kind = F.when(end <= v, "discard").when(F.col("i") > v, "gap").when(F.col("version").isNull(), "start").otherwise("append")
    fresh = F.when(kind.isin("start", "append"), end - v).otherwise(F.lit(0))
    return spans.join(versions, "p", "left").select("p", "i", "n", kind.alias("kind"), F.greatest(F.col("i"), v).alias("from"), fresh.alias("n_new"))


def unrecorded(rows: DataFrame, recorded: DataFrame) -> DataFrame:
    """Rows (p, index) that the index doesn't hold."""
    return rows.join(recorded, ["p", "index"], "left_anti")


def versions(spans: DataFrame) -> DataFrame:
    """p, version: next index after the last recorded span."""
    return spans.groupBy("p").agg(F.max(F.col("i") + F.col("n")).alias("version"))


def flatten(spans: DataFrame) -> DataFrame:
    """p, i, next, gaps: one span per stream from its lowest to its highest index; gaps counts missing indices (0 where it is whole)."""
    before = Window.partitionBy("p").orderBy("i", "n").rowsBetween(Window.unboundedPreceding, -1)
    x = spans.withColumn("end", F.col("i") + F.col("n")).withColumn("reach", F.max("end").over(before))
    return x.groupBy("p").agg(
        F.min("i").alias("i"), F.max("end").alias("next"), F.sum(F.greatest(F.lit(0), F.col("i") - F.coalesce("reach", F.col("i")))).alias("gaps")
    )


def summary(queues: DataFrame) -> DataFrame:
    """streams, events, buffered, queuing, gapped of rows p, write_pos, first_i, n_spans (no queue: null)."""
    has = F.col("first_i").isNotNull()
    gap = has & (F.col("first_i") > F.col("write_pos"))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return queues.agg(
        F.count("*").alias("streams"), F.sum("write_pos").alias("events"), one(has & ~gap & (F.col("n_spans") == 1)).alias("buffered"),
        one(has & ~gap & (F.col("n_spans") > 1)).alias("queuing"), one(gap).alias("gapped")
    )


def hydrate(spans: DataFrame, events: DataFrame) -> DataFrame:
    """The stored events of each span (stream, i, n): equal stream, index in [i, i + n)."""
    e = events.alias("e")
    s = spans.alias("s")
    return s.join(
        e, (F.col("s.stream") == F.col("e.stream")) & (F.col("e.index") >= F.col("s.i")) & (F.col("e.index") < F.col("s.i") + F.col("s.n"))
    ).select("e.*", F.col("s.i").alias("span_i"))


def latest(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Each key's value of the last row by order: active epochs, checkpoint states."""
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def not_reached(targets: DataFrame, positions: DataFrame) -> DataFrame:
    """Notifications (partition, target) whose partition hasn't reached the target."""
    p = positions.select(F.col("partition").alias("__p"), F.col("position").alias("__at"))
    return targets.join(p, (F.col("partition") == F.col("__p")) & (F.col("__at") >= F.col("target")), "left_anti")


def assign_epochs(batches: DataFrame, size: str, most: int, order: list[str], key: str = "partition") -> DataFrame:
    """epoch of every batch: an epoch takes batches until its size exceeds `most`; then it is closed. Rows reach a task in order and are numbered as they come."""
    kind = T.StructType([*batches.schema.fields, T.StructField("epoch", T.IntegerType())])

    def number(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: object = None
        epoch = held = 0
        first = True
        for part in parts:
            out = []
            for k, n in zip(part.column(key).to_pylist(), part.column(size).to_pylist(), strict=True):
                if first or k != last:
                    last, epoch, held, first = k, 0, 0, False
                out.append(epoch)
                held += n
                if held > most:
                    epoch, held = epoch + 1, 0
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.int32())], [*part.schema.names, "epoch"])

    return batches.repartition(key).sortWithinPartitions(key, *order).mapInArrow(number, kind)


BUFFER = "p string, step long, ok boolean, write_pos long, ready_i long, ready_n long"


def index_buffer(operations: DataFrame) -> DataFrame:
    """The index buffer's answers, step by step: p, step, ok, write_pos, ready_i, ready_n. operations: p, step, op, i, n.

    `log` records a span of the index: refused (not ok) if it begins behind the write position, which it else moves. `ingest` takes a span of data: the
    buffer says which contiguous span from the write position on is ready (null for none), and keeps what isn't yet.
    """

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pos, held = None, 0, []
        for part in parts:
            out: list[tuple] = []
            for p, step, op, i, n in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if p != last:
                    last, pos, held = p, 0, []
                ok, ready = True, (None, None)
                if op == "log":
                    ok = i <= pos
                    pos = max(pos, i + n) if ok else pos
                else:
                    held.append((i, i + n))
                held = _joined([(max(a, pos), b) for a, b in held if b > pos])
                if op == "ingest" and held and held[0][0] == pos:
                    ready = (pos, held[0][1] - pos)
                out.append((p, step, ok, pos, *ready))
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["p", "step", "ok", "write_pos", "ready_i", "ready_n"])

    rows = operations.select(
        F.col("p").cast("string"), F.col("step").cast("long"), F.col("op").cast("string"), F.col("i").cast("long"), F.col("n").cast("long")
    )
    return rows.repartition("p").sortWithinPartitions("p", "step").mapInArrow(fold, BUFFER)


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def read_epoch(changes: DataFrame, epoch: Column, least: Column) -> DataFrame:
    """partition, n, version, closed: changes (partition, epoch, seq, kind) of one epoch from a sequence on, and what the epoch says of itself."""
    here = changes.where(F.col("epoch") == epoch)
    seen = F.col("seq") >= least
    return here.groupBy("partition", "epoch").agg(
        F.count(F.when(seen & (F.col("kind") != "closed"), 1)).alias("n"), (F.max("seq") + 1).alias("version"),
        F.max(F.col("kind") == "closed").alias("closed")
    )


def read_index(changes: DataFrame, epoch: int, offset: int, keep: Column, events: DataFrame | None = None) -> DataFrame:
    """stream, index, event_type, data, position of the index from an epoch's offset on: its spans (partition, epoch, seq, stream, i, types) of streams to keep as events.

    events (stream, index, data): hydrate, that is fetch the stored bodies; without them data is null. position: behind the span's change.
    """
    from ..functions.positions import epoch_position

    later = (F.col("epoch") > epoch) | ((F.col("epoch") == epoch) & (F.col("seq") >= offset))
    spans = changes.where(later & keep).select(
        "stream", "i", epoch_position(F.col("epoch"), F.col("seq") + 1).alias("position"), F.posexplode("types").alias("k", "event_type")
    )
    each = spans.select("stream", (F.col("i") + F.col("k")).cast("long").alias("index"), "event_type", "position")
    if events is None:
        return each.withColumn("data", F.lit(None).cast("string"))
    return each.join(events.select("stream", "index", "data"), ["stream", "index"])


def load_index(changes: DataFrame) -> DataFrame:
    """partition, epochs, spans, gapped: what a walk over a partition's epochs, from 0 on while they are closed, loads. changes: partition, epoch, p, i, n, closed."""
    epochs = changes.groupBy("partition", "epoch").agg(F.max("closed").alias("closed"))
    before = F.min(F.col("closed").cast("int")).over(Window.partitionBy("partition").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1))
    at = F.row_number().over(Window.partitionBy("partition").orderBy("epoch")) - 1
    walked = epochs.withColumn("__open", before).withColumn("__at", at).where((F.coalesce("__open", F.lit(1)) == 1) & (F.col("__at") == F.col("epoch")))
    spans = changes.join(walked.select("partition", "epoch"), ["partition", "epoch"])
    reach = F.max(F.col("i") + F.col("n")).over(Window.partitionBy("partition", "p").orderBy("epoch", "i").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("gapped", F.col("i") > F.coalesce(reach, F.lit(0)))
    return spans.groupBy("partition").agg(
        F.countDistinct("epoch").alias("epochs"), F.count("*").alias("spans"), F.sum(F.col("gapped").cast("long")).alias("gapped")
    )


def prune(events: DataFrame, until: DataFrame) -> DataFrame:
    """Events (stream, index) after the stream's pruning position."""
    u = until.select(F.col("stream").alias("__s"), F.col("until").alias("__u"))
    return events.join(u, (F.col("stream") == F.col("__s")) & (F.col("index") <= F.col("__u")), "left_anti")


def within_budget(rows: DataFrame, size: Column, most: int, order: list[str], key: str) -> DataFrame:
    """A key's prefix whose cumulative size is at most `most`."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(size).over(w)).where(F.col("running") <= most)
