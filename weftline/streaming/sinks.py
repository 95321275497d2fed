"""Sinks: per-stream handlers over batches, chunked, batched and parallel handlers, producers, idempotent appends."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import render_spans
from .buffers import RESULT, RESULT_COLUMNS, Handler

# What producers ask of their brokers' clients.
PRODUCER = {"kafka.compression.type": "lz4", "kafka.linger.ms": "5"}


class _Drain:
    """The queue of one stream, handed to the handler in chunks as its events come in; no more than a chunk is held."""

    def __init__(self, stream: str, handle: Handler, max_events: int | None, max_bytes: int | None):
        self.stream, self.handle, self.max_events, self.max_bytes = stream, handle, max_events, max_bytes
        self.held: list[pd.DataFrame] = []
        self.n, self.bytes, self.pos, self.stopped = 0, 0, 0, False
        self.out: list[tuple] = []

    def add(self, events: pd.DataFrame) -> None:
        while len(events) and not self.stopped:
            room = len(events)
            if self.max_events is not None:
                room = min(room, self.max_events - self.n)
            if self.max_bytes is not None:
                room = min(room, int(np.searchsorted(np.cumsum(events["size"].to_numpy()), self.max_bytes - self.bytes, "right")))
            if not self.n:
                room = max(room, 1)
            take, events = events.iloc[:room], events.iloc[room:]
            if room:
                self.held.append(take)
                self.n += room
                self.bytes += int(take["size"].sum()) if self.max_bytes is not None else 0
            if len(events):
                self.flush()
                events = events[events["index"] >= self.pos]

    def flush(self) -> None:
        """Call the handler with what is held; what it leaves stays at the head."""
        if not self.n or self.stopped:
            return
        run = pd.concat(self.held, ignore_index=True) if len(self.held) > 1 else self.held[0].reset_index(drop=True)
        head = int(run["index"].iloc[0])
        try:
            outcome, after = self.handle(self.stream, run)
        except Exception as e:  # noqa: BLE001 - a handler's failure is an outcome
            outcome, after = f"failed: {type(e).__name__}", head
        done = int((run["index"] < after).sum())
        self.out.append((self.stream, head, after, outcome, done))
        self.stopped, self.pos = after <= head, after
        rest = run.iloc[done:]
        self.held, self.n = ([rest], len(rest)) if len(rest) else ([], 0)
        self.bytes = int(rest["size"].sum()) if self.max_bytes is not None else 0

    def end(self) -> list[tuple]:
        while self.n and not self.stopped:
            self.flush()
        return self.out


def handle_chunks(events: DataFrame, handle: Handler, max_events: int | None = 16384, max_bytes: int | None = (1 << 20) - 4096) -> DataFrame:
    """The whole queue of every stream, cut greedily into chunks within both budgets (at least one event), a call for each; results as RESULT.

    Streams run in parallel, never one stream twice; a stream's calls go in order of index. What a handler leaves of a chunk begins the next
    one; a handler without progress, or one that fails, stops its stream. events: stream, index, and size where bytes are limited. Rows reach a task in order, so that it
    holds a chunk at a time, however long a stream is.
    """
    columns = events.columns

    def drain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: _Drain | None = None
        for frame in frames:
            name = frame["stream"].to_numpy()
            edges = np.flatnonzero(name[1:] != name[:-1]) + 1
            out: list[tuple] = []
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(name)], strict=True):
                if now is None or now.stream != name[a]:
                    out += now.end() if now is not None else []
                    now = _Drain(name[a], handle, max_events, max_bytes)
                now.add(frame.iloc[a:b])
            yield pd.DataFrame(out, columns=RESULT_COLUMNS)
        if now is not None:
            yield pd.DataFrame(now.end(), columns=RESULT_COLUMNS)

    rows = events.select(*columns).where(F.col("stream").isNotNull())
    return rows.repartition("stream").sortWithinPartitions("stream", "index").mapInPandas(drain, RESULT)


def handle_streams(events: DataFrame, handle: Handler) -> DataFrame:
    """One call per stream with all its events in order of index; what a handler leaves is offered again until there is no progress."""
    return handle_chunks(events, handle, None, None)


def handle_batched(pending: DataFrame, select: Callable[[DataFrame], DataFrame], handle: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """select picks streams out of all pending ones, handle is called once for the whole selection.

    handle gets stream, ordinal (select's column of that name, else a number of the stream) and span (i, next, events as an array in order of index), and
    returns ordinal, outcome and index_next; the results are zipped to the streams by ordinal. RESULT; a stream without a result, or one twice, is an error.
    """
    chosen = select(pending)
    order = F.col("ordinal") if "ordinal" in chosen.columns else F.xxhash64("stream")
    chosen = chosen.select("stream", order.alias("ordinal")).groupBy("stream").agg(F.min("ordinal").alias("ordinal"))
    event = F.struct("index", *[c for c in pending.columns if c not in ("stream", "index")])
    spans = pending.join(chosen, "stream").groupBy("stream", "ordinal").agg(F.array_sort(F.collect_list(event)).alias("events"))
    items = spans.select(
        "stream", "ordinal",
        F.struct(F.element_at("events", 1)["index"].alias("i"), (F.element_at("events", -1)["index"] + 1).alias("next"), "events").alias("span")
    )
    results = handle(items).select("ordinal", "outcome", F.col("index_next").cast("long").alias("index_next"))
    once = results.groupBy("ordinal").agg(F.max_by("outcome", "index_next").alias("outcome"), F.max("index_next").alias("index_next"), F.count("*").alias("n"))
    zipped = items.join(once, "ordinal", "left")
    checked = F.when(
        F.coalesce("n", F.lit(0)) == 1, F.col("index_next")
    ).otherwise(F.raise_error(F.concat(F.col("stream"), F.lit(": not one result"))).cast("long"))
    done = F.size(F.filter("span.events", lambda x: x["index"] < F.col("index_next"))).cast("long")
    return zipped.select("stream", F.col("span.i").alias("i"), checked.alias("index_next"), "outcome", done.alias("n_events"))


def handle_parallel(items: DataFrame, handle: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Each item by itself, in any order; an error fails the batch."""

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield handle(pdf)

    return items.mapInPandas(call, schema)


def batch_states(results: DataFrame, batch: str = "batch") -> DataFrame:
    """batch, state of parallel items (batch, done, failed): faulted if one failed, completed if all are done, else busy."""
    any_ = lambda c: F.max(F.coalesce(F.col(c), F.lit(False)))
    state = F.when(any_("failed"), "faulted").when(F.min(F.coalesce(F.col("done"), F.lit(False))), "completed").otherwise("busy")
    return results.groupBy(batch).agg(state.alias("state"))


def prepared_messages(events: DataFrame, prepare: Callable[[DataFrame], DataFrame] = render_spans, max_bytes: int = 1_000_000) -> DataFrame:
    """stream, key, value, outcome, index_next: what a producer does with each stream's span.

    prepare gives stream and value, and key if it isn't the stream; a null value produces nothing (skipped). The position is the end of the
    span either way; messages beyond max_bytes are sent, but marked oversize.
    """
    spans = events.groupBy("stream").agg((F.max("index") + 1).alias("index_next"))
    made = prepare(events)
    key = F.coalesce("key", "stream") if "key" in made.columns else F.col("stream")
    made = made.select("stream", key.alias("key"), "value")
    outcome = F.when(F.col("value").isNull(), "skipped").when(F.octet_length("value") > max_bytes, "oversize").otherwise("produced")
    out = spans.join(made, "stream", "left")
    return out.select("stream", F.when(F.col("value").isNotNull(), F.col("key")).alias("key"), "value", outcome.alias("outcome"), "index_next")


def produce(messages: DataFrame, topic: str, servers: str) -> None:
    """Rows of key and value to a topic; a null value is left out. Equal keys keep their order. Needs Spark's Kafka package."""
    writer = messages.where("value is not null").select("key", "value").write.format("kafka")
    writer.option("kafka.bootstrap.servers", servers).option("topic", topic).options(**PRODUCER).save()


def produce_spans(events: DataFrame, topic: str, servers: str, prepare: Callable[[DataFrame], DataFrame] = render_spans, max_bytes: int = 1_000_000) -> None:
    """Prepared spans to a topic, keyed by stream, so that a stream's messages keep their order."""
    produce(prepared_messages(events, prepare, max_bytes), topic, servers)


def produce_parallel(items: DataFrame, render: tuple[Column, Column], topic: str, servers: str) -> None:
    """Each item by itself, rendered as key and value; no order."""
    produce(items.select(render[0].alias("key"), render[1].alias("value")), topic, servers)


def consume_topic(
    spark, topic: str, servers: str, max_offsets: int | None = None, min_offsets: int | None = None, max_delay: str = "5s", starting: str = "earliest"
) -> DataFrame:
    """A topic as a stream of records: micro-batches of max_offsets at most, begun at min_offsets or after max_delay. Needs Spark's Kafka package."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting)
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", str(max_offsets))
    if min_offsets:
        reader = reader.option("minOffsetsPerTrigger", str(min_offsets)).option("maxTriggerDelay", max_delay)
    return reader.load()


def append_once(path: str, writer: str = "") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes each micro-batch to a folder of its own, so that a repeated batch replaces itself. writer: what batch ids count for."""
    folder = f"{path}/writer={writer}" if writer else path

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return write
