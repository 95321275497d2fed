"""Scheduling state of streams: classes, requirements, progress, completion, priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spans import merge_events, numbered


def head_spans(spans: DataFrame, key: str = "stream") -> DataFrame:
    """Each stream's first span."""
    return spans.groupBy(key).agg(
        F.min_by(F.struct("i", "next", "n"), "i").alias("h"), F.count("*").alias("n_spans"), F.sum("n").alias("n_events")
    ).select(key, "h.*", "n_spans", "n_events")


def combine(states: DataFrame, events: DataFrame, arrival: list[str]) -> DataFrame:
    """stream, write_pos, malformed, i, next, n_spans, n_events of several states of each stream (write_pos, malformed) and all their events: the greatest
    position, malformed if any is, and the queue merged from there on (its head; null where nothing waits)."""
    merged = states.groupBy("stream").agg(F.max("write_pos").alias("write_pos"), F.max("malformed").alias("malformed"))
    waiting = events.join(merged.select("stream", "write_pos"), "stream").where(F.col("index") >= F.coalesce("write_pos", F.lit(0)))
    heads = head_spans(merge_events(waiting, arrival)).drop("n")
    return merged.join(heads, "stream", "left")


def dispatchable(require_all: bool, i: Column, write_pos: Column, busy: Column | None = None, malformed: Column | None = None) -> Column:
    """Has a head, isn't malformed or busy; with require_all the head begins at the write position (0 if unknown)."""
    out = i.isNotNull() & ~F.coalesce(
        malformed if malformed is not None else F.lit(False), F.lit(False)
    ) & ~F.coalesce(busy if busy is not None else F.lit(False), F.lit(False))
    return out & (i == F.coalesce(write_pos, F.lit(0))) if require_all else out


def stream_class(i: Column, write_pos: Column, busy: Column, malformed: Column) -> Column:
    """synced, busy, malformed, waiting (a gap before the head) or ready."""
    return F.when(i.isNull(), "synced").when(busy, "busy").when(malformed, "malformed").when(i > F.coalesce(write_pos, F.lit(0)), "waiting").otherwise("ready")


def state_report(states: DataFrame) -> DataFrame:
    """state, streams, events, categories of rows stream, category, state, n_events."""
    return states.groupBy("state").agg(F.count("*").alias("streams"), F.sum("n_events").alias("events"), F.countDistinct("category").alias("categories"))


def requirements(batches: DataFrame, progress: DataFrame) -> DataFrame:
    """Batch requirements (batch, stream, required) that the streams' write positions (stream, write_pos) don't meet yet."""
    return batches.join(progress, "stream").where(F.col("write_pos").isNull() | (F.col("write_pos") < F.col("required")))


def remove_attained(pending: DataFrame, progress: DataFrame) -> DataFrame:
    """Pending requirements without those that a stream's progress has attained."""
    p = progress.select(F.col("stream").alias("__s"), F.col("write_pos").alias("__w"))
    return pending.join(p, (F.col("stream") == F.col("__s")) & (F.col("__w") >= F.col("required")), "left_anti")


def batch_completion(batches: DataFrame, open_: DataFrame) -> DataFrame:
    """batch, done (nothing open), completed (done, and all batches before it): batches complete in order."""
    waiting = open_.groupBy("batch").agg(F.count("*").alias("open"))
    first = waiting.agg(F.min("batch").alias("first_open"))
    state = batches.select("batch").distinct().join(waiting, "batch", "left").withColumn("open", F.coalesce("open", F.lit(0)))
    return state.join(F.broadcast(first)).select(
        "batch", (F.col("open") == 0).alias("done"), (F.col("first_open").isNull() | (F.col("batch") < F.col("first_open"))).alias("completed")
    )


def priority_order(pending: DataFrame) -> DataFrame:
    """rank of every stream once: those of the head batch by weight, heaviest first, then those of later batches in order."""
    head = pending.agg(F.min("batch").alias("head"))
    own = pending.groupBy("stream").agg(F.min("batch").alias("batch"), F.max_by("weight", -F.col("batch")).alias("weight"))
    keyed = own.join(F.broadcast(head)).withColumn("__w", F.when(F.col("batch") == F.col("head"), -F.col("weight")).otherwise(F.lit(0)))
    return numbered(keyed, F.col("batch"), "__w", "stream").select("stream", "batch", (F.col("number") + 1).cast("int").alias("rank"))


def within_capacity(waiting: DataFrame, shard: str, order: list[str], slots: Column) -> DataFrame:
    """Of each shard's waiting rows, by order, as many as it has slots: a limit on what is in flight at once."""
    at = F.row_number().over(Window.partitionBy(shard).orderBy(*order))
    return waiting.withColumn("__at", at).where(F.col("__at") <= slots).drop("__at")


def in_flight(deltas: DataFrame, order: list[str], size: str, limit: int, key: str = "partition") -> DataFrame:
    """deltas with held (bytes taken and not yet given back, step by step) and paused: whether reading pauses there."""
    held = F.sum(size).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return deltas.withColumn("held", held).withColumn("paused", F.col("held") > limit)


def round_robin(batches: DataFrame) -> DataFrame:
    """turn and partition in which batches (partition, epoch) are submitted: one of each partition in turn."""
    return batches.withColumn("turn", F.row_number().over(Window.partitionBy("partition").orderBy("epoch")))


def busy_class(attempts: Column, running_s: Column, failing: Column, stuck: Column, slow_s: int) -> Column:
    return F.when(stuck, "stuck").when(failing, "failing").when(attempts == 0, "waiting").when(running_s > slow_s, "slow").otherwise("running")


def write_result(i: Column, n: Column, actual: Column) -> tuple[Column, Column]:
    """(result, position) of an append of [i, n) to a stream that ends at actual."""
    kind = F.when(actual == i, "ok").when(actual < i, "prefix_missing").when(actual >= n, "duplicate").otherwise("partial_duplicate")
    return kind, F.when(actual == i, n).when(actual < i, i - actual).otherwise(actual)


def append_at_expected(spans: DataFrame, versions: DataFrame) -> DataFrame:
    """An optimistic append of spans (stream, i, next) to streams that end at versions (stream, version; absent: 0).

    result and position as write_result says, and n_new: events that get appended, none where the prefix is missing.
    """
    actual = F.coalesce("version", F.lit(0))
    kind, at = write_result(F.col("i"), F.col("next"), actual)
    joined = spans.join(versions, "stream", "left")
    fresh = F.when(F.col("i") <= actual, F.greatest(F.lit(0), F.col("next") - actual)).otherwise(F.lit(0))
    return joined.select("stream", "i", "next", kind.alias("result"), at.cast("long").alias("position"), fresh.cast("long").alias("n_new"))
