"""Reports as tables: what spans hold, what batches require, how readers and change feeds get on, what is exported as metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import count_if


def span_metrics(events: DataFrame, size: Column, key: str = "stream") -> DataFrame:
    """key, n_events, n_bytes, i, next of each stream's events."""
    i, after = F.min("index").alias("i"), (F.max("index") + 1).alias("next")
    return events.groupBy(key).agg(F.count("*").alias("n_events"), F.sum(size).cast("long").alias("n_bytes"), i, after)


def batch_high_water(events: DataFrame, batch: Column, key: str = "stream") -> DataFrame:
    """batch, key, required (the position that completes the batch for the stream), n."""
    return events.groupBy(batch.alias("batch"), key).agg((F.max("index") + 1).alias("required"), F.count("*").alias("n"))


def reader_stats(reads: DataFrame, by: list[Column], stream: str, failed: Column, waited: str) -> DataFrame:
    """by, events, streams, errors, waited of what readers got."""
    return reads.groupBy(*by).agg(
        F.count("*").alias("events"), F.countDistinct(stream).alias("streams"), count_if(failed).alias("errors"),
        F.round(F.sum(waited), 4).alias("waited")
    )


def changefeed_stats(reads: DataFrame, part: Column, cost: Column, waiting: Column, behind: Column) -> DataFrame:
    """rng, docs, cost, lag, synced by range of a change feed. waiting: documents that count as lag; behind: those that must have been read for the range to be synced."""
    total = F.round(F.sum(cost), 4).alias("cost")
    return reads.groupBy(part.alias("rng")).agg(F.count("*").alias("docs"), total, count_if(waiting).alias("lag"), (count_if(behind) == 0).alias("synced"))


def lag(reads: DataFrame, part: str, read: Column, position: Column, behind: Column) -> DataFrame:
    """part, read_pos (the last position that was read), gap, is_tail; parts of which nothing was read are left out."""
    at = reads.groupBy(part).agg(F.max(F.when(read, position)).alias("read_pos"), count_if(behind).alias("gap"))
    return at.where("read_pos is not null").select(part, "read_pos", "gap", (F.col("gap") == 0).alias("is_tail"))


def gauges(samples: DataFrame, labels: list[str], value: str, order: str) -> DataFrame:
    """labels, gauge (the last value), counter, total."""
    return samples.groupBy(*labels).agg(F.max_by(value, order).alias("gauge"), F.count("*").alias("counter"), F.round(F.sum(value), 4).alias("total"))


def outcome_latency(results: DataFrame, kind: str, category: Column, value: str) -> DataFrame:
    """tag, n, min, max: successes by category, all else by kind."""
    tag = F.when(F.col(kind) == "ok", category).otherwise(F.col(kind))
    return results.groupBy(tag.alias("tag")).agg(F.count("*").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"))


def latency_share(call: list[Column | str], value: str) -> Column:
    """Each event's share of the time of the call that handled it."""
    return F.round(F.col(value) / F.count("*").over(Window.partitionBy(*call)), 6)


def notifications(events: DataFrame, position: str, per_message: int = 10) -> DataFrame:
    """message, partition, target, dedup_id: each partition's highest position, once, ten partitions a message. events: partition and the position."""
    highest = events.groupBy("partition").agg(F.max(position).alias("target"))
    at = F.row_number().over(Window.orderBy("partition")) - 1  # a row a partition
    dedup = F.concat_ws(":", F.col("partition").cast("string"), F.col("target").cast("string"))
    return highest.select(F.floor(at / per_message).cast("long").alias("message"), "partition", "target", dedup.alias("dedup_id"))


def notification_targets(messages: DataFrame) -> DataFrame:
    """partition, target, message_id of notifications (message_id, body: JSON of partition and position); others are left out."""
    x = messages.select("message_id", F.from_json("body", "partition long, position long").alias("x"))
    return x.where("x.partition is not null and x.position is not null").select(
        F.col("x.partition").alias("partition"), F.col("x.position").alias("target"), "message_id"
    )


def item_time(document: str) -> Column:
    """When an item of a change feed was written, from its document's seconds."""
    return F.timestamp_seconds(F.get_json_object(document, "$._ts").cast("double"))


def ages(rows: DataFrame, at: str) -> DataFrame:
    """rows with age_s, seconds before the newest."""
    newest = rows.agg(F.max(at).alias("__now"))
    return rows.join(F.broadcast(newest)).withColumn("age_s", F.unix_seconds("__now") - F.unix_seconds(at)).drop("__now")


def sync_stats(calls: DataFrame, outcome: str, events: str, size: str, prepare_ms: str) -> DataFrame:
    """outcome, calls, events, bytes, prepare_ms_max, prepare_ms_avg of a syncing sink's calls."""
    spent = [F.max(prepare_ms).alias("prepare_ms_max"), F.round(F.avg(prepare_ms), 6).alias("prepare_ms_avg")]
    return calls.groupBy(outcome).agg(F.count("*").alias("calls"), F.sum(events).cast("long").alias("events"), F.sum(size).cast("long").alias("bytes"), *spent)
