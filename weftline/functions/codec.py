"""JSON codecs: rendered spans, summaries, change-feed documents, raw records of external stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import DOCUMENT, RENDERED_SPAN


def render_spans(events: DataFrame, key: str = "stream") -> DataFrame:
    """stream, value: one JSON span per stream of contiguous events (index, event_type, ts, data, meta); null metadata is left out."""
    item = F.struct(
        "index",
        F.struct(
            F.col("event_type").alias("c"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("t"), F.col("data").alias("d"),
            F.col("meta").alias("m")
        ).alias("x")
    )
    spans = events.groupBy(key).agg(F.min("index").alias("i"), F.array_sort(F.collect_list(item)).alias("e"))
    return spans.select(key, F.to_json(F.struct(F.col(key).alias("s"), "i", F.transform("e", lambda x: x["x"]).alias("e"))).alias("value"))


def parse_spans(messages: DataFrame, value: str = "value") -> DataFrame:
    """stream, index, event_type, ts, data, meta of rendered spans; values that aren't spans give nothing."""
    x = messages.select(F.from_json(value, RENDERED_SPAN).alias("x")).where("x.s is not null and x.i is not null and x.e is not null")
    each = x.select(F.col("x.s").alias("stream"), F.col("x.i").alias("i"), F.posexplode("x.e").alias("k", "e"))
    return each.select(
        "stream", (F.col("i") + F.col("k")).alias("index"), F.col("e.c").alias("event_type"), F.try_to_timestamp("e.t").alias("ts"),
        F.col("e.d").alias("data"), F.col("e.m").alias("meta")
    )


def parse_summaries(messages: DataFrame, value: str = "value") -> DataFrame:
    """Unfolds of rendered summaries: all at the summary's index."""
    x = messages.select(F.from_json(value, RENDERED_SPAN.replace(" e array", " u array")).alias("x")).where("x.s is not null and x.u is not null")
    return x.select(F.col("x.s").alias("stream"), F.col("x.i").alias("index"), F.explode("x.u").alias("u")).select(
        "stream", "index", F.col("u.c").alias("event_type"), F.col("u.d").alias("data"), F.col("u.m").alias("meta")
    )


def document_events(docs: DataFrame, value: str = "value", unfolds: bool = True) -> DataFrame:
    """stream, index, is_unfold, event_type, data, ts of change-feed documents: events from i on, unfolds at n. Documents without p, i, n or e are left out."""
    x = docs.select(F.from_json(value, DOCUMENT).alias("x")).where("x.p is not null and x.i is not null and x.n is not null and x.e is not null")
    at = F.timestamp_millis((F.col("x._ts") * 1000).cast("long")).alias("ts")
    events = x.select(F.col("x.p").alias("stream"), F.col("x.i").alias("i"), at, F.posexplode("x.e").alias("k", "e"))
    out = events.select(
        "stream", (F.col("i") + F.col("k")).alias("index"), F.lit(False).alias("is_unfold"), F.col("e.c").alias("event_type"),
        F.col("e.d").alias("data"), "ts"
    )
    if unfolds:
        tail = x.select(F.col("x.p").alias("stream"), F.col("x.n").alias("index"), at, F.explode("x.u").alias("u"))
        out = out.unionByName(tail.select(
            "stream", "index", F.lit(True).alias("is_unfold"), F.col("u.c").alias("event_type"), F.col("u.d").alias("data"), "ts"
        ))
    return out


def message_records(df: DataFrame) -> DataFrame:
    """A topic's records (key, value, topic, partition, offset, in any form) as key, value and context."""
    return df.select(
        F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"),
        F.struct("topic", "partition", "offset").alias("context")
    )


def postgres_rows(df: DataFrame) -> DataFrame:
    """Rows of a category feed (position, type, data, metadata, id, time, stream_name, global_position) as stream events."""
    return df.select(
        F.col("stream_name").alias("stream"), F.col("position").alias("index"), F.col("type").alias("event_type"),
        F.coalesce("data", F.lit("null")).alias("data"), F.col("metadata").alias("meta"), F.col("id").alias("event_id"), F.col("time").alias("ts"),
        F.col("global_position").alias("position")
    )


def export_lines(df: DataFrame, value: str = "value") -> DataFrame:
    """p, i, c of a table export's JSON lines: the types of the last appended events, the index they begin at."""
    x = df.select(F.from_json(
        value, "Item struct<p:struct<S:string>, n:struct<N:string>, c:struct<L:array<struct<S:string>>>>"
    ).alias("x")).where("x.Item.p.S is not null")
    types = F.transform("x.Item.c.L", lambda t: t["S"])
    return x.select(F.col("x.Item.p.S").alias("p"), (F.col("x.Item.n.N").cast("long") - F.size(types)).alias("i"), types.alias("c"))


def change_records(df: DataFrame, index_prefix: str = "$") -> DataFrame:
    """p, i, c of table-stream records (event_name, p, n, a, c): removals, system streams and records that appended nothing are left out."""
    kept = df.where((F.col("event_name") != "REMOVE") & ~F.col("p").startswith(index_prefix) & (F.col("a") > 0))
    types = F.slice("c", -F.col("a").cast("int"), F.col("a").cast("int"))
    return kept.select("p", (F.col("n") - F.size(types)).alias("i"), types.alias("c"))


def timeline_rows(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows of any store's feed as stream events. columns: this package's names (stream, index, event_type, data, meta, event_id, ts, position) to the store's; others are null."""
    kinds = {"stream": "string", "index": "long", "event_type": "string", "data": "string", "meta": "string", "event_id": "string", "ts": "timestamp", "position": "long"}
    unknown = set(columns) - set(kinds)
    if unknown:
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    return df.select(*[(F.col(columns[c]) if c in columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])


def choose(df: DataFrame, keep: Column, **columns: Column) -> DataFrame:
    """Rows for which keep holds, as the given columns: a mapping that may leave events out."""
    return df.where(keep).select(*[c.alias(name) for name, c in columns.items()])
