"""Spans: contiguous runs of a stream's events, merged from copies and fragments.

All operators deal rows out by stream once; the windows and the aggregate after that share the exchange and the sort.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered_islands(events: DataFrame, arrival: Sequence[str], key: str = "stream") -> DataFrame:
    """One copy of each (stream, index), the first by arrival, with its island: rows of an island have contiguous indices."""
    w = Window.partitionBy(key).orderBy("index", *arrival)
    ranked = events.withColumn("__before", F.lag("index").over(w)).withColumn("__rank", F.dense_rank().over(w_index(key)))
    kept = ranked.where(F.col("__before").isNull() | (F.col("__before") != F.col("index")))
    return kept.withColumn("island", F.col("index") - F.col("__rank")).drop("__before", "__rank")


def w_index(key: str = "stream"):
    return Window.partitionBy(key).orderBy("index")


def merge_events(events: DataFrame, arrival: Sequence[str], min_position: Column | None = None, key: str = "stream", bucket: int | None = None) -> DataFrame:
    """stream, i, next, n: disjoint ordered spans of the events at or after min_position (of their row).

    bucket: for streams so long that one task can't hold them. Stretches of so many indices are merged apart, then the few
    spans of each stream are joined where they touch.
    """
    rows = events if min_position is None else events.where(F.col("index") >= min_position)
    if bucket:
        part = rows.withColumn("__part", F.struct(F.col(key).alias("k"), F.floor(F.col("index") / bucket).alias("b")))
        short = merge_events(part, arrival, key="__part").select(F.col("__part.k").alias(key), "i", "n")
        return merge_index_spans(short, key).withColumn("n", F.col("next") - F.col("i"))
    spans = numbered_islands(rows, arrival, key).groupBy(key, "island").agg(F.min("index").alias("i"), F.count("*").alias("n"))
    return spans.select(key, "i", (F.col("i") + F.col("n")).alias("next"), "n")


def merge_spans(rows: DataFrame, key: Sequence[str] = ("stream",)) -> DataFrame:
    """Merge input spans with unfolds; rows: key, min, span_no (arrival), index, is_unfold, event_type, and pos for the order of unfolds in their span.

    Below min nothing stays. The copy of an event in the span that begins first (then arrived first) stays. Unfolds stay only at the
    very end, those of the span that begins last (then arrived last); they go to the span that ends there. Result: key, out_i (the
    span's first index), index, is_unfold, event_type, pos, span_no. Streams with nothing left give no rows.
    """
    key = list(key)
    whole = Window.partitionBy(*key)
    # All windows partition by the key and more, so that they share this exchange.
    live = rows.where(F.col("index") >= F.col("min")).repartition(*key)
    end = F.when(F.col("is_unfold"), F.col("index")).otherwise(F.col("index") + 1)
    live = live.withColumns({"span_i": F.min("index").over(Window.partitionBy(*key, "span_no")), "top": F.max(end).over(whole)})
    span = F.struct("span_i", "span_no")
    last = F.col("is_unfold") & (F.col("index") == F.col("top"))
    copy = F.row_number().over(Window.partitionBy(*key, "is_unfold", "index").orderBy("span_i", "span_no"))
    live = live.withColumns({"copy": copy, "latest": F.max(F.when(last, span)).over(whole)})
    live = live.where(F.when(F.col("is_unfold"), last & (F.col("latest") == span)).otherwise(F.col("copy") == 1))
    island = F.col("index") - F.row_number().over(Window.partitionBy(*key, "is_unfold").orderBy("index"))
    live = live.withColumn("island", F.when(~F.col("is_unfold"), island))
    live = live.withColumn("out_i", F.min("index").over(Window.partitionBy(*key, "is_unfold", "island")))
    host = F.max(F.when(~F.col("is_unfold") & (F.col("index") + 1 == F.col("top")), F.col("out_i"))).over(whole)
    out_i = F.when(F.col("is_unfold"), F.coalesce(host, F.col("index"))).otherwise(F.col("out_i"))
    return live.withColumn("out_i", out_i).select(*key, "out_i", "index", "is_unfold", "event_type", "pos", "span_no")


def drop_before(rows: DataFrame, position: Column) -> DataFrame:
    """Events and unfolds at or after the position."""
    return rows.where(F.col("index") >= position)


def strip_unfolds(rows: DataFrame) -> DataFrame:
    """Events alone."""
    return rows.where(~F.col("is_unfold"))


def slice_prefix(events: DataFrame, max_events: int, max_bytes: int, key: str = "stream") -> DataFrame:
    """Each stream's longest prefix within both budgets, at least one event."""
    w = w_index(key)
    run = Window.partitionBy(key).orderBy("index").rowsBetween(Window.unboundedPreceding, 0)
    ranked = events.withColumn("ordinal", F.row_number().over(w)).withColumn("bytes_to_here", F.sum("size").over(run))
    return ranked.where((F.col("ordinal") == 1) | ((F.col("ordinal") <= max_events) & (F.col("bytes_to_here") <= max_bytes)))


def prepare(events: DataFrame, max_events: int, max_bytes: int, key: str = "stream") -> tuple[DataFrame, DataFrame]:
    """What a sink's call gets of each stream: its events within both budgets, and their metrics (key, n_events, n_bytes, i, next)."""
    trimmed = slice_prefix(events, max_events, max_bytes, key).drop("ordinal", "bytes_to_here")
    i, after = F.min("index").alias("i"), (F.max("index") + 1).alias("next")
    return trimmed, trimmed.groupBy(key).agg(F.count("*").alias("n_events"), F.sum("size").cast("long").alias("n_bytes"), i, after)


def chunk_queue(events: DataFrame, max_events: int, max_bytes: int, key: str = "stream") -> DataFrame:
    """stream, chunk_no, i, next, bytes: the whole queue cut greedily; each chunk is the longest within both budgets, at least one event.

    Rows reach a task in order of stream and index, and are cut as they come: a task holds one Arrow batch, however long a stream is.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None  # key, chunk_no, i, n, bytes
        for batch in batches:
            out: list[list] = []
            for k, index, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is not None and now[0] == k and now[3] < max_events and now[4] + size <= max_bytes:
                    now[3] += 1
                    now[4] += size
                    continue
                if now is not None:
                    out.append(now)
                now = [k, now[1] + 1 if now is not None and now[0] == k else 0, index, 1, size]
            yield _chunks(out, key)
        if now is not None:
            yield _chunks([now], key)

    rows = events.select(F.col(key).cast("string").alias(key), F.col("index").cast("long"), F.col("size").cast("long"))
    ordered = rows.repartition(key).sortWithinPartitions(key, "index")
    return ordered.mapInArrow(cut, f"{key} string, chunk_no int, i long, next long, bytes long")


def _chunks(rows: list[list], key: str) -> pa.RecordBatch:
    name, no, i, n, size = zip(*rows, strict=True) if rows else [()] * 5
    after = [a + b for a, b in zip(i, n, strict=True)]
    columns = [pa.array(name, pa.string()), pa.array(no, pa.int32()), *(pa.array(x, pa.int64()) for x in (i, after, size))]
    return pa.RecordBatch.from_arrays(columns, [key, "chunk_no", "i", "next", "bytes"])


def numbered(rows: DataFrame, bucket: Column, *order: Column | str) -> DataFrame:
    """rows with number, from 0, in order of bucket and then of order. bucket: a column that grows with the order and cuts it into parts that a task can sort.

    Parts are counted first and numbered apart; what is gathered is a row a part.
    """
    parts = rows.groupBy(bucket.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    begins = parts.select("__part", F.coalesce(before, F.lit(0)).alias("__begin"))
    placed = rows.withColumn("__part", bucket).join(begins, "__part")
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return placed.withColumn("number", (F.col("__begin") + within).cast("long")).drop("__part", "__begin")


def sequence_index(rows: DataFrame, arrival: Sequence[str], key: str = "stream") -> DataFrame:
    """index from 0 per stream in order of arrival."""
    return rows.withColumn("index", (F.row_number().over(Window.partitionBy(key).orderBy(*arrival)) - 1).cast("long"))


def merge_index_spans(spans: DataFrame, key: str = "p") -> DataFrame:
    """p, i, next: index spans (i, n) joined where they overlap or touch."""
    before = Window.partitionBy(key).orderBy("i", "n").rowsBetween(Window.unboundedPreceding, -1)
    ends = spans.withColumn("end", F.col("i") + F.col("n")).withColumn("reach", F.max("end").over(before))
    new = (F.col("reach").isNull() | (F.col("i") > F.col("reach"))).cast("int")
    run = Window.partitionBy(key).orderBy("i", "n").rowsBetween(Window.unboundedPreceding, 0)
    return ends.withColumn("island", F.sum(new).over(run)).groupBy(key, "island").agg(F.min("i").alias("i"), F.max("end").alias("next")).drop("island")
