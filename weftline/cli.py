"""Command line: checkpoint tables, index summaries, and syncs from a source to a sink.

    python -m weftline.cli init PATH
    python -m weftline.cli checkpoint PATH [--source S --tranche T --group G --position N]
    python -m weftline.cli index EXPORT [--gaps-limit N]
    python -m weftline.cli sync stats --from-json FILE_OR_URL [--skip N --truncate N --categories C ...]
    python -m weftline.cli sync kafka TOPIC SERVERS --from-parquet PATH
    python -m weftline.cli sync table PATH --from-documents FILE
    python -m weftline.cli sync stats --from-jdbc URL --messages QUERY --category C ... --checkpoints PATH
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import codec, filters
from .functions.names import category
from .operators import index, spans
from .session import ship
from .sources.feeds import jdbc_category, poll_categories, read_json_lines
from .streaming.run import CheckpointTable
from .streaming.sinks import produce_spans

EVENT = "stream string, index long, event_type string, data string, meta string, ts timestamp"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftline")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init", help="make an empty checkpoint table").add_argument("path")
    c = sub.add_parser("checkpoint", help="show a table's positions, or override one")
    c.add_argument("path")
    for name in ("source", "tranche", "group"):
        c.add_argument(f"--{name}")
    c.add_argument("--position", type=int)
    i = sub.add_parser("index", help="summarise a table export as an index")
    i.add_argument("export")
    i.add_argument("--gaps-limit", type=int, default=10)
    s = sub.add_parser("sync", help="read a source into a sink")
    s.add_argument("sink", choices=("stats", "kafka", "table"))
    s.add_argument("target", nargs="*", help="topic and servers of the kafka sink, the path of the table sink")
    source = s.add_mutually_exclusive_group(required=True)
    source.add_argument("--from-json", metavar="FILE", help="JSON lines of events; an http(s) URL is downloaded")
    source.add_argument("--from-parquet", metavar="PATH", help="a table of events")
    source.add_argument("--from-documents", metavar="FILE", help="JSON lines of a change feed's documents")
    source.add_argument("--from-jdbc", metavar="URL", help="a database with category feeds")
    s.add_argument("--messages", help="the database's query, with {category}, {position} and {limit}")
    s.add_argument("--category", nargs="*", default=[], help="categories to poll")
    s.add_argument("--checkpoints", metavar="PATH", help="table of the polled categories' positions")
    s.add_argument("--page-size", type=int, default=500)
    s.add_argument("--skip", type=int, default=0)
    s.add_argument("--truncate", type=int)
    for name in ("categories", "deny-categories", "streams", "deny-streams", "events", "deny-events"):
        s.add_argument(f"--{name}", nargs="*", default=[])
    s.add_argument("--include-system", action="store_true")
    return p


def selected(events: DataFrame, args: argparse.Namespace) -> DataFrame:
    keep = filters.stream_filter(F.col("stream"), args.categories, args.deny_categories, args.streams, args.deny_streams, args.include_system)
    return events.where(keep).withColumn("handled", filters.event_filter(F.col("event_type"), args.events, args.deny_events))


def sync_stats(events: DataFrame) -> DataFrame:
    """Events handled and ignored by category and event type, with totals."""
    return events.withColumn("category", category(F.col("stream"))).groupingSets([["category", "event_type", "handled"], ["category", "handled"]], "category", "event_type", "handled").agg(F.count("*").alias("n")).orderBy("category", "handled", F.desc("n"))


def index_summary(spark: SparkSession, export: str) -> DataFrame:
    got = codec.export_lines(spark.read.text(export)).select("p", "i", F.size("c").cast("long").alias("n"))
    merged = spans.merge_index_spans(got)
    later = F.col("i") > 0
    q = merged.groupBy("p").agg(F.when(F.min("i") == 0, F.min_by("next", "i")).otherwise(0).alias("write_pos"), F.min(F.when(later, F.col("i"))).alias("first_i"), F.count(F.when(later, 1)).alias("n_spans"))
    return index.summary(q)


def gapped_streams(spark: SparkSession, export: str, limit: int) -> DataFrame:
    got = codec.export_lines(spark.read.text(export)).select("p", "i", F.size("c").cast("long").alias("n"))
    return index.flatten(got).where("gaps > 0").orderBy(F.desc("gaps"), "p").limit(limit)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = ship(SparkSession.builder.appName("weftline").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    if args.command in ("init", "checkpoint"):
        table = CheckpointTable(spark, args.path)
        if args.command == "init":
            table.commit(spark.createDataFrame([], "source string, tranche string, consumer_group string, position long"), 0)
        elif args.position is not None:
            table.override(args.source, args.tranche or "0", args.group, args.position)
        table.positions().show(1000, False)
    elif args.command == "index":
        index_summary(spark, args.export).show(truncate=False)
        gapped_streams(spark, args.export, args.gaps_limit).show(args.gaps_limit, False)
    else:
        if args.from_jdbc:
            read = jdbc_category(spark, {"url": args.from_jdbc}, args.messages)
            poll_categories(read, args.category, lambda page, _: sink(page, args), CheckpointTable(spark, args.checkpoints), args.from_jdbc, page_size=args.page_size)
        else:
            sink(source(spark, args), args)
    return 0


def source(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """stream, index, event_type, data, meta, ts of the source that was asked for."""
    if args.from_json:
        return read_json_lines(spark, args.from_json, EVENT, args.skip, args.truncate).select("item.*")
    if args.from_documents:
        docs = codec.document_events(spark.read.text(args.from_documents), unfolds=False)
        return docs.select("stream", "index", "event_type", "data", F.lit(None).cast("string").alias("meta"), "ts")
    given = spark.read.parquet(args.from_parquet)
    return codec.timeline_rows(given, {c: c for c in ("stream", "index", "event_type", "data", "meta", "ts") if c in given.columns})


def sink(rows: DataFrame, args: argparse.Namespace) -> None:
    events = selected(rows, args)
    if args.sink == "stats":
        sync_stats(events).show(1000, False)
    elif args.sink == "kafka":
        produce_spans(events.where("handled"), *args.target)
    else:
        events.where("handled").drop("handled").write.mode("append").parquet(args.target[0])


if __name__ == "__main__":
    sys.exit(main())
