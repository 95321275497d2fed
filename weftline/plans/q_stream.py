"""Streaming queries, run to their end; results are those of the equivalent batch queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, filters
from ..functions.names import category
from ..operators import metrics, spans, state
from ..sources.feeds import MemoryStore, all_feed, paged, poll_categories
from ..sources.tables import conversations, order_lines, table, user_events
from ..streaming import batches, buffers, indexer, run, sinks
from .catalog import query
from .q_spans import CONV, ORDER, USER, islands


def _orders(spark: SparkSession, sf_dir: str, files: int | None = None) -> DataFrame:
    """Order streams; copies of a line arrive in the order of their columns' hash."""
    x = run.read_table_stream(spark, sf_dir, "lineitem", files)
    arrival = F.xxhash64("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return x.select(
        F.concat(F.lit("Order-"), F.col("l_orderkey").cast("string")).alias("stream"),
        (F.col("l_linenumber") - 1).cast("long").alias("index"),
        F.concat("l_returnflag", "l_linestatus").alias("event_type"),
        F.col("l_partkey").cast("string").alias("data"),
        arrival.alias("arrival"),
    )


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_events(spark, sf_dir).select("stream", "index", "event_type", "data")


def _done(stream: str, events: pd.DataFrame) -> tuple[str, int]:
    return "ok", int(events["index"].iloc[-1]) + 1


def _result(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    out = run.scratch(spark, name)
    run.run_to_end(stream, out, run.scratch(spark, f"{name}-state"))
    return spark.read.schema(stream.schema).parquet(out)


@query(f"SELECT stream, CAST(i AS BIGINT) AS i, CAST(next AS BIGINT) AS index_next, 'ok' AS outcome, CAST(n AS BIGINT) AS n_events FROM {islands(ORDER)}")
def stream_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handler calls over order streams with copies and gaps: one per contiguous span."""
    return batches.project(_orders(spark, sf_dir), _done, run.scratch(spark, "project"), run.scratch(spark, "project-state"))


@query(f"SELECT stream, CAST(i AS BIGINT) AS i, CAST(next AS BIGINT) AS index_next, CAST(n AS BIGINT) AS n_events FROM {islands(ORDER)} WHERE i = 0")
def stream_gap_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With require_all only spans from event 0 on are handled; the rest waits."""
    at = run.scratch(spark, "gaps"), run.scratch(spark, "gaps-state")
    return batches.project(_orders(spark, sf_dir), _done, *at, require_all=True).select("stream", "i", "index_next", "n_events")


@query(f"SELECT stream, CAST(i AS BIGINT) AS i, CAST(next AS BIGINT) AS index_next, 'ok' AS outcome, CAST(n AS BIGINT) AS n_events FROM {islands(USER)}")
def stream_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handler calls by the stateful operator, over user streams numbered as they come."""
    e = run.read_table_stream(spark, sf_dir, "events")
    stream = F.concat(F.lit("User-"), F.col("user_id").cast("string")).alias("stream")
    numbered = run.scratch(spark, "numbered")
    run.run_to_end(buffers.sequence(e.select(stream, F.col("event_id").alias("arrival"))), numbered, run.scratch(spark, "numbered-state"))
    rows = spark.readStream.schema("stream string, arrival long, index long").parquet(numbered)
    return _result(spark, buffers.project(rows.select("stream", "index", F.lit("t").alias("event_type"), F.lit("").alias("data"), "arrival"), _done), "buffer")


@query(f"SELECT stream, event_id AS arrival, CAST(\"index\" AS BIGINT) AS \"index\" FROM {USER}")
def stream_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = F.concat(F.lit("User-"), F.col("user_id").cast("string")).alias("stream")
    e = run.read_table_stream(spark, sf_dir, "events").select(stream, F.col("event_id").alias("arrival"))
    return _result(spark, buffers.sequence(e), "sequence")


@query("SELECT DISTINCT concat('Order-', l_orderkey) AS stream, CAST(l_linenumber - 1 AS BIGINT) AS \"index\" FROM lineitem")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).select("stream", "index", F.lit("2024-01-01").cast("timestamp").alias("seen"))
    return _result(spark, buffers.deduplicate(rows, "seen").select("stream", "index"), "dedup")


@query("SELECT concat('Shard', user_id % 5) AS category, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_exactly_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro-batches appended by batch id; the same batch written twice counts once."""
    e = run.read_table_stream(spark, sf_dir, "events")
    out = run.scratch(spark, "once")
    write = sinks.append_once(out)

    def twice(df: DataFrame, batch_id: int) -> None:
        write(df, batch_id)
        write(df, batch_id)

    run.for_each_batch(e, twice, run.scratch(spark, "once-state"))
    got = spark.read.schema(e.schema).option("recursiveFileLookup", "true").parquet(out)
    shard = F.concat(F.lit("Shard"), (F.col("user_id") % 5).cast("string"))
    return got.groupBy(shard.alias("category")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"SELECT split_part(stream, '-', 1) AS category, event_type, CAST(count(*) AS BIGINT) AS n FROM {USER} GROUP BY ALL")
def stream_single_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters over one pass of the feed, in complete mode."""
    e = run.read_table_stream(spark, sf_dir, "events").withColumn("stream", F.concat(F.lit("User-"), F.col("user_id").cast("string")))
    counted = e.groupBy(category(F.col("stream")).alias("category"), "event_type").agg(F.count("*").alias("n"))
    out = run.scratch(spark, "pass")
    run.for_each_batch(counted, lambda df, _: df.write.mode("overwrite").parquet(out), run.scratch(spark, "pass-state"), mode="complete")
    return spark.read.schema(counted.schema).parquet(out)


FEED = """(SELECT event_type AS tranche, concat('User-', user_id) AS stream, event_type, props AS data, event_id,
  row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS place FROM events)"""


def _events_feed(spark: SparkSession, sf_dir: str):
    """Functions of a paged feed over the events, a tranche per event type: names, tails and page, as a store would answer."""
    return _stored_feed(spark, table(spark, sf_dir, "events").select("event_type", "event_id", "user_id", F.col("props").alias("data")))


def _stored_feed(spark: SparkSession, rows: DataFrame):
    tails = {r["event_type"]: r["n"] for r in rows.groupBy("event_type").agg(F.count("*").alias("n")).collect()}
    folder = run.scratch(spark, "feed-pages")
    rows.repartition("event_type").sortWithinPartitions("event_type", "event_id").write.partitionBy("event_type").parquet(folder)

    def page(tranche: str, at: int, limit: int) -> tuple[list[tuple], int]:
        import re

        import pyarrow.dataset as ds
        import pyarrow.fs as pafs

        fs, path = pafs.FileSystem.from_uri(re.sub(r"^(?:file:)?/(?!/)", "file:///", folder))
        kept = ds.dataset(f"{path}/event_type={tranche}", filesystem=fs, format="parquet").scanner(columns=["event_id", "user_id", "data"])
        rows = kept.to_table().sort_by("event_id").slice(at, limit).to_pylist()
        return [(f"User-{r['user_id']}", r["event_id"], tranche, r["data"]) for r in rows], at + len(rows)

    return sorted(tails), tails, page


@query(f"SELECT tranche, stream, CAST(event_id AS BIGINT) AS \"index\", data, CAST(place + 1 AS BIGINT) AS position FROM {FEED}")
def stream_feed_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paged feed, a tranche per event type, as a stream."""
    names, tails, page = _events_feed(spark, sf_dir)
    spark.dataSource.register(paged("weftline_feed", lambda: names, lambda t: tails[t], page))
    feed = spark.readStream.format("weftline_feed").option("page_size", "200000").load()
    return _result(spark, feed.select("tranche", "stream", "index", "data", "position"), "feed")


@query(f"""SELECT stream, CAST(event_id AS BIGINT) AS "index", CAST(place + 1 AS BIGINT) AS position FROM {FEED} WHERE tranche = 'click' AND
  regexp_matches(stream, '[02468]$') AND place >= 10""")
def stream_all_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store's feed of everything from a position on, in stripes that are read at once, without bodies, filtered by stream."""
    _, tails, page = _events_feed(spark, sf_dir)
    spark.dataSource.register(all_feed("weftline_all", lambda: tails["click"], lambda at, n: page("click", at, n)))
    reader = spark.read.format("weftline_all").option("page_size", "200000").option("stripe", "100000").option("data", "false")
    rows = reader.option("from", '{"0": 10}').load().where(filters.stream_filter(F.col("stream"), allow_streams=["[02468]$"]))
    return rows.where("data is null").select("stream", "index", "position")


@query(f"SELECT concat('r', split_part(stream, '-', 2)::BIGINT % 4) AS rng, stream, CAST(\"index\" AS BIGINT) AS \"index\", event_type, data FROM {CONV}")
def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document store's change feed: four ranges of documents, read page by page as a stream and taken apart to events."""
    item = F.struct("index", F.struct(F.col("event_type").alias("c"), F.col("data").alias("d")).alias("x"))
    docs = conversations(spark, sf_dir).groupBy("stream").agg(
        F.min("index").alias("i"), (F.max("index") + 1).alias("n"), F.transform(F.array_sort(F.collect_list(item)), lambda x: x["x"]).alias("e")
    )
    n = F.split_part("stream", F.lit("-"), F.lit(2)).cast("long")
    value = F.to_json(F.struct(F.col("stream").alias("p"), "i", "n", "e", F.lit(1.7e9).alias("_ts")))
    rows = docs.select(F.concat(F.lit("r"), (n % 4).cast("string")).alias("event_type"), n.alias("event_id"), n.alias("user_id"), value.alias("data"))
    names, tails, page = _stored_feed(spark, rows)
    spark.dataSource.register(paged("weftline_documents", lambda: names, lambda t: tails[t], page))
    feed = spark.readStream.format("weftline_documents").option("page_size", "100000").option("stripe", "200000").load()
    got = _result(spark, feed.select("tranche", "data"), "documents")
    ranges = got.select(F.col("tranche").alias("rng"), F.get_json_object("data", "$.p").alias("stream"))
    return codec.document_events(got, "data").join(ranges, "stream").select("rng", "stream", "index", "event_type", "data")


@query("SELECT event_id, event_type AS category, CAST(max(event_id) OVER (PARTITION BY event_type) + 1 AS BIGINT) AS checkpoint FROM events")
def category_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories polled page by page into a table, each page's checkpoint written behind it; the second round finds nothing."""
    e = table(spark, sf_dir, "events").select("event_type", "event_id", F.col("event_id").alias("position"))
    names = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").collect()]
    size = max(1, e.count() // 4)
    out, checkpoints = run.scratch(spark, "categories"), run.CheckpointTable(spark, run.scratch(spark, "category-positions"))

    def read(name: str, position: int, limit: int) -> DataFrame:
        return e.where((F.col("event_type") == name) & (F.col("position") >= position)).orderBy("position").limit(limit)

    for _ in range(2):
        poll_categories(read, names, lambda page, _: page.write.mode("append").parquet(out), checkpoints, page_size=size)
    at = checkpoints.positions().select(F.col("tranche").alias("category"), F.col("position").alias("checkpoint"))
    got = spark.read.schema(e.schema).parquet(out).withColumnRenamed("event_type", "category")
    return got.join(at, "category").select("event_id", "category", "checkpoint")


POSITIONS = "SELECT source, event_type AS tranche, CAST(max(event_id) + 1 AS BIGINT) AS position FROM (SELECT 'all' AS source, * FROM events UNION ALL SELECT 'slow', * FROM events WHERE value > 50) GROUP BY ALL"


@query(f"SELECT source, tranche, CASE WHEN source = 'slow' AND tranche = 'click' THEN 7 ELSE position END AS position FROM ({POSITIONS})")
def stream_checkpoint_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources in one checkpoint table, each kept by its query's micro-batches; a second run adds nothing, an override holds, the table is compacted."""
    e = run.read_table_stream(spark, sf_dir, "events")
    path = run.scratch(spark, "positions")
    for source, rows in (("all", e), ("slow", e.where("value > 50"))):
        table_, state_ = run.CheckpointTable(spark, path), run.scratch(spark, f"positions-{source}")

        def commit(df: DataFrame, batch_id: int, source=source, table_=table_, state_=state_) -> None:
            at = df.groupBy(F.col("event_type").alias("tranche")).agg((F.max("event_id") + 1).alias("position"))
            table_.commit(at.select(F.lit(source).alias("source"), "tranche", F.lit("g").alias("consumer_group"), "position"), batch_id, state_)

        for _ in range(2):
            run.for_each_batch(rows, commit, state_)
    last = run.CheckpointTable(spark, path)
    last.override("slow", "click", "g", 7)
    last.compact()
    return last.positions().select("source", "tranche", "position")


@query("""SELECT concat('Type-', event_type) AS stream, CAST(row_number() OVER (ORDER BY event_type) - 1 AS BIGINT) AS epoch, CAST(count(*) AS VARCHAR) AS data FROM events GROUP BY event_type""")
def memory_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store for tests: the number of events of each type committed to it, read as a stream, a batch a commit, filtered by category."""
    store = MemoryStore(spark, run.scratch(spark, "memory"))
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").cast("string").alias("n")).orderBy("event_type").collect()
    for r in counts:
        store.commit(f"Type-{r['event_type']}", [("counted", r["n"])])
    store.commit("Other-1", [("counted", None)])
    return _result(spark, store.source(["Type"]), "memory-read").select("stream", "epoch", "data")


CALLS = "SELECT stream, CAST(min(\"index\") AS BIGINT) AS i, CAST(max(\"index\") + 1 AS BIGINT) AS index_next, 'ok' AS outcome, CAST(count(*) AS BIGINT) AS n_events FROM "


@query(f"{CALLS}{USER} GROUP BY stream")
def handle_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.handle_streams(_users(spark, sf_dir), _done)


@query(f"{CALLS}{USER} GROUP BY stream, \"index\" // 4")
def sink_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stream's queue in chunks of four events at most, until it is empty."""
    return sinks.handle_chunks(_users(spark, sf_dir), _done, 4, None)


@query(f"""SELECT stream, CAST(min("index") AS BIGINT) AS i, CAST(min("index") + 1 AS BIGINT) AS index_next, concat(min(event_type), min(data)[:1]) AS outcome, CAST(1 AS BIGINT) AS n_events
  FROM (SELECT stream, "index", first_value(event_type) OVER w AS event_type, first_value(data) OVER w AS data FROM {CONV} WINDOW w AS (PARTITION BY stream ORDER BY "index")) GROUP BY stream HAVING count(*) >= 3""")
def sink_batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call for all streams with three events or more; the handler takes one event of each."""

    def handle(items: DataFrame) -> DataFrame:
        head = F.element_at("span.events", 1)
        outcome = F.concat(head["event_type"], F.substring(head["data"], 1, 1))
        return items.select("ordinal", outcome.alias("outcome"), (F.col("span.i") + 1).alias("index_next"))

    rows = conversations(spark, sf_dir).select("stream", "index", "event_type", "data")
    return sinks.handle_batched(rows, lambda p: p.groupBy("stream").count().where("count >= 3"), handle)


@query("SELECT user_id % 7 AS batch, CASE WHEN bool_or(value > 499.9) THEN 'faulted' ELSE 'completed' END AS state FROM events GROUP BY 1")
def sink_parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items handled one by one in any order; a batch is complete when all its items are, and faulted when one fails."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("batch"), "value")

    def handle(items: pd.DataFrame) -> pd.DataFrame:
        failed = items["value"] > 499.9
        return pd.DataFrame({"batch": items["batch"], "done": ~failed, "failed": failed})

    return sinks.batch_states(sinks.handle_parallel(e, handle, "batch long, done boolean, failed boolean"))


@query("""SELECT concat('Conversation-', conv_id) AS stream, CASE WHEN conv_id % 5 <> 0 THEN concat('c', conv_id) END AS key, CASE WHEN conv_id % 5 <> 0 THEN string_agg(text, '|' ORDER BY turn) END AS value,
  CASE WHEN conv_id % 5 = 0 THEN 'skipped' WHEN octet_length(encode(string_agg(text, '|' ORDER BY turn))) > 1500 THEN 'oversize' ELSE 'produced' END AS outcome, CAST(max(turn) + 1 AS BIGINT) AS index_next FROM conversations GROUP BY conv_id""")
def producer_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a producer makes of each stream's span: its own key, nothing for some streams, a mark on large messages."""

    def prepare(events: DataFrame) -> DataFrame:
        x = events.groupBy("stream").agg(F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("index", "data"))), lambda e: e["data"]), "|"
        ).alias("value"))
        n = F.split_part("stream", F.lit("-"), F.lit(2))
        return x.select("stream", F.concat(F.lit("c"), n).alias("key"), F.when(n.cast("long") % 5 != 0, F.col("value")).alias("value"))

    return sinks.prepared_messages(conversations(spark, sf_dir), prepare, 1500)


@query("""SELECT CASE WHEN user_id % 10 = 0 THEN 'failing' WHEN user_id % 10 = 1 THEN 'stuck' ELSE 'ok' END AS class, CAST(count(DISTINCT user_id) AS
  BIGINT) AS streams FROM events GROUP BY 1""")
def sink_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handlers that always fail, never progress, or succeed."""

    def handle(stream: str, events: pd.DataFrame) -> tuple[str, int]:
        kind = int(stream.split("-")[1]) % 10
        if kind == 0:
            raise RuntimeError("transient")
        return ("ok", int(events["index"].iloc[0])) if kind == 1 else _done(stream, events)

    r = sinks.handle_streams(_users(spark, sf_dir), handle).withColumn("attempt", F.lit(1))
    return metrics.counters(buffers.classify_health(r), "class").withColumnRenamed("n", "streams")


FAULTS = f"(SELECT stream, split_part(stream, '-', 2)::BIGINT % 10 AS k FROM {USER})"


@query(f"SELECT CASE WHEN k = 0 THEN 'failing' ELSE 'stuck' END AS class, stream FROM {FAULTS} WHERE k < 2 GROUP BY ALL")
def unhealthy_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of failing streams and that of stuck ones, in one."""
    e = _users(spark, sf_dir).select("stream").distinct().withColumn("k", F.split_part("stream", F.lit("-"), F.lit(2)).cast("long") % 10)
    outcome = F.when(F.col("k") == 0, "failed: x").otherwise("ok")
    r = e.select("stream", F.lit(0).alias("i"), (F.col("k") > 1).cast("int").alias("index_next"), outcome.alias("outcome"), F.lit(1).alias("attempt"))
    classes = buffers.classify_health(r)
    return classes.where("class = 'failing'").unionByName(classes.where("class = 'stuck'")).select("class", "stream")


@query(f"""SELECT CAST(split_part(stream, '-', 2) AS BIGINT) % 8 AS partition, CAST(count(*) AS BIGINT) AS events, CAST(count(DISTINCT stream) AS BIGINT) AS streams, CAST(max("index") + 1 AS BIGINT) AS longest FROM {CONV} GROUP BY 1""")
def stream_index_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns recorded in the append index by micro-batches, each delivered twice, the first turns again after that."""
    c = run.read_table_stream(spark, sf_dir, "conversations")
    name = F.concat(F.lit("Conversation-"), F.col("conv_id").cast("string")).alias("p")
    e = c.select((F.col("conv_id") % 8).alias("partition"), name, F.col("turn").alias("index"), F.col("role").alias("event_type"))
    table_ = indexer.IndexTable(spark, run.scratch(spark, "index"), epoch_streams=100)

    def twice(df: DataFrame, batch_id: int) -> None:
        for at, rows in ((2 * batch_id, df), (2 * batch_id, df), (2 * batch_id + 1, df.where("index < 2"))):
            table_.ingest(rows, at)

    run.for_each_batch(e, twice, run.scratch(spark, "index-state"))
    rows = table_.rows()
    return rows.groupBy("partition").agg(F.count("*").alias("events"), F.countDistinct("p").alias("streams"), (F.max("index") + 1).alias("longest"))


@query("SELECT user_id % 4 AS tranche, CAST(max(event_id) + 1 AS BIGINT) AS position, true AS caught_up FROM events GROUP BY 1")
def stream_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tail over the events; its positions once it has caught up."""
    e = run.read_table_stream(spark, sf_dir, "events")
    checkpoints = run.CheckpointTable(spark, run.scratch(spark, "tail-positions"))

    def handle(df: DataFrame, batch_id: int) -> None:
        at = df.groupBy((F.col("user_id") % 4).cast("string").alias("tranche")).agg((F.max("event_id") + 1).alias("position"))
        checkpoints.commit(at.select(F.lit("tail").alias("source"), "tranche", F.lit("g").alias("consumer_group"), "position"), batch_id)

    with run.Tail(e, handle, run.scratch(spark, "tail-state"), interval_s=0.2) as tail:
        caught_up = bool(tail.await_caught_up(300, fully=True))
    return checkpoints.positions().select(F.col("tranche").cast("long").alias("tranche"), "position", F.lit(caught_up).alias("caught_up"))


@query(f"""SELECT CASE WHEN n % 9 = 0 THEN 'idle' WHEN n % 9 >= 6 THEN 'full' ELSE 'active' END AS load, CAST(count(*) AS BIGINT) AS streams FROM
  (SELECT stream, count(*) AS n FROM {ORDER} GROUP BY stream) GROUP BY 1""")
def state_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams that are idle, active or full."""
    n = order_lines(spark, sf_dir).select("stream", "index").distinct().groupBy("stream").agg((F.count("*") % 9).alias("n"))
    return n.groupBy(metrics.load_class(F.col("n"), 6).alias("load")).agg(F.count("*").alias("streams"))


@query("""WITH s AS (SELECT CAST(sum(user_id % 3) AS BIGINT) AS results, CAST(sum(user_id % 5) AS BIGINT) AS dispatch, CAST(sum(event_id % 7) AS BIGINT) AS sleep FROM events)
  SELECT phase, ms, round(ms / total, 6) AS share FROM (SELECT unnest(['results', 'dispatch', 'sleep']) AS phase, unnest([results, dispatch, sleep]) AS ms, results + dispatch + sleep AS total FROM s)""")
def loop_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the time of a scheduler's loop goes."""
    e = table(spark, sf_dir, "events")
    p = e.select((F.col("user_id") % 3).alias("results"), (F.col("user_id") % 5).alias("dispatch"), (F.col("event_id") % 7).alias("sleep"))
    return metrics.duration_shares(p, ["results", "dispatch", "sleep"])


@query(f"""SELECT stream, CAST(min("index") AS BIGINT) AS i, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY
  split_part(stream, '-', 2)::BIGINT % 50 ORDER BY split_part(stream, '-', 2)::BIGINT) AS slot FROM (SELECT stream, min("index") AS "index"
  FROM {ORDER} GROUP BY stream)) WHERE slot <= 3 GROUP BY stream""")
def dispatch_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the streams that wait, by shard, those for which there is a free slot."""
    heads = order_lines(spark, sf_dir).groupBy("stream", "l_orderkey").agg(F.min("index").alias("i"))
    free = state.within_capacity(heads.withColumn("shard", F.col("l_orderkey") % 50), "shard", ["l_orderkey"], F.lit(3))
    return free.select("stream", "i", F.lit(1).cast("long").alias("n"))


@query(f"""SELECT stream, CAST(count(*) AS BIGINT) AS n_events, CAST(sum(size) AS BIGINT) AS n_bytes, CAST(min("index") AS BIGINT) AS i, CAST(max("index") + 1 AS BIGINT) AS next
  FROM (SELECT *, sum(size) OVER (PARTITION BY stream ORDER BY "index") AS b, row_number() OVER (PARTITION BY stream ORDER BY "index") AS r FROM {CONV}) WHERE r = 1 OR (r <= 4 AND b <= 1000) GROUP BY stream""")
def prepared_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of what a sink's call gets of each stream."""
    return spans.prepare(conversations(spark, sf_dir), 4, 1000)[1]


@query("""SELECT partition, event_id, CAST(sum(d) OVER (PARTITION BY partition ORDER BY event_id) AS BIGINT) AS held, sum(d) OVER (PARTITION BY partition ORDER BY event_id) > 500 AS paused
  FROM (SELECT user_id % 8 AS partition, event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END * length(props) AS d FROM events)""")
def in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes in flight by partition, and where reading pauses."""
    e = table(spark, sf_dir, "events")
    sign = F.when(F.col("event_id") % 3 == 0, -1).otherwise(1)
    d = e.select((F.col("user_id") % 8).alias("partition"), "event_id", (sign * F.length("props")).alias("d"))
    return state.in_flight(d, ["event_id"], "d", 500).select("partition", "event_id", "held", "paused")
