"""Queries over feeds, buffers, reports of sinks and readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codec, filters
from ..functions.names import category, composed_id, id_parts, series_key
from ..operators import feeds, index, metrics, reports, spans, state
from ..sources.tables import LINE_ORDER, conversations, order_lines, table, user_events
from .catalog import query
from .q_index import RECORDED, SPANS, _recorded, _spans
from .q_spans import CONV, ORDER, USER, islands
from .q_state import DAY, KIND, PROGRESS, REQUIRED, _day, _progress, _required


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query("""SELECT user_id AS tranche, CAST(coalesce(CASE WHEN user_id % 10 = 9 THEN 42 END, CASE WHEN user_id % 3 = 0 THEN max(event_id) // 2 END, CASE
  WHEN user_id % 3 = 1 THEN max(event_id) + 1 END, min(event_id), 0) AS BIGINT) AS position FROM events GROUP BY user_id""")
def start_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Override, stored, tail or origin, by tranche."""
    t = _events(spark, sf_dir).groupBy(F.col("user_id").alias("tranche")).agg(F.max("event_id").alias("hi"), F.min("event_id").alias("lo"))
    k = F.col("tranche")
    at = feeds.start_position(F.when(k % 3 == 0, F.expr("hi div 2")), F.col("lo"), F.when(k % 10 == 9, F.lit(42)), k % 3 == 1, F.col("hi") + 1)
    return t.select("tranche", at.cast("long").alias("position"))


@query("""SELECT (event_id * 987654321) >> 28 AS stripe, CAST(count(*) AS BIGINT) AS n, CAST(min((event_id * 987654321 >> 28) * 268435456) AS BIGINT)
  AS begins FROM events GROUP BY 1""")
def stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    number, begins = feeds.stripe(F.col("event_id") * 987654321)
    return _events(spark, sf_dir).select(number.alias("stripe"), begins.alias("b")).groupBy("stripe").agg(F.count("*").alias("n"), F.min("b").alias("begins"))


@query(f"SELECT event_id, CAST(\"index\" AS BIGINT) AS \"index\" FROM {USER} WHERE stream = 'User-7' AND \"index\" >= 5 ORDER BY \"index\" LIMIT 20")
def pull_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.pull_stream(user_events(spark, sf_dir).where("user_id = 7"), "User-7", 5, 20).select("event_id", "index")


@query("""SELECT s.tranche, s.start, c.completed FROM (SELECT user_id % 16 AS tranche, CAST(max(event_id) AS BIGINT) AS start FROM events GROUP BY 1)
  s JOIN (SELECT user_id % 16 AS tranche, CAST(max(event_id) AS BIGINT) AS completed FROM events WHERE event_type = 'click' GROUP BY 1) c
  USING (tranche) WHERE c.completed <= s.start""")
def pending_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("tranche", F.col("user_id") % 16)
    return feeds.pending_work(
        e.groupBy("tranche").agg(F.max("event_id").alias("start")),
        e.where("event_type = 'click'").groupBy("tranche").agg(F.max("event_id").alias("completed"))
    )


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, epoch(ts) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events),
  w AS (SELECT user_id, event_id, r, n, s AS last, true AS is_event FROM o WHERE r = 1
    UNION ALL SELECT o.user_id, o.event_id, o.r, o.n, CASE WHEN o.s >= w.last + 86400 THEN o.s ELSE w.last END, o.s >= w.last + 86400 FROM w
      JOIN o ON o.user_id = w.user_id AND o.r = w.r + 1)
  SELECT user_id, event_id, CASE WHEN is_event THEN 'event' ELSE 'snapshot' END AS kind FROM w WHERE is_event OR r = n""")
def checkpoint_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoint updates: an event a day at most, all others in the snapshot."""
    e = _events(spark, sf_dir).select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return feeds.compact(e, ["user_id"], "ts", 86400, "event_id").select("user_id", "event_id", "kind")


@query("""SELECT user_id, CAST(n AS BIGINT) AS waiting FROM (SELECT user_id, max(ts) AS touched, count(*) FILTER (WHERE event_type = 'error') % 3 AS n
  FROM events GROUP BY user_id) WHERE n > 0 OR floor(epoch(touched)) > (SELECT max(floor(epoch(ts))) FROM events) - 3600 * 6""")
def purge_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id").agg(F.max("ts").alias("touched"), (F.count(F.when(F.col("event_type") == "error", 1)) % 3).alias("waiting"))
    now = e.agg(F.max("ts").alias("now"))
    return feeds.purge(s.join(F.broadcast(now)), F.col("now"), 3600 * 6).select("user_id", "waiting")


@query(f"""SELECT p, CAST(i AS BIGINT) AS i, CAST(greatest(i, w) AS BIGINT) AS "from", CAST(greatest(0, i + n - greatest(i, w)) AS BIGINT) AS n_left
  FROM (SELECT *, l_orderkey % 4 AS w FROM {SPANS})""")
def choose_unwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    begin, left = feeds.choose_unwritten(F.col("i"), F.col("n"), F.col("l_orderkey") % 4)
    return _spans(spark, sf_dir).select("p", "i", begin.alias("from"), left.alias("n_left"))


@query(f"""WITH x AS (SELECT s.p, s.i, s.n, l_orderkey % 4 AS partition, coalesce(version, 0) AS v, version FROM {SPANS} s LEFT JOIN (SELECT p, max("index") + 1 AS version FROM {RECORDED} GROUP BY p) USING (p)),
  k AS (SELECT *, CASE WHEN i + n <= v THEN 'discard' WHEN i > v THEN 'gap' WHEN version IS NULL THEN 'start' ELSE 'append' END AS kind, i + n
    - v AS fresh FROM x)
  SELECT partition, p, CAST(i AS BIGINT) AS i, n, kind, CAST(CASE WHEN kind IN ('start', 'append') AND partition <> 1 THEN fresh ELSE 0 END AS BIGINT) AS accepted, CAST(CASE WHEN kind IN ('start', 'append') AND partition = 1 THEN fresh ELSE 0 END AS BIGINT) AS residual FROM k""")
def ingest_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = index.versions(_recorded(spark, sf_dir).select("p", F.col("index").alias("i"), F.lit(1).alias("n")))
    closed = spark.range(4).select(F.col("id").alias("partition"), (F.col("id") == 1).alias("closed"))
    return feeds.decide_ingest(_spans(spark, sf_dir).withColumn("partition", F.col("l_orderkey") % 4), v, closed)


@query(f"""WITH u AS (SELECT {DAY} AS batch, user_id, "index", event_id % 5 = 0 AS is_unfold FROM {USER})
  SELECT batch, user_id, CAST(count(*) FILTER (WHERE NOT is_unfold) AS BIGINT) AS n_events, CAST(count(*) FILTER (WHERE is_unfold AND "index" = top) AS BIGINT) AS n_unfolds FROM (SELECT *, max(CASE WHEN is_unfold THEN "index" END) OVER (PARTITION BY batch, user_id) AS top FROM u) GROUP BY batch, user_id""")
def batch_unfolds(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = user_events(spark, sf_dir).select(_day().alias("batch"), "user_id", "index", (F.col("event_id") % 5 == 0).alias("is_unfold"))
    kept = feeds.last_unfolds(u, ["batch", "user_id"])
    return kept.groupBy("batch", "user_id").agg(
        metrics.count_if(~F.col("is_unfold")).alias("n_events"), metrics.count_if(F.col("is_unfold")).alias("n_unfolds")
    )


@query(f"""SELECT u.stream, CAST(count(*) AS BIGINT) AS handled FROM {USER} u JOIN {PROGRESS} p USING (stream) WHERE u."index" < p.write_pos GROUP BY
  u.stream""")
def handled_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _progress(_required(spark, sf_dir)).withColumnRenamed("write_pos", "index_next")
    return feeds.handled_prefix(user_events(spark, sf_dir).select("stream", "index"), p).groupBy("stream").agg(F.count("*").alias("handled"))


@query(f"""SELECT CAST(count(DISTINCT split_part(stream, '-', 1)) AS BIGINT) AS categories, CAST(count(*) AS BIGINT) AS streams, CAST(sum(n) AS BIGINT)
  AS events, CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT stream, count(*) AS n, sum(size) AS bytes FROM {CONV} GROUP BY stream)""")
def buffer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = conversations(spark, sf_dir).groupBy("stream").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    return c.agg(
        F.countDistinct(category(F.col("stream"))).alias("categories"), F.count("*").alias("streams"), F.sum("n").alias("events"),
        F.sum("bytes").alias("bytes")
    )


@query(f"SELECT stream, CAST(sum(size) AS BIGINT) AS bytes FROM {CONV} GROUP BY stream ORDER BY bytes DESC, stream LIMIT 5")
def buffer_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.top(conversations(spark, sf_dir).groupBy("stream").agg(F.sum("size").alias("bytes")), "bytes", 5, "stream")


@query(f"""SELECT user_id % 5 AS shard, CAST(count(*) FILTER (WHERE {KIND} = 'ok') AS BIGINT) AS ok, CAST(count(*) FILTER (WHERE {KIND} = 'exception')
  AS BIGINT) AS failed, CAST(count(*) FILTER (WHERE {KIND} = 'rate_limited') AS BIGINT) AS limited FROM events GROUP BY 1""")
def sink_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("kind", metrics.outcome_kind(F.col("event_type"), F.col("value"), 40))
    p = e.groupBy((F.col("user_id") % 5).alias("shard")).pivot("kind", ["ok", "exception", "rate_limited"]).count()
    return p.select("shard", *[F.coalesce(F.col(a), F.lit(0)).alias(b) for a, b in (("ok", "ok"), ("exception", "failed"), ("rate_limited", "limited"))])


@query(f"""SELECT CAST(count(*) AS BIGINT) AS ops, CAST(sum(CASE WHEN d > 0 THEN 0 ELSE 1 END) AS BIGINT) AS nops, CAST(sum(d) AS BIGINT) AS deleted,
  CAST(sum(n - d) AS BIGINT) AS deferred FROM (SELECT stream, count(*) AS n, count(*) FILTER (WHERE "index" <= CAST(split_part(stream, '-',
  2) AS BIGINT) % 4 - 1) AS d FROM {CONV} GROUP BY stream)""")
def pruner_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = conversations(spark, sf_dir).withColumn("until", F.split_part("stream", F.lit("-"), F.lit(2)).cast("long") % 4 - 1)
    per = c.groupBy("stream").agg(F.count("*").alias("n"), metrics.count_if(F.col("index") <= F.col("until")).alias("d"))
    return per.agg(
        F.count("*").alias("ops"), metrics.count_if(F.col("d") == 0).alias("nops"), F.sum("d").alias("deleted"),
        F.sum(F.col("n") - F.col("d")).alias("deferred")
    )


@query("""SELECT CAST(floor(epoch(ts)) AS BIGINT) // 3600 AS hour, CAST(count(*) AS BIGINT) AS events, CAST(count(DISTINCT user_id) AS BIGINT) AS
  streams FROM events GROUP BY 1""")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    w = e.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("streams"))
    return w.select(F.floor(F.unix_seconds("w.start") / 3600).cast("long").alias("hour"), "events", "streams")


@query("""SELECT user_id % 8 AS partition, CAST(count(*) AS BIGINT) AS weight, CAST(rank() OVER (ORDER BY count(*) DESC, user_id % 8) AS INTEGER) AS
  place FROM events GROUP BY 1""")
def partition_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _events(spark, sf_dir).groupBy((F.col("user_id") % 8).alias("partition")).agg(F.count("*").alias("weight"))
    return p.withColumn("place", F.rank().over(Window.orderBy(F.desc("weight"), "partition")))


@query("""SELECT CAST(max(CASE WHEN event_type = 'view' THEN event_id END) AS BIGINT) AS read_epoch, CAST(max(CASE WHEN event_type = 'click' THEN
  event_id END) AS BIGINT) AS validated_epoch, CAST(max(CASE WHEN event_type = 'purchase' THEN event_id END) AS BIGINT) AS committed_epoch,
  CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS failures FROM events""")
def ingester_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = lambda t, name: F.max(F.when(F.col("event_type") == t, F.col("event_id"))).alias(name)
    return _events(spark, sf_dir).agg(
        last("view", "read_epoch"), last("click", "validated_epoch"), last("purchase", "committed_epoch"),
        metrics.count_if(F.col("event_type") == "error").alias("failures")
    )


@query("""SELECT user_id % 6 AS rng, CAST(count(*) AS BIGINT) AS docs, round(sum(value), 4) AS cost, CAST(count(*) FILTER (WHERE value > 40) AS
  BIGINT) AS lag, count(*) FILTER (WHERE value > 90) = 0 AS synced FROM events GROUP BY 1""")
def changefeed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.changefeed_stats(_events(spark, sf_dir), F.col("user_id") % 6, F.col("value"), F.col("value") > 40, F.col("value") > 90)


@query("""SELECT CAST(count(*) AS BIGINT) AS events, CAST(sum(length(props)) AS BIGINT) AS bytes, round(sum(length(props)) / (max(floor(epoch(ts))) -
  min(floor(epoch(ts)))), 6) AS bytes_per_s FROM events""")
def reader_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    return _events(spark, sf_dir).agg(
        F.count("*").alias("events"), F.sum(F.length("props")).cast("long").alias("bytes"),
        F.round(F.sum(F.length("props")) / (F.max(s) - F.min(s)), 6).alias("bytes_per_s")
    )


@query("""SELECT event_type AS label, max_by(value, event_id) AS gauge, CAST(count(*) AS BIGINT) AS counter, round(sum(value), 4) AS total FROM events
  GROUP BY event_type""")
def labelled_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.gauges(_events(spark, sf_dir).withColumn("label", F.col("event_type")), ["label"], "value", "event_id")


@query(f"""SELECT tag, CAST(count(*) AS BIGINT) AS n, min(value) AS min, max(value) AS max FROM (SELECT CASE WHEN {KIND} = 'ok' THEN concat('Shard',
  user_id % 5) ELSE {KIND} END AS tag, value FROM events) GROUP BY tag""")
def outcome_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successes by category, all else by kind."""
    e = _events(spark, sf_dir).withColumn("kind", metrics.outcome_kind(F.col("event_type"), F.col("value"), 40))
    return reports.outcome_latency(e, "kind", F.concat(F.lit("Shard"), (F.col("user_id") % 5).cast("string")), "value")


@query(f"SELECT event_id, round(value / count(*) OVER (PARTITION BY user_id, {DAY}), 6) AS share FROM events")
def latency_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", reports.latency_share(["user_id", _day()], "value").alias("share"))


@query(f"""SELECT r.batch, r.stream, CAST(r.required - p.write_pos AS BIGINT) AS behind FROM {REQUIRED} r JOIN {PROGRESS} p USING (stream) WHERE
  r.batch = (SELECT min(batch) FROM {REQUIRED}) AND p.write_pos < r.required ORDER BY behind DESC, stream LIMIT 10""")
def slow_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _required(spark, sf_dir)
    head = r.join(F.broadcast(r.agg(F.min("batch").alias("batch"))), "batch")
    late = state.requirements(head, _progress(r)).select("batch", "stream", (F.col("required") - F.col("write_pos")).alias("behind"))
    return metrics.top(late, "behind", 10, "stream")


@query(f"""SELECT DISTINCT s.stream FROM (SELECT stream FROM {CONV} WHERE "index" % 3 = 1) s WHERE NOT EXISTS (SELECT 1 FROM {CONV} c WHERE c.stream =
  s.stream AND c.event_type = 'system')""")
def loads_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams wanted less those cached."""
    c = conversations(spark, sf_dir)
    return c.where("index % 3 = 1").select("stream").join(c.where("event_type = 'system'").select("stream"), "stream", "left_anti").distinct()


@query(f"SELECT stream, CAST(i AS BIGINT) AS i, CAST(next AS BIGINT) AS next, CAST(n AS BIGINT) AS n FROM {islands(ORDER)}")
def merge_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two buffers with streams and events in common, merged: between them they hold every line."""
    o = order_lines(spark, sf_dir)
    return spans.merge_events(o.where("partkey % 2 = 0 or suppkey % 3 = 0").unionByName(o.where("partkey % 2 = 1 or suppkey % 5 = 0")), LINE_ORDER)


@query("""SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS at_s, CAST((SELECT max(floor(epoch(ts))) FROM events) - floor(epoch(ts)) AS BIGINT) AS
  age_s FROM events""")
def item_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed items' times from their seconds field, and their ages at the newest."""
    e = _events(spark, sf_dir).select("event_id", F.to_json(F.struct(F.unix_seconds(F.col("ts").cast("timestamp")).alias("_ts"))).alias("j"))
    t = e.select("event_id", reports.item_time("j").alias("at"))
    return reports.ages(t, "at").select("event_id", F.unix_seconds("at").alias("at_s"), "age_s")


@query("""SELECT user_id % 4 AS partition, CAST(count(*) FILTER (WHERE seq >= 100 AND event_type <> 'signup') AS BIGINT) AS n, CAST(max(seq) + 1 AS BIGINT) AS version, bool_or(event_type = 'signup') AS closed
  FROM (SELECT *, event_id % 500 AS seq FROM events WHERE event_id // 500 = user_id % 4) GROUP BY 1""")
def epoch_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of one epoch of each partition from a sequence number on, its version, and whether it has been closed."""
    kind = F.when(F.col("event_type") == "signup", "closed").otherwise("change").alias("kind")
    c = _events(spark, sf_dir).select(
        (F.col("user_id") % 4).alias("partition"), F.expr("event_id div 500").alias("epoch"), (F.col("event_id") % 500).alias("seq"), kind
    )
    return index.read_epoch(c, F.col("partition"), F.lit(100)).select("partition", "n", "version", "closed")


@query("""SELECT DISTINCT user_id % 8 AS partition, CAST(max(event_id) OVER (PARTITION BY user_id % 8, event_id // 1000) AS BIGINT) AS target,
  CAST(event_id // 1000 AS VARCHAR) AS message_id FROM events""")
def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target positions by partition and message, from the messages' JSON; other messages are left out."""
    e = _events(spark, sf_dir).select((F.col("user_id") % 8).alias("partition"), F.expr("event_id div 1000").cast("string").alias("message_id"), "event_id")
    sent = e.groupBy("partition", "message_id").agg(F.max("event_id").alias("position"))
    bodies = sent.select("message_id", F.to_json(F.struct("partition", "position")).alias("body"))
    other = spark.createDataFrame([("x", "no body"), ("y", None)], bodies.schema)
    return reports.notification_targets(bodies.unionByName(other))


@query("""SELECT (row_number() OVER (ORDER BY partition) - 1) // 10 AS message, partition, target, concat(partition, ':', target) AS dedup_id
  FROM (SELECT user_id % 32 AS partition, CAST(max(event_id) AS BIGINT) AS target FROM events GROUP BY 1)""")
def notifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each partition's highest position, ten partitions a message."""
    return reports.notifications(_events(spark, sf_dir).withColumn("partition", F.col("user_id") % 32), "event_id")


@query("""SELECT event_type, CAST(count(*) AS BIGINT) AS calls, CAST(sum(user_id % 7) AS BIGINT) AS events, CAST(sum(length(props)) AS BIGINT) AS bytes, max(value) AS prepare_ms_max, round(avg(value), 6) AS prepare_ms_avg
  FROM events GROUP BY event_type""")
def sync_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of a syncing sink by outcome, with the time that preparing took."""
    e = _events(spark, sf_dir).select("event_type", (F.col("user_id") % 7).alias("n"), F.length("props").alias("size"), "value")
    return reports.sync_stats(e, "event_type", "n", "size", "value")


@query("""SELECT line FROM (SELECT concat('feed_events_total{event_type="', event_type, '",shard="', user_id % 3, '"} ', count(*)) AS line FROM events GROUP BY event_type, user_id % 3
  UNION ALL SELECT '# TYPE feed_events_total counter')""")
def exposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters with labels in the text format of metrics scrapers."""
    e = _events(spark, sf_dir).groupBy("event_type", (F.col("user_id") % 3).alias("shard")).agg(F.count("*").alias("value"))
    return metrics.exposition(e, "feed_events_total", "counter", ["event_type", "shard"])


@query("""SELECT le, bounds, CAST(count(*) FILTER (WHERE value / 100 <= le) AS BIGINT) AS n FROM events,
  (SELECT 'handlers' AS bounds, 0.001 * power(2, unnest(range(0, 16))) AS le UNION ALL SELECT 'charges', CAST(power(2, unnest(range(0, 9))) AS DOUBLE)) GROUP BY ALL""")
def histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histograms of handlers' latencies and of request charges."""
    e = _events(spark, sf_dir).select((F.col("value") / 100).alias("v"))
    of = lambda name, bounds: metrics.histogram(e, "v", bounds).withColumn("bounds", F.lit(name))
    return of("handlers", metrics.HANDLER_BUCKETS).unionByName(of("charges", metrics.CHARGE_BUCKETS))


@query("""SELECT concat('Order-', o_orderkey, '_', o_custkey) AS stream, CAST(o_orderkey AS VARCHAR) AS first, CAST(o_custkey AS VARCHAR) AS second
  FROM orders WHERE o_orderstatus <> 'F'""")
def composed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of several parts, composed and taken apart; a mapping that leaves some orders out."""
    o = table(spark, sf_dir, "orders")
    name = F.concat(F.lit("Order-"), composed_id(F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")))
    some = codec.choose(o, F.col("o_orderstatus") != "F", stream=name)
    parts = id_parts(F.col("stream"))
    return some.select("stream", parts[0].alias("first"), parts[1].alias("second"))


@query(f"SELECT stream, CAST(event_id AS BIGINT) AS position, CAST(\"index\" AS BIGINT) AS \"index\", event_type, data FROM {USER}")
def timeline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store's rows under its own names as stream events."""
    theirs = user_events(spark, sf_dir).select(
        F.col("stream").alias("StreamId"), F.col("index").alias("Version"), F.col("event_type").alias("Type"), F.col("data").alias("Json"),
        F.col("event_id").alias("Checkpoint")
    )
    names = {"stream": "StreamId", "index": "Version", "event_type": "Type", "data": "Json", "position": "Checkpoint"}
    return codec.timeline_rows(theirs, names).select("stream", "position", "index", "event_type", "data")


@query(f"SELECT stream, CAST(\"index\" AS BIGINT) AS \"index\", event_type FROM {CONV}")
def strip_unfolds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events without the unfolds beside them."""
    c = conversations(spark, sf_dir).select("stream", "index", "event_type")
    both = c.withColumn("is_unfold", F.lit(False)).unionByName(c.withColumn("is_unfold", F.lit(True)))
    return spans.strip_unfolds(both).select("stream", "index", "event_type")


@query("""SELECT DISTINCT event_type AS source, CASE WHEN user_id % 2 = 0 THEN '' ELSE CAST(user_id % 4 AS VARCHAR) END AS tranche, CASE WHEN user_id
  % 2 = 0 THEN event_type ELSE concat(event_type, '_', user_id % 4) END AS series FROM events""")
def checkpoint_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select(
        F.col("event_type").alias("source"), F.when(F.col("user_id") % 2 == 0, "").otherwise((F.col("user_id") % 4).cast("string")).alias("tranche")
    ).distinct()
    return e.select("source", "tranche", series_key(F.col("source"), F.col("tranche")).alias("series"))


@query(f"""SELECT stream, CAST("index" AS BIGINT) AS "index", event_type FROM {CONV} WHERE stream = 'Conversation-3' OR (split_part(stream, '-', 1) IN
  ('Conversation', 'Order') AND event_type = 'user')""")
def parser_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one stream, or of a list of categories."""
    c = conversations(spark, sf_dir)
    listed = filters.stream_filter(F.col("stream"), ["Conversation", "Order"]) & (F.col("event_type") == "user")
    return c.where((F.col("stream") == "Conversation-3") | listed).select("stream", "index", "event_type")


@query(f"""WITH u AS (SELECT stream, "index", event_id % 4 = 3 AS with_unfold FROM {USER}), s AS (SELECT stream, max("index") + 1 AS next, max(CASE WHEN with_unfold THEN "index" + 1 END) AS unfold_at, count(*) FILTER (WHERE with_unfold) AS revision FROM u GROUP BY stream)
  SELECT stream, CAST(next AS BIGINT) AS next, CAST(revision AS BIGINT) AS revision, coalesce(unfold_at = next, false) AS has_unfold FROM s""")
def unfold_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a stream's last unfold has changed, and whether one is valid at its tail."""
    u = user_events(spark, sf_dir).select("stream", "index", (F.col("event_id") % 4 == 3).alias("u"))
    s = u.groupBy("stream").agg(
        (F.max("index") + 1).alias("next"), F.max(F.when(F.col("u"), F.col("index") + 1)).alias("at"), metrics.count_if(F.col("u")).alias("revision")
    )
    return s.select("stream", "next", "revision", F.coalesce(F.col("at") == F.col("next"), F.lit(False)).alias("has_unfold"))
