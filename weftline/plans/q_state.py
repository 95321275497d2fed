"""Queries over scheduling state, metrics and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import category, span_label
from ..functions.positions import next_due
from ..operators import metrics, reports, spans, state
from ..sources.tables import LINE_ORDER, order_lines, table, user_events
from .catalog import query
from .q_spans import ORDER, USER, islands

#: Write positions of order streams, as a fixture: known for two thirds of them.
WRITE = "CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_orderkey % 2 END"
HEADS = f"(SELECT stream, min_by(i, i) AS i, min_by(next, i) AS next, min_by(n, i) AS n, count(*) AS n_spans, sum(n) AS n_events, CAST(split_part(stream, '-', 2) AS BIGINT) AS l_orderkey FROM {islands(ORDER)} GROUP BY stream)"
DAY = "CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT)"


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = spans.merge_events(order_lines(spark, sf_dir), LINE_ORDER)
    key = F.split_part("stream", F.lit("-"), F.lit(2)).cast("long")
    return state.head_spans(merged).withColumn("l_orderkey", key).withColumn("write_pos", F.when(key % 3 != 0, key % 2))


def _day() -> F.Column:
    return F.datediff(F.to_date("ts"), F.lit("2024-01-01")).cast("long")


@query(f"SELECT stream, CAST(i AS BIGINT) AS i, CAST(next AS BIGINT) AS next, CAST(n AS BIGINT) AS n FROM {HEADS} WHERE i = coalesce({WRITE}, 0)")
def require_all_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _heads(spark, sf_dir).where(state.dispatchable(True, F.col("i"), F.col("write_pos"))).select("stream", "i", "next", "n")


@query(f"""SELECT state, CAST(count(*) AS BIGINT) AS streams, CAST(sum(n_events) AS BIGINT) AS events, CAST(count(DISTINCT l_orderkey % 7) AS BIGINT) AS categories FROM (
  SELECT *, CASE WHEN l_orderkey % 11 = 0 THEN 'busy' WHEN l_orderkey % 13 = 0 THEN 'malformed' WHEN i > coalesce({WRITE}, 0) THEN 'waiting' ELSE 'ready' END AS state FROM {HEADS}) GROUP BY state""")
def state_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, key = _heads(spark, sf_dir), F.col("l_orderkey")
    named = h.withColumn("state", state.stream_class(F.col("i"), F.col("write_pos"), key % 11 == 0, key % 13 == 0)).withColumn("category", key % 7)
    return state.state_report(named)


def _required(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_events(spark, sf_dir).groupBy(_day().alias("batch"), "stream", "user_id").agg(
        (F.max("index") + 1).alias("required"), F.count("*").alias("weight")
    )


REQUIRED = f"(SELECT {DAY} AS batch, stream, user_id, CAST(max(\"index\") + 1 AS BIGINT) AS required, CAST(count(*) AS BIGINT) AS weight FROM {USER} GROUP BY ALL)"
PROGRESS = f"(SELECT stream, CAST(floor(max(required) * (user_id % 4) / 3.0) AS BIGINT) AS write_pos FROM {REQUIRED} GROUP BY stream, user_id)"


def _progress(required: DataFrame) -> DataFrame:
    """A fixture: streams have handled none, a third, two thirds or all of their events."""
    return required.groupBy("stream", "user_id").agg(F.max("required").alias("m")).select(
        "stream", F.floor(F.col("m") * (F.col("user_id") % 4) / 3.0).cast("long").alias("write_pos")
    )


@query(f"SELECT batch, stream, required, write_pos FROM {REQUIRED} JOIN {PROGRESS} USING (stream) WHERE write_pos < required")
def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _required(spark, sf_dir)
    return state.requirements(r, _progress(r)).select("batch", "stream", "required", "write_pos")


@query(f"""SELECT batch, CAST(count(*) AS BIGINT) AS open FROM {REQUIRED} r WHERE NOT EXISTS (SELECT 1 FROM {PROGRESS} p WHERE p.stream = r.stream AND
  p.write_pos >= r.required) GROUP BY batch""")
def progress_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _required(spark, sf_dir)
    return state.remove_attained(r, _progress(r)).groupBy("batch").agg(F.count("*").alias("open"))


@query(f"""WITH r AS (SELECT * FROM {REQUIRED}), p AS (SELECT stream, CASE WHEN user_id % 2 = 0 THEN max(required) ELSE min(required) + 20 END AS write_pos FROM r GROUP BY stream, user_id),
  o AS (SELECT batch, bool_and(write_pos >= required) AS done FROM r JOIN p USING (stream) GROUP BY batch)
  SELECT batch, done, coalesce(batch < (SELECT min(batch) FROM o WHERE NOT done), true) AS completed FROM o""")
def batch_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _required(spark, sf_dir)
    p = r.groupBy("stream", "user_id").agg(F.max("required").alias("a"), F.min("required").alias("b")).select(
        "stream", F.when(F.col("user_id") % 2 == 0, F.col("a")).otherwise(F.col("b") + 20).alias("write_pos")
    )
    return state.batch_completion(r, state.remove_attained(r, p))


@query(f"""WITH r AS (SELECT * FROM {REQUIRED}), o AS (SELECT stream, min(batch) AS batch, min_by(weight, batch) AS weight FROM r GROUP BY stream)
  SELECT stream, batch, CAST(row_number() OVER (ORDER BY batch, CASE WHEN batch = (SELECT min(batch) FROM r) THEN -weight ELSE 0 END, stream) AS INTEGER) AS rank FROM o""")
def priority_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.priority_order(_required(spark, sf_dir))


@query(f"""SELECT DISTINCT user_id % 8 AS partition, {DAY} AS epoch, CAST(dense_rank() OVER (PARTITION BY user_id % 8 ORDER BY {DAY}) AS INTEGER) AS
  turn FROM events""")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("partition"), _day().alias("epoch")).distinct()
    return state.round_robin(b)


@query("SELECT event_type AS key, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 3")
def counters_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.top(metrics.counters(table(spark, sf_dir, "events").withColumnRenamed("event_type", "key"), "key"), "n", 3, "key")


@query("""SELECT category, event_type, CAST(count(*) AS BIGINT) AS n, CAST(grouping(category) AS INTEGER) AS is_total FROM (SELECT concat('Shard',
  user_id % 5) AS category, event_type FROM events) GROUP BY GROUPING SETS ((category, event_type), (event_type))""")
def category_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("Shard"), (F.col("user_id") % 5).cast("string")).alias("category"), "event_type")
    return e.groupingSets([["category", "event_type"], ["event_type"]], "category", "event_type").agg(
        F.count("*").alias("n"), F.grouping("category").cast("int").alias("is_total")
    )


@query("""SELECT concat('Shard', user_id % 5) AS category, event_type, event_type IN ('purchase', 'signup', 'click') AS handled, CAST(count(*) AS
  BIGINT) AS n FROM events GROUP BY ALL""")
def handled_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn(
        "category", F.concat(F.lit("Shard"), (F.col("user_id") % 5).cast("string"))
    ).withColumn("handled", F.col("event_type").isin("purchase", "signup", "click"))
    return e.groupBy("category", "event_type", "handled").agg(F.count("*").alias("n"))


LATENCY = "CAST(count(*) AS BIGINT) AS n, min(value) AS min, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS max, round(avg(value), 6) AS avg, round(stddev_samp(value), 6) AS stddev"


@query(f"SELECT event_type, {LATENCY} FROM events GROUP BY event_type")
def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latency(table(spark, sf_dir, "events"), ["event_type"], "value", exact=True)


@query("""SELECT category, event_type, CAST(count(*) AS BIGINT) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS avg FROM (SELECT
  *, user_id % 5 AS category FROM events) GROUP BY ROLLUP (category, event_type)""")
def latency_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("category", F.col("user_id") % 5)
    return e.rollup("category", "event_type").agg(
        F.count("*").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.round(F.avg("value"), 6).alias("avg")
    )


@query(f"""SELECT le, CAST(count(*) FILTER (WHERE value <= le) AS BIGINT) AS n FROM events, (SELECT
  CAST(unnest([{', '.join(map(str, metrics.LATENCY_BUCKETS))}]) AS DOUBLE) AS le) GROUP BY le""")
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(table(spark, sf_dir, "events"), "value", metrics.LATENCY_BUCKETS)


@query("""SELECT 30 * (CAST(floor(epoch(ts) / 30) AS BIGINT) - k) + 60 AS end_s, CAST(count(*) AS BIGINT) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99
  FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY ALL""")
def sliding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of what is at most a minute old, every 30 seconds, from sketches."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "value")
    w = metrics.sliding_quantiles(e, "ts", "value", [], "1 minute", "30 seconds")
    return w.select(F.unix_seconds("end").alias("end_s"), "n", "p50", "p95", "p99")


@query("""SELECT event_type, CAST(count(*) AS BIGINT) AS n, min(value) AS min, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value,
  0.95), 6) AS p95, round(quantile_disc(value, 0.99), 6) AS p99, max(value) AS max, round(avg(value), 6) AS avg, round(stddev_samp(value),
  6) AS stddev FROM events GROUP BY event_type""")
def latency_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latencies with quantiles from sketches; at this accuracy they are the values of the exact ranks for the given tables."""
    return metrics.latency(table(spark, sf_dir, "events"), ["event_type"], "value", accuracy=1_000_000)


KIND = "CASE WHEN event_type = 'error' THEN 'exception' WHEN value > 40 THEN 'rate_limited' ELSE 'ok' END"


@query(f"""SELECT {KIND} AS kind, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS streams, CAST(sum(length(props)) AS BIGINT)
  AS bytes, round(sum(value), 4) AS seconds FROM events GROUP BY kind""")
def outcome_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("kind", metrics.outcome_kind(F.col("event_type"), F.col("value"), 40))
    return e.groupBy("kind").agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("streams"), F.sum(F.length("props")).cast("long").alias("bytes"),
        F.round(F.sum("value"), 4).alias("seconds")
    )


@query(f"""WITH s AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) AS attempts, max(value) AS age FROM events GROUP BY user_id),
  c AS (SELECT *, CASE WHEN user_id % 17 = 0 THEN 'stuck' WHEN errors * 5 > attempts THEN 'failing' WHEN attempts = 0 THEN 'waiting' WHEN age
    > 60 THEN 'slow' ELSE 'running' END AS class FROM s)
  SELECT class, CAST(count(*) AS BIGINT) AS streams, CAST(sum(attempts) AS BIGINT) AS attempts, max(age) AS oldest, min(age) AS newest FROM c GROUP BY class""")
def busy_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(
        metrics.count_if(F.col("event_type") == "error").alias("errors"), F.count("*").alias("attempts"), F.max("value").alias("age")
    )
    c = s.withColumn("class", state.busy_class(F.col("attempts"), F.col("age"), F.col("errors") * 5 > F.col("attempts"), F.col("user_id") % 17 == 0, 60))
    return c.groupBy("class").agg(
        F.count("*").alias("streams"), F.sum("attempts").alias("attempts"), F.max("age").alias("oldest"), F.min("age").alias("newest")
    )


@query(f"""SELECT stream, CAST(i AS BIGINT) AS i, CAST(next AS BIGINT) AS next, CASE WHEN a = i THEN 'ok' WHEN a < i THEN 'prefix_missing' WHEN a >= next THEN 'duplicate' ELSE 'partial_duplicate' END AS result, CAST(CASE WHEN a = i THEN next WHEN a < i THEN i - a ELSE a END AS BIGINT) AS position
  FROM (SELECT *, CAST(split_part(stream, '-', 2) AS BIGINT) % 5 AS a FROM {islands(ORDER)})""")
def writer_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans.merge_events(order_lines(spark, sf_dir), LINE_ORDER).withColumn("a", F.split_part("stream", F.lit("-"), F.lit(2)).cast("long") % 5)
    kind, at = state.write_result(F.col("i"), F.col("next"), F.col("a"))
    return s.select("stream", "i", "next", kind.alias("result"), at.alias("position"))


@query(f"""SELECT user_id % 8 AS partition, {DAY} AS day, CAST(count(*) AS BIGINT) AS events, CAST(count(DISTINCT user_id) AS BIGINT) AS streams,
  CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS errors, round(sum(value), 4) AS waited FROM events GROUP BY ALL""")
def reader_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    by = [(F.col("user_id") % 8).alias("partition"), _day().alias("day")]
    return reports.reader_stats(e, by, "user_id", F.col("event_type") == "error", "value")


@query("""WITH c AS (SELECT starts_with(event_type, 's') AS is_meta, event_type AS category, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(props)) AS BIGINT) AS bytes FROM events GROUP BY ALL)
  SELECT is_meta, category, n, bytes FROM (SELECT *, row_number() OVER (PARTITION BY is_meta ORDER BY bytes DESC, category) AS r FROM c) WHERE r <= 3""")
def slice_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").groupBy(
        F.col("event_type").startswith("s").alias("is_meta"), F.col("event_type").alias("category")
    ).agg(F.count("*").alias("n"), F.sum(F.length("props")).cast("long").alias("bytes"))
    w = Window.partitionBy("is_meta").orderBy(F.desc("bytes"), "category")
    return c.withColumn("r", F.row_number().over(w)).where("r <= 3").drop("r")


@query(f"""SELECT stream, concat(':', event_type, CASE WHEN n > 1 THEN concat('+', n - 1) ELSE '' END) AS label, CAST(n AS BIGINT) AS n FROM (SELECT
  stream, event_type, count(*) AS n FROM {USER} GROUP BY ALL)""")
def span_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = user_events(spark, sf_dir).groupBy("stream", "event_type").agg(F.count("*").alias("n"))
    return g.select("stream", span_label(F.col("event_type"), F.col("n")).alias("label"), "n")


@query("""SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) + (60 * (1 + user_id % 3)) AS due_at, (CAST(floor(epoch(ts)) AS BIGINT) + 60 * (1 +
  user_id % 3)) <= 1704200000 AS is_due FROM events""")
def checkpoint_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("due", next_due(F.col("ts").cast("timestamp"), 60 * (1 + F.col("user_id") % 3)))
    return e.select("event_id", F.unix_seconds("due").alias("due_at"), (F.unix_seconds("due") <= 1704200000).alias("is_due"))


@query(f"""SELECT category, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT split_part(stream, '-', 1) AS category, event_type FROM {USER} WHERE
  event_type IN ('click', 'view') UNION SELECT DISTINCT split_part(stream, '-', 1), event_type FROM {USER} WHERE event_type NOT IN ('click',
  'view')) GROUP BY category""")
def union_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = user_events(spark, sf_dir).select(category(F.col("stream")).alias("category"), "event_type")
    handled = F.col("event_type").isin("click", "view")
    return e.where(handled).distinct().union(e.where(~handled).distinct()).distinct().groupBy("category").agg(F.count("*").alias("n"))


@query(f"""WITH v AS (SELECT concat('Order-', l_orderkey) AS stream, CAST(max(l_linenumber) AS BIGINT) AS version FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' AND l_linenumber <= 3 GROUP BY 1), s AS (SELECT i.*, coalesce(version, 0) AS a FROM {islands(ORDER)} i LEFT JOIN v USING (stream))
  SELECT CASE WHEN a = i THEN 'ok' WHEN a < i THEN 'prefix_missing' WHEN a >= next THEN 'duplicate' ELSE 'partial_duplicate' END AS result, CAST(count(*) AS BIGINT) AS spans, CAST(sum(CASE WHEN i <= a THEN greatest(0, next - a) ELSE 0 END) AS BIGINT) AS appended FROM s GROUP BY 1""")
def sync_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = order_lines(spark, sf_dir)
    held = o.where(
        (F.col("shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")) & (F.col("index") < 3)
    ).groupBy("stream").agg((F.max("index") + 1).alias("version"))
    r = state.append_at_expected(spans.merge_events(o, LINE_ORDER), held)
    return r.groupBy("result").agg(F.count("*").alias("spans"), F.sum("n_new").alias("appended"))


@query(f"""WITH s AS (SELECT DISTINCT stream, l_orderkey AS k, greatest(l_orderkey % 3, l_orderkey % 5) AS w FROM {ORDER}),
  q AS (SELECT stream, i, next, n FROM {islands(f'(SELECT stream, "index" FROM {ORDER} WHERE "index" >= greatest(l_orderkey % 3, l_orderkey % 5))')})
  SELECT stream, CAST(w AS BIGINT) AS write_pos, k % 50 = 0 OR k % 70 = 0 AS malformed, CAST(min(i) AS BIGINT) AS i, CAST(min_by(next, i) AS BIGINT) AS next,
    CAST(nullif(count(i), 0) AS BIGINT) AS n_spans, CAST(sum(n) AS BIGINT) AS n_events FROM s LEFT JOIN q USING (stream) GROUP BY ALL""")
def combine_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states of every order stream and its lines, combined."""
    o = order_lines(spark, sf_dir)
    k = F.col("l_orderkey")
    of = lambda n, bad: o.select("stream", (k % n).alias("write_pos"), (k % bad == 0).alias("malformed")).distinct()
    return state.combine(of(3, 50).unionByName(of(5, 70)), o, list(LINE_ORDER))
