"""Queries over spans, names, filters and sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filters, names, positions
from ..operators import reports, spans
from ..sources.tables import LINE_ORDER, conversations, order_lines, table, user_events
from .catalog import query

USER = "(SELECT concat('User-', user_id) AS stream, event_id, user_id, event_type, ts, value, props AS data, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS \"index\" FROM events)"
ORDER = "(SELECT DISTINCT concat('Order-', l_orderkey) AS stream, l_orderkey, l_linenumber - 1 AS \"index\" FROM lineitem)"
CONV = "(SELECT concat('Conversation-', conv_id) AS stream, turn AS \"index\", role AS event_type, text AS data, octet_length(encode(text)) AS size FROM conversations)"


def islands(source: str) -> str:
    return f"(SELECT stream, min(\"index\") AS i, max(\"index\") + 1 AS next, count(*) AS n FROM (SELECT stream, \"index\", \"index\" - row_number() OVER (PARTITION BY stream ORDER BY \"index\") AS island FROM {source}) GROUP BY stream, island)"


@query(f"SELECT stream, CAST(i AS BIGINT) AS i, CAST(next AS BIGINT) AS next, CAST(n AS BIGINT) AS n FROM {islands(ORDER)}")
def span_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.merge_events(order_lines(spark, sf_dir), LINE_ORDER)


@query(f"""SELECT stream, CAST(i AS BIGINT) AS i, CAST(next AS BIGINT) AS next, CAST(n AS BIGINT) AS n FROM
  {islands(f'(SELECT * FROM {ORDER} WHERE "index" >= l_orderkey % 4)')}""")
def span_merge_from_write_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.merge_events(order_lines(spark, sf_dir), LINE_ORDER, F.col("l_orderkey") % 4)


@query(f"""WITH l AS (SELECT concat('Order-', l_orderkey) AS stream, l_orderkey % 3 AS m, l_linenumber - 1 AS x, l_partkey AS p FROM lineitem), live AS (SELECT * FROM l WHERE x >= m),
  ev AS (SELECT DISTINCT stream, x FROM live), isl AS (SELECT stream, x, min(x) OVER (PARTITION BY stream, g) AS out_i FROM (SELECT *, x -
    row_number() OVER (PARTITION BY stream ORDER BY x) AS g FROM ev)),
  top AS (SELECT stream, max(x) + 1 AS t FROM live GROUP BY stream)
  SELECT stream, CAST(out_i AS BIGINT) AS out_i, CAST(count(*) AS BIGINT) AS n_events, CAST(CASE WHEN max(x) + 1 = max(t) THEN 1 ELSE 0 END AS BIGINT) AS n_unfolds FROM isl JOIN top USING (stream) GROUP BY stream, out_i""")
def span_merge_unfolds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line is an input span of one event and one unfold behind it; the unfold at the end of the stream stays."""
    line = order_lines(spark, sf_dir).select(
        "stream", (F.col("l_orderkey") % 3).alias("min"), F.xxhash64(*LINE_ORDER, "index").alias("span_no"), "index", "event_type"
    )
    rows = line.select("stream", "min", "span_no", "index", F.lit(False).alias("is_unfold"), "event_type", F.lit(0).alias("pos")).unionByName(
        line.select("stream", "min", "span_no", (F.col("index") + 1).alias("index"), F.lit(True).alias("is_unfold"), "event_type", F.lit(1).alias("pos")))
    merged = spans.merge_spans(rows.dropDuplicates(["stream", "span_no", "index", "is_unfold"]))
    return merged.groupBy("stream", "out_i").agg(
        F.sum(F.when(F.col("is_unfold"), 0).otherwise(1)).alias("n_events"), F.sum(F.when(F.col("is_unfold"), 1).otherwise(0)).alias("n_unfolds")
    ).where("n_events > 0")


@query(f"SELECT stream, event_id, CAST(\"index\" AS BIGINT) AS \"index\" FROM {USER}")
def sequence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("User-"), F.col("user_id").cast("string")).alias("stream"), "event_id")
    return spans.sequence_index(e, ["event_id"])


@query("""WITH raw AS (SELECT DISTINCT concat('User-', user_id) AS raw FROM events UNION SELECT DISTINCT concat('u', user_id) FROM events UNION SELECT DISTINCT concat('-sys-', user_id) FROM events UNION SELECT DISTINCT concat('Order-', o_orderkey, '_', o_custkey) FROM orders),
  n AS (SELECT raw, CASE WHEN instr(raw, '-') = 0 THEN concat('Misc-', raw) ELSE raw END AS name FROM raw)
  SELECT raw, name, CASE WHEN starts_with(name, '-') THEN substr(name, 2) ELSE split_part(name, '-', 1) END AS category, regexp_extract(name, '^-*([^-]*)', 1) AS legacy, coalesce(CASE WHEN name LIKE '%7' THEN NULL ELSE name END, 'Misc-') AS keyed FROM n""")
def name_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("u")).distinct()
    o = table(spark, sf_dir, "orders").select(F.concat(
        F.lit("Order-"), names.composed_id(F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"))
    ).alias("raw"))
    raw = u.select(F.explode(F.array(F.concat(F.lit("User-"), "u"), F.concat(F.lit("u"), "u"), F.concat(F.lit("-sys-"), "u"))).alias("raw")).union(o).distinct()
    named = raw.withColumn("name", names.stream_name(F.col("raw"), "Misc"))
    key = F.when(~F.col("name").endswith("7"), F.col("name"))
    return named.select(
        "raw", "name", names.category(F.col("name")).alias("category"), names.legacy_category(F.col("name")).alias("legacy"),
        names.message_stream(key, "Misc").alias("keyed")
    )


@query(f"""SELECT stream, event_id FROM {USER} WHERE (split_part(stream, '-', 1) IN ('User') OR regexp_matches(split_part(stream, '-', 1), '^Ord.r$'))
  AND NOT (stream IN ('User') OR regexp_matches(stream, '-1[0-9]$')) AND NOT starts_with(stream, '$')""")
def stream_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = user_events(spark, sf_dir)
    return e.where(filters.stream_filter(F.col("stream"), ["User", "^Ord.r$"], (), (), ["User", "-1[0-9]$"])).select("stream", "event_id")


@query("""SELECT event_id, event_type FROM events WHERE (event_type IN ('click', 'view') OR regexp_matches(event_type, '^p.r')) AND NOT event_type IN
  ('view')""")
def event_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(filters.event_filter(F.col("event_type"), ["click", "view", "^p.r"], ["view"])).select("event_id", "event_type")


@query(f"""SELECT stream, CAST(count(*) AS BIGINT) AS n FROM {USER} WHERE (starts_with(stream, 'User-1') OR starts_with(stream, 'Us-')) AND value > 5
  GROUP BY stream""")
def category_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = user_events(spark, sf_dir)
    return e.where(filters.category_prefix(F.col("stream"), ["User-1", "Us-"], F.col("value") > 5)).groupBy("stream").agg(F.count("*").alias("n"))


@query(f"""SELECT stream, CAST(count(*) AS BIGINT) AS n_events, CAST(sum(octet_length(encode(data))) AS BIGINT) AS n_bytes, CAST(min("index") AS
  BIGINT) AS i, CAST(max("index") + 1 AS BIGINT) AS next FROM {USER} GROUP BY stream""")
def span_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.span_metrics(user_events(spark, sf_dir), F.octet_length("data"))


@query(f"""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS batch, stream, CAST(max("index") + 1 AS BIGINT) AS required, CAST(count(*) AS BIGINT) AS n FROM
  {USER} GROUP BY ALL""")
def batch_high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.batch_high_water(user_events(spark, sf_dir), F.to_date("ts").cast("string"))


@query(f"""SELECT stream, CAST("index" AS BIGINT) AS "index", CAST(b AS BIGINT) AS bytes_to_here FROM (SELECT *, sum(size) OVER (PARTITION BY stream ORDER BY "index") AS b, row_number() OVER (PARTITION BY stream ORDER BY "index") AS r FROM {CONV}) WHERE r = 1 OR (r <= 3 AND b <= 2000)""")
def slice_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.slice_prefix(conversations(spark, sf_dir), 3, 2000).select("stream", "index", "bytes_to_here")


@query(f"""WITH RECURSIVE c AS (SELECT * FROM {CONV}), w AS (
    SELECT stream, "index", 0 AS chunk_no, 1 AS n, CAST(size AS BIGINT) AS bytes FROM c WHERE "index" = 0
    UNION ALL SELECT c.stream, c."index", CASE WHEN w.n + 1 > 3 OR w.bytes + c.size > 2000 THEN w.chunk_no + 1 ELSE w.chunk_no END, CASE WHEN
      w.n + 1 > 3 OR w.bytes + c.size > 2000 THEN 1 ELSE w.n + 1 END, CASE WHEN w.n + 1 > 3 OR w.bytes + c.size > 2000 THEN c.size ELSE w.bytes
      + c.size END
    FROM w JOIN c ON c.stream = w.stream AND c."index" = w."index" + 1)
  SELECT stream, CAST(chunk_no AS INTEGER) AS chunk_no, CAST(min("index") AS BIGINT) AS i, CAST(max("index") + 1 AS BIGINT) AS next, CAST(max(bytes) AS BIGINT) AS bytes FROM w GROUP BY stream, chunk_no""")
def chunk_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.chunk_queue(conversations(spark, sf_dir), 3, 2000)


@query("""SELECT o_orderkey, CAST(o_orderkey * 1000000 + o_custkey AS BIGINT) AS position, CAST((o_orderkey + 1) * 1000000 AS BIGINT) AS
  closed_position, CAST(o_orderkey AS BIGINT) AS epoch, CAST(o_custkey % 1000000 AS BIGINT) AS "offset" FROM orders""")
def checkpoint_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("position", positions.epoch_position(F.col("o_orderkey"), F.col("o_custkey")))
    epoch, offset = positions.position_epoch(F.col("position"))
    return o.select(
        "o_orderkey", "position", positions.epoch_position(F.col("o_orderkey"), F.col("o_custkey"), F.lit(True)).alias("closed_position"),
        epoch.alias("epoch"), offset.alias("offset")
    )


@query("""SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) * 1000000000 + event_id AS position, CAST(floor(epoch(ts)) AS BIGINT) AS seconds, event_id
  AS ordinal FROM events""")
def time_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("position", positions.time_position(F.col("ts").cast("timestamp"), F.col("event_id")))
    seconds, ordinal = positions.position_time(F.col("position"))
    return e.select("event_id", "position", seconds.alias("seconds"), ordinal.alias("ordinal"))


@query("""WITH p AS (SELECT event_id, event_id * 123456789 AS pos, max(event_id * 123456789) OVER () AS most FROM events)
  SELECT event_id, pos >> 28 AS chunk, (pos >> 28) * 268435456 AS base, ((pos >> 28) + 1) * 268435456 AS next_base, (CAST(floor(most * 40 / 100.0) AS BIGINT) >> 28) * 268435456 AS at_40, round(100.0 * pos / most, 4) AS percent FROM p""")
def chunk_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 123456789).alias("pos"))
    most = e.agg(F.max("pos").alias("most"))
    p = F.col("pos")
    x = e.join(F.broadcast(most))
    return x.select(
        "event_id", positions.chunk(p).alias("chunk"), positions.chunk_base(positions.chunk(p)).alias("base"),
        positions.next_chunk(p).alias("next_base"), positions.percent_position(F.col("most"), F.lit(40)).alias("at_40"),
        F.round(F.lit(100.0) * p / F.col("most"), 4).alias("percent")
    )


@query("""SELECT event_id, 16 + 2 * length(event_type) + 2 * length(props) AS message_bytes, octet_length(encode(props)) + 80 AS rendered, CAST(floor((value * 1000 + 512) / 1024) AS BIGINT) AS kib,
  CASE WHEN s >= 86400 THEN concat(s // 86400, 'd', lpad(CAST(s % 86400 // 3600 AS VARCHAR), 2, '0'), 'h') WHEN s >= 3600 THEN concat(s //
    3600, 'h', lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0'), 'm') WHEN s >= 60 THEN concat(s // 60, 'm', lpad(CAST(s % 60 AS VARCHAR), 2,
    '0'), 's') ELSE concat(s, 's') END AS age, greatest(512, event_id - 128) AS degraded
  FROM (SELECT *, event_id * 37 AS s FROM events)""")
def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", positions.message_bytes(F.col("event_type"), F.col("props")).alias("message_bytes"),
        positions.rendered_size(F.col("props"), F.lit(None).cast("string")).alias("rendered"), positions.kib(F.col("value") * 1000).alias("kib"),
        positions.humanized(F.col("event_id") * 37).alias("age"), positions.degraded(F.col("event_id"), 512).alias("degraded")
    )
