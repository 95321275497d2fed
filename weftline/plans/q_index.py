"""Queries over the append index, codecs and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codec, filters
from ..operators import index, reports, spans
from ..sources.tables import conversations, order_lines, table, user_events
from .catalog import query
from .q_spans import CONV, ORDER, USER, islands
from .q_state import DAY, _day

#: Index spans as a fixture: every order line begins a span of 1 to 3 events.
SPANS = "(SELECT DISTINCT concat('Order-', l_orderkey) AS p, l_linenumber - 1 AS i, CAST(1 + l_linenumber % 3 AS BIGINT) AS n, l_orderkey FROM lineitem)"
#: What the index holds: lines shipped before 1998.
RECORDED = f"(SELECT DISTINCT concat('Order-', l_orderkey) AS p, l_linenumber - 1 AS \"index\" FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01')"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("Order-"), F.col("l_orderkey").cast("string")).alias("p"), (F.col("l_linenumber") - 1).cast("long").alias("i"),
        (1 + F.col("l_linenumber") % 3).cast("long").alias("n"), "l_orderkey"
    ).distinct()


def _recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_lines(spark, sf_dir).where(
        F.col("shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    ).select(F.col("stream").alias("p"), "index").distinct()


@query(f"""SELECT p, CAST(min(i) AS BIGINT) AS i, CAST(max(e) AS BIGINT) AS next, CAST(sum(greatest(0, i - coalesce(reach, i))) AS BIGINT) AS gaps FROM
  (SELECT *, i + n AS e, max(i + n) OVER (PARTITION BY p ORDER BY i, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM
  {SPANS}) GROUP BY p""")
def index_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.flatten(_spans(spark, sf_dir))


MERGED = f"(SELECT p, CAST(min(i) AS BIGINT) AS i, CAST(max(e) AS BIGINT) AS next FROM (SELECT *, sum(CASE WHEN reach IS NULL OR i > reach THEN 1 ELSE 0 END) OVER (PARTITION BY p ORDER BY i, n ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, i + n AS e, max(i + n) OVER (PARTITION BY p ORDER BY i, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {SPANS})) GROUP BY p, g)"


@query(f"SELECT p, i, next FROM {MERGED}")
def index_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.merge_index_spans(_spans(spark, sf_dir))


@query(f"""WITH q AS (SELECT p, CASE WHEN min(i) = 0 THEN min_by(next, i) ELSE 0 END AS write_pos, min(CASE WHEN i > 0 THEN i END) AS first_i, count(CASE WHEN i > 0 THEN 1 END) AS n_spans FROM {MERGED} GROUP BY p)
  SELECT CAST(count(*) AS BIGINT) AS streams, CAST(sum(write_pos) AS BIGINT) AS events, CAST(count(*) FILTER (WHERE first_i <= write_pos AND n_spans = 1) AS BIGINT) AS buffered, CAST(count(*) FILTER (WHERE first_i <= write_pos AND n_spans > 1) AS BIGINT) AS queuing, CAST(count(*) FILTER (WHERE first_i > write_pos) AS BIGINT) AS gapped FROM q""")
def index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = spans.merge_index_spans(_spans(spark, sf_dir))
    later = F.col("i") > 0
    q = m.groupBy("p").agg(
        F.when(F.min("i") == 0, F.min_by("next", "i")).otherwise(0).alias("write_pos"), F.min(F.when(later, F.col("i"))).alias("first_i"),
        F.count(F.when(later, 1)).alias("n_spans")
    )
    return index.summary(q)


@query(f"""SELECT s.p, CAST(s.i AS BIGINT) AS i, s.n, CASE WHEN s.i + s.n <= coalesce(version, 0) THEN 'discard' WHEN s.i > coalesce(version, 0) THEN 'gap' WHEN version IS NULL THEN 'start' ELSE 'append' END AS kind, CAST(greatest(s.i, coalesce(version, 0)) AS BIGINT) AS "from",
  CAST(CASE WHEN s.i + s.n > coalesce(version, 0) AND s.i <= coalesce(version, 0) THEN s.i + s.n - coalesce(version, 0) ELSE 0 END AS BIGINT) AS n_new FROM {SPANS} s LEFT JOIN (SELECT p, max("index") + 1 AS version FROM {RECORDED} GROUP BY p) v USING (p)""")
def index_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = index.versions(_recorded(spark, sf_dir).select("p", F.col("index").alias("i"), F.lit(1).alias("n")))
    return index.classify(_spans(spark, sf_dir), v)


@query(f"""SELECT p, CAST("index" AS BIGINT) AS "index" FROM (SELECT DISTINCT stream AS p, "index" FROM {ORDER}) EXCEPT SELECT p, "index" FROM
  {RECORDED}""")
def index_remove_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_lines(spark, sf_dir).select(F.col("stream").alias("p"), "index").distinct()
    return index.unrecorded(rows, _recorded(spark, sf_dir))


@query(f"SELECT p, CAST(max(i + n) AS BIGINT) AS version FROM {SPANS} GROUP BY p")
def index_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.versions(_spans(spark, sf_dir))


@query("SELECT user_id % 8 AS partition, CAST(max_by(event_id // 100, event_id) AS BIGINT) AS epoch FROM events GROUP BY ALL")
def active_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("partition"), F.expr("event_id div 100").alias("epoch"), "event_id")
    return index.latest(e, ["partition"], "epoch", "event_id")


@query("SELECT event_type AS source, user_id % 4 AS tranche, CAST(max_by(event_id + 1, event_id) AS BIGINT) AS position FROM events GROUP BY ALL")
def checkpoint_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("source"), (F.col("user_id") % 4).alias("tranche"), (F.col("event_id") + 1).alias("position"), "event_id"
    )
    return index.latest(e, ["source", "tranche"], "position", "event_id")


@query(f"""SELECT c.stream, CAST(c."index" AS BIGINT) AS "index", c.event_type, CAST(s.i AS BIGINT) AS span_i FROM (SELECT stream, "index" AS i, 2 AS n
  FROM {CONV} WHERE "index" % 2 = 0) s JOIN {CONV} c ON c.stream = s.stream AND c."index" >= s.i AND c."index" < s.i + s.n""")
def hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of spans of two, which cover all streams."""
    c = conversations(spark, sf_dir)
    wanted = c.where(F.col("index") % 2 == 0).select("stream", F.col("index").alias("i"), F.lit(2).alias("n"))
    return index.hydrate(wanted, c).select("stream", "index", "event_type", "span_i")


@query("""SELECT t.* FROM (SELECT DISTINCT user_id % 8 AS partition, event_id AS target FROM events) t WHERE NOT EXISTS (SELECT 1 FROM (SELECT user_id
  % 8 AS partition, max(event_id) // 2 AS position FROM events GROUP BY 1) p WHERE p.partition = t.partition AND p.position >= t.target)""")
def targets_not_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("partition", F.col("user_id") % 8)
    reached = e.groupBy("partition").agg(F.expr("max(event_id) div 2").alias("position"))
    return index.not_reached(e.select("partition", F.col("event_id").alias("target")), reached)


@query("""SELECT user_id % 8 AS partition, CAST(max(event_id) AS BIGINT) AS position, concat(user_id % 8, ':', max(event_id)) AS dedup_id FROM events
  GROUP BY user_id % 8""")
def partition_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 8).alias("partition")).agg(F.max("event_id").alias("position"))
    return m.withColumn("dedup_id", F.concat_ws(":", F.col("partition").cast("string"), F.col("position").cast("string")))


@query("""SELECT r.rng, CAST(r.read_pos AS BIGINT) AS read_pos, CAST(e.gap AS BIGINT) AS gap, e.gap = 0 AS is_tail
  FROM (SELECT user_id % 6 AS rng, max(event_id) AS read_pos FROM events WHERE event_type <> 'error' GROUP BY 1) r
  JOIN (SELECT user_id % 6 AS rng, count(*) FILTER (WHERE value > 90) AS gap FROM events GROUP BY 1) e USING (rng)""")
def lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("rng", F.col("user_id") % 6)
    return reports.lag(e, "rng", F.col("event_type") != "error", F.col("event_id"), F.col("value") > 90)


@query(f"SELECT stream, CAST(\"index\" AS BIGINT) AS \"index\", event_type, data FROM {CONV}")
def rendered_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations rendered to JSON spans and read back."""
    e = conversations(spark, sf_dir).withColumns({"ts": F.timestamp_seconds(F.col("index")), "meta": F.lit(None).cast("string")})
    return codec.parse_spans(codec.render_spans(e)).select("stream", "index", "event_type", "data")


@query(f"SELECT stream, CAST(epoch_us(ts) AS BIGINT) AS us, event_type, data, CAST(\"index\" AS BIGINT) AS \"index\" FROM {USER}")
def rendered_span_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = user_events(spark, sf_dir).withColumn("meta", F.lit(None).cast("string"))
    return codec.parse_spans(codec.render_spans(e)).select("stream", F.unix_micros("ts").alias("us"), "event_type", "data", "index")


@query(f"""SELECT stream, CAST("index" AS BIGINT) AS "index", event_type, is_unfold FROM (SELECT stream, "index", event_type, false AS is_unfold FROM {CONV} UNION ALL SELECT stream, max("index") + 1, 'snapshot', true FROM {CONV} GROUP BY stream)""")
def document_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = conversations(spark, sf_dir)
    item = F.struct("index", F.struct(F.col("event_type").alias("c"), F.col("data").alias("d")).alias("x"))
    doc = c.groupBy("stream").agg(
        F.min("index").alias("i"), (F.max("index") + 1).alias("n"), F.transform(F.array_sort(F.collect_list(item)), lambda x: x["x"]).alias("e")
    )
    value = F.to_json(F.struct(
        F.col("stream").alias("p"), "i", "n", "e", F.array(F.struct(F.lit("snapshot").alias("c"), F.lit("{}").alias("d"))).alias("u"),
        F.lit(1.7e9).alias("_ts")
    ))
    other = doc.select(F.lit('{"p": 1, "id": "x"}').alias("value")).limit(1)
    return codec.document_events(doc.select(value.alias("value")).union(other)).select("stream", "index", "event_type", "is_unfold")


@query(f"SELECT stream, CAST(\"index\" AS BIGINT) AS \"index\", event_type FROM {CONV} WHERE \"index\" > (CAST(split_part(stream, '-', 2) AS BIGINT) % 4)")
def prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = conversations(spark, sf_dir).select("stream", "index", "event_type")
    until = c.select("stream").distinct().withColumn("until", F.split_part("stream", F.lit("-"), F.lit(2)).cast("long") % 4)
    return index.prune(c, until)


@query(f"""WITH RECURSIVE b AS (SELECT user_id % 8 AS partition, {DAY} AS batch, CAST(count(*) AS BIGINT) AS size FROM events GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY partition ORDER BY batch) AS r FROM b), w AS (
    SELECT partition, batch, size, r, 0 AS epoch, CASE WHEN size > 100 THEN 0 ELSE size END AS held, size > 100 AS closed FROM n WHERE r = 1
    UNION ALL SELECT n.partition, n.batch, n.size, n.r, CASE WHEN w.closed THEN w.epoch + 1 ELSE w.epoch END, CASE WHEN w.held + n.size > 100
      THEN 0 ELSE w.held + n.size END, w.held + n.size > 100 FROM w JOIN n ON n.partition = w.partition AND n.r = w.r + 1)
  SELECT partition, batch, size, CAST(epoch AS INTEGER) AS epoch FROM w""")
def epoch_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 8).alias("partition"), _day().alias("batch")).agg(F.count("*").alias("size"))
    return index.assign_epochs(b, "size", 100, ["batch"])


@query("""SELECT user_id % 8 AS partition, event_id, CAST(running AS BIGINT) AS running FROM (SELECT *, sum(length(props)) OVER (PARTITION BY user_id
  % 8 ORDER BY event_id) AS running FROM events) WHERE running <= 3000""")
def import_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("partition", F.col("user_id") % 8)
    return index.within_budget(e, F.length("props"), 3000, ["event_id"], "partition").select("partition", "event_id", "running")


@query("""SELECT p, CAST(i AS BIGINT) AS i, CAST(len(c) AS INTEGER) AS n, array_to_string(c, ',') AS types FROM (SELECT concat('Order-', l_orderkey) AS p, list(l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS c, 10 - count(*) AS i FROM lineitem GROUP BY 1)""")
def export_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table export's JSON lines, written from order lines and read back."""
    x = table(spark, sf_dir, "lineitem")
    each = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")))
    lines = x.groupBy("l_orderkey").agg(each.alias("e"))
    s = lambda c: F.struct(c.alias("S"))
    item = F.struct(
        s(F.concat(F.lit("Order-"), F.col("l_orderkey").cast("string"))).alias("p"), F.struct(F.lit("10").alias("N")).alias("n"),
        F.struct(F.transform("e", lambda v: s(v["l_returnflag"])).alias("L")).alias("c")
    )
    out = codec.export_lines(lines.select(F.to_json(F.struct(item.alias("Item"))).alias("value")))
    return out.select("p", "i", F.size("c").alias("n"), F.array_join("c", ",").alias("types"))


@query("""WITH r AS (SELECT concat('Order-', l_orderkey) AS p, count(*) AS a, list(l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS c, l_orderkey FROM lineitem GROUP BY l_orderkey)
  SELECT p, CAST(20 - least(a, 2) AS BIGINT) AS i, array_to_string(c[-CAST(least(a, 2) AS INTEGER):], ',') AS types FROM r WHERE l_orderkey % 5 <> 0 AND l_orderkey % 7 <> 0""")
def change_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))).alias("e"), F.count("*").alias("k")
    )
    rec = x.select(
        F.when(F.col("l_orderkey") % 5 == 0, "REMOVE").otherwise("MODIFY").alias("event_name"),
        F.concat(F.lit("Order-"), F.col("l_orderkey").cast("string")).alias("p"), F.lit(20).cast("long").alias("n"),
        F.when(F.col("l_orderkey") % 7 == 0, 0).otherwise(F.least("k", F.lit(2))).alias("a"), F.transform("e", lambda v: v["l_returnflag"]).alias("c")
    )
    return codec.change_records(rec).select("p", "i", F.array_join("c", ",").alias("types"))


@query("SELECT CAST(event_id AS VARCHAR) AS key, props AS value, concat(event_type, ':', user_id % 4, ':', event_id) AS context FROM events")
def message_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").cast("binary").alias("key"), F.col("props").cast("binary").alias("value"),
        F.col("event_type").alias("topic"), (F.col("user_id") % 4).alias("partition"), F.col("event_id").alias("offset")
    )
    r = codec.message_records(e)
    return r.select(
        "key", "value",
        F.concat_ws(":", "context.topic", F.col("context.partition").cast("string"), F.col("context.offset").cast("string")).alias("context")
    )


@query("SELECT user_id % 8 AS partition, CAST(max(event_id) + 1 AS BIGINT) AS tail FROM events GROUP BY 1")
def tail_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 8).alias("partition")).agg((F.max("event_id") + 1).alias("tail"))


@query("""SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events WHERE event_id >=
  500) WHERE r <= 100""")
def category_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of 100 rows per category from a checkpoint on."""
    w = Window.partitionBy("event_type").orderBy("event_id")
    return table(spark, sf_dir, "events").where("event_id >= 500").withColumn("r", F.row_number().over(w)).where("r <= 100").select("event_id", "event_type")


@query("""SELECT event_id, 1704067200000000000 + row_number() OVER (ORDER BY event_id) - 1 AS "index", row_number() OVER (ORDER BY event_id) = count(*) OVER () AS held_back FROM events""")
def periodic_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a full crawl: index from the crawl's begin, the last item held back for the batch that carries the new checkpoint."""
    from ..sources.feeds import crawl_indices

    return crawl_indices(table(spark, sf_dir, "events"), "event_id", 1704067200).select("event_id", "index", "held_back")


@query(f"""SELECT series, CAST(epoch AS BIGINT) AS epoch, CAST(row_number() OVER (ORDER BY series, epoch) AS INTEGER) AS released FROM (SELECT DISTINCT
  user_id % 4 AS series, {DAY} AS epoch FROM events)""")
def striped_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("series"), _day().alias("epoch")).distinct()
    return spans.numbered(b, F.col("series"), "epoch").select("series", "epoch", (F.col("number") + 1).cast("int").alias("released"))


@query(f"SELECT p, CAST(i + k AS BIGINT) AS \"index\", CAST(k AS INTEGER) AS k FROM {SPANS}, (SELECT unnest(range(0, 3)) AS k) WHERE k < n")
def index_only_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index spans as events without bodies."""
    s = _spans(spark, sf_dir)
    return s.select(
        "p", "i", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("k")
    ).select("p", (F.col("i") + F.col("k")).alias("index"), "k")


@query(f"""SELECT CAST(count(*) AS BIGINT) AS spans, CAST(count(DISTINCT stream) AS BIGINT) AS streams, CAST(sum(n) AS BIGINT) AS events, bool_or(i >
  0) AS has_gaps FROM {islands(ORDER)}""")
def epoch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import LINE_ORDER

    m = spans.merge_events(order_lines(spark, sf_dir), LINE_ORDER)
    return m.agg(
        F.count("*").alias("spans"), F.countDistinct("stream").alias("streams"), F.sum("n").alias("events"),
        F.expr("bool_or(i > 0)").alias("has_gaps")
    )


@query("""SELECT position, stream, event_type, data FROM (SELECT event_id AS position, concat('User-', user_id) AS stream, event_type, props AS data
  FROM events) WHERE position >= 20""")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON-lines feed written from events (with comment lines) and read from line 20 on."""
    from ..sources.feeds import read_json_lines
    from ..streaming.run import scratch

    e = table(spark, sf_dir, "events")
    item = F.struct(F.concat(F.lit("User-"), F.col("user_id").cast("string")).alias("stream"), "event_type", F.col("props").alias("data"))
    path = scratch(spark, "lines")
    e.orderBy("event_id").coalesce(1).select(F.to_json(item).alias("value")).write.text(path)
    got = read_json_lines(spark, path, "stream string, event_type string, data string", skip=20)
    return got.select((F.col("line") - 1).alias("position"), "item.stream", "item.event_type", "item.data")


OPERATIONS = """(SELECT concat('Order-', l_orderkey) AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS step,
  CASE WHEN l_linenumber % 2 = 0 THEN 'log' ELSE 'ingest' END AS op, l_linenumber - 1 AS i, 1 + l_partkey % 2 AS n FROM lineitem)"""


@query(f"""WITH RECURSIVE o AS (SELECT * FROM {OPERATIONS}), w AS (
    SELECT DISTINCT p, CAST(0 AS BIGINT) AS step, true AS ok, CAST(0 AS BIGINT) AS pos, CAST([] AS BIGINT[]) AS held, false AS asked FROM o
    UNION ALL SELECT o.p, o.step, o.op = 'ingest' OR o.i <= w.pos, CASE WHEN o.op = 'log' AND o.i <= w.pos THEN greatest(w.pos, o.i + o.n) ELSE w.pos END,
      CASE WHEN o.op = 'ingest' THEN list_concat(w.held, range(o.i, o.i + o.n)) ELSE w.held END, o.op = 'ingest' FROM w JOIN o ON o.p = w.p AND
        o.step = w.step + 1),
  r AS (SELECT *, len([k FOR k IN range(0, 20) IF list_has_all(held, range(pos, pos + k + 1))]) AS n FROM w WHERE step > 0)
  SELECT p, step, ok, pos AS write_pos, CASE WHEN asked AND n > 0 THEN pos END AS ready_i, CAST(CASE WHEN asked AND n > 0 THEN n END AS BIGINT) AS ready_n FROM r""")
def index_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index buffer: spans of the index are recorded or refused, spans of data wait until they are contiguous."""
    x = table(spark, sf_dir, "lineitem")
    step = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"))
    op = F.when(F.col("l_linenumber") % 2 == 0, "log").otherwise("ingest").alias("op")
    p = F.concat(F.lit("Order-"), F.col("l_orderkey").cast("string")).alias("p")
    return index.index_buffer(x.select(p, step.alias("step"), op, (F.col("l_linenumber") - 1).alias("i"), (1 + F.col("l_partkey") % 2).alias("n")))


CHANGES = """(SELECT user_id % 8 AS partition, event_id // 500 AS epoch, event_id % 500 AS seq, concat('User-', user_id) AS p,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 + CASE WHEN value > 400 THEN 1 ELSE 0 END AS i, 1 AS n, event_id // 500 <> 3 AS closed FROM events)"""


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = user_events(spark, sf_dir).withColumn("epoch", F.expr("event_id div 500"))
    i = (F.col("index") + F.when(F.col("value") > 400, 1).otherwise(0)).alias("i")
    return e.select(
        (F.col("user_id") % 8).alias("partition"), "epoch", F.col("stream").alias("p"), i, F.lit(1).alias("n"), (F.col("epoch") != 3).alias("closed")
    )


@query(f"""WITH c AS (SELECT *, CASE WHEN "from" IS NULL THEN false ELSE i > "from" END OR ("from" IS NULL AND i > 0) AS gapped FROM (SELECT *, max(i + n) OVER (PARTITION BY partition, p ORDER BY epoch, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS "from" FROM {CHANGES} WHERE epoch <= 3))
  SELECT partition, CAST(count(DISTINCT epoch) AS BIGINT) AS epochs, CAST(count(*) AS BIGINT) AS spans, CAST(count(*) FILTER (WHERE gapped) AS
    BIGINT) AS gapped FROM c
  WHERE epoch <= (SELECT coalesce(min(k) - 1, 3) FROM (SELECT unnest(range(0, 4)) AS k) r WHERE NOT EXISTS (SELECT 1 FROM {CHANGES} x WHERE x.partition = c.partition AND x.epoch = r.k)) GROUP BY partition""")
def index_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk over each partition's epochs, up to the open one: spans loaded, and those behind a gap."""
    return index.load_index(_changes(spark, sf_dir))


INDEXED = "(SELECT stream, \"index\", event_type, data, split_part(stream, '-', 2)::BIGINT AS c FROM " + CONV + ")"


def _indexed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as changes of the index, fifty an epoch, and their events."""
    c = conversations(spark, sf_dir)
    types = F.transform(F.array_sort(F.collect_list(F.struct("index", "event_type"))), lambda x: x["event_type"])
    n = F.split_part("stream", F.lit("-"), F.lit(2)).cast("long")
    spans_ = c.groupBy("stream").agg(F.min("index").alias("i"), types.alias("types"))
    return spans_.select(F.lit(0).alias("partition"), F.floor(n / 50).cast("long").alias("epoch"), (n % 50).alias("seq"), "stream", "i", "types"), c


@query(f"""SELECT stream, CAST("index" AS BIGINT) AS "index", event_type, data, CAST(c // 50 * 1000000 + c % 50 + 1 AS BIGINT) AS position FROM
  {INDEXED} WHERE c >= 60 AND NOT regexp_matches(stream, '7$')""")
def index_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index from a position (epoch 1, offset 10) on, filtered by stream, with the events' bodies."""
    changes, events = _indexed(spark, sf_dir)
    keep = filters.stream_filter(F.col("stream"), deny_streams=["7$"])
    return index.read_index(changes, 1, 10, keep, events).select("stream", "index", "event_type", "data", "position")
