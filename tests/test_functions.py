"""Scalar functions: names, positions, sizes, codecs."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import codec, names, positions


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("name", "category", "legacy"), [("Order-1", "Order", "Order"), ("A-b-c", "A", "A"), ("-sys-1", "sys-1", "sys"), ("$all", "$all", "$all"), ("", "", "")])
def test_categories(spark, name, category, legacy):
    assert one(spark, names.category(F.lit(name))) == category
    assert one(spark, names.legacy_category(F.lit(name))) == legacy


@pytest.mark.parametrize(("key", "want"), [("Order-1", "Order-1"), ("x", "D-x"), (None, "D-"), ("", "D-")])
def test_message_streams(spark, key, want):
    assert one(spark, names.message_stream(F.lit(key).cast("string"), "D")) == want


@pytest.mark.parametrize(("tranche", "want"), [("0", "s_0"), ("", "s"), (None, "s")])
def test_series(spark, tranche, want):
    assert one(spark, names.series_key(F.lit("s"), F.lit(tranche).cast("string"))) == want


def test_epoch_positions(spark):
    assert one(spark, positions.epoch_position(F.lit(3), F.lit(17))) == 3_000_017
    assert one(spark, positions.epoch_position(F.lit(3), F.lit(17), F.lit(True))) == 4_000_000
    e, o = positions.position_epoch(F.lit(3_000_017))
    assert (one(spark, e), one(spark, o)) == (3, 17)
    s, o = positions.position_time(F.lit(0).cast("long"))
    assert (one(spark, s), one(spark, o)) == (None, None)


@pytest.mark.parametrize(("seconds", "want"), [(5, "5s"), (65, "1m05s"), (3700, "1h01m"), (90000, "1d01h"), (0.9, "0s")])
def test_humanized(spark, seconds, want):
    assert one(spark, positions.humanized(F.lit(seconds))) == want


def test_chunks(spark):
    p = (5 << 28) + 7
    assert one(spark, positions.chunk(F.lit(p))) == 5
    assert one(spark, positions.next_chunk(F.lit(p))) == 6 << 28
    assert one(spark, positions.percent_position(F.lit(10 << 28), F.lit(55))) == 5 << 28


def test_index_events_read_both_forms(spark):
    rows = spark.createDataFrame([('{"partition":0,"tranche":null,"epoch":2}',), ('{"tranche":3,"epoch":2}',)], "j string")
    x = rows.select(F.from_json("j", "partition int, tranche int, epoch int").alias("x"))
    assert [tuple(r) for r in x.select(F.coalesce("x.partition", "x.tranche"), "x.epoch").collect()] == [(0, 2), (3, 2)]


def test_documents_and_spans_that_arent(spark):
    bad = spark.createDataFrame([("{}",), ("not json",), ('{"p": "a", "i": 0, "n": 1}',), (None,), ('{"p":"A-1","i":4,"n":6,"e":[{"c":"x","d":"{}"},{"c":"y"}],"u":[{"c":"s"}],"_ts":1.5}',)], "value string")
    got = codec.document_events(bad).orderBy("is_unfold", "index").collect()
    assert [(r["stream"], r["index"], r["is_unfold"], r["event_type"]) for r in got] == [("A-1", 4, False, "x"), ("A-1", 5, False, "y"), ("A-1", 6, True, "s")]
    assert got[0]["ts"].timestamp() % 60 == 1.5
    assert codec.document_events(bad, unfolds=False).count() == 2
    assert codec.parse_spans(bad).count() == 0
    s = spark.createDataFrame([('{"s":"A-1","i":7,"u":[{"c":"p"},{"c":"q"}]}',)], "value string")
    assert [(r["index"], r["event_type"]) for r in codec.parse_summaries(s).collect()] == [(7, "p"), (7, "q")]


def test_rendered_spans_leave_null_metadata_out(spark):
    e = spark.createDataFrame([("A-1", 1, "b", "{}", None), ("A-1", 0, "a", "{}", "m")], "stream string, index long, event_type string, data string, meta string").withColumn("ts", F.timestamp_seconds(F.lit(0)))
    text = codec.render_spans(e).first()["value"]
    assert text.startswith('{"s":"A-1","i":0,"e":[{"c":"a"')
    assert [(r["index"], r["event_type"], r["meta"]) for r in codec.parse_spans(codec.render_spans(e)).orderBy("index").collect()] == [(0, "a", "m"), (1, "b", None)]
