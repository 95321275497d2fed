"""Streaming operators: restarts, partial progress, failures, checkpoint table, paged feed."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.sources.feeds import all_feed, paged, read_json_lines, recrawl
from weftline.streaming import batches, buffers, run, sinks

ROW = "stream string, index long, event_type string, data string"


def done(stream, events):
    return "ok", int(events["index"].iloc[-1]) + 1


def feed(spark, folder, rows):
    spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(folder)


def test_restart_equals_single_run(spark, tmp_path):
    folder, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    seen = []
    for rows in ([("a", 0, "t", "x"), ("a", 1, "t", "x"), ("b", 2, "t", "x")], [("a", 1, "t", "again"), ("a", 2, "t", "x"), ("b", 0, "t", "x"), ("b", 1, "t", "x")]):
        feed(spark, folder, rows)
        stream = spark.readStream.schema(ROW).parquet(folder)
        run.run_to_end(buffers.project(stream, done, require_all=True), out, ck)
        seen.append({(r["stream"], r["i"], r["index_next"]) for r in spark.read.parquet(out).collect()})
    assert seen[0] == {("a", 0, 2)}
    assert seen[1] == {("a", 0, 2), ("a", 2, 3), ("b", 0, 3)}


def test_partial_progress_failure_and_poison(spark, tmp_path):
    def handle(stream, events):
        if stream == "bad":
            raise RuntimeError("transient")
        if stream == "poison":
            raise buffers.Malformed
        if stream == "stuck":
            return "ok", int(events["index"].iloc[0])
        return "ok", int(events["index"].iloc[0]) + 1

    folder, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    feed(spark, folder, [(s, i, "t", "x") for s in ("one", "bad", "poison", "stuck") for i in range(3)])
    run.run_to_end(buffers.project(spark.readStream.schema(ROW).parquet(folder), handle), out, ck)
    r = {}
    for x in spark.read.parquet(out).collect():
        r.setdefault(x["stream"], []).append((x["i"], x["index_next"], x["outcome"]))
    assert sorted(r["one"]) == [(0, 1, "ok"), (1, 2, "ok"), (2, 3, "ok")]
    assert r["bad"] == [(0, 0, "failed: RuntimeError")]
    assert r["poison"] == [(0, 0, "malformed")]
    assert r["stuck"] == [(0, 0, "ok")]


def test_health(spark):
    rows = [("a-ok", 0, 1, "ok", 1), ("a-bad", 0, 0, "failed: X", 1), ("a-stuck", 0, 0, "ok", 1), ("a-bad", 0, 0, "failed: X", 2)]
    r = buffers.classify_health(spark.createDataFrame(rows, "stream string, i long, index_next long, outcome string, attempt int"))
    assert {tuple(x) for x in r.collect()} == {("a-ok", "ok"), ("a-bad", "failing"), ("a-stuck", "stuck")}


def test_sequence_goes_on(spark, tmp_path):
    folder, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    kind = "stream string, arrival long"
    for rows in ([("a", 1), ("b", 2), ("a", 3)], [("a", 4), ("b", 5)]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(folder)
        run.run_to_end(buffers.sequence(spark.readStream.schema(kind).parquet(folder)), out, ck)
    assert {tuple(x) for x in spark.read.parquet(out).select("stream", "arrival", "index").collect()} == {("a", 1, 0), ("a", 3, 1), ("a", 4, 2), ("b", 2, 0), ("b", 5, 1)}


def test_checkpoint_table(spark, tmp_path):
    t = run.CheckpointTable(spark, str(tmp_path / "positions"))
    kind = "source string, tranche string, consumer_group string, position long"
    assert t.start("s", "0", "g") == 0
    assert t.start("s", "0", "g", lambda: 7) == 7
    t.commit(spark.createDataFrame([("s", "0", "g", 5), ("s", "1", "g", 9)], kind), 0)
    t.commit(spark.createDataFrame([("s", "0", "g", 8)], kind), 1)
    t.commit(spark.createDataFrame([("s", "0", "g", 8)], kind), 1)
    assert (t.start("s", "0", "g"), t.start("s", "1", "g")) == (8, 9)
    t.override("s", "0", "g", 2)
    assert t.start("s", "0", "g") == 2


def test_batched_and_parallel(spark):
    e = spark.createDataFrame([("a", 0, "t", "x"), ("a", 1, "t", "y"), ("b", 4, "t", "x"), ("c", 0, "t", "x")], ROW)
    chosen = lambda p: p.where("stream <> 'c'").select("stream", F.when(F.col("stream") == "a", 2).otherwise(1).alias("ordinal"))
    handle = lambda items: items.select("ordinal", F.lit("ok").alias("outcome"), F.when(F.col("ordinal") == 2, F.col("span.next")).otherwise(F.col("span.i")).alias("index_next"))
    got = sinks.handle_batched(e, chosen, handle).collect()
    assert {tuple(r) for r in got} == {("a", 0, 2, "ok", 2), ("b", 4, 4, "ok", 0)}
    assert {r["n"] for r in sinks.handle_parallel(e, lambda p: pd.DataFrame({"n": p["index"] + 1}), "n long").collect()} == {1, 2, 5}


def test_checkpoint_table_of_several_writers(spark, tmp_path):
    """Two sources that write their batch 0 keep both positions; a query whose batch ids begin again comes behind an override; a repeated batch counts once."""
    path, kind = str(tmp_path / "positions"), "source string, tranche string, consumer_group string, position long"
    one = lambda source, position: spark.createDataFrame([(source, "0", "g", position)], kind)
    t = run.CheckpointTable(spark, path)
    t.commit(one("A", 10), 0, "qa")
    t.commit(one("B", 20), 0, "qb")
    t.commit(one("C", 30), 0)
    t.commit(one("D", 40), 0)
    assert {r["source"]: r["position"] for r in t.positions().collect()} == {"A": 10, "B": 20, "C": 30, "D": 40}
    for batch, position in enumerate((100, 200, 300)):
        t.commit(one("A", position), batch, "qa")
    t.override("A", "0", "g", 50)
    assert t.start("A", "0", "g") == 50
    again = run.CheckpointTable(spark, path)
    again.commit(one("A", 60), 0, "qa restarted")
    assert again.start("A", "0", "g") == 60
    assert [r["position"] for r in again.history().where("source = 'A'").collect()] == [100, 200, 300, 50, 60]
    again.commit(one("A", 61), 0, "qa restarted")
    assert again.history().where("source = 'A'").count() == 5
    again.compact()
    assert again.history().count() == 4
    assert {r["source"]: r["position"] for r in again.positions().collect()} == {"A": 61, "B": 20, "C": 30, "D": 40}


def test_checkpoints_in_a_database(spark, tmp_path):
    options = {"url": f"jdbc:derby:memory:positions{tmp_path.name};create=true"}
    t = run.JdbcCheckpoints(spark, options, "positions")
    kind = "source string, tranche string, consumer_group string, position long"
    assert t.start("s", "0", "g", lambda: 7) == 7
    for batch, position in ((0, 5), (1, 8), (1, 8)):
        t.commit(spark.createDataFrame([("s", "0", "g", position), ("s", "1", "g", 1)], kind), batch)
    assert (t.start("s", "0", "g"), t.start("s", "1", "g")) == (8, 1)
    t.override("s", "0", "g", 2)
    assert run.JdbcCheckpoints(spark, options, "positions").start("s", "0", "g") == 2


def test_nulls_and_copies_wait_in_order(spark, tmp_path):
    """What waits behind a gap keeps its nulls; of copies the first arrival counts, in a micro-batch and before it."""
    seen = str(tmp_path / "seen")

    def handle(stream, events):
        with open(seen, "a") as f:
            f.write(json.dumps(events["data"].tolist()) + "\n")
        return done(stream, events)

    folder, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    kind = "arrival long, " + ROW
    for rows in ([(9, "a", 1, "t", "late"), (2, "a", 1, "t", None), (3, "a", 2, "t", "x")], [(1, "a", 1, "t", "later"), (4, "a", 0, "t", "None")]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(folder)
        run.run_to_end(buffers.project(spark.readStream.schema(kind).parquet(folder), handle, require_all=True), out, ck)
    with open(seen) as f:
        assert [json.loads(x) for x in f] == [["None", None, "x"]]


def run_both(spark, tmp_path, batches_of_rows, handle, kind=ROW, **options):
    """Results of the stateful operator and of the table form after each delivery, which must be the same."""
    folder, out, ck, table, ck2 = (str(tmp_path / x) for x in ("in", "out", "ck", "table", "ck2"))
    seen = []
    for rows in batches_of_rows:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(kind).parquet(folder)
        run.run_to_end(buffers.project(stream, handle, **options), out, ck)
        other = batches.project(stream, handle, table, ck2, snapshot_every=2, **options)
        one, two = (sorted(map(tuple, df.collect())) for df in (spark.read.parquet(out).select(*other.columns), other))
        assert one == two
        seen.append(two)
    return seen


@pytest.mark.parametrize("require_all", [False, True])
def test_table_form_equals_the_stateful_operator(spark, tmp_path, require_all):
    def handle(stream, events):
        first = int(events["index"].iloc[0])
        if stream == "bad" and first % 3 == 1:
            raise RuntimeError("transient")
        if stream == "poison" and first >= 4:
            raise buffers.Malformed
        if stream == "jump":
            return "skips", first + len(events) + 2
        return "ok", first + (1 if stream == "slow" else len(events))

    rng = random.Random(5)
    deliveries = []
    for at in (0, 4, 2, 8, 8):
        rows = [(s, i, "t", None if i % 2 else s) for s in ("one", "bad", "poison", "jump", "slow") for i in range(at, at + rng.randint(2, 6)) if rng.random() < 0.9]
        deliveries.append([*rows, *rows[:3], (f"s{at}", at, "t", "x")])
    seen = run_both(spark, tmp_path, deliveries, handle, require_all=require_all, max_events=3)
    assert {r[3] for r in seen[-1]} >= ({"ok"} if require_all else {"ok", "skips", "malformed", "failed: RuntimeError"})


def test_table_form_of_long_runs(spark, tmp_path):
    """Runs that go on over Arrow batches, cut at max_events."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(100).selectExpr("if(id < 60, 'a', 'b') AS stream", "id AS index", "'t' AS event_type", "'' AS data", "CAST(null AS long) AS write_pos", "false AS malformed")
        got = batches.walk(rows, done, max_events=10).where("kind = 'result'").orderBy("i").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert [(r["stream"], r["i"], r["index_next"]) for r in got] == [("a" if k < 60 else "b", k, k + 10) for k in range(0, 100, 10)]


def test_failed_streams_are_tried_again_on_a_timer(spark, tmp_path):
    mark = tmp_path / "failed"

    def handle(stream, events):
        if not mark.exists():
            mark.write_text("once")
            raise RuntimeError("transient")
        return done(stream, events)

    folder = str(tmp_path / "in")
    feed(spark, folder, [("a", 0, "t", "x")])
    got = []
    results = buffers.project(spark.readStream.schema(ROW).parquet(folder), handle, retry_ms=200)
    with run.Tail(results, lambda df, _: got.extend(r["outcome"] for r in df.collect()), str(tmp_path / "ck"), 0.2) as tail:
        for _ in range(100):
            if "ok" in got:
                break
            tail.wait(0.3)
    assert got == ["failed: RuntimeError", "ok"]


def test_tail_goes_on_after_failures(spark, tmp_path):
    folder, got, failures = str(tmp_path / "in"), [], [1, 2]
    feed(spark, folder, [("a", 0, "t", "x")])

    def handle(df, batch_id):
        if failures:
            raise RuntimeError(f"transient {failures.pop()}")
        got.extend(r["index"] for r in df.collect())

    stream = spark.readStream.schema(ROW).parquet(folder)
    with run.Tail(stream, handle, str(tmp_path / "ck"), 0.1, wait_s=lambda k: 0.1) as tail:
        assert tail.await_caught_up(60, fully=True)
        assert got == [0]
        feed(spark, folder, [("a", 1, "t", "x")])
        tail.await_caught_up(60, fully=True)
        assert got == [0, 1]
    assert not tail.supervise()
    with pytest.raises(RuntimeError, match="stopped"):
        tail.await_caught_up(5)
    failures += range(50)
    feed(spark, folder, [("a", 2, "t", "x")])
    with pytest.raises(Exception, match="transient"), run.Tail(stream, handle, str(tmp_path / "ck"), 0.1, wait_s=lambda k: 0.05, max_failures=2) as tail:
        tail.wait(60)


def test_progress_log(spark, tmp_path):
    import time

    from weftline.operators import metrics
    from weftline.streaming.listener import ProgressLog

    feed(spark, str(tmp_path / "in"), [("a", k, "t", "x") for k in range(7)])
    stream = spark.readStream.schema(ROW).parquet(str(tmp_path / "in"))
    with ProgressLog(spark) as log:
        run.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
        with pytest.raises(Exception, match="ZeroDivisionError"):
            run.for_each_batch(stream, lambda df, _: 1 / 0 if df.count() else None, str(tmp_path / "ck2"))
        for _ in range(100):
            if log.errors and log.rows:
                break
            time.sleep(0.1)
    assert log.table().agg(F.sum("rows")).first()[0] >= 7
    assert "ZeroDivisionError" in log.errors[0][1]
    shares = metrics.duration_shares(log.table(), ["results", "dispatch", "commit", "sleep"]).collect()
    assert sum(r["share"] for r in shares) == pytest.approx(1, abs=1e-4)


def test_retry():
    left = [1, 2]

    def step():
        if left:
            raise ValueError(left.pop())
        return "done"

    assert run.retry(step, lambda k: 0.01) == "done"
    left += range(1000)
    with pytest.raises(ValueError, match="9"):
        run.retry(step, lambda k: 0.05, 0.2)


def test_chunks_drain(spark):
    """Every chunk keeps to the budgets; what a handler leaves begins the next chunk; failures and no progress stop the stream alone."""
    rows = [(s, i, "t", "x", 10) for s in ("all", "half", "stuck", "bad") for i in range(10)] + [("big", 0, "t", "x", 1000), ("big", 1, "t", "x", 5)]
    e = spark.createDataFrame(rows, ROW + ", size long")

    def handle(stream, events):
        if stream == "bad" and events["index"].iloc[0] >= 3:
            raise RuntimeError("no")
        if stream == "stuck":
            return "ok", int(events["index"].iloc[0])
        return "ok", int(events["index"].iloc[0]) + (2 if stream == "half" else len(events))

    got = {}
    for r in sinks.handle_chunks(e, handle, 3, 40).orderBy("stream", "i").collect():
        got.setdefault(r["stream"], []).append((r["i"], r["index_next"], r["n_events"]))
    assert got["all"] == [(0, 3, 3), (3, 6, 3), (6, 9, 3), (9, 10, 1)]
    assert got["half"] == [(0, 2, 2), (2, 4, 2), (4, 6, 2), (6, 8, 2), (8, 10, 2)]
    assert got["stuck"] == [(0, 0, 0)]
    assert got["bad"] == [(0, 3, 3), (3, 3, 0)]
    assert got["big"] == [(0, 1, 1), (1, 2, 1)]
    by_bytes = sinks.handle_chunks(e.where("stream = 'all'"), handle, None, 40).orderBy("i").collect()
    assert [(r["i"], r["index_next"]) for r in by_bytes] == [(0, 4), (4, 8), (8, 10)]
    assert sinks.handle_streams(e.where("stream = 'all'"), handle).count() == 1
    assert sinks.handle_chunks(e.limit(0), handle).count() == 0


def test_long_streams_take_linear_time(spark):
    from weftline.operators import index, spans

    e = spark.range(400_000).select(F.lit("a").alias("stream"), F.col("id").alias("index"), F.lit(1).alias("size"))
    assert spans.chunk_queue(e, 2, 100).count() == 200_000
    b = spark.range(400_000).select(F.lit(0).alias("partition"), F.col("id").alias("batch"), F.lit(1).alias("size"))
    assert index.assign_epochs(b, "size", 1, ["batch"]).agg(F.max("epoch")).first()[0] == 199_999


def test_batched_results_must_be_whole(spark):
    e = spark.createDataFrame([("a", 0, "t", "x"), ("b", 0, "t", "x")], ROW)
    some = lambda items: items.where("stream = 'a'").select("ordinal", F.lit("ok").alias("outcome"), F.lit(1).alias("index_next"))
    with pytest.raises(Exception, match="b: not one result"):
        sinks.handle_batched(e, lambda p: p.select("stream"), some).collect()


def test_parallel_batches(spark):
    rows = [(1, True, False), (1, True, False), (2, True, False), (2, None, None), (3, True, True)]
    got = sinks.batch_states(spark.createDataFrame(rows, "batch int, done boolean, failed boolean")).collect()
    assert {r["batch"]: r["state"] for r in got} == {1: "completed", 2: "busy", 3: "faulted"}


def test_stripes_and_smaller_pages(spark):
    def page(at, n):
        if n > 2:
            raise OSError("too large")
        return [("S-1", i, "e", "x") for i in range(at, min(10, at + n))], min(10, at + n)

    spark.dataSource.register(all_feed("striped_test", lambda: 10, page))
    feed_ = spark.read.format("striped_test").option("stripe", "4").option("page_size", "8").option("least_page", "2").option("data", "false")
    got = feed_.option("from", json.dumps({"0": 1})).load()
    assert got.rdd.getNumPartitions() == 3
    assert sorted((r["position"], r["data"]) for r in got.collect()) == [(k, None) for k in range(2, 11)]
    assert spark.read.format("striped_test").option("from_tail", "true").load().count() == 0


def test_recrawl(spark):
    seen, positions = [], []
    items = spark.range(5).toDF("k")
    at = recrawl(lambda: items, lambda df, batch: seen.append((batch, df.count(), len(positions))), "k", 0.0, positions.append, 2)
    assert seen == [(0, 4, 0), (1, 1, 0), (2, 4, 1), (3, 1, 1)]
    assert at == positions[-1] >= positions[0]
    assert recrawl(lambda: items.limit(0), lambda df, batch: None, "k", 0.0, positions.append, 1) == 0


def test_paged_feed_from_position(spark):
    spark.dataSource.register(paged("paged_test", lambda: ["x"], lambda t: 10, lambda t, at, n: ([("S-1", i, "e", "") for i in range(at, min(10, at + n))], min(10, at + n))))
    got = spark.read.format("paged_test").option("from", json.dumps({"x": 4})).option("page_size", "3").load()
    assert sorted(r["position"] for r in got.collect()) == list(range(5, 11))


@pytest.mark.parametrize(("skip", "truncate", "want"), [(0, None, [1, 3, 4]), (1, None, [3, 4]), (2, 1, [3]), (9, None, [])])
def test_json_lines(spark, tmp_path, skip, truncate, want):
    p = tmp_path / "f.jsonl"
    p.write_text('{"a": 1}\n# note\n{"a": 3}\n{"a": 4}\n')
    got = read_json_lines(spark, str(p), "a int", skip, truncate)
    assert sorted((r["line"], r["item"]["a"]) for r in got.collect()) == [(n, n) for n in want]


def test_json_lines_of_several_files(spark, tmp_path):
    """Each file is numbered by itself, whatever order and pieces it is read in."""
    for name, n in (("a", 3), ("b", 40), ("c", 4000)):
        (tmp_path / f"{name}.json").write_text("".join(json.dumps({"a": k}) + "\n" for k in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = read_json_lines(spark, str(tmp_path), "a int", 2, 100).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    by = {}
    for r in got:
        by.setdefault(r["file"][-6], []).append((r["line"], r["item"]["a"]))
    assert {k: sorted(v) for k, v in by.items()} == {k: [(i + 1, i) for i in range(2, min(n, 102))] for k, n in (("a", 3), ("b", 40), ("c", 4000))}


def test_json_lines_by_http(spark, tmp_path):
    import http.server
    import threading

    (tmp_path / "feed.json").write_text('{"a": 1}\n{"a": 2}\n')
    handler = lambda *a: http.server.SimpleHTTPRequestHandler(*a, directory=str(tmp_path))
    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        got = read_json_lines(spark, f"http://127.0.0.1:{server.server_address[1]}/feed.json", "a int").collect()
        server.shutdown()
    assert sorted((r["line"], r["item"]["a"]) for r in got) == [(1, 1), (2, 2)]


def test_filters(spark):
    from weftline.functions.filters import allowed

    df = spark.createDataFrame([("Order",), ("Orders",), ("",), ("Sys",)], "n string")
    names = lambda **k: {r["n"] for r in df.where(allowed(F.col("n"), **k)).collect()}
    assert names() == {"Order", "Orders", "", "Sys"}
    assert names(allow=["Order"]) == {"Order"}
    assert names(allow=["^Ord"], deny=["Orders"]) == {"Order"}
    assert names(allow=[""]) == {""}


def test_purge_and_require_all_exclude_each_other(spark):
    stream = spark.readStream.format("rate").load().selectExpr("'a' AS stream", "value AS index", "'t' AS event_type", "'' AS data")
    with pytest.raises(ValueError, match="excludes"):
        buffers.project(stream, done, require_all=True, purge_ms=1000)


def test_health_abend(spark):
    kind = "stream string, i long, index_next long, outcome string, attempt int, age_s double"
    rows = [("a-ok", 0, 1, "ok", 1, 9.0), ("a-bad", 0, 0, "failed: X", 1, 4.0), ("a-stuck", 0, 0, "ok", 1, 5.0)]
    r = spark.createDataFrame(rows, kind)
    buffers.raise_if_unhealthy(r, 10)
    with pytest.raises(buffers.Unhealthy, match="1 failing for up to 4 s, 1 stuck for up to 5 s"):
        buffers.raise_if_unhealthy(r, 3)


def test_index_epochs_and_gaps(spark, tmp_path):
    from weftline.streaming.indexer import GapError, IndexTable

    kind = "partition long, p string, index long, event_type string"
    batch = lambda *rows: spark.createDataFrame([(0, *r) for r in rows], kind)
    t = IndexTable(spark, str(tmp_path / "ix"), epoch_bytes=11, on_gap="error")
    t.ingest(batch(("a", 0, "x"), ("a", 1, "x")), 0)
    assert [(r["epoch"], r["bytes"], r["streams"], r["closed"]) for r in t.epochs().collect()] == [(0, 11, 1, False)]
    for _ in range(2):
        t.ingest(batch(("a", 1, "x"), ("a", 2, "y")), 1)
    t.ingest(batch(("a", 3, "y"), ("b", 0, "z")), 2)
    assert {(r["epoch"], r["p"], r["index"]) for r in t.rows().collect()} == {(0, "a", 0), (0, "a", 1), (0, "a", 2), (1, "a", 3), (1, "b", 0)}
    assert {(r["p"], r["version"], r["epoch"]) for r in t.versions().collect()} == {("a", 4, 1), ("b", 1, 1)}
    with pytest.raises(GapError, match="a: 5 after 4"):
        t.ingest(batch(("a", 5, "x")), 3)
    left = IndexTable(spark, str(tmp_path / "iy"), epoch_versions=2)
    left.ingest(batch(("a", 0, "x"), ("a", 2, "x")), 0)
    left.ingest(batch(("a", 1, "x")), 1)
    left.ingest(batch(("a", 2, "x")), 2)
    assert sorted((r["epoch"], r["index"]) for r in left.rows().collect()) == [(0, 0), (0, 1), (1, 2)]
    few = IndexTable(spark, str(tmp_path / "iz"), epoch_streams=2)
    few.ingest(batch(("a", 0, "x"), ("b", 0, "x")), 0)
    few.ingest(batch(("a", 1, "x")), 1)
    assert sorted((r["p"], r["epoch"]) for r in few.rows().collect()) == [("a", 0), ("a", 1), ("b", 0)]
