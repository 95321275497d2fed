import json

from weftline import cli
from weftline.streaming.run import CheckpointTable


def test_checkpoint(spark, tmp_path, capsys):
    path = str(tmp_path / "table")
    cli.main(["init", path])
    cli.main(["checkpoint", path, "--source", "s", "--group", "g", "--position", "12"])
    assert CheckpointTable(spark, path).start("s", "0", "g") == 12
    assert "12" in capsys.readouterr().out


def test_sync_stats(spark, tmp_path, capsys):
    f = tmp_path / "e.jsonl"
    f.write_text("".join(json.dumps({"stream": s, "index": k, "event_type": t}) + "\n" for k, (s, t) in enumerate([("A-1", "x"), ("A-2", "y"), ("B-1", "x"), ("$sys-1", "x")])))
    cli.main(["sync", "stats", "--from-json", str(f), "--deny-categories", "B", "--events", "x"])
    out = capsys.readouterr().out
    assert "|A       |x" in out
    assert "B-" not in out
    assert "sys" not in out


def test_index(spark, tmp_path, capsys):
    f = tmp_path / "export.json"
    line = lambda p, n, c: json.dumps({"Item": {"p": {"S": p}, "n": {"N": str(n)}, "c": {"L": [{"S": x} for x in c]}}})
    f.write_text("\n".join([line("A-1", 2, ["a", "b"]), line("A-1", 3, ["c"]), line("B-1", 5, ["z"])]))
    cli.main(["index", str(f)])
    out = capsys.readouterr().out
    assert "|2      |3     |0       |0      |1     |" in out


def test_sync_documents_to_a_table(spark, tmp_path):
    f, out = tmp_path / "docs.jsonl", str(tmp_path / "out")
    doc = {"p": "A-1", "i": 2, "n": 4, "e": [{"c": "x", "d": "1"}, {"c": "y"}], "u": [], "_ts": 1.5e9}
    f.write_text(json.dumps(doc) + "\n" + json.dumps({"id": "other"}) + "\n" + json.dumps(doc | {"p": "B-1"}))
    cli.main(["sync", "table", out, "--from-documents", str(f), "--categories", "A"])
    assert {(r["stream"], r["index"], r["event_type"]) for r in spark.read.parquet(out).collect()} == {("A-1", 2, "x"), ("A-1", 3, "y")}


def test_sync_from_a_database(spark, tmp_path):
    """Pages of two categories from an embedded database, then nothing new, then what came meanwhile."""
    url, positions, out = f"jdbc:derby:memory:feed{tmp_path.name};create=true", str(tmp_path / "positions"), str(tmp_path / "out")
    kind = "position long, type string, data string, metadata string, id string, time timestamp, stream_name string, global_position long"
    rows = [(k // 2, "t", None if k == 3 else f"{k}", None, str(k), None, f"{'Abc'[k % 2]}{'x'}-{k % 4}", k) for k in range(11)]
    write = lambda part: spark.createDataFrame(part, kind).write.format("jdbc").options(url=url, dbtable="messages").mode("append").save()
    messages = """SELECT * FROM messages WHERE "stream_name" LIKE '{category}-%' AND "global_position" >= {position} ORDER BY "global_position" FETCH FIRST {limit} ROWS ONLY"""
    call = ["sync", "table", out, "--from-jdbc", url, "--messages", messages, "--category", "Ax", "bx", "--checkpoints", positions, "--page-size", "2"]
    write(rows[:9])
    for _ in range(2):
        cli.main(call)
        assert sorted(r["position"] for r in spark.read.parquet(out).collect()) == list(range(9))
    write(rows[9:])
    cli.main(call)
    got = {r["position"]: r for r in spark.read.parquet(out).collect()}
    assert sorted(got) == list(range(11))
    assert (got[3]["data"], got[4]["stream"]) == ("null", "Ax-0")
    assert {(r["tranche"], r["position"]) for r in CheckpointTable(spark, positions).positions().collect()} == {("Ax", 11), ("bx", 10)}
