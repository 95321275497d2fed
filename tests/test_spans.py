"""Span merging, chunking, index spans: example tables, invariants on random input, equality with plain Python."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.operators import index, spans, state

ROW = "stream string, min long, span_no long, index long, is_unfold boolean, event_type string, pos int"


def ev(p, c, seg=0):
    return [(p + k, False, str(p + k), seg) for k in range(c)]


def un(p, u, seg=0):
    return [(p, True, f"{p}u{k}", seg) for k in range(u)]


# case -> min, input spans, expected spans
CASES = {
    "nothing": (0, [[], []], []),
    "synced": (1, [ev(0, 1), []], []),
    "no overlap": (0, [ev(0, 1), ev(2, 2)], [ev(0, 1), ev(2, 2)]),
    "overlap": (0, [ev(0, 1), ev(0, 2)], [ev(0, 2)]),
    "remove nulls": (1, [ev(0, 1), ev(0, 2)], [ev(1, 1)]),
    "adjacent": (0, [ev(0, 1), ev(1, 2)], [ev(0, 3)]),
    "adjacent to min merge": (2, [ev(0, 1), ev(1, 2), un(2, 2)], [ev(2, 1)]),
    "adjacent to min no overlap": (2, [ev(0, 2) + un(2, 1), ev(2, 1)], [ev(2, 1)]),
    "adjacent trim merge": (1, [ev(0, 2), ev(2, 2)], [ev(1, 3)]),
    "adjacent trim append merge": (1, [ev(0, 2), ev(2, 2), ev(5, 1)], [ev(1, 3), ev(5, 1)]),
    "mixed": (1, [ev(0, 2), ev(5, 1), ev(2, 2), un(4, 2)], [ev(1, 3), ev(5, 1)]),
    "far": (11614, [[], ev(11614, 1)], [ev(11614, 1)]),
    "far 2": (11613, [ev(11614, 1), []], [ev(11614, 1)]),
    "unfold kept": (0, [un(0, 1)], [un(0, 1)]),
    "unfolds kept": (0, [un(0, 2)], [un(0, 2)]),
    "retain at non-0": (1, [ev(0, 1) + un(1, 1)], [un(1, 1)]),
    "last unfolds win": (0, [un(0, 1), un(0, 2)], [un(0, 2)]),
}


def as_rows(name, low, given_spans):
    return [(name, low, no, i, u, t, pos) for no, span in enumerate(given_spans) for pos, (i, u, t, _) in enumerate(span)]


def merged(spark, rows):
    out = spans.merge_spans(spark.createDataFrame(rows, ROW)).orderBy("stream", "out_i", "index", "is_unfold", "pos").collect()
    found = {}
    for r in out:
        found.setdefault(r["stream"], {}).setdefault(r["out_i"], []).append((r["index"], r["is_unfold"], r["event_type"]))
    return found


def test_examples(spark):
    found = merged(spark, [r for name, (low, given_spans, _) in CASES.items() for r in as_rows(name, low, given_spans)])
    for name, (_, _, want) in CASES.items():
        got = [v for _, v in sorted(found.get(name, {}).items())]
        assert got == [[(i, u, t) for i, u, t, _ in s] for s in want], name


def test_drop_before(spark):
    rows = as_rows("s", 0, [ev(0, 1), ev(1, 2), un(1, 1), un(2, 2)])
    got = spans.drop_before(spark.createDataFrame(rows, ROW), F.lit(2)).orderBy("span_no", "pos").collect()
    assert [(r["span_no"], r["index"], r["is_unfold"]) for r in got] == [(1, 2, False), (3, 2, True), (3, 2, True)]


def sequential(low, given_spans):
    """The same rules, one span after the other."""
    live = [[x for x in s if x[0] >= low] for s in given_spans]
    live = [(min(x[0] for x in s), no, s) for no, s in enumerate(live) if s]
    top = max((x[0] + (0 if x[1] else 1) for _, _, s in live for x in s), default=0)
    events = {}
    for _, _, s in sorted(live, key=lambda x: x[:2]):
        for x in s:
            if not x[1]:
                events.setdefault(x[0], x)
    tails = [(f, no, [x for x in s if x[1] and x[0] == top]) for f, no, s in live]
    tails = [t for t in tails if t[2]]
    out, at = [], None
    for i in sorted(events):
        if at is None or i != at:
            out.append([])
        out[-1].append(events[i][:3])
        at = i + 1
    if tails:
        last = [x[:3] for x in max(tails, key=lambda t: t[:2])[2]]
        if out and at == top:
            out[-1] += last
        else:
            out.append(last)
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10**6))
def test_random_spans(spark, seed):
    rng, cases = random.Random(seed), {}
    for k in range(60):
        at, given_spans = 0, []
        for no in range(rng.randint(0, 5)):
            at = max(0, at + rng.randint(-4, 3))
            n, u = rng.randint(0, 5), rng.choice((0, 0, 1, 2))
            given_spans.append(ev(at, n) + [(at + n, True, f"{no}u{j}", 0) for j in range(u)])
            at += n
        rng.shuffle(given_spans)
        cases[f"c{k}"] = (rng.randint(0, 4), given_spans)
    found = merged(spark, [r for name, (low, s) in cases.items() for r in as_rows(name, low, s)] or [("x", 0, 0, 0, False, "0", 0)])
    for name, (low, s) in cases.items():
        got = [v for _, v in sorted(found.get(name, {}).items())]
        assert got == sequential(low, s), (name, low, s)
        flat = [x for v in got for x in v]
        assert [x[0] for x in flat] == sorted(x[0] for x in flat)
        assert not any(x[1] for v in got[:-1] for x in v)


QUEUE = {  # added, existing, expected: (i, n)
    "a": ((0, 1), [(2, 1)], [(0, 1), (2, 1)]), "b": ((0, 1), [(1, 1)], [(0, 2)]), "c": ((0, 2), [(2, 1)], [(0, 3)]), "d": ((0, 2), [(2, 1), (4, 1)], [(0, 3), (4, 1)]), "e": ((0, 3), [(1, 1), (4, 1)], [(0, 3), (4, 1)]),
    "f": ((0, 3), [(2, 1), (4, 1)], [(0, 3), (4, 1)]), "g": ((0, 3), [(0, 2), (3, 1)], [(0, 4)]), "h": ((0, 3), [(0, 2), (4, 1)], [(0, 3), (4, 1)]), "i": ((0, 2), [(2, 3)], [(0, 5)]), "j": ((1, 1), [(0, 1), (2, 3)], [(0, 5)]),
    "k": ((1, 4), [(0, 1)], [(0, 5)]), "l": ((2, 1), [(0, 1)], [(0, 1), (2, 1)]), "m": ((2, 1), [(0, 1), (3, 1)], [(0, 1), (2, 2)]), "n": ((1, 1), [(0, 3)], [(0, 3)]), "o": ((0, 1), [], [(0, 1)]),
}


def test_index_queue(spark):
    rows = [(k, i, n) for k, (add, old, _) in QUEUE.items() for i, n in [add, *old]]
    got = {}
    for r in spans.merge_index_spans(spark.createDataFrame(rows, "p string, i long, n long")).orderBy("p", "i").collect():
        got.setdefault(r["p"], []).append((r["i"], r["next"] - r["i"]))
    assert got == {k: want for k, (_, _, want) in QUEUE.items()}
    again = spans.merge_index_spans(spark.createDataFrame([(k, i, n) for k, v in got.items() for i, n in v] + rows, "p string, i long, n long"))
    assert again.count() == sum(map(len, got.values()))


def test_epoch_decisions(spark):
    s = spark.createDataFrame([("new", 0, 2), ("app", 1, 2), ("old", 0, 1), ("gap", 2, 1)], "p string, i long, n long")
    v = spark.createDataFrame([("app", 2), ("old", 2), ("gap", 1)], "p string, version long")
    got = {r["p"]: (r["kind"], r["from"], r["n_new"]) for r in index.classify(s, v).collect()}
    assert got == {"new": ("start", 0, 2), "app": ("append", 2, 1), "old": ("discard", 2, 0), "gap": ("gap", 2, 0)}


def test_batch_progress(spark):
    b = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (1, "a", 3), (2, "c", 1)], "batch int, stream string, required long")
    done = lambda p: [r["batch"] for r in state.batch_completion(b, state.remove_attained(b, spark.createDataFrame(p, "stream string, write_pos long"))).where("completed").orderBy("batch").collect()]
    assert done([("a", 0), ("b", 0)]) == []
    assert done([("a", 1), ("b", 3), ("c", 5)]) == [0]
    assert done([("a", 3), ("b", 3), ("c", 5)]) == [0, 1, 2]


@pytest.mark.parametrize(("i", "n", "a", "want"), [(2, 5, 2, ("ok", 5)), (2, 5, 1, ("prefix_missing", 1)), (2, 5, 5, ("duplicate", 5)), (2, 5, 3, ("partial_duplicate", 3))])
def test_write_result(spark, i, n, a, want):
    kind, at = state.write_result(F.lit(i), F.lit(n), F.lit(a))
    assert tuple(spark.range(1).select(kind.alias("k"), at.alias("a")).first()) == want


def test_chunks_keep_everything(spark):
    rng = random.Random(3)
    rows = [(f"s{s}", i, rng.randint(1, 40)) for s in range(20) for i in range(rng.randint(1, 30))]
    got = spans.chunk_queue(spark.createDataFrame(rows, "stream string, index long, size long"), 5, 60).collect()
    sizes = {(s, i): n for s, i, n in rows}
    for r in got:
        own = [sizes[r["stream"], i] for i in range(r["i"], r["next"])]
        assert sum(own) == r["bytes"]
        assert len(own) == 1 or (len(own) <= 5 and sum(own) <= 60)
    assert sum(r["next"] - r["i"] for r in got) == len(rows)


@pytest.mark.parametrize("bucket", [1, 7, 1000])
def test_long_streams_in_stretches(spark, bucket):
    rng = random.Random(4)
    rows = [(f"s{k % 3}", rng.randint(0, 120), k) for k in range(300)]
    df = spark.createDataFrame(rows, "stream string, index long, arrival long")
    as_set = lambda d: {(r["stream"], r["i"], r["next"], r["n"]) for r in d.collect()}
    assert as_set(spans.merge_events(df, ["arrival"], bucket=bucket)) == as_set(spans.merge_events(df, ["arrival"]))
