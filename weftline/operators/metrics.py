"""Counters, latencies, outcomes, histograms, report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bucket bounds of the exported histograms. Feeds, in seconds; handlers, in seconds, doubling; request charges, doubling.
LATENCY_BUCKETS = (0.0005, 0.001, 0.002, 0.004, 0.008, 0.016, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0)
HANDLER_BUCKETS = tuple(0.001 * 2**k for k in range(16))
CHARGE_BUCKETS = tuple(float(2**k) for k in range(9))


def counters(df: DataFrame, key: str, weight: Column | None = None) -> DataFrame:
    return df.groupBy(key).agg((F.sum(weight) if weight is not None else F.count("*")).alias("n"))


def top(df: DataFrame, by: str, k: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(by), *ties).limit(k)


def latency(group: DataFrame, keys: list[str], value: str, exact: bool = False, accuracy: int = 10_000) -> DataFrame:
    """count, min, p50, p95, p99, max, avg, stddev (none for a single value).

    Quantiles are values that occur, within 1/accuracy of their rank, from sketches of bounded size; exact: linear ones, whose state grows with the distinct values.
    """
    def p(q: float) -> Column:
        return F.round(F.percentile(value, F.lit(q)) if exact else F.percentile_approx(value, F.lit(q), F.lit(accuracy)), 6)

    n, spread = F.count("*").alias("n"), [F.round(F.avg(value), 6).alias("avg"), F.round(F.stddev_samp(value), 6).alias("stddev")]
    return group.groupBy(*keys).agg(
        n, F.min(value).alias("min"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.max(value).alias("max"), *spread
    )


def sliding_quantiles(
    rows: DataFrame, ts: str, value: str, keys: list[str], age: str = "1 minute", step: str = "10 seconds", accuracy: int = 1_000
) -> DataFrame:
    """end, keys, n, p50, p95, p99 of windows that are `age` long and begin every `step`: a summary without what is older."""
    w = F.window(ts, age, step)
    q = [F.percentile_approx(value, F.lit(x), F.lit(accuracy)).alias(name) for name, x in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))]
    return rows.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), *q).select(F.col("w.end").alias("end"), *keys, "n", "p50", "p95", "p99")


def duration_shares(progress: DataFrame, phases: list[str]) -> DataFrame:
    """phase, ms, share of rows with a column a phase: where a loop's time goes."""
    sums = progress.agg(*[F.sum(F.coalesce(F.col(p), F.lit(0))).cast("long").alias(p) for p in phases])
    total = sum((F.col(p) for p in phases), F.lit(0))
    each = sums.select(F.explode(F.array(*[F.struct(
        F.lit(p).alias("phase"), F.col(p).alias("ms"), (F.col(p) / F.nullif(total, F.lit(0))).alias("share")
    ) for p in phases])).alias("x"))
    return each.select("x.phase", "x.ms", F.round("x.share", 6).alias("share"))


def load_class(n_events: Column, capacity: int) -> Column:
    """idle (nothing waits), full (capacity or more), else active."""
    return F.when(n_events == 0, "idle").when(n_events >= capacity, "full").otherwise("active")


def exposition(samples: DataFrame, name: str, kind: str, labels: list[str]) -> DataFrame:
    """line: samples (labels, value; le for histograms) in the text format of metrics scrapers, with the type's line first."""
    text = lambda c: F.concat(F.lit(f'{c}="'), F.regexp_replace(F.col(c).cast("string"), r'(["\\])', r"\\$1"), F.lit('"'))
    body = F.concat(F.lit("{"), F.concat_ws(",", *[text(c) for c in labels]), F.lit("} ")) if labels else F.lit(" ")
    lines = samples.select(F.concat(F.lit(name), body, F.col("value").cast("string")).alias("line"))
    head = samples.sparkSession.range(1).select(F.lit(f"# TYPE {name} {kind}").alias("line"))
    return head.unionByName(lines)


def histogram(df: DataFrame, value: str, bounds) -> DataFrame:
    """le, n: how many values are at most each bound; one pass, the bounds are folded in one aggregate row."""
    sums = df.agg(*[F.sum(F.when(F.col(value) <= b, 1).otherwise(0)).cast("long").alias(f"b{k}") for k, b in enumerate(bounds)])
    return sums.select(
        F.explode(F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(bounds)])).alias("x")
    ).select("x.le", "x.n")


def outcome_kind(event_type: Column, value: Column, slow: float) -> Column:
    return F.when(event_type == "error", "exception").when(value > slow, "rate_limited").otherwise("ok")


def count_if(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0)).cast("long")
