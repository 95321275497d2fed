"""Per-stream buffers as stateful streaming operators: ordering, deduplication, gaps, handlers with partial progress.

The state of a stream is its write position and the events that wait behind a gap or for a retry, with the order of their arrival. Rows of one stream
are handled by one task at a time, in order of index; what a handler has done is known by the next index that it returns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Handler: (stream, events as a DataFrame with contiguous index) -> (outcome, next index). Events before the next index are done.
Handler = Callable[[str, pd.DataFrame], tuple[str, int]]
RESULT = "stream string, i long, index_next long, outcome string, n_events long"
RESULT_COLUMNS = ["stream", "i", "index_next", "outcome", "n_events"]
_STATE = "write_pos long, malformed boolean, waiting array<struct<index:long,event_type:string,data:string>>, failures int"


class Malformed(Exception):
    """Raised by a handler: the stream stays stopped, its events buffered."""


class Unhealthy(Exception):
    """Streams that have failed or stood still for too long."""


def raise_if_unhealthy(results: DataFrame, oldest_s: float) -> None:
    """results: stream, attempt, outcome, i, index_next, age_s (of the oldest attempt without progress)."""
    ages = results.groupBy("stream").agg(F.max("age_s").alias("age_s"))
    old = classify_health(results).join(ages, "stream").where((F.col("class") != "ok") & (F.col("age_s") > oldest_s))
    found = {r["class"]: (r["n"], r["age"]) for r in old.groupBy("class").agg(F.count("*").alias("n"), F.max("age_s").alias("age")).collect()}
    if found:
        raise Unhealthy(", ".join(f"{n} {kind} for up to {age:.0f} s" for kind, (n, age) in sorted(found.items())))


class _Head:
    """A stream's buffered events by index, and where it stands."""

    def __init__(self, pos: int | None, malformed: bool, rows: dict[int, tuple]):
        self.pos, self.malformed, self.rows = pos, malformed, rows

    def call(self, stream: str, handle: Handler, require_all: bool, max_events: int, max_attempts: int) -> list[tuple]:
        """Handle contiguous runs from the head until the handler stops; results as RESULT."""
        out: list[tuple] = []
        order = sorted(self.rows)
        at = 0
        while not self.malformed:
            while at < len(order) and order[at] < (self.pos or 0):
                at += 1
            if at == len(order) or require_all and order[at] != (self.pos or 0):
                break
            head, end = order[at], at + 1
            while end < len(order) and end - at < max_events and order[end] == head + end - at:
                end += 1
            run = [self.rows[i] for i in order[at:end]]
            events = pd.DataFrame({"stream": stream, "index": np.arange(head, head + len(run)), "event_type": [r[0] for r in run], "data": [r[1] for r in run]})
            for _ in range(max_attempts):
                try:
                    outcome, after = handle(stream, events)
                    break
                except Malformed:
                    outcome, after, self.malformed = "malformed", head, True
                    break
                except Exception as e:  # noqa: BLE001 - a handler's failure is an outcome
                    outcome, after = f"failed: {type(e).__name__}", head
            out.append((stream, head, after, outcome, max(0, min(after - head, len(run)))))
            if after <= head:
                break
            self.pos = max(self.pos or 0, after)
        self.rows = {i: self.rows[i] for i in order if i >= (self.pos or 0)}
        return out


def project(
    events: DataFrame, handle: Handler, require_all: bool = False, max_events: int = 16384, max_attempts: int = 1, purge_ms: int | None = None,
    retry_ms: int | None = None
) -> DataFrame:
    """Stream of handler results. events: stream, index, event_type, data (streaming), and arrival, if there is one: it orders copies of an index.

    Events before the write position are dropped (repeated deliveries); the first copy of an index counts, by micro-batch, then arrival, then content. Without
    require_all the head is handled even after a gap; with it only what begins at the write position (0 at first). A handler's error keeps its events for the
    stream's next rows, or, with retry_ms, for a timer. Next index = head means no progress (outcome kept); a next index beyond the events drops future ones
    up to it. purge_ms: forget streams without waiting events after so long; not with require_all, which must know where each stream stands.
    """
    if require_all and purge_ms is not None:
        raise ValueError("require_all excludes purging")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, malformed, waiting, failures = state.get if state.exists else (None, False, [], 0)
        if state.hasTimedOut and not waiting:
            if purge_ms is not None and not malformed:
                state.remove()
            return
        rows: dict[int, tuple] = {r["index"]: (r["event_type"], r["data"]) for r in waiting}
        if not state.hasTimedOut:
            new = [x for f in frames for x in zip(*(f[c].tolist() for c in ("arrival", "index", "event_type", "data")), strict=True)]
            if len(new) > 1:
                new.sort(key=lambda x: (x[0], x[1], x[2] is None, x[2] or "", x[3] is None, x[3] or ""))
            for _, index, event_type, data in new:
                if index not in rows:
                    rows[index] = (event_type, data)
        head = _Head(known, malformed, rows)
        out = head.call(key[0], handle, require_all, max_events, max_attempts)
        failures = failures + 1 if out and out[-1][2] <= out[-1][1] else 0 if out else failures
        state.update((head.pos, head.malformed, [(i, *x) for i, x in head.rows.items()], failures))
        if retry_ms is not None and failures and not head.malformed:
            state.setTimeoutDuration(min(retry_ms * 2 ** min(failures - 1, 10), 3_600_000))
        elif purge_ms is not None:
            state.setTimeoutDuration(purge_ms)
        if out:
            yield pd.DataFrame(out, columns=RESULT_COLUMNS)

    arrival = F.col("arrival").cast("long") if "arrival" in events.columns else F.lit(0).cast("long")
    rows = events.select("stream", arrival.alias("arrival"), "index", "event_type", "data")
    timer = GroupStateTimeout.NoTimeout if purge_ms is None and retry_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy("stream").applyInPandasWithState(step, RESULT, _STATE, "append", timer)


def sequence(rows: DataFrame) -> DataFrame:
    """Stream of (stream, arrival, index): a counter per stream, from 0, in order of arrival within a micro-batch and across them."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at = state.get[0] if state.exists else 0
        arrival = np.sort(np.concatenate([f["arrival"].to_numpy() for f in frames]))
        state.update((at + len(arrival),))
        yield pd.DataFrame({"stream": key[0], "arrival": arrival, "index": np.arange(at, at + len(arrival))})

    out = rows.select("stream", "arrival").groupBy("stream")
    return out.applyInPandasWithState(step, "stream string, arrival long, index long", "at long", "append", GroupStateTimeout.NoTimeout)


def deduplicate(events: DataFrame, watermark: str, delay: str = "1 day") -> DataFrame:
    """First delivery of every (stream, index) within the watermark's delay."""
    return events.withWatermark(watermark, delay).dropDuplicatesWithinWatermark(["stream", "index"])


def classify_health(results: DataFrame) -> DataFrame:
    """stream, class of handler results: failing (last attempt failed), stuck (no progress), ok."""
    last = results.groupBy("stream").agg(F.max_by(F.struct("outcome", "i", "index_next"), "attempt").alias("x"))
    kind = F.when(F.col("x.outcome").startswith("failed"), "failing").when(F.col("x.index_next") <= F.col("x.i"), "stuck").otherwise("ok")
    return last.select("stream", kind.alias("class"))
