"""Progress of streaming queries as a table: what a scheduler would log of itself."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

PROGRESS = "query string, batch long, rows long, rows_per_s double, results long, dispatch long, commit long, sleep long, source string, end_position string, latest_position string"
#: Phases of a micro-batch by what they are for.
PHASES = {"results": ("addBatch",), "dispatch": ("getBatch", "queryPlanning", "latestOffset"), "commit": ("walCommit", "commitOffsets", "commitBatch")}


class ProgressLog(StreamingQueryListener):
    """Keeps the newest `keep` micro-batches of all queries. table() gives a row per micro-batch and source; subclasses may override handled and failed."""

    def __init__(self, spark: SparkSession, keep: int = 10_000):
        self.spark, self.keep = spark, keep
        self.rows: list[tuple] = []
        self.errors: list[tuple[str, str]] = []
        self._lock = threading.Lock()

    def __enter__(self) -> ProgressLog:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event: QueryStartedEvent) -> None:  # noqa: N802 - Spark's name
        pass

    def onQueryIdle(self, event: QueryIdleEvent) -> None:  # noqa: N802 - Spark's name
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:  # noqa: N802 - Spark's name
        p = event.progress
        spent = {name: sum(p.durationMs.get(x, 0) for x in of) for name, of in PHASES.items()}
        rest = max(0, p.durationMs.get("triggerExecution", 0) - sum(spent.values()))
        rows = [(
            str(p.id), p.batchId, p.numInputRows, p.processedRowsPerSecond, *spent.values(), rest, s.description, s.endOffset, s.latestOffset
        ) for s in p.sources]
        with self._lock:
            self.rows = [*self.rows, *rows][-self.keep :]
        self.handled(rows)

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:  # noqa: N802 - Spark's name
        if event.exception:
            with self._lock:
                self.errors.append((str(event.id), event.exception))
            self.failed(str(event.id), event.exception)

    def handled(self, rows: list[tuple]) -> None:
        """Called with each micro-batch's rows."""

    def failed(self, query: str, error: str) -> None:
        """Called when a query ends with an error."""

    def table(self) -> DataFrame:
        with self._lock:
            return self.spark.createDataFrame(self.rows, PROGRESS)
