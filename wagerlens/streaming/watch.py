"""A stream's position, lag and idle time from the query itself: observed metrics and a listener.

watched() puts the metrics into the plan that a batch runs anyway; Watch hears them with each batch's progress.  So no
scan of the log is needed to know where it stands, and a drained stream can be left after a time without rows.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from .events import lag

METRICS = "ingested"


def watched(rows: DataFrame) -> DataFrame:
    """Canonical rows with the metrics of each batch: rows, the highest version, and the latest instant of a bet."""
    return rows.observe(METRICS, F.count(F.lit(1)).alias("rows"), F.max("version").alias("position"), F.max("placed_at").alias("latest"))


class Watch(StreamingQueryListener):
    """What a query has said of itself: rows so far, position, lag by source, batches, and since when it is idle."""

    def __init__(self, clock: Callable[[], float] = time.monotonic):
        self._clock, self._lock = clock, threading.Lock()
        self.query: str | None = None
        self.rows, self.batches, self.position, self.lag, self.error = 0, 0, None, {}, None
        self.busy_at = clock()

    def of(self, query: StreamingQuery) -> Watch:
        """Watch this query only, whatever else the session runs."""
        self.query = str(query.id)
        return self

    def _mine(self, of_query) -> bool:
        return self.query is None or str(of_query) == self.query

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if not self._mine(progress.id):
            return
        seen = progress.observedMetrics.get(METRICS)
        with self._lock:
            self.lag = lag({"sources": [{"description": s.description, "latestOffset": s.latestOffset, "endOffset": s.endOffset} for s in progress.sources]})
            if seen and seen["rows"]:
                self.rows += seen["rows"]
                self.batches += 1
                if seen["position"] is not None:
                    self.position = max(self.position or seen["position"], seen["position"])
                self.busy_at = self._clock()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if self._mine(event.id):
            self.error = event.exception

    def wake(self) -> None:
        """Idle time counts from now."""
        with self._lock:
            self.busy_at = self._clock()

    def idle(self) -> float:
        """Seconds since the last batch that had rows."""
        with self._lock:
            return self._clock() - self.busy_at


def run_until_idle(start: Callable[[], StreamingQuery], spark, seconds: float, *, poll: float = 0.2) -> Watch:
    """Start a query and stop it, between batches, once it had no rows for so many seconds; its failure is raised."""
    watch = Watch()
    spark.streams.addListener(watch)
    try:
        query = start()
        watch.of(query)
        ready = False  # a query that still opens its sources isn't idle
        while query.isActive and (not ready or watch.idle() < seconds or query.status["isTriggerActive"] and query.status["isDataAvailable"]):
            if not ready and (watch.batches or query.status["message"].startswith("Waiting")):
                ready = True
                watch.wake()
            query.awaitTermination(poll)
        query.stop()
        if query.exception():
            raise query.exception()
        # the last progress may still be on its way to the listener
        spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty(10_000)
    finally:
        spark.streams.removeListener(watch)
    return watch
