"""Supersedence as a stateful stream: a state store by identity, and changes as they happen.

The store has, for each row_key, the version that counts.  A batch's versions are compared with it by the total order of
the collapse; only what changes the state leaves, with the version that it replaces.  Repeated, late and older versions
so leave nothing, whatever order they come in, and the last change of each identity is the collapse of all.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.legs import KINDS, order_of
from .events import canonicalise

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class NewestVersion(StatefulProcessor):
    """Keeps the newest version of an identity; emits it, and the version before it, when it changes."""

    def __init__(self, facts: T.StructType):
        self._facts = facts
        self._names = facts.names
        self._order = order_of(facts.names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._now = handle.getValueState("now", self._facts)

    def _rank(self, row: tuple) -> list[tuple]:
        """Nulls first, as Spark orders them."""
        value = dict(zip(self._names, row, strict=True))
        value["of_kind"] = KINDS.index(value["event_kind"]) + 1 if value["event_kind"] in KINDS else 0
        return [(value[c] is not None, value[c]) if value[c] is not None else (False,) for c in self._order]

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        best = before = tuple(self._now.get()) if self._now.exists() else None
        for row in rows:
            version = tuple(row[c] for c in self._names)
            if best is None or self._rank(version) > self._rank(best):
                best = version
        if best != before:
            self._now.update(best)
            yield Row(row_key=key[0], **dict(zip(self._names, best, strict=True)), replaced_version=before[self._names.index("version")] if before else None)

    def close(self) -> None:
        pass


def changes(events: DataFrame) -> DataFrame:
    """The changes of the current state that a stream of wire events makes: canonical rows and replaced_version, null for
    an identity's first.  For sinks in update mode; the session keeps its state in RocksDB, of any size."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = canonicalise(events).drop("placed_month")
    # instants as microseconds: the store gives times back in another zone than rows have them
    times = [f.name for f in rows.schema if isinstance(f.dataType, T.TimestampType)]
    kept = rows.withColumns({c: F.unix_micros(c) for c in times})
    facts = T.StructType([f for f in kept.schema if f.name != "row_key"])
    out = T.StructType([T.StructField("row_key", T.StringType()), *[T.StructField(f.name, f.dataType) for f in facts], T.StructField("replaced_version", T.LongType())])
    changed = kept.groupBy("row_key").transformWithState(NewestVersion(facts), outputStructType=out, outputMode="Update", timeMode="None")
    return changed.withColumns({c: F.timestamp_micros(c) for c in times})


def write_changes(events: DataFrame, path: str, checkpoint: str, *, drain: bool = True, every: str = "500 milliseconds") -> StreamingQuery:
    """Changes as Parquet by batch; a batch that runs again replaces its own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = changes(events).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=every)).start()
