"""Paths as keyed state of a stream: the newest observation of each, and a timer for the day it counts as gone.

State is kept by key in RocksDB, so a micro-batch touches the paths it saw and those whose time ran
out, never all of them; what changed goes to the store's log as rows to put and keys to delete.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cairnworks.scratch import discard, materialize
from cairnworks.sources.snapshots import SCHEMAS, Snapshots

_SEEN = "observed_at long, hash string, size long, mime string, mtime long"
_CHANGES = f"drive_id string, path string, {_SEEN}, op string"
_change = Row(*[x.split()[0] for x in _CHANGES.split(", ")])
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _rank(seen: tuple) -> tuple:
    """Order of observations: by time, and any fixed order among those of one second, so that no order of arrival matters."""
    return tuple((x is not None, x) for x in seen)


class PathStates(StatefulProcessor):
    """Value state of one path; a timer fires once the watermark is ``stale_after`` seconds past the last sight of it."""

    def __init__(self, stale_after: int):
        self.stale_after = stale_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _SEEN)

    def _due(self, seen: tuple) -> int:
        return (seen[0] + self.stale_after) * 1000

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        had = tuple(self.last.get()) if self.last.exists() else None
        seen = [(r.observed_at, r.hash, r.size, r.mime, r.mtime) for r in rows]
        new = max([*seen, *([had] if had else [])], key=_rank)
        if new != had:
            if had and had[0] != new[0]:
                self.handle.deleteTimer(self._due(had))
            self.handle.registerTimer(self._due(new))
            self.last.update(new)
            yield _change(*key, *new, "put")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        had = tuple(self.last.get())
        self.last.clear()
        yield _change(*key, *had, "delete")

    def close(self) -> None:
        pass


def path_changes(observations: DataFrame, stale_after: int, late: str) -> DataFrame:
    """Changes (drive_id, path, observed_at, hash, size, mime, mtime, op) of a stream of observations with the same columns but ``op``.

    ``observed_at`` are seconds. Repeated observations change nothing. An observation more than ``late`` behind
    the newest may be left out, as its path may have been told as gone by then; rows without a drive, path or time are left out.
    """
    rows = observations.select("drive_id", "path", "observed_at", "hash", F.col("size").cast("long").alias("size"), "mime", F.col("mtime").cast("long").alias("mtime"), F.timestamp_seconds("observed_at").alias("at"))
    rows = rows.where("drive_id is not null and path is not null and observed_at is not null").withWatermark("at", late)
    return rows.groupBy("drive_id", "path").transformWithState(PathStates(stale_after), _CHANGES, "Update", "EventTime")


def follow(observations: DataFrame, folder: str, checkpoint: str, stale_after: int, late: str = "1 day", name: str = "paths") -> StreamingQuery:
    """Keeps the table ``observed`` of the store in ``folder`` as the stream's observations have it.

    A batch is one commit of changed rows, and of its own number: one that runs again after a crash finds its
    number there and writes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        store = Snapshots(spark, folder)
        key = f"stream:{name}"
        done = store.table("settings").where(F.col("key") == key).first()
        changes = materialize(batch, "changes")  # the state of a batch is worked out once, and also where its commit is there already
        if done and json.loads(done["value"]) >= number:
            discard(changes)
            return
        gone = changes.where("op = 'delete'").select("drive_id", "path")
        put = changes.where("op = 'put'").join(gone, ["drive_id", "path"], "left_anti")
        mark = spark.createDataFrame([(key, json.dumps(number))], SCHEMAS["settings"])
        store.commit({"observed": put, "settings": mark}, {"observed": gone})
        discard(changes)

    spark = observations.sparkSession
    changes = path_changes(observations, stale_after, late)
    with _provider(spark):
        return changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _provider:
    """The state store that this kind of state needs, for the queries started inside; the session's own setting comes back."""

    def __init__(self, spark: SparkSession):
        self.conf = spark.conf

    def __enter__(self) -> None:
        self.had = self.conf.get(_PROVIDER[0], None)
        self.conf.set(*_PROVIDER)

    def __exit__(self, *_) -> None:
        if self.had is None:
            self.conf.unset(_PROVIDER[0])
        else:
            self.conf.set(_PROVIDER[0], self.had)


def observed_paths(observations: DataFrame, stale_after: int, watermark: int | None = None) -> DataFrame:
    """The table ``observed`` from all observations at once; paths last seen ``stale_after`` seconds before the watermark are gone."""
    columns = [x.split()[0] for x in _SEEN.split(", ")]
    rows = observations.where("drive_id is not null and path is not null and observed_at is not null")
    last = rows.groupBy("drive_id", "path").agg(F.max(F.struct(*columns)).alias("s")).select("drive_id", "path", "s.*")
    return last if watermark is None else last.where(F.col("observed_at") + stale_after > watermark)
