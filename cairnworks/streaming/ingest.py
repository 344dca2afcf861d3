"""Incremental ingest: a stream of observations folded into the index by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairnworks.operators.ingest import fold_files, fold_paths

FILES = "hash string, size long, mime string, first_seen_at long"
PATHS = "drive_id string, path string, hash string, mtime long, observed_at long, status string"


def index_stream(observations: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """observations(drive_id, path, hash, size, mime, mtime, observed_at), a streaming DataFrame.

    Every batch writes a new snapshot of files and paths below ``folder`` from the one before,
    so that a batch that is run again reads the same state and gives the same snapshot. ``seq`` orders observations within a batch by observed_at.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = batch.withColumn("seq", F.col("observed_at"))
        old_files = _read(spark, folder, "files", number - 1, FILES)
        old_paths = _read(spark, folder, "paths", number - 1, PATHS)
        fold_files(old_files, seen.select("hash", "size", "mime", F.col("observed_at").alias("first_seen_at"), "seq")).write.mode("overwrite").parquet(f"{folder}/files-{number}")
        fold_paths(old_paths, seen.select("drive_id", "path", "hash", "mtime", "observed_at", "seq")).write.mode("overwrite").parquet(f"{folder}/paths-{number}")

    return observations.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _read(spark, folder: str, table: str, number: int, schema: str) -> DataFrame:
    """The snapshot of a batch; only before the first one there is none, a missing one later is an error."""
    if number < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/{table}-{number}")


def windowed_activity(events: DataFrame, length: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events of each type and day; an addition of this library, on a stream or a table."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")
