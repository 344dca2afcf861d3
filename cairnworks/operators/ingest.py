"""Index maintenance: which files to hash, folding observations, reconciling with the disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_hash(listing: DataFrame, paths: DataFrame, files: DataFrame) -> DataFrame:
    """listing(drive_id, path, size, mtime) with ``known_hash`` where size and mtime are as indexed; null = hash it."""
    have = paths.select("drive_id", "path", "hash", F.col("mtime").alias("old_mtime")).join(files.select("hash", F.col("size").alias("old_size")), "hash")
    rows = listing.join(have, ["drive_id", "path"], "left")
    same = (F.col("mtime") == F.col("old_mtime")) & (F.col("size") == F.col("old_size"))
    return rows.select("drive_id", "path", "size", "mtime", F.when(same, F.col("hash")).alias("known_hash"))


def fold_files(old: DataFrame, seen: DataFrame) -> DataFrame:
    """One row a hash: first sight is kept, the newest size and the newest known mime win.

    Both tables have (hash, size, mime, first_seen_at), ``seen`` also ``seq``.
    """
    rows = old.withColumn("seq", F.lit(-1).cast("long")).unionByName(seen, allowMissingColumns=True)
    return rows.groupBy("hash").agg(F.max_by("size", "seq").alias("size"), F.max_by("mime", F.when(F.col("mime").isNotNull(), F.col("seq"))).alias("mime"), F.min("first_seen_at").alias("first_seen_at"))


def fold_paths(old: DataFrame, seen: DataFrame) -> DataFrame:
    """One row a (drive, path): the newest observation, but the status that state rows gave it."""
    rows = old.withColumn("seq", F.lit(-1).cast("long")).unionByName(seen.withColumn("status", F.lit(None).cast("string")), allowMissingColumns=True)
    last = F.max_by(F.struct("hash", "mtime", "observed_at"), "seq").alias("o")
    return rows.groupBy("drive_id", "path").agg(last, F.coalesce(F.max("status"), F.lit("active")).alias("status")).select("drive_id", "path", "o.*", "status")


def is_good() -> Column:
    """Whether a row of hashed(size, n_read, error) was read to its end."""
    return F.col("error").isNull() & F.coalesce(F.col("n_read") == F.col("size"), F.lit(False))


def short_reads(hashed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(indexable rows, errors) of hashed(drive_id, path, size, n_read, error)."""
    errors = hashed.where(~is_good()).select("drive_id", "path", F.coalesce("error", F.format_string("short_read: expected %d bytes, got %d", "size", "n_read")).alias("error"))
    return hashed.where(is_good()), errors


def missing_paths(paths: DataFrame, files: DataFrame, drives: DataFrame, listing: DataFrame, reachable: DataFrame) -> DataFrame:
    """Active paths of scanned, reachable drives that the listing (drive_id, path) lacks."""
    own = drives.where("kind != 'managed'").select(F.col("id").alias("drive_id")).join(reachable.select("drive_id"), "drive_id", "left_semi")
    rows = paths.where("status = 'active'").join(own, "drive_id", "left_semi").join(listing.select("drive_id", "path"), ["drive_id", "path"], "left_anti")
    return rows.join(files.select("hash", "size"), "hash").select("id", "drive_id", "path", "hash", "size")


def reconcile_report(paths: DataFrame, drives: DataFrame, missing: DataFrame, reachable: DataFrame, sample: int = 20) -> DataFrame:
    """A row for each drive: checked, missing, bytes_missing, sample of the first paths, and why it was left alone."""
    checked = paths.where("status = 'active'").groupBy("drive_id").agg(F.count(F.lit(1)).alias("n"))
    gone = missing.groupBy("drive_id").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("b"))
    from pyspark.sql.window import Window

    few = missing.withColumn("k", F.row_number().over(Window.partitionBy("drive_id").orderBy("path"))).where(F.col("k") <= sample)
    few = few.groupBy("drive_id").agg(F.array_sort(F.collect_list("path")).alias("sample"))
    rows = drives.select(F.col("id").alias("drive_id"), "label", (F.col("kind") == "managed").alias("skipped_managed"))
    rows = rows.join(reachable.select("drive_id", F.lit(True).alias("up")).distinct(), "drive_id", "left")
    rows = rows.join(checked, "drive_id", "left").join(gone, "drive_id", "left").join(few, "drive_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.select(
        "drive_id", "label", "skipped_managed", (F.col("up").isNull() & ~F.col("skipped_managed")).alias("root_unreachable"),
        F.when(F.col("skipped_managed"), 0).otherwise(zero("n")).alias("checked"), zero("m").alias("missing"), zero("b").alias("bytes_missing"), F.coalesce("sample", F.array().cast("array<string>")).alias("sample"),
    )
