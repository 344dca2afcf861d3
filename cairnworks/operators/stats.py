"""Storage statistics and overviews; each is one pass of aggregates per table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnworks.sources.warehouse import REVIEW_FLOOR


def storage(files: DataFrame, paths: DataFrame, drives: DataFrame) -> DataFrame:
    """One row of counts and bytes; ``files_unique`` counts all files, ``bytes_unique`` active ones."""
    active = F.col("status") == "active"
    rows = paths.join(files.select("hash", "size"), "hash").groupBy("hash", "size")
    each = rows.agg(F.count(F.when(active, 1)).alias("a"), F.count(F.when(~active, 1)).alias("p"))
    sums = each.agg(
        F.coalesce(F.sum(F.when(F.col("a") > 0, F.col("size"))), F.lit(0)).alias("bytes_unique"),
        F.coalesce(F.sum(F.col("size") * F.col("a")), F.lit(0)).alias("bytes_total"),
        F.coalesce(F.sum(F.col("size") * F.col("p")), F.lit(0)).alias("bytes_reclaimed"),
    )
    counts = paths.agg(F.count(F.lit(1)).alias("paths"), F.count(F.when(active, 1)).alias("paths_active"), F.count(F.when(~active, 1)).alias("paths_purgatory"))
    out = files.agg(F.count(F.lit(1)).alias("files_unique")).crossJoin(counts).crossJoin(drives.agg(F.count(F.lit(1)).alias("drives"))).crossJoin(sums)  # one row each
    out = out.withColumn("bytes_saveable", F.col("bytes_total") - F.col("bytes_unique"))
    return out.withColumn("savings_pct", 100.0 * F.col("bytes_saveable") / F.greatest(F.col("bytes_total"), F.lit(1)))


def open_by_kind(clusters: DataFrame) -> DataFrame:
    return clusters.where("status = 'open'").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def overview(clusters: DataFrame, summary: DataFrame, floor: int = REVIEW_FLOOR) -> DataFrame:
    """One row of review counts; topics are no duplicates and don't count as such."""
    is_open = F.col("status") == "open"
    counts = clusters.agg(
        F.count(F.lit(1)).alias("clusters_total"),
        F.count(F.when(is_open, 1)).alias("clusters_unresolved"),
        F.count(F.when(~is_open, 1)).alias("clusters_resolved"),
        F.count(F.when(is_open & F.col("kind").isin("exact", "doc_version", "near_image"), 1)).alias("clusters_dedup_open"),
        F.count(F.when(F.col("kind") == "topic", 1)).alias("topic_clusters"),
    )
    hidden = summary.where(F.col("n_active") > 0).where((F.col("kind") == "exact") & is_open & (F.col("reclaimable") < floor))
    return counts.crossJoin(hidden.agg(F.count(F.lit(1)).alias("exact_hidden")))


def purgatory(files: DataFrame, paths: DataFrame) -> DataFrame:
    rows = paths.where("status = 'purgatory'").join(files.select("hash", "size"), "hash", "left")
    return rows.agg(F.count(F.lit(1)).alias("count"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def purgatory_list(files: DataFrame, paths: DataFrame, limit: int = 1000) -> DataFrame:
    rows = paths.where("status = 'purgatory'").join(files.select("hash", "size", "mime"), "hash")
    return rows.select("id", "drive_id", "path", "hash", "size", "mime").orderBy(F.desc("size"), "path", "id").limit(limit)


def orphans(files: DataFrame, paths: DataFrame) -> DataFrame:
    """Files without an active path."""
    return files.join(paths.where("status = 'active'").select("hash"), "hash", "left_anti")


def search(files: DataFrame, paths: DataFrame, pattern: str, include_purgatory: bool = False, limit: int = 200) -> DataFrame:
    """Paths that hold the pattern, case ignored; % and _ in it are wildcards. Largest first."""
    rows = paths if include_purgatory else paths.where("status = 'active'")
    rows = rows.where(F.col("path").ilike(f"%{pattern}%")).join(files.select("hash", "size", "mime"), "hash")
    return rows.select("id", "drive_id", "path", "status", "hash", "size", "mime").orderBy(F.desc("size"), "path", "id").limit(limit)


def one_location(files: DataFrame, paths: DataFrame, drives: DataFrame) -> DataFrame:
    """Each active hash with its first location by drive and path."""
    from cairnworks.functions.names import absolute

    first = paths.where("status = 'active'").groupBy("hash").agg(F.min(F.struct("drive_id", "path")).alias("at"))
    rows = files.select("hash", "size", "mime").join(first, "hash").select("hash", "size", "mime", "at.drive_id", "at.path")
    rows = rows.join(drives.select(F.col("id").alias("drive_id"), "root_path"), "drive_id")
    return rows.select("hash", "mime", "size", absolute(F.col("root_path"), F.col("path")).alias("abspath"), F.col("path").alias("rel"))


def highlighted(paths: DataFrame, patterns: list[str]) -> DataFrame:
    """Paths with a flag for those that hold any of the fragments, case ignored."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.lower("path").contains(p.lower())
    return paths.select("id", "path", hit.alias("highlighted"))


def stale(files: DataFrame, paths: DataFrame, before: int, failed: DataFrame | None = None) -> DataFrame:
    """Active paths not observed since ``before``; those that failed in the run are not stale."""
    rows = paths.where((F.col("status") == "active") & (F.col("observed_at") < before))
    if failed is not None:
        rows = rows.join(failed.select("drive_id", "path"), ["drive_id", "path"], "left_anti")
    return rows.join(files.select("hash", "size"), "hash").select("id", "drive_id", "path", "hash", "size")
