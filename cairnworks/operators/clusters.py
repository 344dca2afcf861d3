"""Duplicate groups and clusters: keys, summaries, details, rationales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnworks.functions.bits import hamming
from cairnworks.functions.names import base_name


def cluster_id(kind: str, hashes: Column) -> Column:
    """A deterministic id: the same members make the same cluster."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(kind), F.array_sort(hashes)), 256), 1, 16)


def exact_groups(files: DataFrame, paths: DataFrame, min_size: int = 1) -> DataFrame:
    """Contents with more than one active path: (hash, size, n_paths, reclaimable, paths sorted by path)."""
    active = paths.where("status = 'active'")
    found = active.join(files.where(F.col("size") >= min_size).select("hash", "size"), "hash")
    found = found.groupBy("hash", "size").agg(F.count("id").alias("n_paths"), F.array_sort(F.collect_list(F.struct("path", "drive_id"))).alias("paths"))
    return found.where("n_paths > 1").withColumn("reclaimable", F.col("size") * (F.col("n_paths") - 1))


def exact_cluster_keys(files: DataFrame, paths: DataFrame, min_size: int = 1, include_purgatory: bool = False) -> DataFrame:
    """Hashes with more than one path; counts only, so nothing is collected."""
    own = paths if include_purgatory else paths.where("status = 'active'")
    counts = own.groupBy("hash").agg(F.count("id").alias("n")).where("n > 1").select("hash")
    return counts.join(files.where(F.col("size") >= min_size).select("hash"), "hash", "left_semi")


def new_exact_clusters(files: DataFrame, paths: DataFrame, members: DataFrame, min_size: int = 1) -> DataFrame:
    """(cluster_id, hash) of exact groups whose hash is in no exact cluster yet."""
    keys = exact_cluster_keys(files, paths, min_size).join(members.select("hash"), "hash", "left_anti")
    return keys.select(cluster_id("exact", F.array("hash")).alias("cluster_id"), "hash")


def without_overlap(components: DataFrame, clustered: DataFrame, node: str = "hash", component: str = "component") -> DataFrame:
    """Components none of whose nodes is clustered already; a cluster never grows."""
    touched = components.join(clustered.select(node).distinct(), node, "left_semi").select(component).distinct()
    return components.join(touched, component, "left_anti")


def as_clusters(components: DataFrame, kind: str, label: str, max_size: int | None = None) -> DataFrame:
    """(cluster_id, kind, label, hash) of components with at least two nodes.

    ``max_size`` drops larger ones; without it members are never collected in one row, and the
    id is of the smallest member alone.
    """
    sized = components.groupBy("component").agg(F.count("hash").alias("n"), F.min("hash").alias("first")).where("n > 1")
    if max_size is not None:
        sized = sized.where(F.col("n") <= max_size)
    named = sized.select("component", cluster_id(kind, F.array("first")).alias("cluster_id"))
    return components.join(named, "component").select("cluster_id", F.lit(kind).alias("kind"), F.lit(label).alias("label"), "hash")


def summaries(clusters: DataFrame, members: DataFrame, files: DataFrame, paths: DataFrame) -> DataFrame:
    """One row a cluster: n_active, n_total, n_members, active_bytes, max_active, reclaimable."""
    rows = clusters.join(members, clusters.id == members.cluster_id).join(files.select("hash", "size"), "hash")
    rows = rows.join(paths.select("hash", F.col("id").alias("path_id"), F.col("status").alias("path_status")), "hash", "left")
    active = F.col("path_status") == "active"
    out = rows.groupBy("id", "kind", "label", "status").agg(
        F.count(F.when(active, 1)).alias("n_active"),
        F.count("path_id").alias("n_total"),
        F.countDistinct("hash").alias("n_members"),
        F.coalesce(F.sum(F.when(active, F.col("size"))), F.lit(0)).alias("active_bytes"),
        F.coalesce(F.max(F.when(active, F.col("size"))), F.lit(0)).alias("max_active"),
    )
    return out.withColumn("reclaimable", F.col("active_bytes") - F.col("max_active"))


def review_queue(summary: DataFrame, include_resolved: bool = False, kinds: tuple[str, ...] | None = None, limit: int = 500, min_reclaimable: int = 0) -> DataFrame:
    """Clusters with active paths, most reclaimable bytes first; small exact ones may be hidden."""
    rows = summary.where("n_active > 0")
    if not include_resolved:
        rows = rows.where("status = 'open'")
    if kinds:
        rows = rows.where(F.col("kind").isin(*kinds))
    if min_reclaimable > 0:
        rows = rows.where((F.col("kind") != "exact") | (F.col("reclaimable") >= min_reclaimable))
    rows = rows.orderBy(F.desc("reclaimable"), F.desc("active_bytes"), "id").limit(limit)
    return rows.select("id", "kind", "label", "n_active", "n_total", "n_members", (F.col("status") != "open").alias("resolved"), "reclaimable")


def details(members: DataFrame, files: DataFrame, paths: DataFrame) -> DataFrame:
    """(cluster_id, hash, size, mime, paths): each member with its paths, by status and path."""
    own = paths.groupBy("hash").agg(F.array_sort(F.collect_list(F.struct("status", "path", "id", "drive_id", "mtime"))).alias("paths"))
    rows = members.join(files.select("hash", "size", "mime"), "hash", "left").join(own, "hash", "left")
    return rows.select("cluster_id", "hash", F.coalesce("size", F.lit(0)).alias("size"), "mime", F.coalesce("paths", F.array().cast(dict(own.dtypes)["paths"])).alias("paths"))


def exact_rationales(members: DataFrame, files: DataFrame, paths: DataFrame, hash_name: str = "sha256") -> DataFrame:
    """(cluster_id, n_copies, names_differ, rationale) of exact clusters with active paths."""
    rows = members.join(files.select("hash", "size"), "hash").join(paths.where("status = 'active'").select("hash", "path"), "hash")
    rows = rows.groupBy("cluster_id", "hash", "size").agg(F.count(F.lit(1)).alias("n_copies"), F.countDistinct(base_name(F.col("path"))).alias("n_names"))
    note = F.when(F.col("n_names") > 1, "filenames differ — matched by content").otherwise("same filename in multiple locations")
    text = F.format_string("identical content — %s %s…, %,d bytes, %d copies; %s", F.lit(hash_name), F.substring("hash", 1, 12), F.col("size"), F.col("n_copies"), note)
    return rows.select("cluster_id", "n_copies", (F.col("n_names") > 1).alias("names_differ"), text.alias("rationale"))


def image_distances(members: DataFrame, signatures: DataFrame) -> DataFrame:
    """(cluster_id, hash, w, h, distance) to the cluster's first member; null without a signature."""
    rows = members.join(signatures.select("hash", "sig", "w", "h"), "hash", "left")
    first = F.first("sig").over(Window.partitionBy("cluster_id").orderBy("hash").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("ref", first).select("cluster_id", "hash", "w", "h", hamming(F.col("ref"), F.col("sig")).alias("distance"))
