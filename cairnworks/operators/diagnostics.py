"""Checks of stored hashes against the disk, and of image signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Signatures that are listed as the commonest.
TOP_SIGNATURES = 6


def hash_prefix(files: DataFrame, prefix: str) -> DataFrame:
    """Files whose hash starts with the prefix; % and _ have no meaning in it."""
    return files.where(F.col("hash").startswith(prefix))


def exact_verdicts(files: DataFrame, paths: DataFrame, disk: DataFrame) -> DataFrame:
    """(hash, size, n_paths, n_found, n_sizes, n_hashes, verdict) of each file with active paths.

    disk(id, disk_size, fresh_hash) is what was found at each path: no row or a null size where
    nothing is there, a null hash where it wasn't read. ``sizes differ`` and ``hashes differ`` mean
    that a hash was stored for contents that aren't equal, ``changed`` that all members agree on
    contents other than the stored ones, ``identical`` that all that were found hash to the stored
    one, ``not hashed`` that sizes agree and some contents weren't read, ``missing`` that nothing was found.
    """
    live = paths.where("status = 'active'").select("id", "hash")
    rows = live.join(disk.select("id", "disk_size", "fresh_hash"), "id", "left")
    told = rows.groupBy("hash").agg(
        F.count(F.lit(1)).alias("n_paths"),
        F.count("disk_size").alias("n_found"),
        F.count(F.when(F.col("disk_size").isNotNull() & F.col("fresh_hash").isNull(), 1)).alias("n_unread"),
        F.countDistinct("disk_size").alias("n_sizes"),
        F.countDistinct("fresh_hash").alias("n_hashes"),
        F.min("fresh_hash").alias("fresh"),
    )
    verdict = (
        F.when(F.col("n_found") == 0, "missing")
        .when(F.col("n_sizes") > 1, "sizes differ")
        .when(F.col("n_hashes") > 1, "hashes differ")
        .when((F.col("n_hashes") == 1) & (F.col("fresh") != F.col("hash")), "changed")
        .when(F.col("n_unread") > 0, "not hashed")
        .otherwise("identical")
    )
    return files.select("hash", "size").join(told, "hash").select("hash", "size", "n_paths", "n_found", "n_sizes", "n_hashes", verdict.alias("verdict"))


def cluster_sizes(clusters: DataFrame, members: DataFrame, kind: str = "near_image") -> DataFrame:
    """(cluster_id, n_members) of the clusters of a kind; larger ones rank first, ties by id."""
    mine = clusters.where(F.col("kind") == kind).select(F.col("id").alias("cluster_id"))
    return members.join(mine, "cluster_id", "left_semi").groupBy("cluster_id").agg(F.count("hash").alias("n_members"))


def common_signatures(signatures: DataFrame, top: int = TOP_SIGNATURES) -> DataFrame:
    """(sig, n, n_bits) of the commonest signatures, ties by value."""
    counted = signatures.groupBy("sig").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "sig").limit(top).select("sig", "n", F.bit_count("sig").alias("n_bits"))


def without_dimensions(signatures: DataFrame) -> DataFrame:
    """(hash) of image signatures that lack a width or a height, each once."""
    return signatures.where("algo = 'phash_image' and (w is null or h is null)").select("hash").distinct()


def drives_by_label(drives: DataFrame) -> DataFrame:
    """All drives, by label, then id."""
    return drives.orderBy("label", "id")
