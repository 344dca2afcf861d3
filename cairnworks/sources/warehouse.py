"""The archive's tables, made of the driver's tables.

A file is its content's hash; a path is one observation of it. ``files``, ``paths`` and
``drives`` come from ``documents``; ``labels`` sends toxic ones to purgatory.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes below which an exact group isn't worth a review by default.
REVIEW_FLOOR = 1_048_576


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass
class Archive:
    """files(hash, size, mime, first_seen_at), paths(id, hash, drive_id, path, mtime, observed_at, status),
    drives(id, label, root_path, kind), clusters(id, kind, label, canonical_hash, status), members(cluster_id, hash)."""

    files: DataFrame
    paths: DataFrame
    drives: DataFrame
    clusters: DataFrame
    members: DataFrame


def archive(spark: SparkSession, sf_dir: str) -> Archive:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("toxic_id")).distinct()
    seen = docs.select("doc_id", "lang", "source", F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("long").alias("size"))
    files = seen.groupBy("hash").agg(F.max("size").alias("size"), F.min("doc_id").alias("first_seen_at"))
    files = files.select("hash", "size", F.lit("text/plain").alias("mime"), "first_seen_at")
    paths = seen.join(toxic, seen.doc_id == toxic.toxic_id, "left").select(
        F.col("doc_id").alias("id"),
        "hash",
        F.col("source").alias("drive_id"),
        F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/note_"), F.col("doc_id") % 97, F.lit("_v"), F.col("doc_id"), F.lit(".txt")).alias("path"),
        (F.lit(1_600_000_000) + F.col("doc_id") * 60).alias("mtime"),
        (F.lit(1_700_000_000) + F.col("doc_id")).alias("observed_at"),
        F.when(F.col("toxic_id").isNull(), "active").otherwise("purgatory").alias("status"),
    )
    drives = docs.select("source").distinct().select(
        F.col("source").alias("id"),
        F.concat(F.lit("drive "), "source").alias("label"),
        F.concat(F.lit("/mnt/"), "source").alias("root_path"),
        F.when(F.col("source") == "src0", "managed").otherwise("scanned").alias("kind"),
    )
    from cairnworks.operators.clusters import cluster_id, exact_cluster_keys

    keys = exact_cluster_keys(files, paths, include_purgatory=True)
    clusters = keys.select(
        cluster_id("exact", F.array("hash")).alias("id"),
        F.lit("exact").alias("kind"),
        F.lit(None).cast("string").alias("label"),
        F.when(F.substring("hash", 1, 1) < "4", F.col("hash")).alias("canonical_hash"),
        F.when(F.substring("hash", 1, 1) < "4", "resolved").otherwise("open").alias("status"),
        "hash",
    )
    return Archive(files, paths, drives, clusters.drop("hash"), clusters.select(F.col("id").alias("cluster_id"), "hash"))
