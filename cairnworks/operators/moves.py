"""Planned relocations: work lists, checks, free names, crash recovery. Plans only; no file is moved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnworks.functions.names import absolute, base_name, parent_dir
from cairnworks.operators.running import running_sum


def pending(moves: DataFrame, paths: DataFrame, files: DataFrame, drives: DataFrame, kind: str | None = None, statuses: tuple[str, ...] = ("pending",)) -> DataFrame:
    """moves(id, path_id, hash, kind, dest_root, status) with their source, largest file first."""
    rows = moves.where(F.col("status").isin(*statuses))
    if kind:
        rows = rows.where(F.col("kind") == kind)
    rows = rows.join(paths.select(F.col("id").alias("path_id"), F.col("path").alias("rel"), F.col("status").alias("path_status"), "drive_id", "mtime"), "path_id")
    rows = rows.join(files.select("hash", "size"), "hash")
    return rows.join(drives.select(F.col("id").alias("drive_id"), F.col("root_path").alias("src_root"), F.col("label").alias("src_drive_label")), "drive_id").orderBy(F.desc("size"), "id")


def totals(work: DataFrame) -> DataFrame:
    return work.agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "keeper", F.col("size"))), F.lit(0)).alias("keeper_bytes"),
        F.coalesce(F.sum(F.when(F.col("kind") == "dup", F.col("size"))), F.lit(0)).alias("dup_bytes"),
    )


def duplicates_to_move(paths: DataFrame, files: DataFrame, drives: DataFrame) -> DataFrame:
    """Purgatory paths that still are on scanned drives."""
    rows = paths.where("status = 'purgatory'").select(F.col("id").alias("path_id"), "hash", F.col("path").alias("rel"), "drive_id")
    rows = rows.join(files.select("hash", "size"), "hash").join(drives.where("kind = 'scanned'").select(F.col("id").alias("drive_id"), F.col("root_path").alias("src_root"), F.col("label").alias("src_drive_label")), "drive_id")
    return rows.select("path_id", "hash", "rel", "size", "src_root", "src_drive_label").orderBy(F.desc("size"), "path_id")


def free_names(items: DataFrame, taken: DataFrame) -> DataFrame:
    """items(item, dest_root, rel) with ``final_rel``: ' (n)' is put on the stem until the name is free.

    ``taken`` has (dest_root, rel) of what lies there. The plan knows its own names: the k-th
    item of one name takes the k-th free number, where 1 is the name itself. Numbers go by item; a
    suffixed name that is itself planned or taken is passed over. Null folders and names are
    groups of their own. Items and used numbers are counted by :func:`running_sum`, so one name may have any share of all rows.
    """
    stem = F.regexp_replace(base_name(F.col("rel")), r"^(.+)\.[^.]+$", "$1")
    ending = F.regexp_extract(base_name(F.col("rel")), r"^.+(\.[^.]+)$", 1)
    folder = F.when(parent_dir(F.col("rel")) == ".", "").otherwise(F.concat(parent_dir(F.col("rel")), F.lit("/")))
    there = taken.select("dest_root", F.col("rel").alias("name")).union(items.select("dest_root", F.col("rel").alias("name"))).distinct()
    suffixed = there.select("dest_root", F.regexp_replace("name", r" \(\d+\)(\.[^./]+)?$", "$1").alias("rel"), F.regexp_extract("name", r" \((\d+)\)(?:\.[^./]+)?$", 1).alias("n"))
    suffixed = suffixed.where("n != '' and length(n) < 10").select("dest_root", "rel", F.col("n").cast("int").alias("n")).where("n >= 2")
    used = suffixed.union(taken.select("dest_root", "rel", F.lit(1))).distinct()
    both = items.select("dest_root", "rel", "item", F.lit(None).cast("int").alias("n")).unionByName(used.withColumn("item", F.lit(None).cast(items.schema["item"].dataType)))
    both = both.withColumn("is_used", F.col("n").isNotNull().cast("int"))
    both = running_sum(both, ["dest_root", "rel", "is_used"], ["item", "n"], F.lit(1), "nth")
    # the j-th used number has n - j free ones below; the k-th item passes over those with fewer than k
    both = both.withColumn("at", F.when(F.col("is_used") == 1, F.col("n") - F.col("nth")).otherwise(F.col("nth")))
    both = running_sum(both, ["dest_root", "rel"], ["at", "is_used", "n", "item"], F.col("is_used"), "passed")
    number = F.col("at") + F.col("passed")
    final = F.when(number == 1, F.col("rel")).otherwise(F.concat(folder, stem, F.lit(" ("), number, F.lit(")"), ending))
    return both.where("is_used = 0").select("item", "dest_root", "rel", final.alias("final_rel"))


def verify_sources(items: DataFrame, listing: DataFrame, by_content: bool = True) -> DataFrame:
    """items(item, abspath, hash, size, mtime) against listing(abspath, is_link, size, mtime, hash): null reason = safe."""
    seen = listing.select("abspath", F.lit(True).alias("there"), "is_link", F.col("size").alias("now_size"), F.col("mtime").alias("now_mtime"), F.col("hash").alias("now_hash"))
    rows = items.join(seen, "abspath", "left")
    reason = F.when(F.col("there").isNull(), "source file is gone").when(F.col("is_link"), "source is a link")
    if by_content:
        reason = reason.when(F.col("now_size") != F.col("size"), "source is being written (short read)").when(~F.col("now_hash").eqNullSafe(F.col("hash")), "content changed since ingest")
    else:
        changed = (F.col("now_mtime") != F.coalesce("mtime", F.lit(0))) | (F.col("now_size") != F.coalesce(F.nullif(F.col("size"), F.lit(0)), F.col("now_size")))
        reason = reason.when(changed, "source changed since ingest")
    return rows.select("item", reason.alias("reason"))


def plan(keepers: DataFrame, dups: DataFrame, holding: str | None, taken: DataFrame) -> DataFrame:
    """(item, kind, src, dest_root, final_rel) of all work; copies go to the holding folder, if there is one."""
    a = keepers.select(F.col("path_id").alias("item"), F.lit("keeper").alias("kind"), absolute(F.col("src_root"), F.col("rel")).alias("src"), "dest_root", "rel")
    b = dups.select(F.col("path_id").alias("item"), F.lit("dup").alias("kind"), absolute(F.col("src_root"), F.col("rel")).alias("src"), F.lit(holding).alias("dest_root"), "rel").where("dest_root is not null")
    rows = a.unionByName(b.join(a.select("item"), "item", "left_anti"))
    names = free_names(rows.select("item", "dest_root", "rel"), taken)
    return rows.join(names.select("item", "final_rel"), "item").select("item", "kind", "src", "dest_root", "final_rel")


def recover(moving: DataFrame) -> DataFrame:
    """moving(id, kind, src_there, dst_there): what a crash calls for."""
    action = F.when(F.col("dst_there") & ~F.col("src_there"), "commit").when(F.col("src_there") & ~F.col("dst_there"), "revert").otherwise("conflict")
    committed = action == "commit"
    return moving.select(
        "id",
        action.alias("outcome"),
        F.when(committed, F.when(F.col("kind") == "keeper", "active").otherwise("purgatory")).alias("new_status"),
        F.when(committed, F.when(F.col("kind") == "keeper", "apply_move").otherwise("apply_remove")).alias("decision"),
    )
