"""Reversible review: decisions over clusters, as rows of state changes.

Nothing is updated in place. Each action takes the current tables and a table of requests, and
returns changes to fold over them and decision rows whose JSON holds what undo needs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Actions whose undo moves files on disk.
DISK_ACTIONS = ("apply_move", "apply_remove")


@dataclass
class Outcome:
    """path_changes(path_id, status), cluster_changes(cluster_id, canonical_hash, status), decisions(request, action, payload), rejected(request columns, reason)."""

    path_changes: DataFrame
    cluster_changes: DataFrame
    decisions: DataFrame
    rejected: DataFrame


def _active_members(members: DataFrame, paths: DataFrame) -> DataFrame:
    return members.join(paths.where("status = 'active'").select("hash", F.col("id").alias("path_id")), "hash")


def _payload(**columns: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in columns.items()]), {"ignoreNullFields": "false"})


def resolve_keep(clusters: DataFrame, members: DataFrame, paths: DataFrame, requests: DataFrame) -> Outcome:
    """requests(cluster_id, keep_path_id): one path stays, the other active ones go to purgatory."""
    actives = _active_members(members, paths)
    keeper = actives.select("cluster_id", F.col("path_id").alias("keep_path_id"), F.col("hash").alias("keep_hash")).distinct()
    good = requests.join(keeper, ["cluster_id", "keep_path_id"])
    bad = requests.join(keeper, ["cluster_id", "keep_path_id"], "left_anti")
    some = actives.select("cluster_id").distinct().withColumn("has", F.lit(True))
    bad = bad.join(some, "cluster_id", "left").select("cluster_id", "keep_path_id", F.when(F.col("has"), "path is not an active member").otherwise("cluster has no active paths").alias("reason"))
    purged = good.join(actives, "cluster_id").where("path_id != keep_path_id")
    return _outcome(clusters, good, purged, bad, "resolve_keep", F.col("keep_hash"), F.col("keep_path_id"))


def purge_all(clusters: DataFrame, members: DataFrame, paths: DataFrame, requests: DataFrame) -> Outcome:
    """requests(cluster_id): all active paths go to purgatory; the canonical hash stays as it was."""
    actives = _active_members(members, paths)
    good = requests.join(actives.select("cluster_id").distinct(), "cluster_id", "left_semi")
    bad = requests.join(actives.select("cluster_id").distinct(), "cluster_id", "left_anti").withColumn("reason", F.lit("cluster has no active paths"))
    return _outcome(clusters, good, good.join(actives, "cluster_id"), bad, "purge_all", None, None)


def _outcome(clusters: DataFrame, good: DataFrame, purged: DataFrame, bad: DataFrame, action: str, canonical: Column | None, kept: Column | None) -> Outcome:
    before = clusters.select(F.col("id").alias("cluster_id"), F.col("canonical_hash").alias("prev_canonical"), F.col("status").alias("prev_status"))
    state = good.join(before, "cluster_id")
    lists = purged.groupBy("cluster_id").agg(F.array_sort(F.collect_set(F.struct(F.col("path_id").alias("id"), F.lit("active").alias("prev_status")))).alias("purged"))
    told = state.join(lists, "cluster_id", "left").select(
        "cluster_id",
        F.lit(action).alias("action"),
        _payload(cluster_id=F.col("cluster_id"), kept_path_id=F.lit(None).cast("long") if kept is None else kept, purged=F.coalesce("purged", F.expr("cast(array() as array<struct<id:bigint,prev_status:string>>)")), prev_canonical=F.col("prev_canonical"), prev_status=F.col("prev_status")).alias("payload"),
    )
    return Outcome(
        purged.select("path_id", F.lit("purgatory").alias("status")).distinct(),
        state.select("cluster_id", (F.col("prev_canonical") if canonical is None else canonical).alias("canonical_hash"), F.lit("resolved").alias("status")),
        told,
        bad,
    )


def restore(clusters: DataFrame, members: DataFrame, paths: DataFrame, drives: DataFrame, requests: DataFrame) -> Outcome:
    """requests(path_id): purgatory paths on scanned drives become active; every resolved cluster with their hash reopens."""
    rows = requests.join(paths.select(F.col("id").alias("path_id"), "hash", "status", "drive_id"), "path_id", "left")
    rows = rows.join(drives.select(F.col("id").alias("drive_id"), F.col("kind").alias("drive_kind")), "drive_id", "left")
    reason = F.when(F.col("hash").isNull(), "no such path").when(F.col("status") != "purgatory", "not in purgatory").when(F.col("drive_kind") == "managed", "moved to a managed drive")
    rows = rows.withColumn("reason", reason)
    good, bad = rows.where("reason is null"), rows.where("reason is not null").select("path_id", "reason")
    resolved = clusters.where("status = 'resolved'").select(F.col("id").alias("cluster_id"), F.col("status").alias("prev_status"), F.col("canonical_hash").alias("prev_canonical"))
    reopened = good.select("path_id", "hash").join(members, "hash").join(resolved, "cluster_id")
    lists = reopened.groupBy("path_id").agg(F.array_sort(F.collect_set(F.struct("cluster_id", "prev_status", "prev_canonical"))).alias("reopened"))
    told = good.join(lists, "path_id", "left").select("path_id", F.lit("restore").alias("action"), _payload(path_id=F.col("path_id"), prev_status=F.lit("purgatory"), reopened=F.coalesce("reopened", F.expr("cast(array() as array<struct<cluster_id:string,prev_status:string,prev_canonical:string>>)"))).alias("payload"))
    return Outcome(
        good.select("path_id", F.lit("active").alias("status")),
        reopened.select("cluster_id", F.lit(None).cast("string").alias("canonical_hash"), F.lit("open").alias("status")).distinct(),
        told,
        bad,
    )


def changed_paths(paths: DataFrame, changes: DataFrame) -> DataFrame:
    """The changed paths alone, with their new states."""
    return paths.drop("status").join(changes.select(F.col("path_id").alias("id"), "status"), "id")


def changed_clusters(clusters: DataFrame, changes: DataFrame) -> DataFrame:
    return clusters.drop("canonical_hash", "status").join(changes.select(F.col("cluster_id").alias("id"), "canonical_hash", "status"), "id")


def fold_paths(paths: DataFrame, changes: DataFrame) -> DataFrame:
    """Paths with changed states."""
    new = changes.select(F.col("path_id").alias("id"), F.col("status").alias("__new"))
    return paths.join(new, "id", "left").withColumn("status", F.coalesce("__new", "status")).drop("__new")


def fold_clusters(clusters: DataFrame, changes: DataFrame) -> DataFrame:
    new = changes.select(F.col("cluster_id").alias("id"), F.col("canonical_hash").alias("__hash"), F.col("status").alias("__new"))
    rows = clusters.join(new, "id", "left")
    changed = F.col("__new").isNotNull()
    return rows.withColumn("canonical_hash", F.when(changed, F.col("__hash")).otherwise(F.col("canonical_hash"))).withColumn("status", F.coalesce("__new", "status")).drop("__hash", "__new")


def not_undone(decisions: DataFrame) -> DataFrame:
    """decisions(id, action, payload): those that are no undo and the target of none."""
    targets = decisions.where("action = 'undo'").select(F.get_json_object("payload", "$.target").cast("long").alias("id")).where("id is not null").distinct()
    return decisions.where("action != 'undo'").join(targets, "id", "left_anti")


def next_undo(decisions: DataFrame) -> DataFrame:
    """The newest decision to undo, if any, and whether that takes moving files."""
    last = not_undone(decisions).agg(F.max_by(F.struct("id", "action", "payload"), "id").alias("d")).where("d is not null").select("d.*")
    return last.withColumn("needs_process_undo", F.col("action").isin(*DISK_ACTIONS))


def last_relocation(decisions: DataFrame) -> DataFrame:
    last = not_undone(decisions).where(F.col("action").isin(*DISK_ACTIONS))
    return last.agg(F.max_by(F.struct("id", "action", "payload"), "id").alias("d")).where("d is not null").select("d.*")


_PURGED = "array<struct<id:bigint,prev_status:string>>"
_REOPENED = "array<struct<cluster_id:string,prev_status:string,prev_canonical:string>>"


def undo(decision: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(path_changes, cluster_changes, undo rows) that reverse decisions(id, action, payload) of the index alone."""
    rows = decision.where(~F.col("action").isin(*DISK_ACTIONS))
    get = lambda path: F.get_json_object("payload", path)
    review = rows.where(F.col("action").isin("resolve_keep", "purge_all"))
    back = review.select(F.explode(F.from_json(get("$.purged"), _PURGED)).alias("p")).select(F.col("p.id").alias("path_id"), F.col("p.prev_status").alias("status"))
    restored = rows.where("action = 'restore'")
    again = restored.select(get("$.path_id").cast("long").alias("path_id"), F.lit("purgatory").alias("status"))
    closed = review.select(get("$.cluster_id").alias("cluster_id"), get("$.prev_canonical").alias("canonical_hash"), F.coalesce(get("$.prev_status"), F.lit("open")).alias("status"))
    reclosed = restored.select(F.explode(F.from_json(get("$.reopened"), _REOPENED)).alias("c")).select("c.cluster_id", F.col("c.prev_canonical").alias("canonical_hash"), F.col("c.prev_status").alias("status"))
    told = rows.select(F.lit("undo").alias("action"), _payload(target=F.col("id"), of_action=F.col("action")).alias("payload"))
    return back.union(again), closed.union(reclosed), told


def deleted_paths(paths: DataFrame, gone: DataFrame, reason: str) -> DataFrame:
    """(drive_id, payload, action): a snapshot of each path with one of the gone ids."""
    lost = paths.join(gone.select("id"), "id", "left_semi")
    return lost.select("drive_id", F.to_json(F.struct(*lost.columns)).alias("payload"), F.lit(reason).alias("action"))


def restored_deletions(snapshots: DataFrame, schema: str) -> DataFrame:
    """The rows that :func:`deleted_paths` took out."""
    return snapshots.select(F.from_json("payload", schema).alias("p")).select("p.*")
