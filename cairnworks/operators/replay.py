"""The archive as of any decision, from the append-only log.

Nothing but the log and the current tables is needed: a state that a later decision replaced is in that
decision's payload, and so are rows that were deleted. Which decisions count is settled by the chain
of undos behind each: an undo may itself be undone, and so on, so an even chain leaves the decision in force.
The state of a path or cluster is then the last word on it, a maximum by decision id that combines before the shuffle;
no group of the log is ever put in order in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnworks.operators.review import _PURGED, _REOPENED, DISK_ACTIONS
from cairnworks.scratch import discard, materialize

DELETIONS = ("reconcile_delete", "ingest_prune")
_PATH_ROW = "id bigint, hash string, drive_id string, path string, mtime bigint, ctime bigint, observed_at bigint, status string"
_PLACE = "struct<drive_id:string,path:string>"


def in_force(decisions: DataFrame, as_of: int | None = None) -> DataFrame:
    """decisions(id, action, payload) up to ``as_of`` that are no undo and not undone.

    The first undo of a target counts, later ones find it undone. Chains of undos are followed by
    pointer doubling, in as many rounds as the length of the longest has binary digits.
    """
    held = decisions if as_of is None else decisions.where(F.col("id") <= as_of)
    target = F.get_json_object("payload", "$.target").cast("long")
    undos = held.where("action = 'undo'").select("id", target.alias("to")).where("`to` < id")
    steps = materialize(undos.groupBy("to").agg(F.min("id").alias("id")).select("id", "to", F.lit(1).cast("long").alias("n")), "undos")
    while True:
        far = steps.select(F.col("id").alias("to"), F.col("to").alias("beyond"), F.col("n").alias("more"))
        joined = steps.join(far, "to", "left")
        after = materialize(joined.select("id", F.coalesce("beyond", "to").alias("to"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.col("beyond").isNotNull().alias("moved")), "undos")
        discard(steps)
        steps = after.drop("moved")
        if after.where("moved").isEmpty():
            break
    undone = steps.groupBy("to").agg(F.max("n").alias("n")).where("n % 2 = 1").select(F.col("to").alias("id"))
    return held.where("action != 'undo'").join(undone, "id", "left_anti")


def _get(path: str) -> Column:
    return F.get_json_object("payload", path)


def path_changes(decisions: DataFrame) -> DataFrame:
    """(seq, path_id, status, was, place, was_place, row): what each decision did to each path.

    ``status`` and ``place`` are null where a decision leaves them; ``row`` is a deleted path's last row.
    """
    empty = {"status": "string", "was": "string", "place": _PLACE, "was_place": _PLACE, "row": f"struct<{_PATH_ROW.replace(' ', ':').replace(',:', ',')}>"}
    shaped = lambda df, **have: df.select(F.col("id").alias("seq"), *[c.alias(k) for k, c in ({"path_id": have.pop("path_id")} | {k: have.get(k, F.lit(None)).cast(t) for k, t in empty.items()}).items()])
    purged = decisions.where(F.col("action").isin("resolve_keep", "purge_all")).select("id", F.explode(F.from_json(_get("$.purged"), _PURGED)).alias("p"))
    restored = decisions.where("action = 'restore'")
    moved = decisions.where(F.col("action").isin(*DISK_ACTIONS))
    dropped = decisions.where(F.col("action").isin(*DELETIONS)).select("id", F.explode(F.from_json(_get("$.rows"), "array<string>")).alias("r")).select("id", F.from_json("r", _PATH_ROW).alias("r"))
    place = lambda side: F.from_json(_get(f"$.{side}"), "drive_id string, path string")
    parts = [
        shaped(purged, path_id=F.col("p.id"), status=F.lit("purgatory"), was=F.col("p.prev_status")),
        shaped(restored, path_id=_get("$.path_id").cast("long"), status=F.lit("active"), was=F.lit("purgatory")),
        shaped(moved, path_id=_get("$.path_id").cast("long"), place=place("dest"), was_place=place("src")),
        shaped(dropped, path_id=F.col("r.id"), row=F.col("r")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).where("path_id is not null")


def paths_as_of(paths: DataFrame, decisions: DataFrame, as_of: int) -> DataFrame:
    """(id, hash, drive_id, path, status) of the paths as they were once decision ``as_of`` was made.

    ``paths`` and ``decisions`` are the current tables. A path in no decision, and one that came later, is as it is
    now; a path deleted by then is left out, one deleted later is back from its decision's payload.
    """
    every = materialize(path_changes(decisions.where("action != 'undo'")), "path-changes")
    live = path_changes(in_force(decisions, as_of))
    first = every.groupBy("path_id").agg(F.min_by("was", F.when(F.col("was").isNotNull(), F.col("seq"))).alias("was"), F.min_by("was_place", F.when(F.col("was_place").isNotNull(), F.col("seq"))).alias("was_place"), F.max_by("row", F.when(F.col("row").isNotNull(), F.col("seq"))).alias("row"))
    last = live.groupBy("path_id").agg(F.max_by("status", F.when(F.col("status").isNotNull(), F.col("seq"))).alias("status"), F.max_by("place", F.when(F.col("place").isNotNull(), F.col("seq"))).alias("place"), F.bool_or(F.col("row").isNotNull()).alias("gone"))
    now = paths.select(F.col("id").alias("path_id"), F.struct("hash", "drive_id", "path", "status").alias("now"))
    rows = now.join(first, "path_id", "full").join(last, "path_id", "left").where("not coalesce(gone, false)")
    rows = rows.withColumn("now", F.coalesce("now", F.when(F.col("row").isNotNull(), F.struct("row.hash", "row.drive_id", "row.path", "row.status")))).where("now is not null")
    place = F.coalesce("place", "was_place", F.struct("now.drive_id", "now.path"))
    return rows.select(F.col("path_id").alias("id"), "now.hash", place["drive_id"].alias("drive_id"), place["path"].alias("path"), F.coalesce(rows["status"], "was", "now.status").alias("status"))


def cluster_changes(decisions: DataFrame) -> DataFrame:
    """(seq, cluster_id, kept_path_id, action, was(canonical_hash, status)): what each decision did to each cluster."""
    review = decisions.where(F.col("action").isin("resolve_keep", "purge_all"))
    review = review.select(F.col("id").alias("seq"), _get("$.cluster_id").alias("cluster_id"), _get("$.kept_path_id").cast("long").alias("kept_path_id"), "action", F.struct(_get("$.prev_canonical").alias("canonical_hash"), F.coalesce(_get("$.prev_status"), F.lit("open")).alias("status")).alias("was"))
    reopened = decisions.where("action = 'restore'").select(F.col("id").alias("seq"), F.explode(F.from_json(_get("$.reopened"), _REOPENED)).alias("c"))
    reopened = reopened.select("seq", "c.cluster_id", F.lit(None).cast("long").alias("kept_path_id"), F.lit("restore").alias("action"), F.struct(F.col("c.prev_canonical").alias("canonical_hash"), F.col("c.prev_status").alias("status")).alias("was"))
    return review.unionByName(reopened)


def clusters_as_of(clusters: DataFrame, paths: DataFrame, decisions: DataFrame, as_of: int) -> DataFrame:
    """(id, canonical_hash, status) of the present clusters once decision ``as_of`` was made; paths tell the kept path's hash.

    A purge keeps the canonical hash that was there, which is the one in its payload.
    """
    every = cluster_changes(decisions.where("action != 'undo'"))
    live = cluster_changes(in_force(decisions, as_of))
    first = every.groupBy("cluster_id").agg(F.min_by("was", "seq").alias("was"))
    last = live.groupBy("cluster_id").agg(F.max_by(F.struct("action", "kept_path_id", "was"), "seq").alias("last"))
    kept = paths.select(F.col("id").alias("kept_path_id"), F.col("hash").alias("kept_hash"))
    last = last.select("cluster_id", "last.action", "last.kept_path_id", F.col("last.was.canonical_hash").alias("stood")).join(kept, "kept_path_id", "left")
    canonical = F.when(F.col("action") == "resolve_keep", F.col("kept_hash")).when(F.col("action") == "purge_all", F.col("stood"))
    status = F.when(F.col("action") == "restore", "open").otherwise("resolved")
    last = last.select("cluster_id", F.struct(canonical.alias("canonical_hash"), status.alias("status")).alias("then"))
    now = clusters.select(F.col("id").alias("cluster_id"), F.struct("canonical_hash", "status").alias("now"))
    rows = now.join(first, "cluster_id", "left").join(last, "cluster_id", "left").withColumn("at", F.coalesce("then", "was", "now"))
    return rows.select(F.col("cluster_id").alias("id"), "at.canonical_hash", "at.status")
