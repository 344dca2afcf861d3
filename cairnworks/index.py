"""One index: ingest a tree, find duplicates, review them, undo, plan relocations."""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cairnworks.functions.bits import aspect_bucket
from cairnworks.functions.names import is_text
from cairnworks.functions.simhash import TEXT_CHARS, simhash_arrow
from cairnworks.operators import archives, clusters, diagnostics, ingest, moves, near, replay, review, stats, topics
from cairnworks.scratch import counted, materialize
from cairnworks.sources import images
from cairnworks.sources.chat import ChatServer, ask_all
from cairnworks.sources.relocate import execute, move_file
from cairnworks.sources.snapshots import SCHEMAS, Snapshots
from cairnworks.sources.treewalk import MARKER, hash_files, walk

MAX_DESTINATIONS = 5
#: Deleted paths that one decision row tells of, about.
DELETED_A_ROW = 1000


def drive_identity(root: str, label: str | None = None) -> dict:
    """The marker file's id and label; a new marker is written where there is none. The marker's label wins."""
    marker = os.path.join(root, MARKER)
    if os.path.exists(marker):
        with open(marker, encoding="utf-8") as f:
            found = json.load(f)
        return {"id": found["id"], "label": found.get("label") or label or os.path.basename(root)}
    made = {"id": str(uuid.uuid4()), "label": label or os.path.basename(os.path.abspath(root))}
    with open(marker, "w", encoding="utf-8") as f:
        json.dump(made, f)
    return made


def chat_url(base: str) -> str:
    """The base of a chat API: a scheme if there is none, and /v1 at its end once."""
    base = base.strip().rstrip("/")
    if "://" not in base:
        base = f"http://{base}"
    return base if base.endswith("/v1") else f"{base}/v1"


def managed_id(root: str) -> str:
    return "managed:" + hashlib.sha256(os.path.normcase(os.path.abspath(root)).encode()).hexdigest()[:16]


class Index:
    """All state is in ``folder``; see :class:`Snapshots`. Times are seconds and may be given for repeatable runs.

    ``decoder`` gives pixels of images (see :mod:`cairnworks.sources.images`); Pillow's where that is installed.
    """

    def __init__(self, spark: SparkSession, folder: str, now: Callable[[], int] = lambda: int(time.time()), decoder: images.Decoder | None = None):
        self.spark, self.now = spark, now
        self.decoder = decoder or (images.pillow_decoder() if images.Image is not None else None)
        self.tables = Snapshots(spark, folder)

    def __getattr__(self, name: str) -> DataFrame:
        if name in SCHEMAS:
            return self.tables.table(name)
        raise AttributeError(name)

    # --- ingest

    def ingest(self, root: str, label: str | None = None, prune: bool = False) -> dict:
        """Indexes a tree; unchanged files aren't read again. Counts of what happened, taken while the listing and the hashes are written."""
        drive, now = drive_identity(root, label), self.now()
        roots = [r["root_path"] for r in self.drives.where("kind = 'managed'").select("root_path").collect()]  # a few destinations
        walked = walk(self.spark, root, roots, errors=True).withColumn("drive_id", F.lit(drive["id"]))
        walked, saw = counted(walked, "listing", unreadable=F.count("error"), links=F.count_if(F.expr("error is null and is_link")), files=F.count_if(F.expr("error is null and not is_link")))
        listing = walked.where("error is null").drop("error")
        known = ingest.to_hash(listing.where("not is_link"), self.paths, self.files)
        todo = listing.join(known.where("known_hash is null").select("drive_id", "path"), ["drive_id", "path"], "left_semi")
        hashed = hash_files(todo.select("drive_id", "path", "abspath", "size", "mtime", "ctime"))
        hashed, read = counted(hashed, "hashed", all=F.count(F.lit(1)), good=F.count_if(ingest.is_good()))
        good, errors = ingest.short_reads(hashed)
        same = listing.join(known.where("known_hash is not null").select("drive_id", "path", "known_hash"), ["drive_id", "path"])
        same = same.select("drive_id", "path", F.col("known_hash").alias("hash"), "mtime", "ctime")
        seen = good.select("drive_id", "path", "hash", "mtime", "ctime").unionByName(same)
        files = ingest.fold_files(self.files.join(good.select("hash"), "hash", "left_semi"), good.select("hash", "size", "mime", F.lit(now).cast("long").alias("first_seen_at"), F.lit(now).cast("long").alias("seq")))
        known_paths = self.paths.join(seen.select("drive_id", "path"), ["drive_id", "path"], "left_semi")
        old = known_paths.select("drive_id", "path", "hash", "mtime", "observed_at", "status")
        folded = ingest.fold_paths(old, seen.select("drive_id", "path", "hash", "mtime", F.lit(now).cast("long").alias("observed_at"), F.lit(now).cast("long").alias("seq")))
        ids = known_paths.select("drive_id", "path", "id", F.col("ctime").alias("old_ctime"))
        base = self.tables.next_id("paths")
        paths = folded.join(ids, ["drive_id", "path"], "left").join(seen.select("drive_id", "path", "ctime"), ["drive_id", "path"], "left")
        paths = paths.withColumn("id", F.coalesce("id", F.lit(base) + F.monotonically_increasing_id())).withColumn("ctime", F.coalesce("ctime", "old_ctime"))
        drives = self._rows("drives", [(drive["id"], drive["label"], os.path.abspath(root), now, "scanned")])
        self.tables.commit({"files": files, "paths": paths, "drives": drives})
        failed = read["all"] - read["good"] + saw["unreadable"]
        out = {"drive_id": drive["id"], "links": saw["links"], "hashed": read["good"], "skipped": saw["files"] - read["all"], "errors": failed, "pruned": 0}
        if prune and not saw["unreadable"]:  # what lies below a folder that can't be read is not gone
            gone = stats.stale(self.files, self.paths.where(F.col("drive_id") == drive["id"]), now, errors)
            out["pruned"] = self._delete(materialize(gone.select("id"), "gone"), "ingest_prune")
        return out

    def reconcile(self, drive_id: str | None = None, dry_run: bool = False) -> DataFrame:
        """The report of every scanned drive; paths that vanished from reachable ones are deleted."""
        drives = self.drives if drive_id is None else self.drives.where(F.col("id") == drive_id)
        roots = drives.where("kind != 'managed'").select("id", "root_path").collect()  # a row for each drive
        up = [(r["id"], r["root_path"]) for r in roots if r["root_path"] and os.path.isdir(r["root_path"])]
        listing = self.spark.createDataFrame([], "drive_id string, path string, error string")
        for i, root in up:
            listing = listing.unionByName(walk(self.spark, root, errors=True).select(F.lit(i).alias("drive_id"), "path", "error"))
        listing = materialize(listing, "listing")
        # a drive with a folder that can't be read counts as out of reach
        reachable = self.spark.createDataFrame([(i,) for i, _ in up], "drive_id string").join(listing.where("error is not null"), "drive_id", "left_anti")
        listing = listing.where("error is null").drop("error")
        missing = materialize(ingest.missing_paths(self.paths, self.files, drives, listing, reachable), "missing")
        report = materialize(ingest.reconcile_report(self.paths, drives, missing, reachable), "report")
        if not dry_run:
            self._delete(missing.select("id"), "reconcile_delete")
        return report

    def _delete(self, gone: DataFrame, reason: str) -> int:
        """Paths go; decision rows of bounded size, told by one batch name, keep them."""
        n = gone.count()
        if n:
            lost = review.deleted_paths(self.paths, gone, reason)
            share = F.pmod(F.xxhash64("payload"), F.lit(-(-n // DELETED_A_ROW)))
            told = F.to_json(F.struct(F.lit(uuid.uuid4().hex).alias("batch"), F.collect_list("payload").alias("rows")))
            payload = lost.groupBy("action", share.alias("share")).agg(told.alias("payload")).drop("share")
            self.tables.commit({"decisions": self._decided(payload, "auto")}, {"paths": gone.select("id")})
        return n

    # --- clusters and topics

    def cluster(self, reset_near: bool = False, most_images: int | None = near.MAX_IMAGE_CLUSTER) -> dict:
        """Exact groups, text signatures, document versions and near images; counts of new clusters.

        Components of more than ``most_images`` images make no cluster, None keeps all; :meth:`oversize_images` tells of them.
        Images are signed where there is a decoder; signatures can also come by :meth:`add_image_signatures`.
        """
        if reset_near:
            self.reset_clusters("near_image")
        new = {"exact": clusters.new_exact_clusters(self.files, self.paths, self._of_kind("exact")).select("cluster_id", F.lit("exact").alias("kind"), F.lit(None).cast("string").alias("label"), "hash")}
        self._sign_texts()
        if self.decoder is not None:
            self._sign_images()
        text = self.signatures.where("algo = 'simhash_text'")
        live = self.paths.where("status = 'active'").select("hash").distinct()
        new["doc_version"] = near.document_clusters(self.paths, text.join(live, "hash", "left_semi"), self._of_kind("doc_version"))
        new["near_image"] = near.image_clusters(self._live_images(), self._of_kind("near_image"), most=most_images)
        return {kind: self._add_clusters(rows) for kind, rows in new.items()}

    def _live_images(self) -> DataFrame:
        live = self.paths.where("status = 'active'").select("hash").distinct()
        image = self.signatures.where("algo = 'phash_image'").withColumn("aspect", aspect_bucket(F.col("w"), F.col("h")))
        return image.join(live, "hash", "left_semi")

    def oversize_images(self, most: int = near.MAX_IMAGE_CLUSTER) -> DataFrame:
        """(component, n): components of near images that :meth:`cluster` leaves out for their size."""
        return near.oversize(near.components_of(near.band_links(self._live_images())), most)

    def _of_kind(self, kind: str) -> DataFrame:
        return self.members.join(self.clusters.where(F.col("kind") == kind).select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi")

    def _add_clusters(self, rows: DataFrame) -> int:
        rows = materialize(rows, "new-clusters")
        heads = rows.select("cluster_id", "kind", "label").distinct()
        n = heads.count()
        if n:
            made = heads.select(F.col("cluster_id").alias("id"), "kind", "label", F.lit(None).cast("string").alias("canonical_hash"), F.lit(self.now()).cast("long").alias("created_at"), F.lit("open").alias("status"))
            bridge = rows.select("cluster_id", "hash", F.lit(1.0).alias("confidence")).distinct()
            self.tables.commit({"clusters": made, "members": bridge})
        return n

    def reset_clusters(self, kind: str) -> int:
        """Drops derived clusters; the decision row keeps their members."""
        if kind == "exact":
            raise ValueError("exact clusters hold review state")
        gone = self.clusters.where(F.col("kind") == kind)
        n = gone.count()
        if n:
            lost = self.members.join(gone.select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi")
            payload = lost.groupBy("cluster_id").agg(F.sort_array(F.collect_list("hash")).alias("hashes")).select(F.lit("reset_clusters").alias("action"), F.to_json(F.struct(F.lit(kind).alias("kind"), "cluster_id", "hashes")).alias("payload"))
            self.tables.commit({"decisions": self._decided(payload, "auto")}, {"clusters": gone.select("id"), "members": lost.select("cluster_id", "hash")})
        return n

    def _texts(self, rows: DataFrame, chars: int) -> DataFrame:
        """(hash, text): the first characters of each file, bytes that are no UTF-8 left out."""

        def read(batches):
            for batch in batches:
                texts = []
                for path in batch["abspath"]:
                    try:
                        with open(path, encoding="utf-8", errors="ignore") as f:
                            texts.append(f.read(chars))
                    except OSError:
                        texts.append(None)
                yield batch[["hash"]].assign(text=texts)

        return rows.select("hash", "abspath").mapInPandas(read, "hash string, text string").where("text is not null")

    def _sign_texts(self) -> None:
        rows = stats.one_location(self.files, self.paths, self.drives).where(is_text(F.col("rel"), F.col("mime")))
        rows = rows.join(self.signatures.where("algo = 'simhash_text'").select("hash"), "hash", "left_anti")
        signed = simhash_arrow(self._texts(rows, TEXT_CHARS), "hash", "text").select("hash", F.lit("simhash_text").alias("algo"), "sig", F.lit(None).cast("int").alias("w"), F.lit(None).cast("int").alias("h"))
        self.tables.commit({"signatures": signed})

    def _sign_images(self) -> None:
        """Signs active images that have no signature, or one without dimensions."""
        known = self.signatures.where("algo = 'phash_image'").join(diagnostics.without_dimensions(self.signatures), "hash", "left_anti")
        rows = stats.one_location(self.files, self.paths, self.drives).where(F.col("mime").startswith("image/")).join(known.select("hash"), "hash", "left_anti")

        def read(batches):
            for batch in batches:
                for key, path in zip(batch["hash"], batch["abspath"], strict=True):  # one file at a time
                    try:
                        with open(path, "rb") as f:
                            yield pd.DataFrame({"hash": [key], "content": [f.read()]})
                    except OSError:
                        continue

        contents = rows.select("hash", "abspath").mapInPandas(read, "hash string, content binary")
        self.add_image_signatures(materialize(images.image_signatures(contents, self.decoder), "image-signatures"))

    def add_image_signatures(self, signed: DataFrame) -> None:
        """signed(hash, sig, w, h), a row for each hash, from any decoder; later rows replace earlier ones."""
        rows = signed.select("hash", F.lit("phash_image").alias("algo"), F.col("sig").cast("long").alias("sig"), F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h"))
        self.tables.commit({"signatures": rows})

    def topics(self, model: Callable[[], Callable[[str], str]] | None = None, limit: int | None = None, server: ChatServer | None = None, **pace) -> dict:
        """Tags texts by their heading, by a model's answers or by those of a server; groups of two make clusters.

        ``pace`` goes to :meth:`_ask`; texts that a server gave no answer to are counted as ``errors`` and asked again next time.
        """
        todo = topics.untagged_texts(stats.one_location(self.files, self.paths, self.drives), self.tags, limit)
        todo, saw = counted(todo, "untagged", files=F.count(F.lit(1)))
        texts, failed = self._texts(todo, topics.TOPIC_CHARS), {}
        if server:
            texts = materialize(topics.keyed_texts(texts, "hash", "text"), "shown-texts")
            answers = self._ask(texts, server, **pace)
            failed["errors"] = topics.unanswered(texts, answers).count()
            found = topics.infer_by_answers(texts, "hash", answers)
        else:
            found = topics.infer_by_model(texts, "hash", "text", model) if model else topics.infer_by_heading(texts, "hash", "text")
        tags = topics.as_tags(found, "llm" if model or server else "rule")
        tags, told = counted(tags, "tags", files=F.count_if(F.col("key") == "topic"))  # one such tag a file
        self.tables.commit({"tags": tags.dropDuplicates(["hash", "key", "value"])})
        made = self._add_clusters(topics.topic_clusters(self.tags, self.paths, self._of_kind("topic")))
        return {"tagged": told["files"], "skipped": saw["files"] - told["files"], "clusters": made} | failed

    def _ask(self, texts: DataFrame, server: ChatServer, at_once: int = 4, per_second: float | None = None, share: int = 64) -> DataFrame:
        """The server's answers, once texts(text_key, t) without one were asked for.

        Rounds of about ``share`` texts for each of ``at_once`` tasks, each kept by one commit: a lost task repeats its share
        of a round, and a run that died is taken up where its last round ended. A round without any answer is the last.
        """
        known = lambda: self.answers.where(F.col("model") == server.model)
        open_texts = materialize(topics.unanswered(texts, known()), "unanswered")
        rounds = -(-open_texts.count() // (at_once * share))
        if rounds:
            dealt = open_texts.withColumn("round", F.pmod(F.xxhash64("text_key"), F.lit(rounds)))
            dealt = materialize(dealt.repartitionByRange("round").sortWithinPartitions("round"), "dealt")  # a round reads its row groups
        for k in range(rounds):
            seen = Observation()
            asked = ask_all(dealt.where(F.col("round") == k), server, at_once, per_second)
            self.tables.commit({"answers": asked.observe(seen, F.count("answer").alias("answered"), F.count("error").alias("failed"))})
            if seen.get["failed"] and not seen.get["answered"]:
                break
        return known()

    # --- reading

    def stats(self) -> DataFrame:
        return stats.storage(self.files, self.paths, self.drives)

    def overview(self) -> DataFrame:
        return stats.overview(self.clusters, self._summary())

    def _summary(self) -> DataFrame:
        return clusters.summaries(self.clusters, self.members, self.files, self.paths)

    def queue(self, **options) -> DataFrame:
        return clusters.review_queue(self._summary(), **options)

    def duplicates(self, min_size: int = 1) -> DataFrame:
        return clusters.exact_groups(self.files, self.paths, min_size)

    def detail(self, cluster_id: str) -> DataFrame:
        return clusters.details(self.members.where(F.col("cluster_id") == cluster_id), self.files, self.paths)

    def search(self, pattern: str, **options) -> DataFrame:
        return stats.search(self.files, self.paths, pattern, **options)

    def purgatory(self, limit: int = 1000) -> DataFrame:
        return stats.purgatory_list(self.files, self.paths, limit)

    def archive_members(self) -> DataFrame:
        """Entries of every active zip and tar file, each archive's from one of its paths; see :mod:`cairnworks.operators.archives`."""
        held = stats.one_location(self.files, self.paths, self.drives).where(archives.listable(F.col("rel")))
        rows = archives.list_files(held.select(F.col("rel").alias("path"), "abspath", "hash"))
        return rows.drop("abspath")

    # --- review

    def keep(self, cluster_id: str, path_id: int, dest_root: str | None = None, dest_label: str | None = None) -> None:
        requests = self.spark.createDataFrame([(cluster_id, path_id)], "cluster_id string, keep_path_id long")
        extra = {}
        if dest_root:
            row = self.paths.where(F.col("id") == path_id).select(F.lit(self.tables.next_id("moves")).alias("id"), F.col("id").alias("path_id"), "hash", F.lit("keeper").alias("kind"), F.lit(dest_label).alias("dest_label"), F.lit(dest_root).alias("dest_root"), F.lit(None).cast("string").alias("src_abspath"), F.lit(None).cast("string").alias("final_path"), F.lit(self.now()).alias("enqueued_at"), F.lit("pending").alias("status"))
            extra["moves"] = row
        self._apply(review.resolve_keep(self.clusters, self.members, self.paths, requests), **extra)

    def purge_all(self, cluster_id: str) -> None:
        self._apply(review.purge_all(self.clusters, self.members, self.paths, self.spark.createDataFrame([(cluster_id,)], "cluster_id string")))

    def restore(self, path_id: int) -> None:
        self._apply(review.restore(self.clusters, self.members, self.paths, self.drives, self.spark.createDataFrame([(path_id,)], "path_id long")))

    def _apply(self, out: review.Outcome, **extra: DataFrame) -> None:
        bad = out.rejected.first()
        if bad:
            raise ValueError(bad["reason"])
        self.tables.commit({"paths": review.changed_paths(self.paths, out.path_changes), "clusters": review.changed_clusters(self.clusters, out.cluster_changes), "decisions": self._decided(out.decisions, "user"), **extra})

    def undo(self) -> dict | None:
        """Reverses the newest decision that isn't undone; moved files and dropped clusters are left to their own commands."""
        last = review.next_undo(self.decisions.select("id", "action", "payload")).first()
        if last is None:
            return None
        if last["needs_process_undo"]:
            return {"needs_process_undo": True, "decision_id": last["id"], "action": last["action"]}
        if last["action"] == "reset_clusters":
            raise ValueError("clusters were reset; build them again")
        row = self.decisions.where(F.col("id") == last["id"]).select("id", "action", "payload")
        if last["action"] in ("reconcile_delete", "ingest_prune"):
            batch = json.loads(last["payload"]).get("batch")  # rows of older indexes have none and stand alone
            if batch:
                same = (F.col("action") == last["action"]) & (F.get_json_object("payload", "$.batch") == batch)
                row = self.decisions.where(same).select("id", "action", "payload")
            rows = row.select(F.explode(F.from_json(F.get_json_object("payload", "$.rows"), "array<string>")).alias("payload"))
            again = review.restored_deletions(rows, SCHEMAS["paths"])
            told = row.select(F.lit("undo").alias("action"), F.to_json(F.struct(F.col("id").alias("target"), F.col("action").alias("of_action"))).alias("payload"))
            self.tables.commit({"paths": again, "decisions": self._decided(told, "user")})
        else:
            back, closed, told = review.undo(row)
            self.tables.commit({"paths": review.changed_paths(self.paths, back), "clusters": review.changed_clusters(self.clusters, closed), "decisions": self._decided(told, "user"), "moves": self._canceled(last["payload"])})
        return {"undone_decision_id": last["id"], "action": last["action"]}

    def _canceled(self, payload: str) -> DataFrame:
        """A keeper that was queued with the decision leaves the queue."""
        kept = json.loads(payload).get("kept_path_id")
        mine = (F.col("path_id") == F.lit(kept)) & (F.col("status") == "pending") & (F.col("kind") == "keeper")
        return self.moves.where(mine).withColumn("status", F.lit("canceled"))

    def _decided(self, rows: DataFrame, actor: str) -> DataFrame:
        """New rows of the log of decisions."""
        base = self.tables.next_id("decisions")
        new = rows.select((F.lit(base) + F.monotonically_increasing_id()).alias("id"), F.lit(self.now()).cast("long").alias("ts"), F.lit(actor).alias("actor"), "action", "payload")
        return materialize(new, "decisions")

    def paths_as_of(self, decision_id: int) -> DataFrame:
        """The paths once a decision was made; see :mod:`cairnworks.operators.replay`."""
        return replay.paths_as_of(self.paths, self.decisions, decision_id)

    def clusters_as_of(self, decision_id: int) -> DataFrame:
        return replay.clusters_as_of(self.clusters, self.paths_as_of(decision_id), self.decisions, decision_id)

    # --- the queue of relocations

    def moving(self) -> DataFrame:
        """Moves that were begun and not finished."""
        return self.moves.where("status = 'moving'")

    def pending_for(self, path_id: int, statuses: tuple[str, ...] = ("pending", "moving", "executed")) -> DataFrame:
        return self.moves.where((F.col("path_id") == path_id) & F.col("status").isin(*statuses))

    def cancel_move(self, move_id: int) -> None:
        """A pending move leaves the queue; others are left alone."""
        self._advance(move_id, ("pending",), "canceled")

    def begin_move(self, move_id: int, src_abspath: str, final_path: str) -> None:
        """Notes where a pending move's file comes from and goes to, before the file is touched."""
        self._advance(move_id, ("pending", "moving"), "moving", src_abspath=F.lit(src_abspath), final_path=F.lit(final_path))

    def revert_move(self, move_id: int) -> None:
        """A move that was begun is pending again."""
        self._advance(move_id, ("moving",), "pending", src_abspath=F.lit(None).cast("string"))

    def _advance(self, move_id: int, states: tuple[str, ...], status: str, **columns: Column) -> None:
        mine = (F.col("id") == move_id) & F.col("status").isin(*states)
        self.tables.commit({"moves": self.moves.where(mine).withColumns(columns | {"status": F.lit(status)})})

    # --- settings and relocation

    def get_setting(self, key: str, default=None):
        row = self.settings.where(F.col("key") == key).first()
        return json.loads(row["value"]) if row else default

    def set_setting(self, key: str, value) -> None:
        if key == "destinations" and len(value) > MAX_DESTINATIONS:
            raise ValueError(f"at most {MAX_DESTINATIONS} destinations")
        self.tables.commit({"settings": self._rows("settings", [(key, json.dumps(value))])})

    def plan_moves(self) -> DataFrame:
        """What processing the queue would move where; no file is touched."""
        work = moves.pending(self.moves, self.paths, self.files, self.drives, "keeper", ("pending", "moving"))
        dups = moves.duplicates_to_move(self.paths, self.files, self.drives)
        roots = self.drives.select(F.col("id").alias("drive_id"), F.col("root_path").alias("dest_root"))
        taken = self.paths.join(roots, "drive_id").select("dest_root", F.col("path").alias("rel"))
        return moves.plan(work, dups, self.get_setting("holding_dir"), taken)

    def process(self, dry_run: bool = True, verify: bool = True) -> DataFrame:
        """Moves what the plan holds: (item, dest_root, final_rel, mtime, reason), null reason = moved.

        A dry run only plans. Refuses while a source drive can't be reached. The queue says
        ``moving`` before any file moves; moves of an interrupted run are finished by the next.
        """
        plan = materialize(self.plan_moves().join(self._sources(), "item"), "plan")
        if dry_run:
            return plan.select("item", "dest_root", "final_rel", F.lit(None).cast("long").alias("mtime"), F.lit("planned").alias("reason"))
        for r in plan.select("src_root").distinct().collect():  # a row for each drive
            if not os.path.isdir(r["src_root"]):
                raise FileNotFoundError(r["src_root"])
        queued = self.moves.where(F.col("status").isin("pending", "moving")).select(F.col("path_id").alias("item"))
        base = self.tables.next_id("moves")
        dups = plan.where("kind = 'dup'").join(queued, "item", "left_anti")
        new = dups.select((F.lit(base) + F.monotonically_increasing_id()).alias("id"), F.col("item").alias("path_id"), "hash", "kind", F.lit(None).cast("string").alias("dest_label"), "dest_root", F.lit(self.now()).alias("enqueued_at"))
        waiting = self.moves.where(F.col("status").isin("pending", "moving")).select(*new.columns)
        mine = plan.select(F.col("item").alias("path_id"), F.col("src").alias("src_abspath"), F.col("final_rel").alias("final_path"))
        queue = waiting.unionByName(new).join(mine, "path_id").withColumn("status", F.lit("moving"))
        self.tables.commit({"moves": queue})
        result = materialize(execute(plan, verify), "moved")
        self.commit_moves(result.where("reason is null").select(F.col("item").alias("path_id"), "dest_root", "final_rel", "mtime"))
        self.tables.commit({"moves": self.moving().withColumn("status", F.lit("pending"))})
        return result

    def _sources(self) -> DataFrame:
        rows = self.paths.join(self.files.select("hash", "size"), "hash").join(self.drives.select(F.col("id").alias("drive_id"), F.col("root_path").alias("src_root")), "drive_id")
        return rows.select(F.col("id").alias("item"), "hash", "size", "src_root")

    def undo_process(self) -> dict | None:
        """Moves the file of the newest relocation back and reverses it in the index."""
        last = review.last_relocation(self.decisions.select("id", "action", "payload")).first()
        if last is None:
            return None
        p = json.loads(last["payload"])
        roots = {r["id"]: r["root_path"] for r in self.drives.where(F.col("id").isin(p["src"]["drive_id"], p["dest"]["drive_id"])).collect()}
        reason = move_file(os.path.join(roots[p["dest"]["drive_id"]], p["dest"]["path"]), os.path.join(roots[p["src"]["drive_id"]], p["src"]["path"]), None, None, verify=False)
        if reason:
            raise OSError(reason)
        return self.reverse_move()

    def commit_moves(self, done: DataFrame) -> None:
        """done(path_id, dest_root, final_rel, mtime): files that were moved. Paths point to managed drives afterwards."""
        done = materialize(done, "done-moves")
        roots = [r["dest_root"] for r in done.select("dest_root").distinct().collect()]  # destinations and the holding folder
        drives = self._rows("drives", [(managed_id(r), os.path.basename(r), os.path.abspath(r), self.now(), "managed") for r in roots])
        ids = self.spark.createDataFrame([(r, managed_id(r)) for r in roots], "dest_root string, new_drive string")
        rows = self.paths.join(done.join(ids, "dest_root").select(F.col("path_id").alias("id"), "new_drive", "final_rel", F.col("mtime").alias("new_mtime")), "id")
        told = rows.select(
            F.when(F.col("status") == "active", "apply_move").otherwise("apply_remove").alias("action"),
            F.to_json(F.struct(F.col("id").alias("path_id"), F.struct("drive_id", "path", "mtime").alias("src"), F.struct(F.col("new_drive").alias("drive_id"), F.col("final_rel").alias("path")).alias("dest"))).alias("payload"),
        )
        paths = rows.withColumn("drive_id", F.coalesce("new_drive", "drive_id")).withColumn("path", F.coalesce("final_rel", "path")).withColumn("mtime", F.coalesce("new_mtime", "mtime"))
        queue = self.moves.where(F.col("status").isin("pending", "moving")).join(done.select("path_id", "final_rel"), "path_id")
        queue = queue.withColumn("final_path", F.col("final_rel")).withColumn("status", F.lit("executed"))
        self.tables.commit({"paths": paths, "drives": drives, "moves": queue, "decisions": self._decided(told, "user")})

    def reverse_move(self, real_path: str | None = None) -> dict | None:
        """The index side of undoing the newest relocation; ``real_path`` is where the file went back to."""
        last = review.last_relocation(self.decisions.select("id", "action", "payload")).first()
        if last is None:
            return None
        p = json.loads(last["payload"])
        mine = F.col("id") == p["path_id"]
        back = {"drive_id": p["src"]["drive_id"], "path": real_path or p["src"]["path"], "mtime": p["src"]["mtime"]}
        paths = self.paths.where(mine).withColumns({c: F.lit(v) for c, v in back.items()})
        queue = self.moves.where((F.col("path_id") == p["path_id"]) & (F.col("status") == "executed")).withColumn("status", F.lit("pending"))
        told = self.spark.createDataFrame([("undo", json.dumps({"target": last["id"], "of_action": last["action"]}))], "action string, payload string")
        self.tables.commit({"paths": paths, "moves": queue, "decisions": self._decided(told, "user")})
        return {"reversed_decision_id": last["id"], "action": last["action"], **back}

    # --- upkeep

    def compact(self, vacuum: bool = False) -> dict[str, list[int]]:
        """Works the logs of changes into the tables: the buckets rewritten, by table. ``vacuum`` also deletes what no longer counts."""
        done = {name: touched for name in SCHEMAS if name in self.tables.versions and (touched := self.tables.compact(name))}
        if vacuum:
            self.tables.vacuum()
        return done

    def _rows(self, table: str, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, SCHEMAS[table])
