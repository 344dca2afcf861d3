"""Merge on read: what is written, what readers see, compaction and crashes."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from cairnworks.index import Index
from cairnworks.sources import snapshots
from cairnworks.sources.snapshots import SCHEMAS, Snapshots


def bytes_below(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def settings(spark, rows):
    return spark.createDataFrame(list(rows.items()), SCHEMAS["settings"])


def read(store, name="settings"):
    return dict(map(tuple, store.table(name).collect()))


def test_a_decision_on_a_large_index_writes_little(spark, tmp_path):
    """Three million paths in pairs of equal hashes; the limit is a megabyte whatever their number."""
    n = 3_000_000
    index = Index(spark, str(tmp_path), now=lambda: 5)
    i = F.col("id")
    name = F.concat(F.lit("h"), (i / 2).cast("long"))
    paths = spark.range(n).select("id", name.alias("hash"), F.lit("d").alias("drive_id"), F.concat(F.lit("some/folder/file_"), "id").alias("path"), i.alias("mtime"), i.alias("ctime"), i.alias("observed_at"), F.lit("active").alias("status"))
    some = spark.range(1000).select(F.concat(F.lit("c"), "id").alias("cluster_id"), F.concat(F.lit("h"), "id").alias("hash"), F.lit(1.0).alias("confidence"))
    index.tables.commit(paths=paths, members=some, clusters=some.select(F.col("cluster_id").alias("id"), F.lit("exact").alias("kind"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("canonical_hash"), F.lit(1).alias("created_at"), F.lit("open").alias("status")))
    entry = index.tables.versions["paths"]
    assert entry["buckets"] == 16 and entry["rows"] == n and entry["top"] == n - 1
    before = bytes_below(tmp_path)
    index.keep("c7", 14)
    assert before > 20 << 20 and bytes_below(tmp_path) - before < 1 << 20
    assert index.paths.where("status = 'purgatory'").select("id").collect() == [(15,)]
    assert index.undo()["action"] == "resolve_keep" and index.paths.where("status != 'active'").count() == 0
    assert bytes_below(tmp_path) - before < 1 << 20
    # only the buckets of the two changed paths are rewritten
    touched = index.tables.compact("paths")
    assert len(touched) == 1 and not index.tables.versions["paths"]["log"]
    assert index.paths.count() == n and index.paths.where("status != 'active'").count() == 0
    index.tables.vacuum()
    assert index.paths.where("id = 15").first()["status"] == "active"


def test_readers_see_the_fold_of_all_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "BUCKET_ROWS", 20)
    monkeypatch.setattr(snapshots, "MOST_PIECES", 5)
    r, want = random.Random(4), {f"k{i}": "0" for i in range(90)}
    store = Snapshots(spark, str(tmp_path))
    store.commit(settings=settings(spark, want))
    assert store.versions["settings"]["buckets"] == 8
    pieces = []
    for step in range(1, 15):
        puts = {f"k{r.randrange(140)}": str(step) for _ in range(r.randrange(1, 6))}
        gone = {f"k{r.randrange(140)}" for _ in range(3)}
        store.commit({"settings": settings(spark, puts)}, {"settings": spark.createDataFrame([(k,) for k in gone], "key string")})
        want = {k: v for k, v in want.items() if k not in gone} | puts
        pieces.append(len(store.versions["settings"]["log"]))
        if step % 3 == 0:
            monkeypatch.setattr(snapshots, "BROADCAST_BYTES", (4 << 20) * (step % 2))
            assert read(store) == read(Snapshots(spark, str(tmp_path))) == want
    assert max(pieces) <= 5 and 0 in pieces  # compacted on the way
    store.compact("settings")
    assert read(store) == want and not store.compact("settings")
    monkeypatch.setattr(snapshots, "BROADCAST_BYTES", 4 << 20)
    # a table that only ever had changes is laid out by its first compaction
    store.commit({"tags": spark.createDataFrame([("h", "k", "v", "s", 1.0)], SCHEMAS["tags"])})
    assert store.table("tags").count() == 1 and store.compact("tags") and store.table("tags").first()["value"] == "v"
    before = set(os.listdir(tmp_path / "settings"))
    gone = store.vacuum()
    assert gone and set(os.listdir(tmp_path / "settings")) < before and read(store) == read(Snapshots(spark, str(tmp_path))) == want


def test_a_table_that_outgrew_its_buckets_is_laid_out_anew(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "BUCKET_ROWS", 5)
    store = Snapshots(spark, str(tmp_path))
    store.commit(settings=settings(spark, {"a": "1", "b": "2"}))
    assert store.versions["settings"]["buckets"] == 1
    more = {f"k{i}": "x" for i in range(60)}
    store.commit({"settings": settings(spark, more)})
    store.compact("settings")
    assert store.versions["settings"]["buckets"] == 16 and read(store) == more | {"a": "1", "b": "2"}


@pytest.mark.parametrize("where", ["_write_buckets", "_point"])
def test_a_compaction_that_dies_changes_nothing(spark, tmp_path, monkeypatch, where):
    store = Snapshots(spark, str(tmp_path))
    store.commit(settings=settings(spark, {"a": "1", "b": "2"}))
    store.commit({"settings": settings(spark, {"b": "3"})}, {"settings": spark.createDataFrame([("a",)], "key string")})
    real = getattr(Snapshots, where)

    def die(self, *args):
        if where == "_write_buckets":
            real(self, *args)
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Snapshots, where, die)
        with pytest.raises(KeyboardInterrupt):
            store.compact("settings")
    again = Snapshots(spark, str(tmp_path))
    assert read(again) == {"b": "3"} and len(again.versions["settings"]["log"]) == 1
    assert again.compact("settings") == [0] and read(again) == {"b": "3"}
    assert again.vacuum() and read(Snapshots(spark, str(tmp_path))) == {"b": "3"}  # what the dead one left goes


def test_changes_of_nothing_leave_no_piece_and_ids_never_return(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    rows = spark.createDataFrame([(4, 1, "user", "a", "{}")], SCHEMAS["decisions"])
    store.commit({"decisions": rows, "settings": settings(spark, {"x": "1"}).limit(0)})
    assert "settings" not in store.versions and store.next_id("decisions") == 5
    store.commit(None, {"decisions": rows.select("id")})
    assert store.table("decisions").count() == 0 and Snapshots(spark, str(tmp_path)).next_id("decisions") == 5


def test_indexes_of_older_layouts_are_read_and_changed(spark, tmp_path):
    old = spark.createDataFrame([(1, "h", "d", "p", 1, 1, 1), (2, "h", "d", "q", 1, 1, 1)], "id long, hash string, drive_id string, path string, mtime long, ctime long, observed_at long")
    old.write.parquet(str(tmp_path / "paths/v-old"))
    (tmp_path / "CURRENT.json").write_text('{"paths": "v-old"}')
    store = Snapshots(spark, str(tmp_path))
    assert store.next_id("paths") == 3 and {r["status"] for r in store.table("paths").collect()} == {"active"}
    store.commit({"paths": store.table("paths").where("id = 2").withColumn("status", F.lit("purgatory"))})
    states = {1: "active", 2: "purgatory"}
    assert {r["id"]: r["status"] for r in Snapshots(spark, str(tmp_path)).table("paths").collect()} == states
    store.compact("paths")
    assert {r["id"]: r["status"] for r in Snapshots(spark, str(tmp_path)).table("paths").collect()} == states
