"""A messy tree from end to end, through the index."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cairnworks.index import Index, chat_url
from cairnworks.settings import load_env


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    r = random.Random(42)
    words = [f"word{i}" for i in range(400)]
    text = [r.choice(words) for _ in range(600)]
    for name, edits in (("notes_v1.md", 0), ("notes_v2.md", 6), ("notes_final.md", 6)):
        for _ in range(edits):
            text[r.randrange(len(text))] = r.choice(words)
        (root / "kitchen").mkdir(exist_ok=True)
        (root / "kitchen" / name).write_text("# Kitchen Reno\n\n" + " ".join(text))
    (root / "other").mkdir()
    (root / "other/copy of notes.md").write_bytes((root / "kitchen/notes_v1.md").read_bytes())
    for i in range(6):
        (root / f"other/file_{i:03d}.txt").write_text(" ".join(r.choice(words) for _ in range(200)))
    for i in range(3):
        (root / f"empty{i}.tmp").write_bytes(b"")
    return root


def test_from_ingest_to_undo(spark, tree, tmp_path):
    clock = iter(range(1000, 9000, 10))
    index = Index(spark, str(tmp_path / "index"), now=lambda: next(clock))
    first = index.ingest(str(tree), "disk")
    assert (first["hashed"], first["skipped"], first["errors"]) == (13, 0, 0)
    again = index.ingest(str(tree))
    assert (again["hashed"], again["skipped"]) == (0, 13) and again["drive_id"] == first["drive_id"]
    assert index.drives.first()["label"] == "disk"

    assert index.cluster() == {"exact": 1, "doc_version": 1, "near_image": 0}
    assert index.cluster() == {"exact": 0, "doc_version": 0, "near_image": 0}
    assert index.topics() == {"tagged": 3, "skipped": 6, "clusters": 1} and index.topics()["clusters"] == 0
    versions = index.clusters.where("kind = 'doc_version'").first()
    assert index.detail(versions["id"]).count() == 3
    row = index.overview().first()
    assert (row["clusters_unresolved"], row["clusters_dedup_open"], row["topic_clusters"]) == (3, 2, 1)

    before = sorted(index.paths.select("id", "status").collect())
    exact = index.clusters.where("kind = 'exact'").first()["id"]
    keeper = index.paths.where("path like 'kitchen/%v1%'").first()["id"]
    with pytest.raises(ValueError):
        index.keep(exact, index.paths.where("path like '%000%'").first()["id"])
    index.keep(exact, keeper, dest_root=str(tmp_path / "dest"))
    assert [r["path"] for r in index.purgatory().collect()] == ["other/copy of notes.md"]
    assert index.stats().first()["paths_purgatory"] == 1 and index.queue().where(F.col("id") == exact).count() == 0
    index.set_setting("holding_dir", str(tmp_path / "hold"))
    plan = {r["kind"]: r["final_rel"] for r in index.plan_moves().collect()}
    assert plan == {"keeper": "kitchen/notes_v1.md", "dup": "other/copy of notes.md"}

    lost = index.paths.where("status = 'purgatory'").first()["id"]
    index.restore(lost)
    assert index.clusters.where(F.col("id") == exact).first()["status"] == "open"
    assert index.undo()["action"] == "restore" and index.undo()["action"] == "resolve_keep" and index.undo() is None
    assert sorted(index.paths.select("id", "status").collect()) == before
    assert index.moves.first()["status"] == "canceled"

    index.keep(exact, keeper, dest_root=str(tmp_path / "dest"))
    done = index.plan_moves().where("kind = 'keeper'").select(F.col("item").alias("path_id"), "dest_root", "final_rel", F.lit(7).cast("long").alias("mtime"))
    index.commit_moves(done)
    assert index.paths.where(F.col("id") == keeper).first()["drive_id"].startswith("managed:")
    assert index.undo()["needs_process_undo"]
    assert index.reverse_move()["path"] == "kitchen/notes_v1.md" and index.moves.where("status = 'pending'").count() == 1

    planned = index.process()
    assert planned.count() == 2 and (tree / "kitchen/notes_v1.md").exists()
    (tmp_path / "dest/kitchen").mkdir(parents=True)
    (tree / "kitchen/notes_v1.md").rename(tmp_path / "dest/kitchen/notes_v1.md")  # as a crash after the move leaves it
    moved = index.process(dry_run=False)
    assert moved.where("reason is null").count() == 2
    assert (tmp_path / "hold/other/copy of notes.md").exists() and (tmp_path / "dest/kitchen/notes_v1.md").exists()
    assert {r["status"] for r in index.moves.where("kind = 'dup'").collect()} == {"executed"}
    with pytest.raises(ValueError):
        index.restore(index.paths.where("status = 'purgatory'").first()["id"])
    assert index.undo_process() and index.undo_process() and index.undo_process() is None
    assert (tree / "kitchen/notes_v1.md").exists() and (tree / "other/copy of notes.md").exists()

    (tree / "empty0.tmp").unlink()
    report = index.reconcile(dry_run=True).where("not skipped_managed").first()
    assert (report["missing"], report["sample"]) == (1, ["empty0.tmp"]) and index.paths.count() == 13
    assert index.ingest(str(tree), prune=True)["pruned"] == 1 and index.paths.count() == 12
    assert index.undo()["action"] == "ingest_prune" and index.paths.count() == 13
    assert index.reset_clusters("doc_version") == 1 and index.cluster()["doc_version"] == 1
    assert [r["path"] for r in index.search("NOTES_v2").collect()] == ["kitchen/notes_v2.md"]
    assert Index(spark, str(tmp_path / "index")).paths.count() == 13


def test_environment_files(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# c\nexport CW_A=1\nCW_B=\"x # y\"\nCW_C=z # note\nCW_D=\nbad line\n")
    monkeypatch.setenv("CW_A", "kept")
    for key in ("CW_B", "CW_C", "CW_D"):
        monkeypatch.setenv(key, "")
        monkeypatch.delenv(key)
    assert load_env(str(tmp_path / ".env")) == {"CW_B": "x # y", "CW_C": "z", "CW_D": ""} and load_env(str(tmp_path / "none")) == {}


def test_chat_urls():
    assert [chat_url(x) for x in ("localhost:1234", "http://h/v1/", "https://h/api")] == ["http://localhost:1234/v1", "http://h/v1", "https://h/api/v1"]
