"""What goes wrong outside: crashes between writes, missing snapshots, folders that can't be read, values with #."""

from __future__ import annotations

import os
import random
from collections import Counter

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from cairnworks.index import Index
from cairnworks.operators import moves, near, running
from cairnworks.plans.catalogue import QUERIES
from cairnworks.scratch import materialize
from cairnworks.settings import load_env
from cairnworks.sources.snapshots import Snapshots
from cairnworks.sources.treewalk import TreeReader
from cairnworks.streaming.ingest import FILES, _read

SF = "/root/testdata/sf0.001"


def test_a_value_may_hold_a_hash_sign(tmp_path, monkeypatch):
    for key in ("CW_X", "CW_Y", "CW_Z"):
        monkeypatch.setenv(key, "")
        monkeypatch.delenv(key)
    (tmp_path / ".env").write_text("CW_X=a#b\nCW_Y=a#b # note\nCW_Z='q # r' # note\n")
    assert load_env(str(tmp_path / ".env")) == {"CW_X": "a#b", "CW_Y": "a#b", "CW_Z": "q # r"}


def test_pointers_are_never_replaced(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    assert store.versions == {}
    for k in range(4):
        store.commit(settings=spark.createDataFrame([("k", str(k))], "key string, value string"))
        assert Snapshots(spark, str(tmp_path)).table("settings").first()["value"] == str(k)
    names = sorted(n for n in os.listdir(tmp_path) if n.startswith("CURRENT"))
    assert names == ["CURRENT-000000000003.json", "CURRENT-000000000004.json"]
    # a writer that dies before its pointer is there leaves the last one in force
    (tmp_path / ".CURRENT-half").write_text("{")
    assert Snapshots(spark, str(tmp_path)).table("settings").first()["value"] == "3"
    late = Snapshots(spark, str(tmp_path))
    late._pointers = lambda: [(3, "x")]  # has not seen the fourth
    with pytest.raises(FileExistsError):
        late.commit(settings=spark.createDataFrame([("k", "late")], "key string, value string"))
    assert Snapshots(spark, str(tmp_path)).table("settings").first()["value"] == "3"


def test_only_the_first_batch_starts_without_a_snapshot(spark, tmp_path):
    assert _read(spark, str(tmp_path), "files", -1, FILES).count() == 0
    with pytest.raises(AnalysisException):
        _read(spark, str(tmp_path), "files", 0, FILES).count()


def test_what_cannot_be_read_is_a_row_with_an_error(tmp_path, monkeypatch):
    for folder in ("a", "b", "b/c"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "f.txt").write_text("x")
    real = os.scandir

    def scandir(path):
        if str(path).endswith("/c"):
            raise PermissionError("no")
        return real(path)

    monkeypatch.setattr(os, "scandir", scandir)
    reader = TreeReader(str(tmp_path), [])
    rows = [r for part in reader.partitions() for r in reader.read(part)]
    assert {r[0] for r in rows if r[6] is None} == {"a/f.txt", "b/f.txt"} and [r[0] for r in rows if r[6]] == ["b/c"]


def test_unreadable_folders_put_a_prune_off(spark, tmp_path, monkeypatch):
    from cairnworks import index as index_module
    from cairnworks.index import Index

    root = tmp_path / "disk"
    (root / "sub").mkdir(parents=True)
    (root / "sub" / "f.txt").write_text("x")
    index = Index(spark, str(tmp_path / "index"))
    index.ingest(str(root))
    real = index_module.walk

    def walk(spark, path, managed=None, errors=False):
        rows = real(spark, path, managed, errors=True).withColumn("error", F.lit("no")).withColumn("path", F.lit("sub"))
        return rows if errors else rows.limit(0).drop("error")

    monkeypatch.setattr(index_module, "walk", walk)
    out = index.ingest(str(root), prune=True)
    assert out["errors"] == 1 and out["pruned"] == 0 and index.paths.count() == 1
    index.reconcile()
    assert index.paths.count() == 1


def test_free_names_of_many_copies(spark):
    taken = {"a (3).txt", "a (4).txt", "a.txt", "b (2).txt", "a (1).txt"}
    items = [(i, "/d", "a.txt") for i in range(400)] + [(900 + i, "/d", "b.txt") for i in range(3)] + [(990, "/d", "a (6).txt")]
    got = moves.free_names(spark.createDataFrame(items, "item long, dest_root string, rel string"), spark.createDataFrame([("/d", x) for x in taken], "dest_root string, rel string"))
    got = {r["item"]: r["final_rel"] for r in got.collect()}
    free = [f"a ({n}).txt" for n in range(2, 420) if n not in (3, 4, 6)]
    assert [got[i] for i in range(400)] == free[:400] and got[990] == "a (6).txt"
    assert [got[900 + i] for i in range(3)] == ["b.txt", "b (3).txt", "b (4).txt"]
    assert max(Counter(got.values()).values()) == 1


def test_free_names_equal_a_greedy_walk_where_one_name_has_most_rows(spark):
    chance = random.Random(5)
    names = ["hot.txt"] * 6 + ["x/cold.md", "bare", "hot (3).txt", "hot (7).txt"]
    items = [(i, chance.choice(["/d", "/e"]), chance.choice(names)) for i in range(600)]
    taken = {("/d", f"hot ({n}).txt") for n in range(40, 300)} | {("/d", "hot.txt"), ("/e", "bare"), ("/e", "bare (2)"), ("/e", "x/cold (1).md")}
    left, want, planned = {}, {}, taken | {(d, x) for _, d, x in items}
    for i, d, x in items:  # in order of item
        stem, dot, end = x.rpartition(".") if "." in x else (x, "", "")
        n = left.get((d, x), 1)
        while (n == 1 and (d, x) in taken) or (n > 1 and (d, f"{stem} ({n}){dot}{end}") in planned):
            n += 1
        left[d, x], want[i] = n + 1, x if n == 1 else f"{stem} ({n}){dot}{end}"
    chance.shuffle(items)
    got = moves.free_names(spark.createDataFrame(items, "item long, dest_root string, rel string"), spark.createDataFrame(sorted(taken), "dest_root string, rel string"))
    assert {r["item"]: r["final_rel"] for r in got.collect()} == want
    empty = spark.createDataFrame([], "item long, dest_root string, rel string")
    assert moves.free_names(empty, spark.createDataFrame(sorted(taken), "dest_root string, rel string")).count() == 0


def test_running_sums_carry_over_between_tasks(spark, monkeypatch):
    rows = [(None if i % 3 else i % 5, i, i % 7) for i in range(3000)]
    seen = []

    def spy(df, name):
        seen.append(materialize(df, name))
        return seen[-1]

    monkeypatch.setattr(running, "materialize", spy)
    got = running.running_sum(spark.createDataFrame(rows, "k int, i long, v long").repartition(3), ["k"], ["i"], F.col("v"), "s").collect()
    totals, want = Counter(), {}
    for k, i, v in rows:
        totals[k] += v
        want[i] = totals[k]
    assert {r["i"]: r["s"] for r in got} == want
    shares = [r["count"] for r in seen[0].groupBy("stretch").count().collect()]  # the null key has two thirds of all rows
    assert len(shares) == 4 and max(shares) < 2 * sorted(shares)[1]


def test_all_orders_link_what_union_find_links(spark):
    rows = [(r["o_custkey"], -(r["o_orderkey"] % 977) - 1) for r in spark.read.parquet(f"{SF}/orders.parquet").collect()]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in rows:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in QUERIES["g1_order_components"](spark, SF).collect()}
    assert got == {x: find(x) for x in parent}


def test_image_clusters_of_any_size(spark):
    rows = [(f"h{i:03d}", (0x0F0F0F0F0F0F0F0F), "wide") for i in range(250)]
    signatures = spark.createDataFrame(rows, "hash string, sig long, aspect string")
    none = signatures.limit(0).select("hash")
    assert near.image_clusters(signatures, none).count() == 0 and near.image_clusters(signatures, none, most=None).count() == 250


def _moves(index: Index, *states: str):
    rows = [(i, i, "h", "keeper", None, "/d", None, None, 1, s) for i, s in enumerate(states, 1)]
    index.tables.commit(moves=index._rows("moves", rows))


def test_moves_advance_and_go_back(spark, tmp_path):
    index = Index(spark, str(tmp_path))
    _moves(index, "pending", "pending", "executed")
    index.begin_move(1, "/s/a", "a")
    index.cancel_move(1)  # begun: stays
    index.cancel_move(2)
    index.cancel_move(3)
    index.revert_move(3)
    assert [(r["id"], r["src_abspath"], r["final_path"]) for r in index.moving().collect()] == [(1, "/s/a", "a")]
    assert {r["id"]: r["status"] for r in index.moves.collect()} == {1: "moving", 2: "canceled", 3: "executed"}
    index.revert_move(1)
    assert index.moving().count() == 0
    assert [(r["status"], r["src_abspath"], r["final_path"]) for r in index.pending_for(1).collect()] == [("pending", None, "a")]
    assert index.pending_for(2).count() == 0 and index.pending_for(3).count() == 1


def test_many_deleted_paths_come_back_at_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("cairnworks.index.DELETED_A_ROW", 10)
    index = Index(spark, str(tmp_path))
    rows = [(i, f"h{i}", "d", f"p{i}", 1, 1, 1, "active") for i in range(60)]
    index.tables.commit(paths=index._rows("paths", rows))
    before = sorted(index.paths.collect())
    assert index._delete(index.paths.where("id < 50").select("id"), "ingest_prune") == 50
    told = index.decisions.where("action = 'ingest_prune'").count()
    assert 1 < told <= 5 and index.paths.count() == 10
    assert index._delete(index.paths.where("id = 55").select("id"), "ingest_prune") == 1
    assert index.undo()["action"] == "ingest_prune" and index.paths.count() == 10
    assert index.undo()["action"] == "ingest_prune" and sorted(index.paths.collect()) == before
    assert index.undo() is None


def test_images_are_signed_by_the_cluster_pass(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    pixels = [(i * 37) % 251 for i in range(72)]
    for name, shift in (("a.png", 0), ("b.png", 1), ("c.png", 0)):
        (root / name).write_bytes(bytes(p + shift for p in pixels) + name.encode())
    (root / "bad.png").write_bytes(b"no image")

    def decode(content):
        if len(content) < 72:
            raise ValueError("no image")
        return list(content[:72]), 640, 480

    index = Index(spark, str(tmp_path / "index"), decoder=decode)
    index.ingest(str(root))
    assert index.cluster()["near_image"] == 1
    signed = index.signatures.where("algo = 'phash_image'").collect()
    assert len(signed) == 3 and {(r["w"], r["h"]) for r in signed} == {(640, 480)}
    assert index.cluster()["near_image"] == 0
    # a signature without dimensions is made again
    index.add_image_signatures(index.signatures.where("algo = 'phash_image'").withColumn("w", F.lit(None)))
    index.cluster()
    assert {r["w"] for r in index.signatures.where("algo = 'phash_image'").collect()} == {640}


def test_large_image_components_are_told_and_can_be_kept(spark, tmp_path):
    index = Index(spark, str(tmp_path))
    index.tables.commit(paths=index._rows("paths", [(i, f"h{i}", "d", f"p{i}", 1, 1, 1, "active") for i in range(6)]), files=index._rows("files", [(f"h{i}", 1, "image/png", 1) for i in range(6)]))
    index.add_image_signatures(spark.createDataFrame([(f"h{i}", 0x0F0F0F0F0F0F0F0F if i < 4 else 0x3333333333333333, 64, 48) for i in range(6)], "hash string, sig long, w int, h int"))
    assert [(r["component"], r["n"]) for r in index.oversize_images(3).collect()] == [("h0", 4)]
    assert index.cluster(most_images=3)["near_image"] == 1 and index.cluster(most_images=None)["near_image"] == 1
    assert index.oversize_images().count() == 0 and index.members.count() == 6


def test_a_name_taken_at_the_last_moment_is_left_alone(tmp_path, monkeypatch):
    from cairnworks.sources import relocate

    src, dst = tmp_path / "a", tmp_path / "out/b"
    src.write_text("mine")
    real = os.makedirs

    def late(path, exist_ok):
        real(path, exist_ok=exist_ok)
        dst.write_text("theirs")

    with monkeypatch.context() as m:
        m.setattr(os, "makedirs", late)
        assert relocate.move_file(str(src), str(dst), None, None, False) == "destination already exists"
    assert (src.read_text(), dst.read_text()) == ("mine", "theirs")
    dst.unlink()
    # volumes without hard links, and others
    no = lambda *a: (_ for _ in ()).throw(OSError("no"))
    monkeypatch.setattr(os, "link", no)
    assert relocate.move_file(str(src), str(dst), None, None, False) is None and dst.read_text() == "mine" and not src.exists()
    src.write_text("more")
    dst.unlink()
    replace = os.replace
    monkeypatch.setattr(os, "replace", lambda a, b: replace(a, b) if a.endswith(".part") else no())
    assert relocate.move_file(str(src), str(dst), None, None, False) is None and dst.read_text() == "more" and os.listdir(tmp_path) == ["out"]
    # an attempt that died between the two names
    monkeypatch.undo()
    os.link(dst, src)
    assert relocate.move_file(str(src), str(dst), None, None, False) is None and not src.exists() and dst.read_text() == "more"
