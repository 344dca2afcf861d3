"""The archive as of any decision: undos of undos, deletions, moves; against stepwise replay and against the index's own past."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from cairnworks.index import Index
from cairnworks.operators import replay

LOG = "id long, action string, payload string"


def log(spark, rows):
    return spark.createDataFrame([(i, a, json.dumps(p)) for i, a, p in rows], LOG)


def test_chains_of_undos_cancel_by_parity(spark):
    rows = [(1, "resolve_keep", {}), (2, "resolve_keep", {}), (3, "undo", {"target": 1}), (4, "undo", {"target": 3}), (5, "undo", {"target": 4}), (6, "undo", {"target": 2}), (7, "undo", {"target": 6}), (8, "undo", {"target": 6}), (9, "undo", {"target": 99}), (10, "undo", {})]
    df = log(spark, rows)
    want = {3: {2}, 4: {1, 2}, 6: set(), 10: {2}}
    for at, live in want.items():
        assert {r["id"] for r in replay.in_force(df, at).collect()} == live, at
    chain = [(0, "restore", {})] + [(i, "undo", {"target": i - 1}) for i in range(1, 200)]
    assert [replay.in_force(log(spark, chain), n).count() for n in (2, 101, 199)] == [1, 0, 0]
    assert replay.in_force(df.limit(0)).count() == 0


def slow_live(rows, at):
    """Decisions in force, from the newest back: an undo that is in force takes its target out."""
    kept, used = {}, set()
    for i, a, p in rows:
        if a == "undo" and p["target"] not in used and i <= at:
            used.add(p["target"])
            kept[i] = p["target"]
    off = set()
    for i in sorted(kept, reverse=True):
        if i not in off:
            off.add(kept[i])
    return [(i, a, p) for i, a, p in rows if i <= at and a != "undo" and i not in off]


def test_random_logs_replay_step_by_step(spark):
    r = random.Random(6)
    start = {i: ("active", "d", f"p{i}") for i in range(12)}
    rows = []
    for i in range(1, 70):
        kind = r.choice(["keep", "keep", "restore", "move", "undo"])
        p = r.randrange(12)
        if kind == "undo" and rows:
            rows.append((i, "undo", {"target": r.randrange(max(0, i - 6), i)}))
        elif kind == "restore":
            rows.append((i, "restore", {"path_id": p, "reopened": []}))
        elif kind == "move":
            rows.append((i, "apply_move", {"path_id": p, "src": {"drive_id": "d", "path": f"p{p}"}, "dest": {"drive_id": "m", "path": f"q{i}"}}))
        else:
            rows.append((i, "purge_all", {"cluster_id": "c", "purged": [{"id": p, "prev_status": "active"}]}))
    for at in (20, 69):
        now = dict(start)
        for i, a, p in slow_live(rows, at):
            if a == "restore":
                now[p["path_id"]] = ("active", *now[p["path_id"]][1:])
            elif a == "apply_move":
                now[p["path_id"]] = (now[p["path_id"]][0], "m", f"q{i}")
            else:
                now[p["purged"][0]["id"]] = ("purgatory", *now[p["purged"][0]["id"]][1:])
        firsts = {}
        for _, a, p in rows:  # before any decision a restored path lay in purgatory
            if a == "restore":
                firsts.setdefault(p["path_id"], "purgatory")
            elif a == "purge_all":
                firsts.setdefault(p["purged"][0]["id"], "active")
        touched = {p.get("path_id", (p.get("purged") or [{}])[0].get("id")) for _, a, p in slow_live(rows, at) if a in ("restore", "purge_all")}
        now = {k: (v[0] if k in touched else firsts.get(k, "active"), *v[1:]) for k, v in now.items()}
        paths = spark.createDataFrame([(k, "h", "d", f"p{k}", "active") for k in start], "id long, hash string, drive_id string, path string, status string")
        got = {x["id"]: (x["status"], x["drive_id"], x["path"]) for x in replay.paths_as_of(paths, log(spark, rows), at).collect()}
        assert got == now, at


def test_the_index_remembers_its_past(spark, tmp_path):
    index = Index(spark, str(tmp_path), now=lambda: 5)
    index.tables.commit(
        paths=index._rows("paths", [(i, f"h{i // 3}", "d", f"p{i}", 1, 1, 1, "active") for i in range(9)]),
        members=index._rows("members", [(f"c{k}", f"h{k}", 1.0) for k in range(3)]),
        clusters=index._rows("clusters", [(f"c{k}", "exact", None, None, 1, "open") for k in range(3)]),
        drives=index._rows("drives", [("d", "d", "/d", 1, "scanned")]),
    )
    shot = lambda: (sorted(map(tuple, index.paths.select("id", "hash", "drive_id", "path", "status").collect())), sorted(map(tuple, index.clusters.select("id", "canonical_hash", "status").collect())))
    past = {0: shot()}
    last = lambda: index.decisions.agg(F.max("id")).first()[0]
    for act in (lambda: index.keep("c0", 1), lambda: index.purge_all("c1"), lambda: index.restore(4), index.undo, lambda: index._delete(index.paths.where("id = 8").select("id"), "ingest_prune"), lambda: index.keep("c2", 6), index.undo):
        act()
        past[last()] = shot()
    assert len({json.dumps(s) for s in past.values()}) >= 6
    for at, (paths, clusters) in past.items():
        assert sorted(map(tuple, index.paths_as_of(at).collect())) == paths, at
        assert sorted(map(tuple, index.clusters_as_of(at).collect()), key=repr) == sorted(clusters, key=repr), at
