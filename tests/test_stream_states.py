"""Keyed state of the stream of observations: order, repeats, staleness, restarts."""

from __future__ import annotations

import json
import random

from cairnworks.sources.snapshots import Snapshots
from cairnworks.streaming import states

SCHEMA = "drive_id string, path string, hash string, size long, mime string, mtime long, observed_at long"
DAY = 86_400


def write(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps(dict(zip([x.split()[0] for x in SCHEMA.split(", ")], r, strict=True))) for r in rows) + "\n")


def run(spark, tmp_path, stale_after):
    """One pass over the files that are there; commits of the store afterwards."""
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = states.follow(rows, str(tmp_path / "store"), str(tmp_path / "checkpoint"), stale_after, "2 days")
    query.awaitTermination()
    return Snapshots(spark, str(tmp_path / "store"))


def test_stream_equals_batch_over_restarts_and_repeats(spark, tmp_path):
    r = random.Random(1)
    (tmp_path / "in").mkdir()
    rows = [(f"d{i % 2}", f"p{i % 25}", f"h{r.randrange(9)}", r.randrange(99), r.choice(["a/b", None]), 5, 10 * DAY + r.randrange(DAY)) for i in range(120)]
    rows += [("d0", "p0", "tie", 1, None, 1, rows[0][6]), (None, "x", "h", 1, None, 1, 10 * DAY), ("d0", None, "h", 1, None, 1, 10 * DAY)]
    r.shuffle(rows)
    for k in range(2):
        write(tmp_path / "in", f"a{k}.json", rows[k::3] + rows[k::9])  # some come twice
    before = spark.conf.get(states._PROVIDER[0])
    first = run(spark, tmp_path, 90 * DAY)
    assert spark.conf.get(states._PROVIDER[0]) == before
    seen = spark.createDataFrame([x for k in range(2) for x in rows[k::3]], SCHEMA)
    cols = first.table("observed").columns
    table = lambda df: sorted(map(tuple, df.select(*cols).collect()), key=repr)
    assert table(first.table("observed")) == table(states.observed_paths(seen, 90 * DAY))
    # a restart goes on from the checkpoint: only what the new file changes is written
    write(tmp_path / "in", "b.json", rows[2::3])
    second = run(spark, tmp_path, 90 * DAY)
    whole = states.observed_paths(spark.createDataFrame(rows, SCHEMA), 90 * DAY)
    assert table(second.table("observed")) == table(whole) and whole.count() == 50
    pieces = second.versions["observed"]["log"]
    assert pieces[-1]["rows"] < 50
    # nothing new, nothing written
    assert run(spark, tmp_path, 90 * DAY).versions["observed"] == second.versions["observed"]


def test_paths_not_seen_again_are_gone(spark, tmp_path):
    (tmp_path / "in").mkdir()
    see = lambda path, day: ("d", path, "h", 1, None, 1, day * DAY)
    write(tmp_path / "in", "a.json", [see("old", 10), see("kept", 10), see("back", 10)])
    write(tmp_path / "in", "b.json", [see("kept", 14), see("new", 20)])
    store = run(spark, tmp_path, 5 * DAY)
    assert {r["path"] for r in store.table("observed").collect()} <= {"old", "kept", "back", "new"}
    write(tmp_path / "in", "c.json", [see("back", 30), see("new", 30)])
    write(tmp_path / "in", "d.json", [see("new", 31)])
    store = run(spark, tmp_path, 5 * DAY)
    got = {r["path"]: r["observed_at"] // DAY for r in store.table("observed").collect()}
    assert got == {"back": 30, "new": 31}


def test_a_batch_that_runs_again_writes_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in", "a.json", [("d", "p", "h", 1, None, 1, 10)])
    store = run(spark, tmp_path, DAY)
    # as after a crash between the store's commit and the stream's own note of it
    for kind in ("commits", "offsets"):
        assert (tmp_path / "checkpoint" / kind).is_dir()
    newest = max(int(p.name) for p in (tmp_path / "checkpoint/commits").iterdir() if p.name.isdigit())
    for p in (tmp_path / "checkpoint/commits").iterdir():
        if str(newest) in p.name:
            p.unlink()
    again = run(spark, tmp_path, DAY)
    assert again.versions["observed"] == store.versions["observed"] and again.table("observed").count() == 1
