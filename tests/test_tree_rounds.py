"""Trees are walked in rounds that all tasks share."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from cairnworks.sources import treewalk
from cairnworks.sources.treewalk import Tree


@pytest.fixture(scope="module")
def deep(tmp_path_factory):
    """Everything lies below one folder: a chain of twelve, and forty folders at its end."""
    root = tmp_path_factory.mktemp("deep")
    at = root.joinpath(*[f"d{k}" for k in range(12)])
    for k in range(40):
        (at / f"leaf{k}" / "x").mkdir(parents=True)
        for n in range(5):
            (at / f"leaf{k}" / "x" / f"f{n}.txt").write_text("x" * n)
    (at / "empty").mkdir()
    os.symlink(at / "leaf0", root / "to_folder")
    return root


def plain(root):
    found = set()
    for folder, _, names in os.walk(root):
        found |= {os.path.relpath(os.path.join(folder, n), root) for n in names}
    return found | {"to_folder"}


@pytest.mark.parametrize("budget", [1, 7, 100_000])
def test_any_budget_finds_each_file_once(spark, deep, budget):
    rows = treewalk.walk(spark, str(deep), budget=budget).collect()
    assert len(rows) == 201 and {r["path"] for r in rows} == plain(deep)
    assert [r["path"] for r in rows if r["is_link"]] == ["to_folder"]
    assert all(r["size"] == int(r["path"][-5]) for r in rows if not r["is_link"])


def test_all_tasks_share_what_lies_below_one_folder(spark, deep):
    tree = Tree(str(deep), [])
    leaves = [r[1] for r in tree.visit([str(deep)], 13) if r[0] is None]
    while len(leaves) < 40:
        leaves = [r[1] for r in tree.visit(leaves, 1) if r[0] is None]
    folders = spark.createDataFrame([(f,) for f in leaves], "abspath string").repartition(8)
    tasks = treewalk._round(tree, folders, 1000).where("path is not null").select(F.spark_partition_id().alias("t")).distinct().count()
    assert tasks == 8


def test_a_task_reads_at_least_one_folder_and_tells_the_others():
    rows = list(Tree("/nowhere", []).visit(["/nowhere/a", "/nowhere/b"], 1))
    assert [(r[1], r[6] is None) for r in rows] == [("/nowhere/a", False), ("/nowhere/b", True)]


def test_managed_folders_and_empty_and_missing_roots(spark, deep, tmp_path):
    managed = [str(deep.joinpath(*[f"d{k}" for k in range(12)], "leaf3"))]
    assert treewalk.walk(spark, str(deep), managed, budget=3).count() == 196
    assert treewalk.walk(spark, str(deep), [str(deep)]).count() == 0
    assert treewalk.walk(spark, str(tmp_path), errors=True).count() == 0
    with pytest.raises(FileNotFoundError):
        treewalk.walk(spark, str(tmp_path / "none"))
