"""Counts of a run come from the passes that write, not from jobs of their own."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnworks.index import Index
from cairnworks.scratch import counted


@pytest.fixture
def no_counts(monkeypatch):
    """Any count() of a DataFrame fails."""

    def count(self):
        raise AssertionError("a job of its own counts rows")

    for kind in {DataFrame, *DataFrame.__subclasses__()}:
        if "count" in vars(kind):
            monkeypatch.setattr(kind, "count", count)


def test_an_ingest_counts_in_its_own_passes(spark, tmp_path, monkeypatch, no_counts):
    root = tmp_path / "disk"
    (root / "sub").mkdir(parents=True)
    for k in range(5):
        (root / "sub" / f"{k}.txt").write_text("x" * k)
    os.symlink(root / "sub" / "1.txt", root / "link")
    index = Index(spark, str(tmp_path / "index"))
    first = index.ingest(str(root))
    assert {k: first[k] for k in ("links", "hashed", "skipped", "errors")} == {"links": 1, "hashed": 5, "skipped": 0, "errors": 0}
    (root / "sub" / "new.txt").write_text("new")
    (root / "sub" / "1.txt").write_text("changed")
    again = index.ingest(str(root))
    assert {k: again[k] for k in ("links", "hashed", "skipped", "errors")} == {"links": 1, "hashed": 2, "skipped": 4, "errors": 0}


def test_figures_of_a_table_and_of_an_empty_one(spark, no_counts):
    figures = {"n": F.count(F.lit(1)), "top": F.max("id")}
    table, seen = counted(spark.range(1000).repartition(7), "numbers", **figures)
    assert seen == {"n": 1000, "top": 999} and table.agg(F.sum("id")).first()[0] == 499500
    assert counted(spark.range(0), "numbers", **figures)[1] == {"n": 0, "top": 0}
