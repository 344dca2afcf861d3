"""Intermediate tables in the folder that all executors share.

A table written here cuts lineage and survives the loss of any executor. The folder is the
one the cluster names in ``spark.checkpoint.dir``; only where that is unset (a bare local
session, as in tests) a fresh temporary folder is made and remembered in the session.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables, without a trailing slash."""
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="cairnworks-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


#: Paths given out in this process, oldest first.
_made: list[str] = []
_PATH = "_scratch_path"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the scratch root."""
    path = f"{scratch_root(spark)}/cairnworks/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    setattr(table, _PATH, path)
    return table


def counted(df: DataFrame, name: str, **figures: Column) -> tuple[DataFrame, dict[str, int]]:
    """:func:`materialize`, and aggregates over the rows, taken while they are written; null ones are 0."""
    seen = Observation()
    table = materialize(df.observe(seen, *[c.alias(k) for k, c in figures.items()]), name)
    return table, {k: v or 0 for k, v in seen.get.items()}


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if path in _made:
        _made.remove(path)


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`materialize` that nothing reads any more; other DataFrames stay."""
    if path := getattr(df, _PATH, None) if _PATH in vars(df) else None:
        _delete(df.sparkSession, path)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables and folders made inside once it ends, but for those given to the yielded function."""
    first, kept = len(_made), set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(vars(table).get(_PATH))
        return table

    try:
        yield keep
    finally:
        for path in [p for p in _made[first:] if p not in kept]:
            _delete(spark, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
