"""A directory tree as a table, walked in rounds.

A round is a job over a table of folders, dealt evenly to the tasks. A task walks its folders and
what lies below until it has seen ``budget`` entries; folders it then still has to read go to the next
round, where all tasks share them. So a tree below one deep folder is spread as a wide one is, a small
tree takes one round, and a lost task repeats its own folders alone.

Zero-byte files are listed (Spark's binaryFile source drops them), links are listed as links and
never followed, and managed folders below the root are left out. ``cairn_tree`` is the same as a
data source, one partition for each sub-folder of the root.
"""

from __future__ import annotations

import hashlib
import os
import stat
import sys
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cairnworks.functions.names import mime_type, to_posix
from cairnworks.scratch import materialize

MARKER = ".archive_drive.json"
CHUNK = 4 << 20
COLUMNS = "path string, abspath string, size long, mtime long, ctime long, is_link boolean, error string"
#: Entries that a task sees in a round, and in the first one, which has a single task.
BUDGET = 100_000
FIRST_BUDGET = 2_000
#: Shares of folders for each task that runs at a time, and rows that a task hands over at a time.
TASK_SHARES = 4
ROWS = 10_000


class Tree:
    """Reads folders below a root, without the managed ones."""

    def __init__(self, root: str, managed: list[str]):
        self.root, self.managed = os.path.abspath(root), [os.path.abspath(m) for m in managed]

    def left_out(self, path: str) -> bool:
        return any(path == m or path.startswith(m.rstrip(os.sep) + os.sep) for m in self.managed)

    def _failed(self, path: str, error: OSError) -> tuple:
        return (os.path.relpath(path, self.root), path, None, None, None, None, str(error))

    def entries(self, folder: str, below: list[str]) -> Iterator[tuple]:
        """Rows of a folder's files and links; its sub-folders are added to ``below``.

        Folders and files that can't be read, or vanish meanwhile, are rows with an error.
        """
        try:
            with os.scandir(folder) as found:
                for e in found:
                    try:
                        info = e.stat(follow_symlinks=False)
                    except OSError as error:
                        yield self._failed(e.path, error)
                        continue
                    if stat.S_ISDIR(info.st_mode):
                        if not self.left_out(e.path):
                            below.append(e.path)
                    elif e.name != MARKER and (stat.S_ISLNK(info.st_mode) or stat.S_ISREG(info.st_mode)):
                        yield (os.path.relpath(e.path, self.root), e.path, info.st_size, int(info.st_mtime), int(info.st_ctime), stat.S_ISLNK(info.st_mode), None)
        except OSError as error:
            yield self._failed(folder, error)

    def visit(self, folders: list[str], budget: int) -> Iterator[tuple]:
        """Rows of the folders and all below until ``budget`` entries are seen; folders left unread are rows of their paths alone."""
        todo, seen = [f for f in reversed(folders) if not self.left_out(f)], 0
        while todo and seen < budget:
            below: list[str] = []
            for row in self.entries(todo.pop(), below):
                seen += 1
                yield row
            seen += 1 + len(below)
            todo += below
        for folder in todo:
            yield (None, folder, None, None, None, None, None)


class _Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class TreeReader(DataSourceReader):
    def __init__(self, root: str, managed: list[str]):
        self.tree = Tree(root, managed)

    def partitions(self) -> list[InputPartition]:
        root = self.tree.root
        if not os.path.isdir(root):
            raise FileNotFoundError(root)
        with os.scandir(root) as entries:
            below = sorted(e.path for e in entries if e.is_dir(follow_symlinks=False))
        return [_Folder(root, False), *(_Folder(p, True) for p in below)]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        if self.tree.left_out(partition.path):
            return iter(())
        return self.tree.visit([partition.path], sys.maxsize) if partition.deep else self.tree.entries(partition.path, [])


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cairn_tree"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> TreeReader:
        managed = self.options.get("managed", "")
        return TreeReader(self.options["path"], [m for m in managed.split(os.pathsep) if m])


def _round(tree: Tree, folders: DataFrame, budget: int) -> DataFrame:
    """What the tasks find in their shares of folders(abspath); rows without path and error are folders left unread."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = [f for batch in batches for f in batch["abspath"]]
        rows = tree.visit(mine, budget)
        while part := list(islice(rows, ROWS)):
            frame = pd.DataFrame(part, columns=[c.split()[0] for c in COLUMNS.split(", ")])
            yield frame.astype({"size": "Int64", "mtime": "Int64", "ctime": "Int64", "is_link": "boolean"})

    return folders.mapInPandas(run, COLUMNS)


def walk(spark: SparkSession, root: str, managed: list[str] | None = None, errors: bool = False, budget: int = BUDGET) -> DataFrame:
    """(path, abspath, size, mtime, ctime, is_link) of every file below the root.

    With ``errors`` also ``error``, and a row for each folder or file that couldn't be read. An empty root gives an
    empty table; a root that is no folder raises.
    """
    tree = Tree(root, managed or [])
    if not os.path.isdir(tree.root):
        raise FileNotFoundError(tree.root)
    tasks, rounds = spark.sparkContext.defaultParallelism, []
    folders = spark.createDataFrame([(tree.root,)], "abspath string")
    more = 1
    while more:
        unread = Observation()
        found = _round(tree, folders, budget if rounds else min(budget, FIRST_BUDGET))
        left = F.col("path").isNull()
        found = materialize(found.observe(unread, F.count_if(left).alias("n")), "tree")
        rounds.append(found.where(~left))
        more = unread.get["n"]
        folders = found.where(left).select("abspath").repartition(max(1, min(more, TASK_SHARES * tasks)))
    rows = reduce(DataFrame.unionByName, rounds).withColumn("path", to_posix(F.col("path")))
    return rows if errors else rows.where("error is null").drop("error")


def hash_files(listing: DataFrame) -> DataFrame:
    """listing(drive_id, path, abspath, size, ...) with (hash, n_read, mime, error); read in chunks of 4 MiB."""
    out = [f for f in listing.schema.fields]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out) + ", hash string, n_read long, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for path in batch["abspath"]:
                digest, n = hashlib.sha256(), 0
                try:
                    with open(path, "rb") as f:
                        while data := f.read(CHUNK):
                            digest.update(data)
                            n += len(data)
                    found.append((digest.hexdigest(), n, None))
                except OSError as e:
                    found.append((None, None, str(e)))
            hashes, counts, errors = zip(*found, strict=True) if found else ((), (), ())
            yield batch.assign(hash=list(hashes), n_read=pd.array(list(counts), "Int64"), error=list(errors))

    return listing.mapInPandas(run, schema).withColumn("mime", mime_type(F.col("path")))
