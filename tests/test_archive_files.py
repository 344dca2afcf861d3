"""Archives are listed by ranges of their files."""

from __future__ import annotations

import gzip
import io
import os
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from cairnworks.index import Index
from cairnworks.operators import archives


class Counting(io.FileIO):
    """A file that counts the bytes read of it."""

    seen = 0

    def read(self, n=-1):
        data = super().read(n)
        self.seen += len(data)
        return data

    def readinto(self, buffer):
        n = super().readinto(buffer)
        self.seen += n or 0
        return n


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """A zip and a tar of a gigabyte each (holes in the file), small ones, and broken ones."""
    at = tmp_path_factory.mktemp("archives")
    with zipfile.ZipFile(at / "big.zip", "w") as z:
        z.writestr("a/", "")
        z.writestr("a/one.txt", "x" * 10)
        z.writestr("last.bin", b"y" * 20)
    content = (at / "big.zip").read_bytes()
    with open(at / "big.zip", "wb") as f:  # a gigabyte before the archive, as in self-extracting ones
        f.seek(1 << 30)
        f.write(content)
    with open(at / "big.tar", "wb") as f:
        for k in range(4):
            info = tarfile.TarInfo(f"part{k}.bin")
            info.size = 1 << 28
            f.write(info.tobuf())
            f.seek(1 << 28, os.SEEK_CUR)
        f.write(b"\0" * 1024)
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as t:
        d = tarfile.TarInfo("sub")
        d.type = tarfile.DIRTYPE
        t.addfile(d)
        for k in range(3000):
            info = tarfile.TarInfo(f"sub/{k}.txt")
            info.size = k % 7
            t.addfile(info, io.BytesIO(b"z" * (k % 7)))
    (at / "many.tgz").write_bytes(gzip.compress(raw.getvalue()))
    (at / "cut.tar.gz").write_bytes(gzip.compress(raw.getvalue())[:9000])
    (at / "bad.zip").write_bytes(b"nope")
    (at / "empty.zip").write_bytes(b"PK\5\6" + b"\0" * 18)
    return at


def listing(spark, folder, *names):
    rows = spark.createDataFrame([(n, str(folder / n)) for n in names], "path string, abspath string")
    return archives.list_files(rows)


@pytest.mark.parametrize(("name", "members"), [("big.zip", 3), ("big.tar", 4)])
def test_a_gigabyte_is_listed_from_less_than_a_megabyte(folder, name, members):
    with Counting(str(folder / name)) as f:
        rows = list(archives.members_of(f, name))
    assert len(rows) == members and rows[0][2] is None and f.seen < 1 << 20


def test_files_are_listed_as_bytes_are(spark, folder):
    small = ["many.tgz", "cut.tar.gz", "bad.zip", "empty.zip"]
    got = archives.as_entries(listing(spark, folder, *small, "gone.tar"))
    totals = {r["path"]: r for r in archives.archive_totals(got).collect()}
    contents = spark.createDataFrame([(n, bytearray((folder / n).read_bytes())) for n in small], "path string, content binary")
    for r in archives.archive_totals(archives.list_archives(contents)).collect():
        assert totals[r["path"]] == r
    t = totals["many.tgz"]
    assert (t["ok"], t["entry_count"], t["total_size"], t["truncated"]) == (True, 3001, sum(k % 7 for k in range(3000)), True)
    assert not totals["cut.tar.gz"]["ok"] and not totals["bad.zip"]["ok"] and not totals["gone.tar"]["ok"]
    assert totals["empty.zip"]["ok"] and totals["empty.zip"]["entry_count"] == 0
    assert archives.shown(got.where("path = 'many.tgz'")).count() == archives.MAX_ENTRIES


def test_a_fault_keeps_the_members_before_it(spark, folder):
    rows = listing(spark, folder, "cut.tar.gz").orderBy("position").collect()
    assert rows[-1]["error"].startswith("not readable") and len(rows) > 100 and rows[0]["name"] == "sub/"


def test_the_listing_in_sql(spark, folder):
    archives.register(spark)
    spark.createDataFrame([(1, str(folder / "big.zip")), (2, None)], "k int, file string").createOrReplaceTempView("held")
    rows = spark.sql("select k, name, size, is_dir from held, lateral list_archive(file) order by position").collect()
    assert [tuple(r) for r in rows] == [(1, "a/", 0, True), (1, "a/one.txt", 10, False), (1, "last.bin", 20, False)]


def test_archives_of_an_index(spark, folder, tmp_path):
    disk = tmp_path / "disk"
    disk.mkdir()
    for name in ("many.tgz", "bad.zip"):
        (disk / name).write_bytes((folder / name).read_bytes())
        (disk / f"copy-{name}").write_bytes((folder / name).read_bytes())
    (disk / "note.txt").write_text("x")
    index = Index(spark, str(tmp_path / "index"))
    index.ingest(str(disk))
    rows = index.archive_members()
    assert rows.select("hash").distinct().count() == 2  # copies are listed once
    assert rows.groupBy(F.col("error").isNull().alias("ok")).count().orderBy("ok").collect() == [(False, 1), (True, 3001)]
