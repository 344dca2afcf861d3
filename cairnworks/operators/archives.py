"""Archive listings: zip and tar members from files or bytes, and the 7-Zip technical listing.

Of files only what tells the members is read: of a zip the end record and the central directory, of a plain
tar the headers, seeking over the members. Compressed tars are unpacked piece by piece and forgotten.
"""

from __future__ import annotations

import io
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from cairnworks.functions.names import archive_format

MAX_ENTRIES = 2000
ENTRIES = "path string, ok boolean, backend string, encrypted boolean, error string, position int, name string, size long, is_dir boolean"


ZIPS = (".zip", ".jar", ".war", ".whl", ".epub", ".apk", ".cbz")
TARS = (".tar", ".tgz", ".tar.gz", ".tbz2", ".tar.bz2", ".txz", ".tar.xz")
BROKEN = (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, zlib.error, ValueError, NotImplementedError)
MEMBER = "backend string, encrypted boolean, error string, position long, name string, size long, is_dir boolean"


def _tar_members(source: io.BufferedIOBase) -> Iterator[tuple[str, int, bool]]:
    with tarfile.open(fileobj=source, mode="r:*") as t:  # not as a stream, which takes a cut archive for a whole one
        for m in t:
            yield m.name + "/" * m.isdir(), 0 if m.isdir() else m.size, m.isdir()
            t.members = []  # it would remember all of them


def listable(path: Column) -> Column:
    """Whether a path names an archive that can be listed here."""
    return reduce(Column.__or__, (F.lower(path).endswith(x) for x in ZIPS + TARS))


def members_of(source: io.BufferedIOBase, path: str) -> Iterator[tuple]:
    """Rows (backend, encrypted, error, position, name, size, is_dir) of an archive that can be sought in.

    One without members is one row with a null name. So is what can't be read, with an error, behind the
    members before the fault; nothing is raised for it.
    """
    zipped = path.lower().endswith(ZIPS)
    backend, encrypted, k = "zipfile" if zipped else "tarfile", False, 0
    try:
        if zipped:
            with zipfile.ZipFile(source) as z:
                infos = z.infolist()
            encrypted = any(i.flag_bits & 1 for i in infos)
            found = ((i.filename, i.file_size, i.is_dir()) for i in infos)
        else:
            found = _tar_members(source)
        for member in found:
            yield backend, encrypted, None, k, *member
            k += 1
        if not k:
            yield backend, encrypted, None, 0, None, None, None
    except BROKEN as e:
        yield "", encrypted, f"not readable: {e}", k, None, None, None


@udtf(returnType=MEMBER)
class ListArchive:
    """Members of the archive file at a path, as :func:`members_of` has them."""

    def eval(self, abspath: str):
        if abspath is None:
            return
        try:
            source = open(abspath, "rb", buffering=0)
        except OSError as e:
            yield "", False, f"not readable: {e}", 0, None, None, None
            return
        with source:
            yield from members_of(source, abspath)


def register(spark: SparkSession) -> None:
    """SQL gets ``LATERAL list_archive(path)``."""
    spark.udtf.register("list_archive", ListArchive)


def list_files(files: DataFrame) -> DataFrame:
    """files(path, abspath, ...) and, of each, a row a member: (backend, encrypted, error, position, name, size, is_dir).

    Rows without an abspath have none. Memory holds the directory of one zip, or one tar header, at a time.
    """
    return files.lateralJoin(ListArchive(F.col("abspath").outer()))


def list_members(content: bytes, path: str) -> tuple[bool, str, bool, str | None, list[tuple[str, int, bool]]]:
    """(ok, backend, encrypted, error, members) of one archive; errors are data."""
    rows = list(members_of(io.BytesIO(content), path))
    if rows[-1][2]:
        return False, "", False, rows[-1][2], []
    return True, rows[0][0], rows[0][1], None, [r[4:] for r in rows if r[4] is not None]


def list_archives(archives: DataFrame) -> DataFrame:
    """archives(path, content) to one row a member; an archive without any is one row with a null name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                ok, backend, encrypted, error, members = list_members(bytes(content), path)
                for k, (name, size, is_dir) in enumerate(members) if members else [(0, (None, None, None))]:
                    out.append((path, ok, backend, encrypted, error, k, name, size, is_dir))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in ENTRIES.split(", ")])
            yield frame.astype({"size": "Int64", "is_dir": "boolean"})

    return archives.select("path", "content").mapInPandas(run, ENTRIES)


def as_entries(members: DataFrame) -> DataFrame:
    """Rows of :func:`list_files` in the form of :func:`list_archives`: an archive with a fault is one row with its error."""
    fault = members.where("error is not null").select("path", F.col("error").alias("fault")).distinct()
    rows = members.join(fault, "path", "left").where("fault is null or error is not null")
    ok = F.col("fault").isNull()
    return rows.select("path", ok.alias("ok"), "backend", (F.col("encrypted") & ok).alias("encrypted"), F.col("fault").alias("error"), "position", "name", "size", "is_dir")


def archive_totals(entries: DataFrame) -> DataFrame:
    """The result of each archive: format, true count, bytes, whether entries were cut at MAX_ENTRIES.

    ``entries`` are those of :func:`list_archives`, or of :func:`as_entries`.
    """
    rows = entries.groupBy("path", "ok", "backend", "encrypted", "error").agg(F.count("name").alias("entry_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"))
    return rows.withColumn("format", archive_format(F.col("path"))).withColumn("truncated", F.col("entry_count") > MAX_ENTRIES)


def shown(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("name").isNotNull() & (F.col("position") < MAX_ENTRIES))


def parse_listing(listings: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, name, size, is_dir) from the blocks of key = value lines below a dashed line."""
    body = F.regexp_extract(F.regexp_replace(F.col(text), r"\r\n?", "\n"), r"(?s)(?:^|\n)[ \t]*-{10}[^\n]*\n(.*)$", 1)
    blocks = listings.select(key, F.posexplode(F.split(body, r"\n[ \t]*\n")).alias("block", "b"))
    value = lambda name: F.trim(F.regexp_extract("b", rf"(?:^|\n)\s*{name} = ([^\n]*)(?![\s\S]*\n\s*{name} = )", 1))
    rows = blocks.where(F.col("b").rlike(r"(?:^|\n)\s*Path = "))
    rows = rows.select(key, "block", value("Path").alias("name"), F.coalesce(value("Size").try_cast("long"), F.lit(0)).alias("size"), ((value("Folder") == "+") | value("Attributes").startswith("D")).alias("is_dir"))
    return rows.select(key, F.col("block").alias("position"), "name", "size", "is_dir")
