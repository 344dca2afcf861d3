"""Expressions over file paths and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of each kind of file. Fixed values.
TEXT_SUFFIXES = (".txt", ".md", ".csv", ".json", ".log", ".rst", ".tex", ".html", ".xml", ".ini", ".py")
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".webp")
ARCHIVE_SUFFIXES = (".zip", ".7z", ".rar", ".tar", ".gz", ".tgz", ".bz2", ".tbz2", ".tbz", ".xz", ".txz", ".zst", ".cbz", ".cbr", ".cb7", ".jar", ".war", ".whl", ".epub", ".apk", ".iso")
COMPOUND_SUFFIXES = (".tar.gz", ".tar.bz2", ".tar.xz", ".tar.zst")
#: What marks a version in a file's name, case ignored. Fixed value.
VERSION_MARK = r"(?i)(_v\d+|_final|_revised|_backup|_copy|\bfinal\b)"


def to_posix(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def parent_dir(path: Column) -> Column:
    """The folder a path lies in; '.' at the root."""
    found = F.regexp_extract(path, r"^(.*?)/+[^/]+/*$", 1)
    return F.when(found != "", found).otherwise(F.when(path.rlike("^/+[^/]*$"), "/").otherwise("."))


def suffix(path: Column) -> Column:
    """The last dot and what follows, lower case; empty for none or for a name that only starts with a dot."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"^(.+)\.[^.]+$", "$1")


def normal_stem(path: Column) -> Column:
    """The name without suffix and version marks; the plain stem where nothing is left."""
    low = F.lower(stem(path))
    bare = F.btrim(F.regexp_replace(low, VERSION_MARK, ""), F.lit("_ "))
    return F.coalesce(F.nullif(bare, F.lit("")), low)


def _kind(path: Column, mime: Column, suffixes: tuple[str, ...], family: str) -> Column:
    return suffix(path).isin(*suffixes) | F.coalesce(mime.startswith(family), F.lit(False))


def is_text(path: Column, mime: Column) -> Column:
    return _kind(path, mime, TEXT_SUFFIXES, "text/")


def is_image(path: Column, mime: Column) -> Column:
    return _kind(path, mime, IMAGE_SUFFIXES, "image/")


def is_archive(path: Column) -> Column:
    low = F.lower(path)
    out = suffix(path).isin(*ARCHIVE_SUFFIXES)
    for s in COMPOUND_SUFFIXES:
        out = out | low.endswith(s)
    return out


def archive_format(path: Column) -> Column:
    low = F.lower(path)
    compound = F.lit(False)
    for s in COMPOUND_SUFFIXES:
        compound = compound | low.endswith(s)
    plain = F.nullif(F.ltrim(suffix(path), F.lit(".")), F.lit(""))
    return F.when(compound, "tar").otherwise(F.coalesce(plain, F.lit("?")))


def absolute(root: Column, path: Column) -> Column:
    return F.when(F.coalesce(root, F.lit("")) != "", F.concat_ws("/", F.rtrim(root, F.lit("/")), path)).otherwise(path)


def managed_drive_id(root: Column) -> Column:
    return F.concat(F.lit("managed:"), F.substring(F.sha2(root, 256), 1, 16))


def mime_type(path: Column) -> Column:
    """From the name alone, by Python's table; null when unknown."""
    import mimetypes

    table = mimetypes.MimeTypes().types_map[True]
    ending = F.regexp_extract(F.lower(base_name(path)), r"(\.[^.]+)$", 1)
    pairs = F.create_map(*[F.lit(x) for item in sorted(table.items()) for x in item])
    return pairs[ending]
