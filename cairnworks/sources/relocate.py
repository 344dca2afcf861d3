"""Moves planned files by tasks that may be run again.

A move that an earlier attempt finished is seen by its destination and counts as done; nothing
is ever overwritten, and a copy across volumes is checked before its source goes.
"""

from __future__ import annotations

import hashlib
import os
import shutil
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from cairnworks.sources.treewalk import CHUNK


def content_hash(path: str) -> tuple[str, int]:
    digest, n = hashlib.sha256(), 0
    with open(path, "rb") as f:
        while data := f.read(CHUNK):
            digest.update(data)
            n += len(data)
    return digest.hexdigest(), n


def _rename_to_free(src: str, dst: str) -> None:
    """Gives a file a name that nobody has; raises FileExistsError where it is taken, however late."""
    try:
        os.link(src, dst)
    except FileExistsError:
        raise
    except OSError:  # another volume, or one without hard links: an empty file of one's own holds the name
        os.close(os.open(dst, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        try:
            os.replace(src, dst)
        except OSError:
            os.remove(dst)
            raise
    else:
        os.unlink(src)


def move_file(src: str, dst: str, want: str | None, size: int | None, verify: bool = True) -> str | None:
    """None when the file is at ``dst``, else why it was left alone."""
    if os.path.lexists(dst):
        if os.path.lexists(src):
            if os.path.islink(src) or os.path.islink(dst) or not os.path.samefile(src, dst):
                return "destination already exists"
            os.unlink(src)  # an attempt died between the new name and the old
        return None if not verify or content_hash(dst)[0] == want else "destination holds other content"
    if not os.path.lexists(src):
        return "source file is gone"
    if os.path.islink(src):
        return "source is a link"
    if verify:
        got, n = content_hash(src)
        if size is not None and n != size:
            return "source is being written (short read)"
        if got != want:
            return "content changed since ingest"
    os.makedirs(os.path.dirname(dst), exist_ok=True)
    try:
        _rename_to_free(src, dst)
    except FileExistsError:
        return "destination already exists"
    except OSError:
        part = f"{dst}.part"
        shutil.copy2(src, part)
        if want is not None and content_hash(part)[0] != want:
            os.remove(part)
            return "copy verification failed"
        try:
            _rename_to_free(part, dst)
        except FileExistsError:
            os.remove(part)
            return "destination already exists"
        os.remove(src)
    return None


def execute(plan: DataFrame, verify: bool = True) -> DataFrame:
    """plan(item, src, dest_root, final_rel, hash, size) to (item, dest_root, final_rel, mtime, reason); runs when it is read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                dst = os.path.join(r.dest_root, *r.final_rel.split("/"))
                try:
                    reason = move_file(r.src, dst, r.hash, int(r.size), verify)
                    mtime = int(os.stat(dst).st_mtime) if reason is None else None
                except OSError as e:
                    reason, mtime = str(e), None
                out.append((r.item, r.dest_root, r.final_rel, mtime, reason))
            frame = pd.DataFrame(out, columns=["item", "dest_root", "final_rel", "mtime", "reason"])
            yield frame.astype({"mtime": "Int64"})

    return plan.select("item", "src", "dest_root", "final_rel", "hash", "size").mapInPandas(run, "item long, dest_root string, final_rel string, mtime long, reason string")
