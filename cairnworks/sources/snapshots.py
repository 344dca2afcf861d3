"""Tables below one folder: base files in hash buckets, a log of changed rows, and numbered pointer files for all of them.

A change writes the changed rows alone, as one more piece of a table's log, and then a pointer file with the
next number under a name that never existed; the largest number counts. Nothing is replaced, and older
pointers only go once the new one is there, so a reader sees all of a change or nothing of it, also when the
writer dies at any point. Readers merge base and log by key. Compaction rewrites the buckets that the
log touches and leaves the others where they are; ``vacuum`` deletes what no kept pointer names. Columns that
an older version lacks are filled with defaults when it is read. There is one writer at a time.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cairnworks.operators.merge import OP, SEQ, bucket_of, merged

_POINTER = re.compile(r"CURRENT(?:-(\d+))?\.json$")
#: Columns of each table, and what fills those that an old version lacks.
SCHEMAS = {
    "files": "hash string, size long, mime string, first_seen_at long",
    "drives": "id string, label string, root_path string, last_ingested_at long, kind string",
    "paths": "id long, hash string, drive_id string, path string, mtime long, ctime long, observed_at long, status string",
    "clusters": "id string, kind string, label string, canonical_hash string, created_at long, status string",
    "members": "cluster_id string, hash string, confidence double",
    "signatures": "hash string, algo string, sig long, w int, h int",
    "tags": "hash string, key string, value string, source string, confidence double",
    "decisions": "id long, ts long, actor string, action string, payload string",
    "settings": "key string, value string",
    "moves": "id long, path_id long, hash string, kind string, dest_label string, dest_root string, src_abspath string, final_path string, enqueued_at long, status string",
    "observed": "drive_id string, path string, observed_at long, hash string, size long, mime string, mtime long",
    "answers": "text_key string, model string, answer string, error string",
}
DEFAULTS = {("paths", "status"): "active", ("clusters", "status"): "open", ("drives", "kind"): "scanned", ("members", "confidence"): 1.0}
#: What tells a table's rows apart.
KEYS = {"files": ["hash"], "members": ["cluster_id", "hash"], "signatures": ["hash", "algo"], "tags": ["hash", "key", "value"], "settings": ["key"], "observed": ["drive_id", "path"], "answers": ["text_key", "model"]}
#: Tables whose ids are numbers given out here.
NUMBERED = ("paths", "decisions", "moves")
#: Rows of a bucket that a table is laid out for, and pieces of a log after which it is compacted.
BUCKET_ROWS = 1 << 18
MOST_PIECES = 32
#: Bytes of a log, as written, up to which its keys are broadcast to the base.
BROADCAST_BYTES = 4 << 20


def keys_of(name: str) -> list[str]:
    return KEYS.get(name, ["id"])


def columns_of(name: str) -> list[tuple[str, str]]:
    return [tuple(x.split()) for x in SCHEMAS[name].split(", ")]


class Snapshots:
    """``versions`` has, by table: ``buckets``, ``base`` {bucket: folder}, ``rows`` of the base, ``log`` [piece], and the largest id given out as ``top``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.versions: dict[str, dict] = self._read_pointer()

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []

    def _pointers(self) -> list[tuple[int, str]]:
        """(number, path) of all pointer files, in order; the unnumbered one of old indexes is number 0."""
        return sorted((int(m[1] or 0), f"{self.folder}/{m[0]}") for m in map(_POINTER.match, self._names(self.folder)) if m)

    def _pointed(self, path: str) -> dict[str, dict]:
        told = json.loads("".join(r[0] for r in self.spark.read.text(path, wholetext=True).collect()))
        return {name: {"buckets": 0, "base": {"all": x}, "rows": 0, "log": [], "top": None} if isinstance(x, str) else x for name, x in told.items()}

    def _read_pointer(self) -> dict[str, dict]:
        found = self._pointers()
        return self._pointed(found[-1][1]) if found else {}

    # --- reading

    def _base(self, name: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[name])
        rows = self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{self.folder}/{name}/{x}" for x in folders])
        filled = {c: F.coalesce(c, F.lit(DEFAULTS[name, c])) for c, _ in columns_of(name) if (name, c) in DEFAULTS}
        return rows.withColumns(filled) if filled else rows

    def _log(self, name: str) -> DataFrame:
        pieces = self.versions[name]["log"]
        return self.spark.read.schema(f"{SCHEMAS[name]}, {OP} string, {SEQ} long").parquet(*[f"{self.folder}/{name}/{p['path']}" for p in pieces])

    def table(self, name: str) -> DataFrame:
        """All rows as of the pointer that was read last."""
        entry = self.versions.get(name)
        if entry is None:
            return self._base(name, [])
        return self._merged(name, list(entry["base"].values()))

    def _merged(self, name: str, folders: list[str]) -> DataFrame:
        log = self.versions[name]["log"]
        if not log:
            return self._base(name, folders)
        base = self._base(name, folders) if folders else None
        rows = merged(base, self._log(name), keys_of(name), sum(p["bytes"] for p in log) <= BROADCAST_BYTES)
        return rows.select(*[c for c, _ in columns_of(name)])

    def next_id(self, name: str) -> int:
        """A number above all that the table's rows ever had."""
        entry = self.versions.get(name)
        if entry is None:
            return 1
        if entry.get("top") is None:  # an index of before ids were noted
            entry["top"] = self.table(name).agg(F.max("id")).first()[0] or 0
        return entry["top"] + 1

    # --- writing

    def _entry(self, name: str) -> dict:
        return json.loads(json.dumps(self.versions.get(name) or {"buckets": 0, "base": {}, "rows": 0, "log": [], "top": 0}))

    def _counted(self, name: str, df: DataFrame, write) -> tuple[int, int]:
        """Rows written and their largest id, seen while they are written."""
        seen = Observation()
        largest = F.max("id") if name in NUMBERED else F.lit(None).cast("long")
        write(df.observe(seen, F.count(F.lit(1)).alias("n"), largest.alias("top")))
        return seen.get["n"], seen.get["top"] or 0

    def _write_buckets(self, name: str, rows: DataFrame, buckets: int) -> tuple[dict[str, str], int, int]:
        """({bucket: folder}, rows, largest id) of a new version; empty buckets have no folder."""
        version = f"v-{uuid.uuid4().hex[:12]}"
        path = f"{self.folder}/{name}/{version}"
        held = rows.withColumn("bucket", bucket_of(keys_of(name), buckets)).repartition(buckets, "bucket")
        n, top = self._counted(name, held, lambda df: df.write.partitionBy("bucket").parquet(path))
        return {x.split("=")[1]: f"{version}/{x}" for x in self._names(path) if x.startswith("bucket=")}, n, top

    def _write_piece(self, name: str, number: int, puts: DataFrame | None, deletes: DataFrame | None) -> tuple[dict | None, int]:
        """A piece of the log of the table, None if it has no rows; of a key that is deleted and put the put counts."""
        keys, cols = keys_of(name), columns_of(name)
        parts = []
        if puts is not None:
            parts.append(puts.select(*[F.col(c).cast(t).alias(c) for c, t in cols], F.lit("put").alias(OP), F.lit(2 * number + 1).cast("long").alias(SEQ)))
        if deletes is not None:
            parts.append(deletes.select(*[(F.col(c) if c in keys else F.lit(None)).cast(t).alias(c) for c, t in cols], F.lit("delete").alias(OP), F.lit(2 * number).cast("long").alias(SEQ)))
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        path = f"log-{number:012d}-{uuid.uuid4().hex[:12]}"
        n, top = self._counted(name, rows, lambda df: df.write.parquet(f"{self.folder}/{name}/{path}"))
        fs, p = self._fs(f"{self.folder}/{name}/{path}")
        if not n:
            fs.delete(p, True)
            return None, top
        return {"path": path, "rows": n, "bytes": fs.getContentSummary(p).getLength()}, top

    def commit(self, puts: dict[str, DataFrame] | None = None, deletes: dict[str, DataFrame] | None = None, **whole: DataFrame) -> None:
        """Makes changes current together: rows to put by key, keys to delete, and tables given in full.

        Rows put must be unique by key. What is written of a changed table is the changed rows; only tables
        given in full are written in full. A log of many pieces, or one that has grown to a quarter of its table and is
        too large to broadcast, is compacted afterwards.
        """
        puts, deletes = puts or {}, deletes or {}
        before = self._pointers()
        number = before[-1][0] + 1 if before else 1
        new = dict(self.versions)
        for name, df in whole.items():
            rows = df.select(*[F.col(c).cast(t).alias(c) for c, t in columns_of(name)])
            new[name] = self._laid_out(name, rows, df.count(), self._entry(name)["top"])
        for name in {**puts, **deletes}:
            entry = self._entry(name)
            top = self.next_id(name) - 1 if name in NUMBERED else 0
            piece, most = self._write_piece(name, number, puts.get(name), deletes.get(name))
            if piece:
                entry["log"].append(piece)
                entry["top"] = max(top, most)
                new[name] = entry
        self._point(new, number, before)
        for name, entry in new.items():
            log = entry["log"]
            large = sum(p["bytes"] for p in log) > BROADCAST_BYTES and 4 * sum(p["rows"] for p in log) > entry["rows"]
            if large or len(log) > MOST_PIECES:
                self.compact(name)

    def _laid_out(self, name: str, rows: DataFrame, n: int, top: int | None) -> dict:
        """The entry of a table written in full, in so many buckets that each has at most ``BUCKET_ROWS`` rows, about."""
        buckets = 1 << max(0, (n - 1) // BUCKET_ROWS).bit_length()
        base, n, most = self._write_buckets(name, rows, buckets)
        return {"buckets": buckets, "base": base, "rows": n, "log": [], "top": max(top or 0, most)}

    def _point(self, new: dict[str, dict], number: int, before: list[tuple[int, str]]) -> None:
        fs, p = self._fs(f"{self.folder}/CURRENT-{number:012d}.json")
        _, part = self._fs(f"{self.folder}/.CURRENT-{uuid.uuid4().hex}")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        if not fs.rename(part, p):
            raise FileExistsError(f"another writer made {p}")
        self.versions = new
        for _, old in before[:-1]:  # the one before stays, for readers that have just listed it
            fs.delete(self._fs(old)[1], False)

    def compact(self, name: str) -> list[int]:
        """Works the log into the buckets it touches and returns their numbers; a table that outgrew its buckets, or has none, is laid out anew.

        The log and the old buckets stay on disk and count until the pointer to the new ones is there.
        """
        entry = self._entry(name)
        if not entry["log"]:
            return []
        before = self._pointers()
        number = before[-1][0] + 1
        rows = entry["rows"] + sum(p["rows"] for p in entry["log"])
        keys, buckets = keys_of(name), entry["buckets"]
        if not buckets or rows > 4 * buckets * BUCKET_ROWS:
            new = self._laid_out(name, self.table(name), rows, entry["top"])
            touched = sorted(map(int, new["base"]))
        else:
            touched = sorted(r[0] for r in self._log(name).select(bucket_of(keys, buckets)).distinct().collect())  # as many as buckets
            rows_of = self._merged(name, [entry["base"][str(b)] for b in touched if str(b) in entry["base"]])
            base, _, _ = self._write_buckets(name, rows_of, buckets)
            left = {b: x for b, x in entry["base"].items() if int(b) not in touched}
            new = entry | {"base": left | base, "rows": rows, "log": []}
        self._point(self.versions | {name: new}, number, before)
        return touched

    def vacuum(self) -> list[str]:
        """Deletes, and names, what neither of the last two pointers needs; readers that hold on to older tables lose them."""
        kept = set()
        for _, path in self._pointers()[-2:]:
            for name, entry in self._pointed(path).items():
                kept |= {f"{name}/{x}" for x in [*entry["base"].values(), *(p["path"] for p in entry["log"])]}
        gone = []
        for name in SCHEMAS:
            for version in self._names(f"{self.folder}/{name}"):
                top = f"{name}/{version}"
                parts = [f"{top}/{x}" for x in self._names(f"{self.folder}/{top}") if x.startswith("bucket=")]
                if top not in kept and not kept.intersection(parts):
                    gone.append(top)
                elif top not in kept:
                    gone += [x for x in parts if x not in kept]
        for path in gone:
            fs, p = self._fs(f"{self.folder}/{path}")
            fs.delete(p, True)
        return gone
