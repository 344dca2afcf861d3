"""SimHash near-duplicates: fingerprints, exact radius search, components.

Fingerprints of one value are searched once. Two fingerprints within radius r agree on at least
B - r of B bit blocks, so each goes to one bucket for every choice of B - r blocks, and every
link has both ends in a common bucket. B grows with the number of distinct fingerprints to keep
buckets near the size of one comparison block; each choice of B finds the same links. Buckets
over one block are split into tiles, and each pair of tiles is a group of its own, spread by
hash. A comparison block returns a spanning star of each linked set, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnworks.llm.batches import by_bytes, map_arrow, map_batches
from cairnworks.llm.columns import join_spread, whole_text
from cairnworks.llm.fingerprints import close_pairs, smallest_linked
from cairnworks.operators.components import connected_components
from cairnworks.scratch import discard, materialize, shuffle_partitions

RADIUS = 4
#: Fingerprints compared at a time; larger buckets are dealt out in tiles of half of it.
BLOCK = 1024
#: Bytes of text taken at a time, and shingles hashed before they are added up.
SLICE_BYTES = 4 << 20
CHUNK = 1 << 16
#: Most oversized buckets that are broadcast (24 bytes each); beyond, the join is shuffled.
BROADCAST_BUCKETS = 50_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint_all(texts: list[bytes], words: int = 4) -> np.ndarray:
    """uint64 SimHash of each UTF-8 text: XXH64 (seed 42) of its word shingles, strict majority bits."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    ones = np.zeros((len(texts), 64), np.int64)
    counts = np.zeros(len(texts), np.int64)
    held: list[int] = []
    spans: list[tuple[int, int]] = []  # (text, first of its hashes in held)

    def add() -> None:
        if held:
            bits = np.unpackbits(np.array(held, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at = np.array([first for _, first in spans])
            ones[[row for row, _ in spans]] += np.add.reduceat(bits, at, axis=0, dtype=np.int64)
        held.clear()
        spans.clear()

    for row, text in enumerate(texts):
        parts = text.translate(_LOWER).split()
        if not parts:
            continue
        joined = b" ".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        k = min(words, len(parts))
        starts, ends = starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist()
        counts[row] = len(starts)
        for first in range(0, len(starts), CHUNK):
            spans.append((row, len(held)))
            held.extend([digest(joined[a:b], 42) for a, b in zip(starts[first : first + CHUNK], ends[first : first + CHUNK], strict=True)])
            if len(held) >= CHUNK:
                add()
    add()
    return np.packbits(ones * 2 > counts[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """Rows (doc_id, text_hash, fp), one for each input row; fp is the fingerprint's 64 bits as a long."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).cast(pa.binary())
            prints = np.concatenate([fingerprint_all(texts.slice(a, b - a).to_pylist(), words) for a, b in by_bytes(texts, SLICE_BYTES)])
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints.view(np.int64))], names=["doc_id", "text_hash", "fp"])

        return f

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("t"))
    return map_batches(rows.select("doc_id", "t", F.xxhash64("t").alias("text_hash")), make, "doc_id long, text_hash long, fp long")


def _block_masks(blocks: int) -> list[int]:
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _choose_blocks(n: int, radius: int) -> int:
    """Number of bit blocks with the least work for n distinct fingerprints."""

    def work(blocks: int) -> float:
        ways = comb(blocks, radius)
        return ways * n * (1 + max(1.0, n / 2 ** (64 * (blocks - radius) / blocks) / BLOCK))

    return min(range(radius + 1, radius + 5), key=work)


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (src, dst) between the distinct values of ``fp`` whose components are those of all links."""
    spark = prints.sparkSession
    n = shuffle_partitions(spark)
    blocks = _choose_blocks(max(1, prints.count()), radius)
    whole = _block_masks(blocks)
    masks = [sum(whole[i] for i in some) for some in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]

    rows = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("way", "key"))
    large = rows.groupBy("way", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    large = materialize(large.select("way", "key", F.ceil(F.col("n") / (BLOCK // 2)).cast("int").alias("tiles")), "large-buckets")
    few = large.count() <= BROADCAST_BUCKETS
    rows = rows.join(F.broadcast(large) if few else large, ["way", "key"], "left")
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("tiles")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    rows = rows.select("way", "key", "fp", F.explode(F.when(F.col("tiles").isNull(), alone).otherwise(pairs)).alias("tile")).select("way", "key", "tile.i", "tile.j", "fp")
    rows = rows.repartition(n, "way", "key", "i", "j").sortWithinPartitions("way", "key", "i", "j", "fp")

    def compare(values: list[np.ndarray]) -> pa.RecordBatch | None:
        found = np.unique(np.concatenate(values))
        label = smallest_linked(len(found), close_pairs(found, radius))
        moved = np.nonzero(label != np.arange(len(found)))[0]
        signed_prints = found.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(signed_prints[moved]), pa.array(signed_prints[label[moved]])], names=["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole groups, as many as fit, are compared as one block."""
        ready: list[np.ndarray] = []  # whole groups
        size, open_key, open_rows = 0, None, []
        for batch in batches:
            cols = [batch.column(k).to_numpy() for k in range(5)]
            change = np.nonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0))[0] + 1
            prints = cols[4].view(np.uint64)
            for a, b in zip([0, *change], [*change, batch.num_rows], strict=True):
                key = tuple(c[a] for c in cols[:4])
                if key != open_key:
                    group = open_rows
                    count = sum(map(len, group))
                    if size + count > BLOCK and ready:
                        yield compare(ready)
                        ready, size = [], 0
                    if count > 1:
                        ready, size = ready + group, size + count
                    open_key, open_rows = key, []
                open_rows.append(prints[a:b])
        if ready and size + sum(map(len, open_rows)) > BLOCK:
            yield compare(ready)
            ready = []
        if ready or sum(map(len, open_rows)) > 1:
            yield compare(ready + open_rows)

    return map_arrow(rows, run, "src long, dst long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, words: int = 4) -> DataFrame:
    """Rows (doc_id, text_hash, fp, component_id), one for each input row.

    Fingerprints of at most ``radius`` differing bits link; component_id is the smallest doc_id
    that links reach, itself included. Null or empty text has no words and fingerprint zero,
    which links like any other. Texts of fewer words than a shingle are one shingle. Null ids
    keep their row and are never a component's name unless it has no other. Repeated rows fall
    into one component; other columns are not read; an empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, words), "fingerprints")
    values = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-values")
    edges = materialize(links(values.select("fp"), radius), "fingerprint-links")
    found = connected_components(edges)
    rooted = values.join(found.select(F.col("node").alias("fp"), F.col("component").alias("root")), "fp", "left")
    rooted = materialize(rooted.select("fp", "first", F.coalesce("root", "fp").alias("root")), "fingerprint-roots")
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialize(join_spread(rooted, names, "root", "fp").select("fp", "component_id"), "fingerprint-components")
    for table in (values, edges, rooted):
        discard(table)
    return join_spread(prints, named, "fp", "doc_id").select("doc_id", "text_hash", "fp", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, words: int = 4) -> DataFrame:
    """The input rows, all columns, of one document of each component: the one with the smallest id.

    Rows are told apart by id and text; of repeated rows one is kept.
    """
    found = near_groups(docs, id_col, text_col, radius, words)
    slim = found.groupBy("component_id", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    first = slim.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash", "n")).alias("best"))
    kept = materialize(first.select(F.col("best.doc_id").alias("keep"), F.col("best.text_hash").alias("text_hash"), F.col("best.n").alias("n")), "kept")
    # a row is one column on its way, so that no name of its columns can meet one used here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), F.col(id_col).cast("long").alias("id"), F.xxhash64(whole_text(text_col)).alias("own"))
    met = rows.join(kept, F.col("id").eqNullSafe(F.col("keep")) & (F.col("own") == F.col("text_hash")))
    if kept.where("n > 1").isEmpty():
        return met.select("r.*")
    repeated = met.where("n > 1").groupBy("id", "own").agg(F.first("r").alias("r"))
    return met.where("n = 1").select("r").union(repeated.select("r")).select("r.*")
