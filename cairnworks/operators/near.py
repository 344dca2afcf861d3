"""Near duplicates of documents and images: candidates, links, clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnworks.functions.bits import band, informative, to_hex
from cairnworks.functions.names import normal_stem, parent_dir
from cairnworks.operators.clusters import as_clusters, without_overlap
from cairnworks.operators.components import connected_components, grow_components
from cairnworks.operators.spread import join_spread
from cairnworks.scratch import materialize, shuffle_partitions

DOC_RADIUS = 16
IMAGE_RADIUS = 6
MAX_IMAGE_CLUSTER = 200
BANDS = 8
BUCKET_CAP = 4000
#: Members of a tile; larger blocks are compared tile by tile, in as many tasks.
TILE = 16_384
#: Signatures compared at a time, and pairs in a batch.
COMPARED = 1 << 16
OUT_ROWS = 1 << 16


def block_pairs(keyed: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """Pairs (a, b, distance), a < b, of the same ``block`` within the radius; keyed(block, hash, sig).

    The rows of a block are packed into tiles, a row each; a task takes a tile or two and returns their pairs.
    """
    rows = materialize(keyed.distinct().withColumn("fresh", F.lit(True)), "keyed")
    packed = materialize(_pack(rows, "hash", ["hash", "sig"], tile), "tiles")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, sigs in _rows(batches):
            yield from _pairs(hashes, sigs, hashes, sigs, radius, True)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sides in _rows(batches):
            yield from _pairs(*sides, radius, False)

    schema = "a string, b string, distance int"
    alone = _spread(packed.where(F.size("hash") > 1), "block", "name").select("hash", "sig").mapInArrow(within, schema)
    return alone.union(_facing(packed, ["hash", "sig"]).mapInArrow(across, schema)).distinct()


def _pairs(hashes: pa.Array, signatures: pa.Array, other: pa.Array, others: pa.Array, radius: int, same: bool) -> Iterator[pa.RecordBatch]:
    def batch() -> pa.RecordBatch:
        i, j, distance = (np.concatenate(x) for x in zip(*held, strict=True))
        a, b = hashes.take(pa.array(i)), other.take(pa.array(j))
        up = pc.less(a, b)
        out = pa.RecordBatch.from_arrays([pc.if_else(up, a, b), pc.if_else(up, b, a), pa.array(distance.astype(np.int32))], names=["a", "b", "distance"])
        return out.filter(pc.not_equal(a, b))  # a hash may have two signatures

    held, n = [], 0
    for i, j, distance in _close(_numbers(signatures), _numbers(others), radius):
        if same:
            i, j, distance = (x[i < j] for x in (i, j, distance))
        held.append((i, j, distance))
        n += len(i)
        if n >= OUT_ROWS:
            yield batch()
            held, n = [], 0
    if n:
        yield batch()


def _close(signatures: np.ndarray, others: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of all i, j within the radius, ``COMPARED`` looked at at a time."""
    bits, more = signatures.view(np.uint64), others.view(np.uint64)  # counts of signed numbers are those of their absolute values
    step = max(1, COMPARED // max(1, len(more)))
    differ, distance = np.empty((step, len(more)), np.uint64), np.empty((step, len(more)), np.uint8)
    for k in range(0, len(bits), step):
        rows = min(step, len(bits) - k)
        np.bitwise_xor(bits[k : k + rows, None], more, out=differ[:rows])
        np.bitwise_count(differ[:rows], out=distance[:rows])
        at = np.flatnonzero(distance[:rows].reshape(-1) <= radius)
        if len(at):
            yield at // len(more) + k, at % len(more), distance.reshape(-1)[at]


def _roots(signatures: np.ndarray, radius: int) -> np.ndarray:
    """Of each signature the first one that it reaches by steps within the radius."""
    rest = signatures.view(np.uint64)
    root = left = np.arange(len(rest))
    while len(left):
        at, reached = left[0], [rest[0]]
        left, rest = left[1:], rest[1:]
        while reached and len(left):
            close = np.bitwise_count(rest ^ reached.pop()) <= radius
            if close.any():
                root = root.copy() if root is left else root
                root[left[close]] = at
                reached.extend(rest[close])
                left, rest = left[~close], rest[~close]
    return root


def spanning_forest(nodes: np.ndarray, signatures: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of nodes, fewer than nodes, with the components that all pairs within the radius have: stars round their first members."""
    root = _roots(signatures, radius)
    other = root != np.arange(len(root))
    return nodes[root[other]], nodes[other]


def cross_links(
    nodes: np.ndarray, signatures: np.ndarray, other: np.ndarray, others: np.ndarray, radius: int, roots: np.ndarray | None = None, other_roots: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) from a tile to another that join components of the two, one for each that they have less together.

    What is linked inside a tile is known from the tile alone (``roots``), so its components are the points here.
    """
    n = len(nodes)
    roots = _roots(signatures, radius) if roots is None else roots
    other_roots = _roots(others, radius) if other_roots is None else other_roots
    at = np.concatenate([roots, n + other_roots])  # the component of each point so far
    label, a, b = np.arange(len(at)), [], []

    def find(k: int) -> int:
        while label[k] != k:
            label[k] = label[label[k]]
            k = label[k]
        return k

    def join(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal label, at
        x, y = at[i], at[n + j]
        news = np.flatnonzero(x != y)
        if len(news):
            news = news[np.unique(x[news] * len(at) + y[news], return_index=True)[1]]
            for k in news.tolist():
                u, v = find(x[k]), find(y[k])
                if u != v:
                    label[v] = u
                    a.append(i[k])
                    b.append(j[k])
            while (label[label] != label).any():
                label = label[label]
            at = label[at]

    held, size = [], 0  # labels are brought up to date once for many matches
    for i, j, _ in _close(signatures, others, radius):
        held.append((i, j))
        size += len(i)
        if size >= len(at):
            join(*(np.concatenate(z) for z in zip(*held, strict=True)))
            held, size = [], 0
    if held:
        join(*(np.concatenate(z) for z in zip(*held, strict=True)))
    return nodes[np.array(a, np.int64)], other[np.array(b, np.int64)]


def _pack(rows: DataFrame, by: str, held: list[str], tile: int) -> DataFrame:
    """(block, name, a list for each of ``held``): tiles of about ``tile`` of the rows(block, fresh, by, *held), dealt by ``by``."""
    counts = rows.groupBy("block", "fresh").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    dealt = join_spread(rows, counts, ["block", "fresh"], by).withColumn("tile", F.pmod(F.xxhash64(by), F.col("tiles")).cast("int"))
    packed = dealt.groupBy("block", "fresh", "tile").agg(F.collect_list(F.struct(*held)).alias("held"))
    return packed.select("block", F.struct("fresh", "tile").alias("name"), *[F.col(f"held.{c}").alias(c) for c in held])


def _spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Dealt over as many tasks as the shuffle has, however few bytes they are."""
    return rows.repartition(shuffle_partitions(rows.sparkSession), *keys)


def _facing(packed: DataFrame, held: list[str]) -> DataFrame:
    """Both lists of every two tiles of a block, one of them fresh at least. Each tile is copied for those it meets, then the two
    meet under their names, so that a block's tiles are dealt over all tasks."""
    names = packed.groupBy("block").agg(F.collect_list("name").alias("names")).where(F.size("names") > 1)
    tiles = _spread(packed.join(names, "block"), "block", "name")
    met = lambda side: F.filter("names", lambda x: side(x) & (x["fresh"] | F.col("name.fresh")))
    a = tiles.select("block", F.col("name").alias("i"), F.explode(met(lambda x: x > F.col("name"))).alias("j"), *[F.col(c).alias(f"a_{c}") for c in held])
    b = tiles.select("block", F.explode(met(lambda x: x < F.col("name"))).alias("i"), F.col("name").alias("j"), *[F.col(c).alias(f"b_{c}") for c in held])
    keys = ["block", "i", "j"]
    two = _spread(a, *keys).join(_spread(b, *keys), keys)
    return two.select(*[f"{side}_{c}" for side in "ab" for c in held])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
    """The lists of each row."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield [c.slice(k, 1).flatten() for c in batch.columns]


def _numbers(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(np.int64)


def block_links(keyed: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """Links (a, b) with the components that pairs of the same ``block`` within the radius have; keyed(block, node, sig[, fresh]).

    Equal signatures of a block are one point, linked to its other members by a star. The points of a block
    are packed into tiles, a row each; a task finds the components of a tile once, or takes two tiles and
    returns the links that join their components, never the pairs. With a boolean ``fresh`` two tiles without a fresh member aren't compared: their links are known.
    """
    rows = keyed if "fresh" in keyed.columns else keyed.withColumn("fresh", F.lit(True))
    points = materialize(rows.groupBy("block", "sig").agg(F.min("node").alias("point"), F.count_distinct("node").alias("n"), F.max("fresh").alias("fresh")), "points")
    stars = rows.join(points.where("n > 1 and fresh").select("block", "sig", "point"), ["block", "sig"]).where("node != point").select(F.col("point").alias("a"), F.col("node").alias("b"))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pa.array([_roots(_numbers(s.values), radius) for s in batch.column("sig")], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "root"])

    packed = _pack(points, "sig", ["point", "sig"], tile)
    kinds = dict(packed.dtypes)
    spread = _spread(packed, "block", "name").mapInArrow(inside, ", ".join(f"{c} {kinds[c]}" for c in packed.columns) + ", root array<long>")
    tiles = materialize(spread, "tiles")
    own = tiles.where("name.fresh").select(F.explode(F.filter(F.zip_with(F.transform("root", lambda r: F.get("point", r.cast("int"))), "point", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: x.a != x.b)).alias("x")).select("x.*")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sides in _rows(batches):
            points, sigs, roots, more_points, more_sigs, more_roots = map(_numbers, sides)
            x, y = cross_links(points, sigs, more_points, more_sigs, radius, roots, more_roots)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    return own.union(_facing(tiles, ["point", "sig", "root"]).mapInArrow(across, "a long, b long")).union(stars)


def document_blocks(paths: DataFrame, signatures: DataFrame) -> DataFrame:
    """(block, hash, sig and what else signatures have): the folders and normal stems of every active path, whatever the drive."""
    seen = paths.where("status = 'active'").select("hash", "path").join(signatures, "hash")
    keys = F.array(F.concat(F.lit("d:"), parent_dir(F.col("path"))), F.concat(F.lit("s:"), normal_stem(F.col("path"))))
    return seen.select(F.explode(keys).alias("block"), *signatures.columns).distinct()


def document_links(paths: DataFrame, signatures: DataFrame, radius: int = DOC_RADIUS) -> DataFrame:
    """Links (a, b) of nodes, which stand for hashes, with the components of :func:`document_pairs`; signatures(hash, sig[, fresh])."""
    wanted = ["hash", "sig", *(["fresh"] if "fresh" in signatures.columns else [])]
    rows = document_blocks(paths, signatures.select(*wanted)).withColumn("node", node_of(F.col("hash"))).drop("hash")
    return block_links(rows, radius)


def document_pairs(paths: DataFrame, signatures: DataFrame, radius: int = DOC_RADIUS) -> DataFrame:
    """Pairs that share a folder or a normal stem in any active path, whatever the drive."""
    return block_pairs(document_blocks(paths, signatures.select("hash", "sig")), radius)


def band_pairs(signatures: DataFrame, radius: int = IMAGE_RADIUS, bands: int = BANDS, tile: int = TILE) -> DataFrame:
    """Pairs of equal aspect with a band in common and within the radius.

    Signatures that say nothing are left out. Equal signatures of an aspect are compared once;
    the pairs of their members are put together tile by tile.
    """
    kept, close = _close_shapes(signatures, radius, bands, tile)
    equal = block_pairs(kept.select(F.col("shape").alias("block"), "hash", "sig"), radius, tile)
    tiles = kept.groupBy("shape").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    members = kept.join(tiles, "shape").select("shape", F.pmod(F.xxhash64("hash"), F.col("tiles")).cast("int").alias("tile"), "hash")
    for side in ("a", "b"):
        close = close.join(tiles.select(F.col("shape").alias(side), "tiles"), side)
        close = close.withColumn(f"{side}_tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).drop("tiles")
    close = materialize(close, "close-shapes")
    keys = ["a", "a_tile", "b", "b_tile", "distance"]
    left, right = (close.join(members.select(F.col("shape").alias(s), F.col("tile").alias(f"{s}_tile"), F.col("hash").alias(f"{s}_hash")), [s, f"{s}_tile"]) for s in ("a", "b"))
    across = left.join(right, keys).where("a_hash != b_hash")
    across = across.select(F.least("a_hash", "b_hash").alias("a"), F.greatest("a_hash", "b_hash").alias("b"), "distance")
    return equal.union(across).distinct()


def band_links(signatures: DataFrame, radius: int = IMAGE_RADIUS, bands: int = BANDS, tile: int = TILE) -> DataFrame:
    """Links (a, b) with the components of :func:`band_pairs`: a star for each group of equal signatures."""
    kept, close = _close_shapes(signatures, radius, bands, tile)
    first = kept.groupBy("shape").agg(F.min("hash").alias("first"))
    stars = kept.join(first, "shape").where("hash != first").select(F.col("first").alias("a"), F.col("hash").alias("b"))
    ends = close.join(first.select(F.col("shape").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("shape").alias("b"), F.col("first").alias("y")), "b")
    return stars.union(ends.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()


def _close_shapes(signatures: DataFrame, radius: int, bands: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """(hash, sig, aspect, shape) of what is compared, and pairs (a, b, distance) of shapes: signatures of an aspect."""
    kept = signatures.where(informative(F.col("sig")) & F.col("aspect").isNotNull()).select("hash", "sig", "aspect").distinct()
    kept = materialize(kept.withColumn("shape", F.concat_ws("|", "aspect", to_hex(F.col("sig")))), "shapes")
    shapes = kept.select(F.col("shape").alias("hash"), "sig", "aspect").distinct()
    rows = _banded(shapes, bands).select(F.concat_ws("|", "aspect", "i", "value").alias("block"), "hash", "sig")
    return kept, block_pairs(rows, radius, tile)


def skipped_buckets(signatures: DataFrame, bands: int = BANDS, cap: int = BUCKET_CAP) -> DataFrame:
    """Buckets over ``cap``, which the reference skips; nothing here does."""
    rows = _banded(signatures.where(informative(F.col("sig"))).select("hash", "sig", "aspect"), bands)
    return rows.groupBy("aspect", "i", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cap)


def _banded(rows: DataFrame, bands: int) -> DataFrame:
    return rows.select("hash", "sig", "aspect", F.posexplode(F.array(*[band(F.col("sig"), F.lit(i)) for i in range(bands)])).alias("i", "value"))


def node_of(key: Column) -> Column:
    """A 64-bit number that stands for a hash while components are found."""
    return F.xxhash64(key)


def components_of(pairs: DataFrame) -> DataFrame:
    """(hash, component) of pairs of hashes; a component is named by its smallest hash."""
    hashes = pairs.select(F.explode(F.array("a", "b")).alias("hash")).distinct()
    return named_components(pairs.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b")), hashes)


def named_components(links: DataFrame, hashes: DataFrame) -> DataFrame:
    """(hash, component) of links of nodes; see :func:`named`."""
    return named(connected_components(links, "a", "b"), hashes)


def named(components: DataFrame, hashes: DataFrame) -> DataFrame:
    """(hash, component) of components(node, component), named by their smallest hash; ``hashes`` are unique and may hold others too."""
    placed = materialize(hashes.select("hash", node_of(F.col("hash")).alias("node")).join(components, "node"), "placed")
    names = placed.groupBy("component").agg(F.min("hash").alias("name"))
    return placed.join(names, "component").select("hash", F.col("name").alias("component"))


def grown_documents(paths: DataFrame, signatures: DataFrame, known: DataFrame, radius: int = DOC_RADIUS) -> tuple[DataFrame, DataFrame]:
    """(changed rows (node, component), merges (component, into)) when documents were added to known(node, component).

    ``signatures(hash, sig, fresh)`` says which are new; only tiles with new documents are compared, and only their links
    are followed. A document that only has new locations is fresh too.
    """
    return grow_components(known, document_links(paths, signatures, radius), "a", "b")


def document_clusters(paths: DataFrame, signatures: DataFrame, clustered: DataFrame, radius: int = DOC_RADIUS) -> DataFrame:
    found = named_components(document_links(paths, signatures, radius), signatures.select("hash").distinct())
    return as_clusters(without_overlap(found, clustered), "doc_version", "document versions")


def image_clusters(signatures: DataFrame, clustered: DataFrame, radius: int = IMAGE_RADIUS, most: int | None = MAX_IMAGE_CLUSTER) -> DataFrame:
    """Clusters of at most ``most`` images, the usual rule against runaway chains; None keeps all."""
    found = components_of(band_links(signatures, radius))
    return as_clusters(without_overlap(found, clustered), "near_image", "similar images", most)


def oversize(components: DataFrame, most: int = MAX_IMAGE_CLUSTER) -> DataFrame:
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
