"""Connected components by alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Each round is two
grouped minima (combined before the shuffle) and two equi-joins whose large partitions
adaptive execution may split, so a hub with a third of all edges does not end in one task.
Only a count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnworks.scratch import discard, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Rows (node, component): every node of an edge, with the smallest node it can reach.

    Self loops keep their node as a component of its own; rows with a null end are ignored;
    repeated edges count once. An empty edge table gives an empty result.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    links = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    all_links, state = links, None
    for _ in range(max_rounds):
        after = materialize(_small_star(_large_star(links.where("u != v"))), "edges")
        now = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if links is not all_links:
            discard(links)
        links = after
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = all_links.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select(
        "node", F.coalesce("root", "node").alias("component")
    )


def _minima(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    """Joins every larger neighbour to the smallest node around ``u``."""
    both = links.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
    m = _minima(both).select("u", F.least("u", "m").alias("m"))
    return both.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Joins ``u`` and its smaller neighbours to the smallest of them."""
    m = _minima(links)
    moved = links.join(m, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(m.select("u", "m")).distinct()


def grow_components(known: DataFrame, edges: DataFrame, src: str = "src", dst: str = "dst") -> tuple[DataFrame, DataFrame]:
    """(changed rows (node, component), merges (component, into)) when ``edges`` are added to the components known(node, component).

    Each end of a new edge stands for its old component, itself if it has none, and components are found among
    those alone: rounds follow the new edges, however many are known. The known table is read twice, for the
    ends and for members of components that merged. Components are named by their smallest node, as by
    :func:`connected_components`, so growing by parts gives the same table as all edges at once.
    """
    e = materialize(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null").distinct(), "new-edges")
    ends = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    old = known.select("node", "component")
    placed = materialize(ends.join(old.join(ends, "node", "left_semi"), "node", "left").select("node", F.col("component").alias("had"), F.coalesce("component", "node").alias("at")), "ends")
    side = lambda name, at: placed.select(F.col("node").alias(name), F.col("at").alias(at))
    contracted = e.join(side("u", "a"), "u").join(side("v", "b"), "v").select("a", "b")
    found = materialize(connected_components(contracted, "a", "b"), "grown")
    merges = found.where("node != component").join(placed.where("had is not null").select(F.col("had").alias("node")).distinct(), "node", "left_semi")
    merges = merges.select(F.col("node").alias("component"), F.col("component").alias("into"))
    moved = old.join(merges, "component").select("node", F.col("into").alias("component"))
    fresh = placed.where("had is null").select("node").join(found, "node").select("node", "component")
    return moved.union(fresh), merges
