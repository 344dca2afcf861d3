"""Merge on read: a table's base rows under a log of changed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OP, SEQ = "__op", "__seq"


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("int")


def newest(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The last change of each key: changes(columns, __op, __seq), in which of one ``__seq`` a key has one row; combined before the shuffle."""
    others = [c for c in changes.columns if c not in (*keys, SEQ)]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*others), SEQ).alias("__row")).select(*keys, "__row.*")


def merged(base: DataFrame | None, changes: DataFrame, keys: list[str], small: bool = False) -> DataFrame:
    """Base rows without a change, and the last put of each key; a key whose last change is a delete is gone.

    ``small`` says that the changes' size was checked: they are then folded in one task, without a shuffle,
    and their keys are broadcast. Else both sides are shuffled by key. Keys may hold nulls, which only
    equal each other in the changes. Without a base the changes are all there is.
    """
    last = newest(changes.coalesce(1) if small else changes, keys)
    put = last.where(F.col(OP) == "put").drop(OP)
    if base is None:
        return put
    gone = last.select(*keys)
    kept = base.join(F.broadcast(gone) if small else gone, keys, "left_anti")
    return kept.unionByName(put.select(*base.columns))
