"""Running sums within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnworks.scratch import materialize, shuffle_partitions


def running_sum(rows: DataFrame, keys: list[str], order: list[str], value: Column, to: str) -> DataFrame:
    """``rows`` with ``to``: the sum of ``value`` over the rows of equal keys up to each, in the order given.

    Rows are dealt by ranges of keys and order, so a key with a third of all rows lies in as many tasks as
    its share asks for. Each task sums its stretch of a key; what lies before a stretch is carried over from
    the stretches' totals, of which a key has at most one for each partition. Nulls sort first and are keys
    like others. Rows with equal keys and order are summed in any order.
    """
    dealt = rows.withColumn(to, value).repartitionByRange(shuffle_partitions(rows.sparkSession), *keys, *order)
    dealt = materialize(dealt.withColumn("stretch", F.spark_partition_id()), "running-sum")
    before = Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("stretch", *keys).agg(F.sum(to).alias("own"))
    carried = totals.withColumn("carried", F.sum("own").over(before)).where("carried is not null").drop("own")
    inside = Window.partitionBy("stretch", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    a, b = dealt.withColumn(to, F.sum(to).over(inside)).alias("a"), carried.alias("b")
    same = F.col("a.stretch") == F.col("b.stretch")
    for key in keys:
        same &= F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}"))
    total = (F.col(f"a.{to}") + F.coalesce("b.carried", F.lit(0))).alias(to)
    return a.join(b, same, "left").select(*[F.col(f"a.{c}") for c in rows.columns], total)
