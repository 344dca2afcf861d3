"""Joins that no hot key can fill."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnworks.scratch import shuffle_partitions


def join_spread(rows: DataFrame, table: DataFrame, keys: list[str], by: str) -> DataFrame:
    """``rows`` joined to ``table``, unique in ``keys``: its rows are copied to the salts their keys have, hashes of ``by``.

    A key with a third of all rows is met in as many tasks as the shuffle has.
    """
    salt = F.pmod(F.xxhash64(by), F.lit(shuffle_partitions(rows.sparkSession))).cast("int")
    salted = rows.withColumn("__salt", salt)
    copies = salted.select(*keys, "__salt").distinct().join(table, keys)
    return salted.join(copies, [*keys, "__salt"]).drop("__salt")
