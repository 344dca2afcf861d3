"""Current state from an append-only log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key; tombstones (op = 'delete') then go."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return log.withColumn("__nth", nth).where("__nth = 1 and op != 'delete'").drop("__nth", "op")
