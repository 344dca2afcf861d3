"""Column expressions and a join that several operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnworks.scratch import shuffle_partitions


def whole_text(name: str) -> Column:
    """The text, a null one as the empty string."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; text of one byte a character takes the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def join_spread(rows: DataFrame, table: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` joined to ``table``, unique in ``key``, by way of salted keys.

    The table's rows are copied to the salts that their key has, so a key with a third of all
    rows is spread by the hash of ``by`` over as many tasks as the shuffle has.
    """
    salt = F.pmod(F.xxhash64(by), F.lit(shuffle_partitions(rows.sparkSession))).cast("int")
    salted = rows.withColumn("_salt", salt)
    copies = salted.select(key, "_salt").distinct().join(table, key)
    return salted.join(copies, [key, "_salt"]).drop("_salt")
