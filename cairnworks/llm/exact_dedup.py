"""Exact deduplication by skew-safe combining (DataFrame operations only).

Three combining steps, each grouping on digest *and* full text, so a digest collision can
never merge two texts:

1. copies meet within each input partition (the map side of the first aggregate);
2. rows that share a salt, a hash of their id, merge their digest groups;
3. the winners of all salts are combined into one group for each text.

A group with a third of all rows reaches step 3 as one row for each salt. The way back from a group
to its rows carries no text: step 3 has compared all texts of a digest, so where it found one text
the digest names the group, and rows are met by (digest, salt), of which no key is hot.
Where it found several, those rows alone are met by digest and text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnworks.llm.columns import ascii_lower, whole_text
from cairnworks.scratch import materialize, shuffle_partitions


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row (doc_id, keep_id, group_size, kept, text_sha256) for each input row.

    Texts are equal when identical after lower-casing A-Z. The row with the largest id stays.
    Null text counts as empty; a null id is smaller than any other; of repeated rows with the
    winning id exactly one is kept, any of them. Other columns, whatever their names, are not read.
    An empty table gives an empty result. ``digest`` may collide.
    """
    salts = shuffle_partitions(docs.sparkSession)
    id_ = F.col(id_col)
    rows = docs.select(id_.alias("id"), ascii_lower(whole_text(text_col)).alias("t"), F.pmod(F.xxhash64(id_), F.lit(salts)).cast("int").alias("salt"))
    rows = rows.select("id", "t", digest(F.col("t")).alias("d"), "salt")

    salted = rows.groupBy("d", "salt", "t").agg(F.max("id").alias("w"), F.count(F.lit(1)).alias("n"))
    groups = salted.groupBy("d", "t").agg(F.max("w").alias("keep_id"), F.sum("n").alias("group_size"))
    proven = groups.groupBy("d").agg(F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
    proven = materialize(proven, "digest-groups")

    one = proven.where("texts = 1").select("d", "keep_id", "group_size")
    light = rows.select("id", "d", "salt", F.lower(F.hex("d" if digest is sha256 else sha256(F.col("t")))).alias("text_sha256"))
    spread = light.select("d", "salt").distinct().join(one, "d")
    found = light.join(spread, ["d", "salt"])
    if proven.where("texts > 1").limit(1).count():
        clash = proven.where("texts > 1").select("d")
        own = rows.join(clash, "d", "left_semi")
        mixed = own.select("d", "salt", "t").distinct().join(groups.join(clash, "d", "left_semi"), ["d", "t"])
        met = own.join(mixed, ["d", "salt", "t"]).withColumn("text_sha256", F.lower(F.hex(sha256(F.col("t")))))
        found = found.unionByName(met.select(*found.columns))
    wins = F.col("id").eqNullSafe(F.col("keep_id"))
    # tells repeated rows with the winning id apart; all of them have one salt
    nth = F.row_number().over(Window.partitionBy("d", "salt", "text_sha256", "id").orderBy(F.lit(1)))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", (wins & (nth == 1)).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, all columns, of each group of :func:`exact_groups`: the one with the largest id.

    The same three steps, with the best row so far in place of the ids, so that nothing has to
    be looked up afterwards. Repeated rows with the winning id give one row.
    """
    salts = shuffle_partitions(docs.sparkSession)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"),
        F.struct(F.col(id_col), F.xxhash64(whole_text(text_col))).alias("rank"),
        ascii_lower(whole_text(text_col)).alias("t"),
        F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"),
    )
    rows = rows.select("r", "rank", "t", F.unhex(F.sha2("t", 256)).alias("d"), "salt")
    best = (F.max_by("r", "rank").alias("r"), F.max("rank").alias("rank"))
    return rows.groupBy("d", "salt", "t").agg(*best).groupBy("d", "t").agg(*best).select("r.*")
