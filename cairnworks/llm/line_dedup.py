"""Line deduplication over range-partitioned hashes (DataFrame operations only).

Every long line of every document becomes (hash, document, position). Those rows are range
partitioned and sorted by hash, document and position, so a line that fills a third of the
corpus spreads over as many partitions as it has rows for. Within a partition each hash is one
sorted run: a row whose document differs from the row before it is a first occurrence, and the run's
last row holds its largest document. A hash that crosses partitions has its run in each of them;
those runs, one first and one last for each partition at most, are carried over to each other as
one small table. Later steps run on (partition, hash), of which no key holds more than
one partition's share. The largest document that holds a frequent line keeps it; the operator
returns run-length compressed keep bitmaps for each document, never text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnworks.llm.columns import ascii_lower, whole_text
from cairnworks.scratch import discard, materialize, shuffle_partitions

#: [\x20\x09-\x0D]
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Rows (doc_id, text_hash, n_lines, n_dropped, keep_runs), one for each document that loses lines.

    A line's key is the line, stripped of blanks and with A-Z lower-cased. Keys of at least
    ``min_chars`` code points found in at least ``min_docs`` documents (rows) go from all of
    them but the one with the largest id; equal largest ids all keep theirs. ``keep_runs`` is
    the bitmap of kept lines as runs (first, length). Null or empty text is one empty line. A
    null id is smaller than any other. Rows with equal id and text get one common bitmap.
    Other columns are not read; an empty table gives an empty result.
    """
    n = shuffle_partitions(docs.sparkSession)
    text = whole_text(text_col)
    keys = F.transform(F.split("t", "\n"), lambda line: line_key(line))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t")).select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        F.xxhash64("t").alias("text_hash"),
        F.transform(keys, lambda k: F.when(F.char_length(k) >= min_chars, F.unhex(F.substring(F.sha2(k, 256), 1, 32)))).alias("hs"),
    )
    rows = materialize(rows, "lines")

    placed = rows.select("doc_id", "row", "text_hash", F.size("hs").alias("n_lines"), F.posexplode("hs").alias("pos", "h")).where("h is not null")
    placed = placed.repartitionByRange(n, "h", "doc_id", "row", "pos").sortWithinPartitions("h", "doc_id", "row", "pos")
    placed = materialize(placed.withColumn("part", F.spark_partition_id()), "placed-lines")
    discard(rows)

    in_order = Window.partitionBy("part", "h").orderBy("doc_id", "row", "pos")
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.coalesce(F.lag("row").over(in_order) != F.col("row"), F.lit(True))
    runs = placed.withColumn("first", first.cast("long"))
    runs = runs.withColumn("n_docs", F.sum("first").over(whole)).withColumn("owner", F.last("doc_id").over(whole))
    carried = materialize(_carried(placed), "carried-lines")
    # at most one row for each partition and the next
    both = runs.join(F.broadcast(carried), "h", "left").select("doc_id", "text_hash", "n_lines", "pos", F.coalesce("all_docs", "n_docs").alias("n_docs"), F.when(F.col("all_docs").isNull(), F.col("owner")).otherwise(F.col("all_owner")).alias("owner"))
    gone = both.where((F.col("n_docs") >= min_docs) & F.col("owner").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") < F.col("owner"))))
    dropped = gone.groupBy("doc_id", "text_hash").agg(F.max("n_lines").alias("n_lines"), F.sort_array(F.collect_set("pos")).alias("drops"))
    return dropped.select("doc_id", "text_hash", "n_lines", F.size("drops").alias("n_dropped"), _keep_runs().alias("keep_runs"))


def _carried(placed: DataFrame) -> DataFrame:
    """Rows (h, all_docs, all_owner) of the hashes whose runs cross partitions.

    Such a hash is the last of one partition and the first of another, so there are fewer than
    partitions. A document whose lines go on in the next partition is counted once.
    """
    edges = placed.groupBy("part").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    crossing = edges.select(F.explode(F.array_distinct(F.array("low", "high"))).alias("h")).groupBy("h").count().where("count > 1").select("h")
    document = F.struct("doc_id", "row")
    pieces = placed.join(F.broadcast(crossing), "h").groupBy("h", "part").agg(F.count_distinct("row").alias("n"), F.min(document).alias("first"), F.max(document).alias("last"))
    goes_on = F.lag("last.row").over(Window.partitionBy("h").orderBy("part")) == F.col("first.row")
    pieces = pieces.withColumn("n", F.col("n") - F.when(goes_on, 1).otherwise(0))
    return pieces.groupBy("h").agg(F.sum("n").alias("all_docs"), F.max("last.doc_id").alias("all_owner"))


def _keep_runs() -> Column:
    """Complement, as runs, of the sorted positions in ``drops``."""
    starts = F.expr("filter(drops, (p, i) -> i = 0 or drops[i - 1] != p - 1)")
    ends = F.expr("filter(drops, (p, i) -> i = size(drops) - 1 or drops[i + 1] != p + 1)")
    first = F.concat(F.array(F.lit(0)), F.transform(ends, lambda p: p + 1))
    after = F.concat(starts, F.array(F.col("n_lines")))
    runs = F.zip_with(first, after, lambda a, b: F.struct(a.alias("first"), (b - a).alias("length")))
    return F.filter(runs, lambda r: r["length"] > 0)


def drop_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_lines, n_dropped, kept_text), one for each document."""
    base = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("t")).withColumn("text_hash", F.xxhash64("t")).alias("a")
    marks = bitmaps.select("doc_id", "text_hash", "n_dropped", "keep_runs").alias("b")
    both = base.join(marks, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash")), "left")
    lines = F.split("t", "\n")
    kept = F.array_join(F.flatten(F.expr("transform(keep_runs, r -> slice(split(t, '\\n'), r.first + 1, r.length))")), "\n")
    return both.select(
        F.col("a.doc_id").alias("doc_id"),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("keep_runs").isNull(), F.col("t")).otherwise(kept).alias("kept_text"),
    )
