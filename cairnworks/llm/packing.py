"""Packing documents into sequences by a configuration linear program.

Pieces of documents are known by their lengths alone, so the histogram of lengths (one count for
each length up to the capacity) is all that reaches the driver, where the program of
``configuration_lp`` is solved and rounded. The plan, runs of equal sequences, has a size bounded by
the capacity, whatever the number of documents. Executors place each piece by its length and its
rank among the pieces of that length.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnworks.llm import configuration_lp
from cairnworks.llm.batches import by_bytes, map_batches
from cairnworks.llm.columns import whole_text
from cairnworks.llm.configuration_lp import Plan
from cairnworks.llm.tokens import LOOKUP_BYTES, IdEncoder, whole_ids
from cairnworks.scratch import materialize

CAPACITY = 4096
END_ID = 1


def pack_lengths(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Runs (number of sequences, {length: copies in each}) that hold exactly the histogram's pieces."""
    return configuration_lp.pack_lengths(histogram, capacity)


def _slots(plan: Plan) -> dict[str, np.ndarray]:
    """For each run and length: its ranks among that length's pieces, and where they go."""
    rows, used, sequence = [], Counter(), 0
    for times, pattern in plan:
        offset = 0
        for length, copies in pattern.items():
            rows.append((length, used[length], sequence, copies, offset))
            used[length] += times * copies
            offset += length * copies
        sequence += times
    rows.sort()
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(("length", "rank", "sequence", "copies", "offset"))}


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): each document's ids, then END_ID, cut at ``capacity``."""

    def make():
        encoder = IdEncoder(tokenizer)

        def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for first, end in by_bytes(texts, LOOKUP_BYTES):
                part = texts.slice(first, end - first).to_pylist()
                all_ids = [whole_ids(encoder, part[0])] if len(part) == 1 else encoder.encode(part)
                for key, ids in zip(keys[first:end], all_ids, strict=True):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4", copy=False)
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        piece = ids[start : start + capacity]
                        out.append((key, k, start, len(piece), zlib.crc32(piece)))
            cols = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

        return cut

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("t"))
    return map_batches(rows, make, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one for each piece.

    Null text counts as empty; an empty document is END_ID alone. Documents of more than
    ``capacity`` tokens are cut into full pieces and a last, shorter one. Repeated rows and null
    ids are packed as documents of their own; other columns are not read; an empty table gives
    an empty result. In every sequence offsets run from 0 without gaps.
    """
    spark = docs.sparkSession
    rows = materialize(token_pieces(docs, tokenizer, capacity, id_col, text_col).withColumn("part", F.spark_partition_id()), "token-pieces")
    shares = rows.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = dict(rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect())  # at most ``capacity`` rows
    slots = spark.sparkContext.broadcast(_slots(pack_lengths(histogram, capacity)))

    inside = Window.partitionBy("part", "length").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = rows.withColumn("nth", F.row_number().over(inside)).join(shares, ["part", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth") - 1).alias("rank"))

    def make():
        s = slots.value
        spread = np.int64(1 << 44)
        keys = s["length"] * spread + s["rank"]

        def place(batch: pa.RecordBatch) -> pa.RecordBatch:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(keys, length * spread + rank, side="right") - 1
            nth = rank - s["rank"][at]
            sequence = s["sequence"][at] + nth // s["copies"][at]
            offset = s["offset"][at] + nth % s["copies"][at] * length
            return pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"]
            )

        return place

    return map_batches(ranked, make, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
