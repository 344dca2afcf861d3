"""Product codes of integer vectors: a codebook for each part, trained by sums over RDD blocks.

A task packs vectors into blocks of columns, one NumPy array (component, vector) of 32-bit integers each,
which are written to the shared folder. Each round is one ``treeAggregate`` over the blocks:
distances grow component by component, ``np.add.at`` puts a block's vectors into sum and count
tensors of the codebooks' size, and the tensors are added along a tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnworks.llm.batches import map_arrow
from cairnworks.llm.columns import join_spread
from cairnworks.llm.vectors import integer_vectors, matrix
from cairnworks.scratch import discard, materialize

#: Vectors of a block at most.
BLOCK = 4096


def to_blocks(vectors: DataFrame, dims: int) -> DataFrame:
    """(ids, labels, block): ``vectors(vec_id, label, v)`` packed, each task its own."""
    label = vectors.schema["label"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                part = batch.slice(k, BLOCK)
                block = np.ascontiguousarray(matrix(part.column(2), dims).T.astype(np.int32)).tobytes()
                ends = pa.array([0, part.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, part.column(0)), pa.ListArray.from_arrays(ends, part.column(1)), pa.array([block])], names=["ids", "labels", "block"])

    return map_arrow(vectors.select("vec_id", "label", "v"), pack, f"ids array<bigint>, labels array<{label}>, block binary")


def nearest_entries(block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries (part, vector) nearest to a block's parts and their squared distances; of ties the lower entry."""
    parts, entries, width = books.shape
    best = np.zeros((parts, block.shape[1]), np.int64)
    least = np.zeros((parts, block.shape[1]), np.int64)
    for p in range(parts):
        distance = np.zeros((entries, block.shape[1]), np.int64)
        for j in range(width):
            apart = block[p * width + j][None, :] - books[p, :, j][:, None]
            distance += apart * apart
        best[p] = distance.argmin(axis=0)
        least[p] = distance.min(axis=0)
    return best, least


def trained(blocks: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """The codebooks after ``rounds`` rounds; an entry becomes its parts' mean, rounded down, unused ones stay."""
    parts, entries, width = books.shape
    dims = parts * width
    held = blocks.select("block").rdd.map(lambda r: np.frombuffer(r[0], np.int32).reshape(dims, -1).astype(np.int64))
    for _ in range(rounds):

        def add(tensors, block, books=books):
            sums, counts = tensors
            best, _ = nearest_entries(block, books)
            for p in range(parts):
                np.add.at(counts[p], best[p], 1)
                for j in range(width):
                    np.add.at(sums[p, :, j], best[p], block[p * width + j])
            return sums, counts

        zero = (np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64))
        sums, counts = held.treeAggregate(zero, add, lambda a, b: (a[0] + b[0], a[1] + b[1]))
        books = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)
    return books


def encode_vectors(
    table: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, dims: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> tuple[DataFrame, np.ndarray]:
    """(rows (vec_id, label, code, error, slot), codebooks (part, entry, component)).

    Vectors are integers floor(scale * x). The codebooks start as the parts of the vectors with the smallest
    ids; a code has an index below ``entries`` for each part, in two hexadecimal digits; ``error`` is the squared
    distance to what the code stands for. ``slot`` is any number that spreads rows.
    Null vectors and those with null or non-finite components are left out, and so are vectors of other lengths than
    ``dims``, which have no distance to the others. Repeated rows and ids count each; null ids and labels stay, null
    ids are the largest; rows of one id start in the order of their vectors. Fewer vectors than ``entries`` give
    fewer entries; an empty table gives no rows. Columns but the three named are not read.
    """
    if dims % parts or entries > 256:
        raise ValueError("parts must be equal and entries fit two hexadecimal digits")
    spark = table.sparkSession
    named = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("x"))
    vectors = integer_vectors(named, scale, dims, "vec_id", "label", vector_col="x")
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()  # as many as a codebook has
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, dims // parts).transpose(1, 0, 2)
    label = vectors.schema["label"].dataType.simpleString()
    schema = f"vec_id long, label {label}, code string, error long, slot int"
    if not first:
        return spark.createDataFrame([], schema), books
    blocks = materialize(to_blocks(vectors, dims), "vector-blocks")
    books = trained(blocks, books, rounds)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, labels, data = (c.slice(k, 1) for c in batch.columns)
                block = np.frombuffer(data[0].as_buffer(), np.int32).reshape(dims, -1).astype(np.int64)
                best, least = nearest_entries(block, books)
                codes = [row.tobytes().hex() for row in best.T.astype(np.uint8)]
                slots = np.arange(block.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([ids.flatten(), labels.flatten(), pa.array(codes), pa.array(least.sum(axis=0)), pa.array(slots)], names=["vec_id", "label", "code", "error", "slot"])

    rows = materialize(map_arrow(blocks, encode, schema), "vector-codes")
    discard(blocks)
    return rows, books


def with_label_error(rows: DataFrame) -> DataFrame:
    """Adds the error summed over equal labels; rows of a label are spread by their slots when they meet the sum."""
    keyed = rows.withColumn("key", F.to_json(F.struct("label")))
    sums = keyed.groupBy("key").agg(F.sum("error").alias("label_error"))
    return join_spread(keyed, sums, "key", "slot").drop("key", "slot")


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
