"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``, for the documents they keep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairnworks.llm import decontaminate, exact_dedup, langid, packing, simhash_dedup
from cairnworks.llm.queries import TOKENIZER
from cairnworks.scratch import discard, materialize, scratch_scope


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows, which is trained on the labelled ones of ``docs``.

    Null and empty text and text without a letter go. Repeated rows are judged alike and stay
    repeated; where no row has a label all go; an empty table stays empty.
    """
    return langid.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal documents the one with the largest id.

    Null text counts as empty and null ids as smallest; of repeated rows with the winning id one
    stays, any of those that tie; an empty table stays empty.
    """
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id.

    Null and empty texts are near copies of each other; a null id stays only where its component has
    no other; of repeated rows one stays; an empty table stays empty.
    """
    return simhash_dedup.drop_near_copies(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without contamination.

    Null and empty texts are clean. Repeated rows are judged alike and stay repeated; an empty
    benchmark contaminates nothing; an empty table stays empty.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest as pieces in sequences, one row for each piece.

    Null text is an empty document, its end token alone; repeated rows and null ids are packed as
    documents of their own; an empty table gives no rows.
    """
    return packing.pack(docs, TOKENIZER)


STAGES = [("language", language), ("exact", exact), ("near", near), ("benchmark", benchmark), ("pack", pack)]

#: Language models, fingerprints' components and packing are beyond SQL; tests hold each stage
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = docs
        with scratch_scope(spark) as keep:  # what a stage left behind goes, and so does its input
            docs = keep(materialize(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
