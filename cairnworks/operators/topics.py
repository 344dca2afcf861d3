"""Topics: inference back ends, tags, groups and clusters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnworks.functions.names import is_text
from cairnworks.functions.text import heading, model_answer, slug
from cairnworks.operators.clusters import as_clusters, without_overlap

TOPIC_CHARS = 8192


def infer_by_heading(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, topic, slug, kind, confidence) of texts that start with a Markdown heading."""
    found = rows.select(key, heading(F.substring(F.col(text), 1, TOPIC_CHARS)).alias("topic")).where("topic is not null")
    return found.select(key, "topic", slug(F.col("topic")).alias("slug"), F.lit("document").alias("kind"), F.lit(0.9).alias("confidence"))


def infer_by_model(rows: DataFrame, key: str, text: str, make: Callable[[], Callable[[str], str]]) -> DataFrame:
    """(key, topic, slug, kind, confidence) from a model's answers; texts without a usable one are left out.

    ``make()`` runs once for each task and gives the function that asks the model.
    """
    kind = dict(rows.dtypes)[key]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "answer": [model(t) for t in batch["t"]]})

    asked = rows.select(key, F.substring(F.coalesce(F.col(text), F.lit("")), 1, TOPIC_CHARS).alias("t")).mapInPandas(ask, f"{key} {kind}, answer string")
    return asked.select(key, model_answer(F.col("answer")).alias("r")).where("r is not null").select(key, "r.*")


def keyed_texts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text_key, t): what a model is shown of each text, and its hash; equal ones are asked once."""
    shown = rows.select(key, F.substring(F.coalesce(F.col(text), F.lit("")), 1, TOPIC_CHARS).alias("t"))
    return shown.select(key, F.sha2("t", 256).alias("text_key"), "t")


def unanswered(texts: DataFrame, answers: DataFrame) -> DataFrame:
    """(text_key, t) of texts that no answer is known for, each once."""
    return texts.join(answers.where("answer is not null").select("text_key"), "text_key", "left_anti").groupBy("text_key").agg(F.first("t").alias("t"))


def infer_by_answers(texts: DataFrame, key: str, answers: DataFrame) -> DataFrame:
    """(key, topic, slug, kind, confidence) of texts(key, text_key) with a usable answer."""
    found = answers.select("text_key", model_answer(F.col("answer")).alias("r")).where("r is not null")
    return texts.select(key, "text_key").join(found, "text_key").select(key, "r.*")


def untagged_texts(locations: DataFrame, tags: DataFrame, limit: int | None = None) -> DataFrame:
    """Active text files without a topic; the first by hash where a limit is given."""
    rows = locations.where(is_text(F.col("rel"), F.col("mime"))).join(tags.where("key = 'topic_slug'").select("hash"), "hash", "left_anti")
    return rows if limit is None else rows.orderBy("hash").limit(limit)


def as_tags(inferred: DataFrame, source: str) -> DataFrame:
    """Three tags a file: topic, topic_slug, topic_file_kind."""
    return inferred.select(
        "hash",
        F.explode(F.create_map(F.lit("topic"), "topic", F.lit("topic_slug"), "slug", F.lit("topic_file_kind"), "kind")).alias("key", "value"),
        F.lit(source).alias("source"),
        F.col("confidence").cast("double").alias("confidence"),
    )


def topic_groups(tags: DataFrame, paths: DataFrame, min_size: int = 2) -> DataFrame:
    """(slug, label, n_hashes, hash): active files of each slug with enough of them."""
    live = paths.where("status = 'active'").select("hash").distinct()
    slugs = tags.where("key = 'topic_slug'").select(F.col("value").alias("slug"), "hash").distinct().join(live, "hash", "left_semi")
    labels = tags.where("key = 'topic'").groupBy("hash").agg(F.min("value").alias("label"))
    rows = slugs.join(labels, "hash", "left")
    sized = rows.groupBy("slug").agg(F.count(F.lit(1)).alias("n_hashes"), F.min("label").alias("label")).where(F.col("n_hashes") >= min_size)
    return slugs.join(sized, "slug").select("slug", F.coalesce("label", "slug").alias("label"), "n_hashes", "hash")


def topic_clusters(tags: DataFrame, paths: DataFrame, clustered: DataFrame, min_size: int = 2) -> DataFrame:
    groups = topic_groups(tags, paths, min_size).select(F.col("slug").alias("component"), "hash", F.col("label").alias("topic"))
    kept = without_overlap(groups, clustered)
    built = as_clusters(kept.select("component", "hash"), "topic", "topic")
    labels = kept.groupBy("hash", "component").agg(F.min("topic").alias("topic"))
    return built.drop("label").join(labels, "hash").select("cluster_id", "kind", F.col("topic").alias("label"), "hash").distinct()
