"""Expressions over text: tokens, shingles, titles, slugs, model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"
KINDS = ("document", "note", "receipt", "code", "other")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def joined_tokens(text: Column) -> Column:
    """The same with one space between them."""
    return F.btrim(F.regexp_replace(F.lower(text), TOKEN.replace("[", "[^"), " "), F.lit(" "))


def shingles(words: Column, k: int) -> Column:
    """Every k words in a row; all words where they are fewer; none without words.

    ``words`` should be a column, not an expression: it is looked at once for each shingle.
    """
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))
    return F.when(n >= k, many).when(n > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))


def slug(title: Column) -> Column:
    """Lower-case ASCII letters and digits joined by hyphens, 60 at most; ``untitled`` for none."""
    bare = F.btrim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(F.substring(bare, 1, 60), F.lit("")), F.lit("untitled"))


def heading(text: Column) -> Column:
    """The title in a Markdown heading on the first line that isn't blank; null otherwise."""
    first = F.regexp_extract(text, r"^\s*([^\r\n]*)", 1)
    title = F.regexp_extract(F.trim(first), r"^#+\s+(.{2,60})", 1)
    return F.nullif(F.trim(F.rtrim(F.trim(title), F.lit("#"))), F.lit(""))


def model_answer(answer: Column) -> Column:
    """A model's JSON, or the first block in braces of it, as (topic, slug, kind, confidence).

    Null without a topic. The confidence is 0.5 where it is no number; the kind is ``other``
    where it is none of KINDS.
    """
    block = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    text = F.when(F.get_json_object(answer, "$").isNotNull() & answer.rlike(r"^\s*\{"), answer).otherwise(block)
    topic = F.nullif(F.trim(F.coalesce(F.get_json_object(text, "$.topic"), F.lit(""))), F.lit(""))
    named = F.nullif(F.get_json_object(text, "$.slug"), F.lit(""))
    kind = F.get_json_object(text, "$.kind")
    return F.when(
        topic.isNotNull(),
        F.struct(
            topic.alias("topic"),
            slug(F.coalesce(named, topic)).alias("slug"),
            F.when(kind.isin(*KINDS), kind).otherwise("other").alias("kind"),
            F.coalesce(F.get_json_object(text, "$.confidence").try_cast("double"), F.lit(0.5)).alias("confidence"),
        ),
    )
