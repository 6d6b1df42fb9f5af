"""Adapters from flat tables to the document model: documents, categories, events, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def author_name(source):
    """``src7`` as ``src07``, so that names sort as numbers; null as ``unknown``."""
    digits = F.regexp_extract(source, "([0-9]+)$", 1)
    head = F.regexp_replace(source, "[0-9]+$", "")
    padded = F.concat(head, F.when(digits == "", "").otherwise(F.lpad(digits, F.greatest(F.length(digits), F.lit(2)), F.lit("0"))))
    return F.coalesce(padded, F.lit("unknown"))


def with_identity(docs: DataFrame) -> DataFrame:
    author = author_name(F.col("source"))
    return docs.withColumn("author_id", author).withColumn("slug", T.author_slug(author, F.concat(F.lit("doc-"), F.lpad(F.col("doc_id").cast("string"), 7, "0"))))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document record a row: slug, title, guest, keywords, publish_date, content, transcript, ..."""
    docs = with_identity(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", "slug", "author_id", F.lit("author").alias("source"), "lang",
        F.element_at(T.lines(text), 1).alias("title"), F.coalesce("source", F.lit("")).alias("guest"),
        F.array(F.coalesce("lang", F.lit(""))).alias("keywords"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")), "yyyy-MM-dd").alias("publish_date"),
        text.alias("content"), T.collapse(text).alias("transcript"),
    )


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(slug, category_slug): labels and languages as categories, each pair once."""
    docs = with_identity(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"))
    labels = table(spark, sf_dir, "labels")
    named = labels.select("doc_id", F.explode(F.array(F.concat(F.lit("quality-"), "quality"), F.concat(F.lit("toxic-"), "toxic"))).alias("category_slug"))
    pairs = docs.select("slug", F.concat(F.lit("lang-"), "lang").alias("category_slug"))
    return pairs.union(docs.join(named, "doc_id").select("slug", "category_slug")).where("category_slug is not null").distinct()


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line, value): the events as lines of a JSON log. Events of two of the types have an action
    that the log doesn't know."""
    e = table(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "signup", "import").when(F.col("event_type") == "purchase", "refresh").when(F.col("event_type") == "error", "delete").otherwise(F.col("event_type"))
    source = F.concat(F.lit("author:u"), F.lpad(F.col("user_id").cast("string"), 5, "0"))
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return e.select(F.col("event_id").alias("line"), F.to_json(F.struct(source.alias("sourceId"), action.alias("action"), at.alias("at"), F.floor("value").alias("documentCount"))).alias("value"))
