"""The append-only event log of sources: parsing, summaries, history, status and compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

ACTIONS = ("import", "delete", "refresh")
KEEP = 20
HISTORY_CAP, HISTORY_DEFAULT = 200, 100


def parse_events(lines: DataFrame) -> DataFrame:
    """``lines(line, value)``; returns line, source_id, action, at, document_count, malformed.

    Blank lines are no events. A line is malformed unless it is an object whose sourceId, action and
    at are strings, the action one of three, and documentCount a number or left out (then 0): types
    are looked at as they stand in the JSON, nothing is cast.
    """
    # exploding an array of one keeps the parse in a step of its own, so that a line is parsed once
    rows = lines.where(F.trim("value") != "").withColumn("v", F.explode(F.array(F.try_parse_json("value"))))
    kind = lambda k: F.schema_of_variant(F.try_variant_get("v", f"$.{k}", "variant"))
    text = lambda k: F.when(kind(k) == "STRING", F.try_variant_get("v", f"$.{k}", "string"))
    count_kind = kind("documentCount")
    number = count_kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    rows = rows.select("line", text("sourceId").alias("source_id"), text("action").alias("action"), text("at").alias("at"), F.when(count_kind.isNull(), F.lit(0.0)).when(number, F.try_variant_get("v", "$.documentCount", "double")).alias("n"))
    sound = F.col("source_id").isNotNull() & F.col("at").isNotNull() & F.col("action").isin(*ACTIONS) & F.col("n").isNotNull()
    return rows.select("line", "source_id", "action", "at", F.col("n").alias("document_count"), (~F.coalesce(sound, F.lit(False))).alias("malformed"))


def valid(events: DataFrame) -> DataFrame:
    return events.where("not malformed").drop("malformed")


def summarize(events: DataFrame) -> DataFrame:
    """Per source: events, first and last by line (never by time)."""
    return valid(events).groupBy("source_id").agg(
        F.count("*").alias("interaction_count"), F.min_by("at", "line").alias("first_seen_at"),
        F.max_by("at", "line").alias("last_seen_at"), F.max_by("action", "line").alias("last_action"),
    )


def status(events: DataFrame, compactions: DataFrame | None = None) -> DataFrame:
    """Per source the summary, with the number of malformed lines of the whole log and its last compaction."""
    bad = events.agg(F.count_if("malformed").alias("malformed_event_count"))
    rows = summarize(events).crossJoin(F.broadcast(bad))  # one row
    if compactions is None:
        return rows.withColumn("compacted", F.lit(False))
    last = compactions.groupBy("source_id").agg(F.max("compacted_at").alias("last_compacted_at"), F.max_by("retained", "compacted_at").alias("retention_kept_events"))
    return rows.join(last, "source_id", "left").withColumn("compacted", F.col("last_compacted_at").isNotNull())


def history(events: DataFrame, source_id: str | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """A page of valid events in order of lines; the limit within 0..200."""
    offset, limit = max(0, offset), max(0, min(HISTORY_CAP, HISTORY_DEFAULT if limit is None else limit))
    rows = valid(events)
    if source_id:
        rows = rows.where(F.col("source_id") == source_id)
    best = rows.orderBy("line").limit(offset + limit)
    return best.withColumn("n", F.row_number().over(Window.orderBy("line"))).where(F.col("n") > offset).drop("n")


def compact(events: DataFrame, keep: int = KEEP, source_id: str | None = None) -> DataFrame:
    """Valid events of which each source (or the one named) has only its last ``keep`` lines."""
    nth = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("line")))
    if source_id is None:
        return valid(events).withColumn("nth", nth).where(F.col("nth") <= keep).drop("nth")
    own = valid(events).where(F.col("source_id") == source_id).orderBy(F.desc("line")).limit(keep)
    return valid(events).where(F.col("source_id") != source_id).unionByName(own)


def compaction_record(events: DataFrame, keep: int = KEEP) -> DataFrame:
    """Per source what a compaction keeps and removes, and the malformed lines that it drops."""
    bad = events.agg(F.count_if("malformed").alias("skipped_malformed"))
    rows = valid(events).groupBy("source_id").agg(F.count("*").alias("n"))
    kept = F.least(F.col("n"), F.lit(keep))
    return rows.crossJoin(F.broadcast(bad)).select("source_id", kept.alias("retained"), (F.col("n") - kept).alias("removed"), "skipped_malformed")


def sources(documents: DataFrame, events: DataFrame) -> DataFrame:
    """Sources by their documents, with what the log says of them."""
    own = documents.groupBy(T.source_id(F.col("author_id"), F.col("slug")).alias("source_id")).agg(F.count("*").alias("document_count"))
    seen = summarize(events)
    rows = own.join(seen, "source_id", "left")
    return rows.select("source_id", F.lit("author").alias("type"), "document_count", F.coalesce("interaction_count", F.lit(0)).alias("interaction_count"), "last_action", "last_seen_at")


def public_compactions(records: DataFrame) -> DataFrame:
    """Records with the name of the backup alone, not its place."""
    return records.withColumn("backup_id", F.element_at(F.split("backup_path", "/"), -1)).drop("backup_path")


def bad_compactions(records: DataFrame) -> DataFrame:
    """(source_id, problem) of records of compactions that can't be right: nothing may be compacted beside them."""
    count = lambda c: F.col(c).isNull() | (F.col(c) < 0)
    problem = (
        F.when(~F.coalesce(F.col("source_id").rlike("^author:[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"), F.lit(False)), "no source")
        .when(F.try_to_timestamp("compacted_at").isNull(), "no time").when(count("retained") | count("removed") | count("skipped_malformed"), "no count")
        .when(F.coalesce("backup_path", F.lit("")) == "", "no backup")
    )
    return records.select("source_id", problem.alias("problem")).where("problem is not null")
