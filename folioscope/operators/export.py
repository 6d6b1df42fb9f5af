"""Exports of sources with provenance and checksums that a second export repeats."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jsontext as J
from ..functions import text as T
from ..workers import importable


def export_documents(documents: DataFrame) -> DataFrame:
    """Each document with its checksum, size and provenance."""
    source = T.source_id(F.col("author_id"), F.col("slug"))
    return documents.select(
        source.alias("source_id"), F.lit("author").alias("source_type"), "slug", "title", F.coalesce("content", F.lit("")).alias("content"),
        F.sha2(F.coalesce("content", F.lit("")), 256).alias("checksum"), F.lit("sha256").alias("checksum_algorithm"), T.byte_length(F.col("content")).alias("content_bytes"),
        F.col("original_url") if "original_url" in documents.columns else F.lit(None).cast("string").alias("original_url"),
    )


def export_manifest(exported: DataFrame, events: DataFrame | None = None, generated_at: str | None = None) -> DataFrame:
    """Per source the counts and the four checksums.

    A checksum is over the documents' entries one after another, so a source's entries pass through one task in
    order and are hashed as they pass: nothing is gathered. The bundle's checksum is over the
    other three, and the time of the export is in none of them.
    """
    entry = J.stable_struct(slug=F.col("slug"), checksum=F.col("checksum"), contentBytes=F.col("content_bytes"))
    origin = J.stable_struct(slug=F.col("slug"), title=F.col("title"), sourceId=F.col("source_id"), sourceType=F.col("source_type"), checksum=F.col("checksum"), originalUrl=F.col("original_url"))
    rows = exported.groupBy("source_id", "source_type").agg(F.count("*").alias("document_count"), F.sum("content_bytes").alias("content_bytes"))
    text = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    part = lambda df, which, pos, order, piece: df.select("source_id", F.lit(which).alias("which"), F.lit(pos).alias("pos"), order.alias("ord"), piece.alias("piece"))
    none, source = F.array().cast("array<string>"), F.concat(F.lit('"sourceId":'), text(F.col("source_id")))
    made = F.lit("" if generated_at is None else f'"manifestGeneratedAt":{json.dumps(generated_at)},')
    parts = [
        part(rows, "set", 0, none, F.concat(F.lit('{"contentBytes":'), F.col("content_bytes").cast("string"), F.lit(',"documentChecksums":['))),
        part(exported, "set", 1, F.array("slug", F.to_json(entry)), F.to_json(entry)), part(rows, "set", 2, none, F.concat(F.lit("],"), source, F.lit("}"))),
        part(rows, "origin", 0, none, F.lit('{"documents":[')), part(exported, "origin", 1, F.array("slug", F.to_json(origin)), F.to_json(origin)),
        part(rows, "origin", 2, none, F.concat(F.lit("],"), made, source, F.lit(',"sourceType":'), text(F.col("source_type")), F.lit("}"))),
    ]
    sums = {"set": "document_set_checksum", "origin": "provenance_checksum"}
    if events is not None:
        said = J.stable_struct(sourceId=F.col("source_id"), action=F.col("action"), at=F.col("at"), documentCount=F.col("document_count").cast("long"))
        own = events.join(rows.select("source_id"), "source_id", "left_semi")
        parts += [part(rows, "log", 0, none, F.lit('{"events":[')), part(own, "log", 1, F.array("at", "action", F.format_string("%020.3f", F.col("document_count").cast("double"))), F.to_json(said)), part(rows, "log", 2, none, F.lit("]}"))]
        sums["log"] = "history_checksum"
    pieces = parts[0]
    for more in parts[1:]:
        pieces = pieces.unionByName(more)
    found = _digests(pieces).groupBy("source_id").pivot("which", list(sums)).agg(F.first("sha256"))
    rows = rows.join(found.select("source_id", *(F.col(k).alias(v) for k, v in sums.items())), "source_id")
    rows = rows.withColumn("history_included", F.lit(events is not None))
    if events is None:
        rows = rows.withColumn("history_checksum", F.lit(None).cast("string"))
    bundle = J.stable_json(sourceId=F.col("source_id"), documentSetChecksum=F.col("document_set_checksum"), historyIncluded=F.col("history_included"), historyChecksum=F.col("history_checksum"), provenanceChecksum=F.col("provenance_checksum"))
    return rows.withColumn("bundle_checksum", F.sha2(bundle, 256))


def _digests(pieces: DataFrame) -> DataFrame:
    """(source_id, which, sha256) of the pieces (source_id, which, pos, ord, piece) of each text, in order, with commas between those at 1."""
    importable(pieces.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, last = None, None, 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (*own, state.hexdigest())], ["source_id", "which", "sha256"])

        for batch in batches:
            for source, which, pos, piece in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (source, which) != own:
                    if own is not None:
                        yield out()
                    own, state, last = (source, which), hashlib.sha256(), 0
                if last == pos == 1:
                    state.update(b",")
                state.update((piece or "").encode())
                last = pos
        if own is not None:
            yield out()

    ordered = pieces.repartition("source_id", "which").sortWithinPartitions("source_id", "which", "pos", "ord")
    return ordered.select("source_id", "which", "pos", "piece").mapInArrow(run, "source_id string, which string, sha256 string")


DIGITS, DEEPEST = 3, 4  # hexadecimal digits by which branches are parted at each level; levels at most


def tree_checksums(exported: DataFrame, bucket: int = 1_000) -> DataFrame:
    """(source_id, document_count, content_bytes, tree_checksum): one checksum a source that, unlike those of ``export_manifest``, no task has
    to hash from end to end, so that a source may hold any share of all documents.

    A source's documents are dealt to leaves of about ``bucket`` by the first digits of the hash of their slug, more digits for more
    documents of that source, whatever the others hold. A leaf is hashed over its slugs and checksums in order, a
    branch over the names, counts and hashes of its children, 4,096 at most. Rows that agree in slug all count.
    """
    of = exported.groupBy("source_id").agg(F.count("*").alias("document_count"), F.sum("content_bytes").alias("content_bytes"))
    digits = F.lit(DIGITS * DEEPEST)
    for k in range(DEEPEST - 1, 0, -1):
        digits = F.when(F.col("document_count") <= bucket * 16 ** (DIGITS * k), DIGITS * k).otherwise(digits)
    rows = exported.select("source_id", "slug", "checksum").join(of.select("source_id", digits.alias("digits")), "source_id")
    entries = F.array_sort(F.collect_list(F.concat_ws(" ", "slug", "checksum")))
    hashed = lambda texts: F.sha2(F.array_join(texts, "\n"), 256)
    nodes = rows.groupBy("source_id", F.left(F.md5("slug"), F.col("digits")).alias("branch")).agg(F.count("*").alias("n"), hashed(entries).alias("h"))
    children = F.array_sort(F.collect_list(F.concat_ws(" ", "branch", F.col("n").cast("string"), "h")))
    for left in range(DIGITS * (DEEPEST - 1), 0, -DIGITS):
        deeper = F.max(F.length("branch")) > left  # a branch that isn't as deep stays as it is
        nodes = nodes.groupBy("source_id", F.left("branch", F.lit(left)).alias("branch")).agg(F.sum("n").alias("n"), F.when(deeper, hashed(children)).otherwise(F.first("h")).alias("h"))
    roots = nodes.groupBy("source_id").agg(hashed(children).alias("tree_checksum"))
    return of.join(roots, "source_id")


def export_markdown(exported: DataFrame, manifest: DataFrame) -> DataFrame:
    """(source_id, part, ord, text): the lines of each source's bundle as ordered rows.

    A bundle is as large as its source, so it is a table to be written sorted, never one cell.
    """
    head = manifest.select("source_id", F.lit(0).alias("part"), F.lit("").alias("ord"), F.concat_ws("\n", F.concat(F.lit("# Exported Source: "), "source_id"), F.lit(""), F.concat(F.lit("- Type: "), "source_type"), F.concat(F.lit("- Documents: "), F.col("document_count").cast("string")), F.lit(""), F.lit("## Manifest"), F.lit(""), F.concat(F.lit("- Document set checksum: "), "document_set_checksum"), F.concat(F.lit("- Bundle checksum: "), "bundle_checksum"), F.concat(F.lit("- Provenance checksum: "), "provenance_checksum"), F.concat(F.lit("- History checksum: "), "history_checksum")).alias("text"))
    sums = exported.select("source_id", F.lit(1).alias("part"), F.col("slug").alias("ord"), F.concat(F.lit("- "), "slug", F.lit(": "), "checksum").alias("text"))
    bodies = exported.select("source_id", F.lit(2).alias("part"), F.col("slug").alias("ord"), F.concat(F.lit("\n## "), "slug", F.lit("\n\n"), "content", F.lit("\n")).alias("text"))
    return head.unionByName(sums).unionByName(bodies)
