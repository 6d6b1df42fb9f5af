"""The category index, manifests, differences between versions, upserts and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def category_bridge(documents: DataFrame, categories: DataFrame) -> DataFrame:
    """(slug, category_slug) from ``categories(slug, documentSlugs)``; slugs that no document has are dropped."""
    pairs = categories.select(F.col("slug").alias("category_slug"), F.explode("documentSlugs").alias("slug")).distinct()
    return pairs.join(documents.select("slug"), "slug", "left_semi").select("slug", "category_slug")


def document_categories(documents: DataFrame, bridge: DataFrame) -> DataFrame:
    """(slug, category_slugs) for every document, in order, empty where it has none."""
    lists = bridge.groupBy("slug").agg(F.array_sort(F.collect_set("category_slug")).alias("c"))
    return documents.select("slug").join(lists, "slug", "left").select("slug", F.coalesce("c", F.array().cast("array<string>")).alias("category_slugs"))


def enrich(documents: DataFrame, category_slugs: DataFrame, bridge: DataFrame) -> DataFrame:
    """The bridge with the pairs that keywords of the documents name."""
    named = documents.select("slug", F.explode("keywords").alias("k")).select("slug", T.keyword_slug(F.col("k")).alias("category_slug"))
    known = named.join(category_slugs.select("category_slug").distinct(), "category_slug", "left_semi")
    return bridge.select("slug", "category_slug").unionByName(known).distinct()


def category_sizes(bridge: DataFrame) -> DataFrame:
    return bridge.groupBy("category_slug").agg(F.countDistinct("slug").alias("documents"))


def inspect(documents: DataFrame, bridge: DataFrame, k: int = 10) -> DataFrame:
    """(kind, name, documents): the largest and smallest categories, and how many documents have none."""
    sizes = category_sizes(bridge)
    top = sizes.orderBy(F.desc("documents"), "category_slug").limit(k).select(F.lit("largest").alias("kind"), F.col("category_slug").alias("name"), "documents")
    low = sizes.orderBy("documents", "category_slug").limit(k).select(F.lit("smallest").alias("kind"), F.col("category_slug").alias("name"), "documents")
    none = documents.join(bridge.select("slug").distinct(), "slug", "left_anti").agg(F.lit("uncategorised").alias("kind"), F.lit("").alias("name"), F.count("*").alias("documents"))
    return top.unionByName(low).unionByName(none)


def manifest(documents: DataFrame, hidden: str = "blog:") -> DataFrame:
    """One row: counts, bytes, words, and a digest of the slugs and hashes that are listed."""
    listed = ~F.col("slug").startswith(hidden)
    rows = documents.select("slug", T.byte_length(F.col("content")).alias("b"), T.word_count(F.col("content")).alias("w"), T.short_hash(F.coalesce("content", F.lit(""))).alias("h"))
    return rows.agg(F.count("*").alias("document_count"), F.coalesce(F.sum("b"), F.lit(0)).alias("content_bytes"), F.coalesce(F.sum("w"), F.lit(0)).alias("content_words"), F.count_if(listed).alias("hashed_count"), F.countDistinct("h").alias("distinct_hashes"), F.min("slug").alias("first_slug"), F.max("slug").alias("last_slug"))


TOTALS = "document_count bigint, content_bytes bigint, content_words bigint"


def totals(documents: DataFrame) -> DataFrame:
    """What a manifest counts of ``documents(content, ...)``: one row."""
    return documents.agg(F.count("*").alias("document_count"), F.coalesce(F.sum(T.byte_length(F.col("content"))), F.lit(0)).alias("content_bytes"), F.coalesce(F.sum(T.word_count(F.col("content"))), F.lit(0)).alias("content_words"))


def with_changes(before: DataFrame, gone: DataFrame, come: DataFrame) -> DataFrame:
    """Totals after documents ``gone`` (removed, or as they were before an update) and ``come`` (added, or as they
    are now): only these are read."""
    names = [x.split()[0] for x in TOTALS.split(", ")]
    signed = lambda df, sign: df.select(*((sign * F.col(n)).alias(n) for n in names))
    parts = signed(before, F.lit(1)).unionByName(signed(totals(gone), F.lit(-1))).unionByName(signed(totals(come), F.lit(1)))
    return parts.agg(*(F.sum(n).alias(n) for n in names))


BUCKET = 1_000  # documents in a bucket of the digest, about
DIGITS = 3  # hexadecimal digits by which buckets are parted at each level


def digest(documents: DataFrame) -> DataFrame:
    """(digest): 16 digits over all slugs and content hashes, so that any change of a text is one.

    A tree: slugs are dealt to buckets by the first digits of their hash, more digits for more documents, so that a bucket stays
    small; a bucket's rows are hashed in order, and 4,096 neighbouring buckets' hashes at each level above.
    """
    digits = DIGITS
    n = documents.count()
    while n > BUCKET * 16**digits and digits < 30:
        digits += DIGITS
    rows = documents.select("slug", T.short_hash(F.coalesce("content", F.lit(""))).alias("hash"), F.left(F.md5("slug"), F.lit(digits)).alias("bucket"))
    said = F.array_sort(F.collect_list(F.concat_ws(" ", "slug", "hash")))
    nodes = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sha2(F.array_join(said, "\n"), 256).alias("h"))
    whole = F.array_sort(F.collect_list(F.concat_ws(" ", "bucket", F.col("n").cast("string"), "h")))  # 4,096 at most
    for left in range(digits - DIGITS, 0, -DIGITS):
        nodes = nodes.groupBy(F.left("bucket", F.lit(left)).alias("bucket")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(whole, "\n"), 256).alias("h"))
    return nodes.agg(F.left(F.sha2(F.array_join(whole, "\n"), 256), F.lit(16)).alias("digest"))


def with_hashes(documents: DataFrame, files: DataFrame) -> DataFrame:
    """(slug, content_hash) of every document: its own hash, else that of its file in ``files(slug, hash)``, else none ("")."""
    rows = documents.select("slug", F.nullif("content_hash", F.lit("")).alias("own")).join(files.select("slug", "hash"), "slug", "left")
    return rows.select("slug", F.coalesce("own", "hash", F.lit("")).alias("content_hash"))


def incremental_update(stored: DataFrame, current: DataFrame, changes: DataFrame) -> DataFrame:
    """The stored documents after ``changes`` of ``diff``: removed and changed ones out, added and changed ones in.
    Documents that didn't change are not written anew by a store that keeps them by author."""
    gone = changes.where("change in ('removed', 'changed')")
    new = changes.where("change in ('added', 'changed')")
    return remove(stored, gone).unionByName(current.join(new.select("slug"), "slug", "left_semi").select(*stored.columns))


def by_guest(documents: DataFrame, guest: str, order: str = "slug") -> DataFrame:
    """The first document whose guest holds the name, or whose slug holds it with dashes for blanks; the letter case of the name doesn't count."""
    name = guest.lower()
    dashed = "-".join(name.split())
    return documents.where(F.lower(F.coalesce("guest", F.lit(""))).contains(name) | F.col("slug").contains(dashed)).orderBy(order).limit(1)


def manifest_rows(documents: DataFrame, hidden: str = "blog:") -> DataFrame:
    """(slug, content_hash): the listed documents. A table, not a map in one row."""
    return documents.where(~F.col("slug").startswith(hidden)).select("slug", T.short_hash(F.coalesce("content", F.lit(""))).alias("content_hash"))


def latest_wins(*hashes: DataFrame) -> DataFrame:
    """(slug, hash) of several sources; of a slug in more than one the later source counts."""
    out = None
    for i, h in enumerate(hashes):
        part = h.select("slug", "hash", F.lit(i).alias("p"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("slug").agg(F.max_by("hash", "p").alias("hash"))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(slug, change, previous_hash, next_hash) of what was added, changed or removed between two lists
    of (slug, hash). An empty hash counts as none."""
    a = before.select("slug", F.nullif("hash", F.lit("")).alias("previous_hash"))
    b = after.select("slug", F.nullif("hash", F.lit("")).alias("next_hash"))
    both = a.join(b, "slug", "full")
    change = F.when(F.col("previous_hash").isNull() & F.col("next_hash").isNotNull(), "added").when(F.col("previous_hash").isNotNull() & F.col("next_hash").isNull(), "removed").when(F.col("previous_hash") != F.col("next_hash"), "changed")
    return both.select("slug", change.alias("change"), "previous_hash", "next_hash").where("change is not null")


def collection_diff(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``diff`` of the documents and of the categories of two states, each (documents, categories), with ``kind``."""
    parts = [diff(a, b).select(F.lit(kind).alias("kind"), "*") for kind, a, b in zip(("document", "category"), before, after, strict=True)]
    return parts[0].unionByName(parts[1])


def changeset(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(slug, title, action, previous_hash, next_hash) for each incoming row (slug, title, hash, ord).

    Rows of one slug are taken in order, each after the one before; the same hash is skipped.
    """
    before = F.lag("hash").over(Window.partitionBy("slug").orderBy("ord"))
    rows = incoming.withColumn("own", before).join(stored.select("slug", F.col("hash").alias("kept")), "slug", "left")
    previous = F.coalesce("own", "kept")
    action = F.when(previous.isNull(), "added").when(previous == F.col("hash"), "skipped").otherwise("updated")
    return rows.select("slug", "title", action.alias("action"), previous.alias("previous_hash"), F.col("hash").alias("next_hash"))


def counters(changes: DataFrame) -> DataFrame:
    return changes.agg(*(F.count_if(F.col("action") == a).alias(a) for a in ("added", "updated", "skipped")))


def upsert(stored: DataFrame, incoming: DataFrame, order: str = "ord") -> DataFrame:
    """The stored rows with those that came in, the last of each slug; what didn't come in stays."""
    last = F.row_number().over(Window.partitionBy("slug").orderBy(F.desc(order)))
    new = incoming.select(*stored.columns, last.alias("nth_of_slug")).where("nth_of_slug = 1").drop("nth_of_slug")
    return stored.join(new.select("slug"), "slug", "left_anti").unionByName(new)


def remove(stored: DataFrame, slugs: DataFrame) -> DataFrame:
    return stored.join(slugs.select("slug"), "slug", "left_anti")


def update_plan(document_changes: DataFrame, category_changes: DataFrame) -> DataFrame:
    """(mode, remove, add): a change of categories means a full index, else changed rows are taken out and put in."""
    c = category_changes.agg(F.count("*").alias("c"))
    d = document_changes.agg(F.count_if(F.col("change").isin("removed", "changed")).alias("r"), F.count_if(F.col("change").isin("added", "changed")).alias("a"))
    return d.crossJoin(F.broadcast(c)).select(F.when(F.col("c") > 0, "full").when((F.col("r") + F.col("a")) > 0, "incremental").otherwise("none").alias("mode"), F.col("r").alias("remove"), F.col("a").alias("add"))


class InvalidCollection(ValueError):
    """A collection with errors."""


def require_valid(issues: DataFrame) -> DataFrame:
    """Issues that are warnings; any error raises, and says how many of which there are."""
    found = issues.where("level = 'error'").groupBy("rule").count().orderBy("rule").collect()
    if found:
        raise InvalidCollection(", ".join(f"{r['rule']}: {r['count']}" for r in found))
    return issues


def validate_collection(documents: DataFrame, categories: DataFrame, manifest: DataFrame, indexed: DataFrame) -> DataFrame:
    """(level, rule, name): documents without slug, without title and guest, or without content (a warning), category
    entries of no document, totals that the manifest has otherwise, documents that the index ``indexed(slug)`` lacks."""
    row = lambda df, level, rule, name: df.select(F.lit(level).alias("level"), F.lit(rule).alias("rule"), name.alias("name"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    entries = categories.select(F.col("slug").alias("category"), F.explode("documentSlugs").alias("slug"))
    unknown = entries.join(documents.select("slug"), "slug", "left_anti")
    n = documents.agg(F.count("*").alias("n")).crossJoin(F.broadcast(categories.agg(F.count("*").alias("c"))))  # one row each
    counted = n.crossJoin(F.broadcast(manifest.select("document_count", "category_count")))
    counted = counted.select(F.explode(F.array_compact(F.array(F.when(F.col("n") != F.col("document_count"), F.lit("documents")), F.when(F.col("c") != F.col("category_count"), F.lit("categories"))))).alias("of"))
    parts = [
        row(documents.where(blank("slug")), "error", "missing-slug", F.lit("")), row(documents.where(blank("title") & blank("guest")), "error", "missing-title-and-guest", F.col("slug")),
        row(documents.where(blank("content")), "warning", "empty-content", F.col("slug")), row(unknown, "error", "unknown-document", F.concat_ws(" ", "category", "slug")),
        row(counted, "error", "manifest-count", F.col("of")), row(documents.join(indexed.select("slug"), "slug", "left_anti"), "error", "not-indexed", F.col("slug")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def validate(documents: DataFrame, bridge: DataFrame) -> DataFrame:
    """(level, rule, slug): what is wrong with the collection."""
    rule = lambda df, level, name: df.select(F.lit(level).alias("level"), F.lit(name).alias("rule"), "slug")
    twice = documents.groupBy("slug").count().where("count > 1")
    untitled = documents.where(F.coalesce(F.trim("title"), F.lit("")) == "")
    empty = documents.where(F.coalesce(F.trim("content"), F.lit("")) == "")
    orphans = bridge.join(documents.select("slug"), "slug", "left_anti").select("slug").distinct()
    bare = documents.join(bridge.select("slug").distinct(), "slug", "left_anti")
    out = rule(twice, "error", "duplicate-slug")
    for df, level, name in ((untitled, "error", "missing-title"), (empty, "error", "empty-content"), (orphans, "error", "orphan-category"), (bare, "warning", "no-category")):
        out = out.unionByName(rule(df, level, name))
    return out
