"""Personas as Markdown files and back, and the register of knowledge sources."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# The sections of the file in their order, the sentence that has to stay, the categories
# and the kinds of sources.
SECTIONS = ("Persona Narrative", "Speaking style", "Guidelines", "Background")
DISCLAIMER = "Simulated persona; not a real person."
DISCLAIMED = r"(?i)simulated|not a real person"
NO_CLAIM = "No grounded claim available."
CATEGORIES = ("vc", "tech", "founder", "expert", "influencer", "politician", "celebrity")
SOURCE_TYPES = ("file", "text", "url", "youtube", "interview", "social")
KNOWLEDGE_NAME = r"^\d{4}-\d{2}-\d{2}-[-\w]+\.md$"


def render(personas: DataFrame, claims: DataFrame) -> DataFrame:
    """(author_id, text): each persona's file. ``personas``: author_id, display_name, tagline, categories,
    primary_category, voice_traits, caveats; ``claims`` as ``persona.claims`` gives them."""
    quote = F.concat(F.lit("- "), "quote", F.lit(" ("), "source_file", F.lit(":"), F.col("line_start").cast("string"), F.lit(")"))
    cited = claims.groupBy("author_id").agg(F.min_by("text", "claim_id").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim_id", quote.alias("q")))), lambda x: x["q"]), "\n").alias("background"))
    rows = personas.join(cited, "author_id", "left")
    none = F.array().cast("array<string>")
    said = F.array_join(F.coalesce("caveats", none), " ")
    warned = F.when(said == "", DISCLAIMER).when(said.rlike(DISCLAIMED), said).otherwise(F.concat_ws(" ", said, F.lit(DISCLAIMER)))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), F.coalesce(value, F.lit("")))
    part = lambda name, value: F.concat(F.lit(f"\n## {name}\n"), value)
    traits = F.coalesce("voice_traits", none)
    text = F.concat_ws(
        "\n", F.lit("---"), field("name", F.col("author_id")), field("display_name", F.coalesce("display_name", "author_id")), field("tagline", F.col("tagline")),
        field("categories", F.array_join(F.coalesce("categories", none), ",")), field("primary_category", F.coalesce("primary_category", F.get("categories", F.lit(0)))),
        field("voice_traits", F.array_join(traits, ",")), F.lit("not_real_person: true\n---"), part(SECTIONS[0], F.coalesce("first", F.lit(NO_CLAIM))),
        part(SECTIONS[1], F.when(F.size(traits) > 0, F.array_join(traits, ", ")).otherwise("grounded")), part(SECTIONS[2], warned), part(SECTIONS[3], F.coalesce("background", F.lit(""))), F.lit(""),
    )
    return rows.select("author_id", text.alias("text"))


def parse(rows: DataFrame) -> DataFrame:
    """``rows(name, value)``, name that of the file's folder; returns the persona's columns, its sections as
    narrative and guidelines, and ``problem``: null, or what is wrong with the file."""
    shape = r"^---\r?\n([\s\S]*?)\r?\n---(?:\r?\n|$)"
    value = F.regexp_replace("value", "\r\n", "\n")
    rows = rows.select("name", F.regexp_extract(value, shape, 1).alias("head"), F.concat(F.lit("\n"), F.regexp_replace(value, shape, "")).alias("body"), value.rlike(shape).alias("shaped"))
    field = lambda k: F.trim(F.regexp_extract("head", rf"(?m)^[ \t]*{k}[ \t]*:(.*)$", 1))
    listed = lambda c: F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    parts = F.transform(F.slice(F.split("body", "\n## "), F.lit(2), F.size(F.split("body", "\n## "))), lambda x: F.struct(F.trim(F.element_at(F.split(x, "\n"), 1)).alias("k"), F.regexp_replace(F.regexp_replace(x, r"^[^\n]*", ""), r"^\s+|\s+$", "").alias("v")))
    rows = rows.withColumn("parts", parts)
    section = lambda k: F.try_element_at(F.filter("parts", lambda x: x["k"] == k), F.lit(-1))["v"]
    at = [F.array_position(F.transform("parts", lambda x: x["k"]), k) for k in SECTIONS]
    ordered = (at[0] > 0) & (at[1] > at[0]) & (at[2] > at[1]) & (at[3] > at[2])
    out = rows.select(
        "name", field("name").alias("author_id"), field("display_name").alias("display_name"), field("tagline").alias("tagline"), listed(field("categories")).alias("categories"),
        F.nullif(field("primary_category"), F.lit("")).alias("primary_category"), listed(field("voice_traits")).alias("voice_traits"), section(SECTIONS[0]).alias("narrative"),
        section(SECTIONS[2]).alias("guidelines"), "shaped", ordered.alias("ordered"), field("not_real_person").alias("declared"),
    )
    known = F.array(*map(F.lit, CATEGORIES))
    problem = (
        F.when(~F.col("shaped"), "no front matter").when((F.col("author_id") != "") & (F.col("author_id") != F.col("name")), "name differs from folder")
        .when(F.col("declared") != "true", "not_real_person is not declared").when(F.size("categories") == 0, "no categories")
        .when(F.size(F.array_except(F.array_compact(F.concat("categories", F.array("primary_category"))), known)) > 0, "unknown category")
        .when(~F.col("ordered"), "sections missing or out of order").when(F.coalesce("narrative", F.lit("")) == "", "no narrative")
        .when(~F.coalesce(F.col("guidelines").rlike(DISCLAIMED), F.lit(False)), "no disclaimer")
    )
    named = F.when(F.col("author_id") == "", F.col("name")).otherwise(F.col("author_id"))
    out = out.withColumn("author_id", named).withColumn("primary_category", F.coalesce("primary_category", F.get("categories", F.lit(0))))
    return out.withColumn("problem", problem).drop("shaped", "ordered", "declared")


def score(files: DataFrame, entries: DataFrame) -> DataFrame:
    """(name, schema, quality, knowledge): which tests the persona ``files(name, value)`` pass, and whether all of their
    knowledge ``entries(name, entry)`` are named as they have to be. An empty file passes none."""
    field = lambda k: F.trim(F.regexp_extract("value", rf"(?m)^{k}:(.*)$", 1))
    listed = F.filter(F.transform(F.split(field("categories"), ","), lambda x: F.trim(x)), lambda x: x != "")
    known = F.size(F.array_except(listed, F.array(*map(F.lit, CATEGORIES)))) == 0
    value = F.coalesce("value", F.lit(""))
    schema = value.contains("not_real_person: true") & known & F.array_contains(listed, field("primary_category")) & (field("voice_traits") != "")
    for name in SECTIONS:
        schema = schema & value.contains(f"## {name}")
    quality = value.rlike("[가-힣]") & value.rlike(DISCLAIMED)
    named = entries.groupBy(F.col("name").alias("n")).agg(F.bool_and(F.col("entry").rlike(KNOWLEDGE_NAME)).alias("good"))
    rows = files.join(named, F.col("name") == F.col("n"), "left")
    there = value != ""
    return rows.select("name", (there & schema).alias("schema"), (there & quality).alias("quality"), (there & F.coalesce("good", F.lit(True))).alias("knowledge"))


def knowledge(docs: DataFrame, label: str, category: str | None = None, source_type: str | None = None, published_at: str | None = None) -> DataFrame:
    """Rows for the register of knowledge sources: ``docs(doc_id, source)`` with what is said of them."""
    if source_type is not None and source_type not in SOURCE_TYPES:
        raise ValueError(f"no such source type: {source_type}")
    if published_at is not None and not re.fullmatch(r"\d{4}-\d{2}-\d{2}", published_at):
        raise ValueError(f"not a date: {published_at}")
    text = lambda v: F.lit(v).cast("string")
    rows = docs.select("doc_id", "source", text(label).alias("source_label"), text(category).alias("category"), text(source_type).alias("source_type"), text(published_at).alias("published_at"))
    file = F.concat(F.lit(f"{published_at}-"), T.safe_category(F.col("category")), F.lit(".md"))
    return rows.withColumn("stub", file if category and published_at else F.lit(None).cast("string"))


def panel_lens(personas: DataFrame, lenses: DataFrame, category: str) -> DataFrame:
    """Personas of a category with its lens, from ``lenses(category, ...)``, a table of one row a category."""
    if category not in CATEGORIES:
        raise ValueError(f"no such category: {category}")
    own = personas.where(F.array_contains("categories", category)).withColumn("category", F.lit(category))
    return own.join(F.broadcast(lenses.where(F.col("category") == category).limit(1)), "category", "left")


def listed(clones: DataFrame, turns: DataFrame) -> DataFrame:
    """(name, problem, sessions, turns): the clones of ``parse`` by name, with the chats that were kept with each.

    ``turns(session_id, author_id)``: a row a turn. Clones without chats have none; chats with a name that is no clone aren't listed.
    """
    by = turns.groupBy(F.col("author_id").alias("name")).agg(F.count_distinct("session_id").alias("sessions"), F.count("*").alias("turns"))
    rows = clones.select("name", "problem").join(by, "name", "left")
    return rows.select("name", "problem", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("sessions", "turns")))
