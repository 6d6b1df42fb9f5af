"""Evidence-bound personas: claims from chunks, provenance checks, debates, gates and chats."""

from __future__ import annotations

import re
import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CLAIMS, QUOTE = 5, 120
# Sentences of the generated texts, thresholds of the gates, categories and their lenses' names.
GROUNDED = "This simulated persona is grounded in: "
NO_EVIDENCE = "No source evidence was available; no claims were fabricated."
THRESHOLDS = {"retrieval_adherence": (0.85, 0.9, True), "consistency": (0.8, 0.84, True), "pcr": (0.1, 0.05, False), "scr": (0.1, 0.05, False), "human_similarity": (0.9, 0.92, True)}
FACTORS = {"consistency": (6.0, 4.5), "completeness": (6.0, 3.5), "credibility": (6.0, 4.0), "clarity": (6.0, 6.0), "willingness_to_use": (6.0, 4.0), "empathy": (6.0, 6.0)}
PPS_AVERAGE, PPS_LEAST = 5.5, 4.0
MOST_PERSONAS = MOST_ROUNDS = 5
# What a folder of personas has to declare, and the dimensions of its report.
PROVIDERS = ("openai-compatible", "codex", "claude-code", "ollama", "fake")
COMMANDS = ("chat", "room", "panel", "list", "status", "history")
DIMENSIONS = (
    "personaSchema", "personaQuality", "personaChatReadiness", "categoryPanelReadiness", "groupRoomReadiness",
    "standaloneCliReadiness", "providerParity", "migrationReadiness", "securityReadiness", "overall",
)
EVIDENCE = ("quote", "chunk_id", "element_id", "doc_id", "source_file")


def claims(chunks: DataFrame, author: str = "author_id", *order: str) -> DataFrame:
    """The first five chunks of each author as claims with their evidence: author_id, claim_id, text,
    confidence and the columns of the evidence."""
    nth = F.row_number().over(Window.partitionBy(author).orderBy(*order))
    rows = chunks.withColumn("n", nth).where(F.col("n") <= CLAIMS)
    return rows.select(
        F.col(author).alias("author_id"), F.concat(F.lit("claim-"), F.col("n").cast("string")).alias("claim_id"), F.concat(F.lit(GROUNDED), F.left("text", F.lit(QUOTE))).alias("text"),
        F.lit("medium").alias("confidence"), F.col("text").alias("quote"), "chunk_id", "element_id", F.col("doc_id").cast("string").alias("doc_id"), "source_file", "line_start", "line_end",
    )


def personas(authors: DataFrame, found: DataFrame) -> DataFrame:
    """(persona_id, author_id, not_real_person, n_claims, caveat) for every author, also those without evidence."""
    counts = found.groupBy("author_id").agg(F.count("*").alias("n"))
    rows = authors.select("author_id").distinct().join(counts, "author_id", "left")
    n = F.coalesce("n", F.lit(0))
    return rows.select(F.concat("author_id", F.lit("-persona")).alias("persona_id"), "author_id", F.lit(True).alias("not_real_person"), n.alias("n_claims"), F.when(n == 0, NO_EVIDENCE).alias("caveat"))


def provenance_failures(claim_rows: DataFrame) -> DataFrame:
    """(author_id, claim_id, failure): claims without evidence (all parts null), or with parts missing."""
    none = F.coalesce(*(F.col(c).cast("string") for c in EVIDENCE)).isNull()
    missing = F.array_compact(F.array(*(F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(f"missing {c}")) for c in EVIDENCE)))
    return claim_rows.select("author_id", "claim_id", F.explode(F.when(none, F.array(F.lit("missing evidence"))).otherwise(missing)).alias("failure"))


def debate(spark: SparkSession, claim_rows: DataFrame, authors: list[str], question: str, rounds: int) -> DataFrame:
    """(round, ord, author_id, text, citation): each persona's first claim in every round."""
    if not 1 <= len(authors) <= MOST_PERSONAS or not 1 <= rounds <= MOST_ROUNDS:
        raise ValueError("a debate has 1 to 5 personas and 1 to 5 rounds")
    seats = spark.createDataFrame([(i, a) for i, a in enumerate(authors, 1)], "ord int, author_id string")
    first = claim_rows.where(F.col("author_id").isin(*authors) & (F.col("claim_id") == "claim-1"))
    turns = F.broadcast(seats).crossJoin(spark.range(1, rounds + 1).select(F.col("id").cast("int").alias("round")))  # at most 25 rows
    rows = turns.join(first, "author_id", "left")
    text = F.concat(F.col("author_id"), F.lit(f' answers "{question}" using '), F.col("text"))
    cited = F.concat_ws(":", "source_file", F.col("line_start").cast("string"))
    sound = F.assert_true(F.col("text").isNotNull(), F.concat("author_id", F.lit(" is missing citation evidence")))
    return rows.select("round", "ord", "author_id", F.when(sound.isNull(), text).alias("text"), cited.alias("citation"))


def panel(persona_rows: DataFrame, category: str) -> DataFrame:
    """Personas of a category, the first five by author."""
    return persona_rows.where(F.array_contains("categories", category)).orderBy("author_id").limit(MOST_PERSONAS)


def room(turns: DataFrame) -> DataFrame:
    """The persona that a single round is routed to: its first turn's."""
    return turns.where("round = 1").agg(F.min_by("author_id", "ord").alias("selected_author_id"), F.count("*").alias("participants"))


def tag(persona_rows: DataFrame, categories: list[str], known: list[str], primary: str | None = None) -> DataFrame:
    if unknown := [c for c in [*categories, *([primary] if primary else [])] if c not in known]:
        raise ValueError(f"unknown categories: {unknown}")
    more = F.array(*map(F.lit, categories)).cast("array<string>")
    first = F.lit(primary) if primary else F.coalesce("primary_category", F.lit(categories[0] if categories else None))
    return persona_rows.withColumn("categories", F.array_union(F.coalesce("categories", F.array().cast("array<string>")), more)).withColumn("primary_category", first)


def evaluate(metrics: DataFrame, defaults: bool = True) -> DataFrame:
    """``metrics`` with failures (names in order) and pass. Without ``defaults`` a missing metric fails;
    with them it counts as a value that passes."""
    tests = []
    for name, (bound, default, least) in THRESHOLDS.items():
        value = F.coalesce(F.col(name), F.lit(default if defaults else None).cast("double"))
        good = value >= bound if least else value <= bound
        tests.append(F.when(~F.coalesce(good, F.lit(False)), F.lit(name)))
    failures = F.array_compact(F.array(*tests))
    return metrics.withColumn("failures", F.array_join(failures, ",")).withColumn("pass", F.size(failures) == 0)


def judge(persona_rows: DataFrame) -> DataFrame:
    """A fixed score for each factor, lower for personas with a caveat or without claims; the mean and the gate."""
    weak = F.col("caveat").isNotNull() | (F.col("n_claims") == 0)
    rows = persona_rows.select("*", *(F.when(weak, low).otherwise(high).alias(n) for n, (high, low) in FACTORS.items()))
    mean = sum((F.col(n) for n in FACTORS), F.lit(0.0)) / len(FACTORS)
    failures = F.array_compact(F.array(F.when(mean < PPS_AVERAGE, F.lit("average")), *(F.when(F.col(n) < PPS_LEAST, F.lit(n)) for n in FACTORS)))
    return rows.withColumn("average", mean).withColumn("failures", F.array_join(failures, ",")).withColumn("pass", F.size(failures) == 0)


def benchmark(checks: DataFrame) -> DataFrame:
    """(dimension, pass, score): ``checks(dimension, ok)`` rolled up; a dimension passes if all of it does."""
    return checks.groupBy("dimension").agg(F.bool_and("ok").alias("pass"), (F.count_if("ok") / F.count("*")).alias("score"))


def persona_benchmark(scores: DataFrame, expected: dict, denied: tuple = ()) -> DataFrame:
    """(dimension, pass, score): ``scores(name, schema, quality, knowledge)`` of a folder's personas, see ``clones.score``, rolled up with what
    ``expected`` declares (categories, providers, commands, dimensions). A name of ``denied`` is an error."""
    from .clones import CATEGORIES

    if denied and (found := scores.where(F.col("name").isin(*denied)).limit(1).collect()):
        raise ValueError(f"a persona that may not be: {found[0]['name']}")
    has = {k: F.lit(set(need) <= set(expected.get(k) or ())) for k, need in (("categories", CATEGORIES), ("providers", PROVIDERS), ("commands", COMMANDS), ("dimensions", DIMENSIONS))}
    every = lambda c: F.coalesce(F.bool_and(c), F.lit(True)).alias(c)
    one = scores.agg((F.count("*") > 0).alias("any"), every("schema"), every("quality"), every("knowledge"))
    schema, quality, knowledge = (F.col(c) for c in ("schema", "quality", "knowledge"))
    sound = F.col("any") & has["dimensions"] & schema & quality & knowledge
    tests = (
        schema, quality, has["commands"], has["categories"] & schema, has["commands"], has["commands"], has["providers"], schema & knowledge,
        sound & has["providers"], has["categories"] & sound & has["providers"] & has["commands"],
    )
    rows = F.array(*(F.struct(F.lit(n).alias("dimension"), t.alias("pass")) for n, t in zip(DIMENSIONS, tests, strict=True)))
    return one.select(F.explode(rows).alias("r")).select("r.dimension", "r.pass", F.col("r.pass").cast("double").alias("score"))


def moderator_summary(persona_rows: DataFrame) -> DataFrame:
    """(ord, caveat): the caveats of a debate's personas, in order of the personas and of each one's own. At most five personas."""
    return persona_rows.select("author_id", F.posexplode("caveats").alias("nth", "caveat")).select((F.row_number().over(Window.orderBy("author_id", "nth"))).alias("ord"), "caveat")


def render_benchmark(dimensions: DataFrame) -> DataFrame:
    line = F.concat(F.lit("- "), "dimension", F.lit(": "), F.when(F.col("pass"), "PASS").otherwise("FAIL"), F.lit(" ("), F.format_number("score", 2), F.lit(")"))
    return dimensions.select("dimension", line.alias("text"))


def quality_gate(exported: DataFrame, source_id: Column, forbidden: list[str], least_words: int = 8) -> DataFrame:
    """One row of the checks of an export: documents, citations, Hangul, phrases, words."""
    from ..functions import text as T

    text = F.coalesce("content", F.lit(""))
    bad = F.lit(False)
    for phrase in forbidden:
        bad = bad | F.lower(text).contains(phrase.lower())
    return exported.agg(
        (F.count("*") > 0).alias("has_documents"), F.coalesce(F.bool_and(F.coalesce(F.col("source_id") == source_id, F.lit(False))), F.lit(False)).alias("all_cited"),
        F.coalesce(F.bool_or(text.rlike("[가-힣]")), F.lit(False)).alias("has_hangul"), F.coalesce(~F.bool_or(bad), F.lit(True)).alias("no_forbidden"),
        (F.coalesce(F.sum(T.word_count(text)), F.lit(0)) >= least_words).alias("enough_words"),
    )


def sessions(conversations: DataFrame) -> DataFrame:
    """Per conversation its turns, by role, and its first and last text's length."""
    return conversations.groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.min_by(F.length("text"), F.struct("turn", "text")).cast("long").alias("first_chars"), F.max_by(F.length("text"), F.struct("turn", "text")).cast("long").alias("last_chars"),
    )


def answer(persona_rows: DataFrame, claim_rows: DataFrame) -> DataFrame:
    """What a persona says in a chat: its name and its first claim."""
    first = claim_rows.where("claim_id = 'claim-1'").select("author_id", F.col("text").alias("t"))
    return persona_rows.join(first, "author_id", "left").select("author_id", F.concat_ws(": ", "author_id", F.coalesce("t", F.lit(NO_EVIDENCE))).alias("answer"))


CHAT = "session_id string, turn bigint, author_id string, prompt string, answer string"


def chat(spark: SparkSession, persona_rows: DataFrame, claim_rows: DataFrame, author: str, prompt: str, folder: str | None = None, resume: str | None = None) -> DataFrame:
    """One turn of a chat with a persona: its answer, appended to the session's history under ``folder``.

    A session is named after the persona unless it is ``resume``d by name; names of other signs than letters, digits, _ and - are an error.
    """
    session = resume or f"session-{author}"
    if not prompt or not re.fullmatch(r"[A-Za-z0-9_-]+", session):
        raise ValueError(f"a chat needs a prompt and a session with a plain name: {session}")
    said = answer(persona_rows.where(F.col("author_id") == author), claim_rows).first()
    if said is None:
        raise ValueError(f"no such persona: {author}")
    row = spark.createDataFrame([(session, time.time_ns(), author, prompt, said["answer"])], CHAT)
    if folder:
        row.coalesce(1).write.mode("append").partitionBy("session_id").parquet(folder)
    return row


def chat_history(spark: SparkSession, folder: str) -> DataFrame:
    """(session_id, turns) of the sessions kept under ``folder``."""
    return spark.read.schema(CHAT).parquet(folder).groupBy("session_id").agg(F.count("*").alias("turns"))


def exported_texts(exported: DataFrame) -> DataFrame:
    """(source_id, content) of an export's documents, as the quality gate takes them: the source from the provenance
    where the document has none, blank values as missing."""
    named = lambda c: F.nullif(F.trim(c), F.lit(""))
    source = named(F.col("source_id"))
    if "provenance" in exported.columns:
        source = F.coalesce(source, named(F.col("provenance.sourceId")))
    return exported.select(source.alias("source_id"), named(F.col("content")).alias("content"))


def export_chunks(exported: DataFrame, most: int = CLAIMS) -> DataFrame:
    """The first documents with text of each exported source as chunks, to make claims of."""
    first = F.row_number().over(Window.partitionBy("source_id").orderBy("slug"))
    rows = exported.where(F.trim("content") != "").withColumn("nth", first).where(F.col("nth") <= most)
    text = F.trim(F.regexp_replace("content", r"\s+", " "))
    return rows.select("source_id", F.col("slug").alias("doc_id"), F.concat("slug", F.lit(":e1")).alias("element_id"), F.concat("slug", F.lit(":e1:c1")).alias("chunk_id"), text.alias("text"), F.col("slug").alias("source_file"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"))
