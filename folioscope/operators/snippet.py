"""The passage of a text that a query is best found in, in projections inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.query import parse_query

LONGEST = 320
AROUND = 14


def matches_in(text: Column, terms: list[str]) -> Column:
    """Two for each term of several words that the text holds, one for each place of a single word."""
    count = F.lit(0)
    for t in terms:
        count = count + (F.when(text.contains(t), 2).otherwise(0) if " " in t else F.regexp_count(text, F.lit(T.bounded(t))))
    return count


def positions(words: Column, terms: list[str]) -> Column:
    """Places (0 first) of words where terms are found, term by term."""
    places = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)))
    return F.concat(*(_of_phrase(words, places, t.split()) if " " in t else _of_word(words, places, t) for t in terms))


def _of_word(words: Column, places: Column, term: str) -> Column:
    return F.filter(places, lambda i: F.coalesce(F.get(words, i).rlike(T.bounded(term)), F.lit(False)))


def _of_phrase(words: Column, places: Column, parts: list[str]) -> Column:
    """Words in a row that hold the parts, all of them places."""

    def here(i: Column) -> Column:
        test = F.lit(True)
        for k, part in enumerate(parts):
            test = test & F.coalesce(F.get(words, i + k).contains(part), F.lit(False))
        return test

    return F.flatten(F.transform(F.filter(places, here), lambda i: F.sequence(i, i + (len(parts) - 1))))


def with_snippet(df: DataFrame, text_col: str, query: str, name: str = "snippet") -> DataFrame:
    """``df`` with the 29 words around the first of the places whose surroundings hold most matches;
    without any, the first 320 characters.

    Words, their lower case and the places are columns of their own, one projection after another, so
    that each is worked out once a row and not once a word.
    """
    terms = parse_query(query).snippet_terms()
    text = F.coalesce(text_col, F.lit(""))
    plain = T.collapse(F.left(text, F.lit(LONGEST)))
    if not terms:
        return df.withColumn(name, plain)
    rows = df.withColumn("__words", T.pieces(text)).withColumn("__lower", F.transform("__words", lambda w: F.lower(w)))
    words, lower = F.col("__words"), F.col("__lower")
    n = F.size(words)
    rows = rows.withColumn("__places", positions(lower, terms))
    start = lambda c: F.greatest(F.lit(0), c - AROUND)
    around = lambda c: F.array_join(F.slice(lower, start(c) + 1, F.least(n, c + (AROUND + 1)) - start(c)), " ")
    scored = F.transform("__places", lambda c, i: F.struct(matches_in(around(c), terms).alias("n"), (-i).alias("i"), start(c).alias("start")))
    rows = rows.withColumn("__best", F.array_max(scored)["start"])
    best = F.col("__best")
    end = F.least(n, best + (2 * AROUND + 1))
    body = F.array_join(F.slice(words, best + 1, end - best), " ")
    whole = F.concat(F.when(best > 0, "… ").otherwise(""), body, F.when(end < n, " …").otherwise(""))
    rows = rows.withColumn("__whole", whole)
    short = F.concat(F.regexp_replace(F.trim(F.left("__whole", F.lit(LONGEST))), r"\s+\S*$", ""), F.lit("…"))
    out = F.when(best.isNull(), plain).when(F.length("__whole") > LONGEST, short).otherwise(F.col("__whole"))
    return rows.withColumn(name, out).drop("__words", "__lower", "__places", "__best", "__whole")
