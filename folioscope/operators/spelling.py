"""Words within one or two letters of each other: joins on what is left when letters are left out.

Two words within d letters share a string that comes of each by leaving out at most d letters (Mor and Fraenkel, CACM 1982), so such strings
are joined by equality, and pairs confirmed by their edit distance. Words of more than ``LONG`` letters would leave too many:
they are cut into d + 1 pieces, one of which an edit leaves whole, at most d places off (Li, Deng, Wang and Feng, VLDB 2011).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONG = 20
FEW = 200_000  # keys of words, by a count, that are sent to wherever the tokens are


def _without_one(word: Column) -> Column:
    n = F.length(word)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))


def leavings(word: Column, distance: int) -> Column:
    """The distinct strings that are left of a word without up to ``distance`` of its letters, the word itself included."""
    every, last = F.array(word), F.array(word)
    for _ in range(distance):
        last = F.array_distinct(F.flatten(F.transform(last, _without_one)))
        every = F.concat(every, last)
    return F.array_distinct(every)


def _pieces(word: Column, of_length: Column, distance: int, slack: int) -> Column:
    """Keys of the pieces that a word of ``of_length`` letters is cut into, as they stand in ``word`` up to ``slack`` places off."""
    step = F.floor(of_length / (distance + 1)).cast("int")
    keys = []
    for i in range(distance + 1):
        size = of_length - i * step if i == distance else step
        for off in range(-slack, slack + 1):
            start = step * i + 1 + off
            keys.append(F.when((start >= 1) & (start + size - 1 <= F.length(word)), F.concat(of_length.cast("string"), F.lit(f":{i}:"), F.substring(word, start, size))))
    return F.array_compact(F.array(*keys))


def neighbours(words: DataFrame, tokens: DataFrame, distance: int = 2, long: int = LONG) -> DataFrame:
    """(word, token, distance) of all pairs of ``words(word)`` and ``tokens(token)`` within ``distance`` letters put in, left out or changed.

    Nulls are in no pair, repeated words count once, and a word pairs with itself at distance 0. Words may be empty and of any length.
    """
    words = words.select("word").where("word is not null").distinct()
    tokens = tokens.select("token").where("token is not null").distinct()
    n = F.length("word")
    keyed = lambda rows, test, keys: rows.where(test).select("*", F.explode(keys).alias("key"))
    some = keyed(words, n <= long + distance, leavings(F.col("word"), distance))
    few = some.limit(FEW + 1).count() <= FEW  # then the many keys of the tokens aren't shuffled
    short = (F.broadcast(some) if few else some).join(keyed(tokens, F.length("token") <= long, leavings(F.col("token"), distance)), "key")
    lengths = F.flatten(F.array(*(_pieces(F.col("word"), n + d, distance, distance) for d in range(-distance, distance + 1))))
    far = keyed(words, n > long - distance, lengths).join(keyed(tokens, F.length("token") > long, _pieces(F.col("token"), F.length("token"), distance, 0)), "key")
    pairs = short.select("word", "token").unionByName(far.select("word", "token")).distinct()
    found = pairs.select("word", "token", F.levenshtein("word", "token", distance).alias("distance"))
    return found.where(F.col("distance") >= 0)


def suggestions(words: DataFrame, tokens: DataFrame, distance: int = 2) -> DataFrame:
    """(word, token, distance, df) for ``words`` that aren't among ``tokens(token, df)``, each with the tokens near it."""
    unknown = words.join(tokens, F.col("word") == F.col("token"), "left_anti")
    return neighbours(unknown, tokens, distance).join(tokens.select("token", "df"), "token").select("word", "token", "distance", "df")
