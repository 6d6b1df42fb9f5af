"""How document filters interact: what each filter takes out, in every order of the filters, from one CUBE.

A document's failures are five flags. Documents are counted by part and flags, at most 32 rows a part, and CUBE over
the flags and the part counts those for every subset: the grouping-set row whose selected flags are all false holds
the survivors of that subset of filters. A step of an order goes from the survivors of the filters before it to those
with its own as well, so each step is a join of two subsets; nothing is filtered 120 times.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
# Blanks between words, and the symbols that filter D looks for.
BLANK_PATTERN = "[\\x20\\x09-\\x0D]+"
SYMBOL_PATTERN = "[#$%&*|]"


def failures(text: Column) -> dict[str, Column]:
    """Conditions A to D over a text that isn't null."""
    words = F.filter(F.split(text, BLANK_PATTERN), lambda w: w != "")
    n = F.size(words).cast("long")
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    return {
        "A": n < 200,
        "B": F.size(F.array_distinct(words)).cast("long") * 100 < n * 50,
        "C": capitals * 100 > F.char_length(text).cast("long") * 3,
        "D": text.rlike(SYMBOL_PATTERN),
    }


def flagged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: part, good, toxic and a flag for each of A to E (true: it fails).

    E: the text stands with a smaller id somewhere in the table. Each text's smallest id is found with partial sums, and
    joined back on text hash and id, so copies of one text, however many, are spread by their ids. A row without an id has no smaller one.
    Null texts count as empty, null parts as the empty string. Several labels of one id: good if any says so, toxic if any does.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("hash"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), *[f.alias(k) for k, f in failures(text).items()])
    first = rows.where("id is not null").groupBy("hash").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    whole = rows.join(said, "id", "left").join(first, ["id", "hash"], "left")
    no = F.lit(False)
    return whole.select("part", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"), *"ABCD", (F.col("id").isNotNull() & F.col("first").isNull()).alias("E"))


def survivors(flags: DataFrame) -> DataFrame:
    """(part, subset, n, good, toxic): documents of each part that pass all filters of each subset, zeros included.

    ``subset`` is a number with a bit for each filter, A being 16 and E 1.
    """
    few = flags.groupBy("part", *FILTERS).agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    cells = few.cube("part", *FILTERS).agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"), (F.grouping_id() % 32).alias("left_out"), F.grouping("part").alias("whole"))
    passed = F.lit(True)
    for f in FILTERS:
        passed = passed & ~F.coalesce(F.col(f), F.lit(False))
    found = cells.where((F.col("whole") == 0) & passed).select("part", (31 - F.col("left_out")).cast("int").alias("subset"), "n", "good", "toxic")
    everywhere = few.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("subset"))
    zero = F.lit(0).cast("long")
    return everywhere.join(found, ["part", "subset"], "left").select("part", "subset", *[F.coalesce(c, zero).alias(c) for c in ("n", "good", "toxic")])


def steps(spark) -> DataFrame:
    """(filter_order, step, filter, before, after, alone): the two subsets that each step of each order compares."""
    bit = {f: 16 >> i for i, f in enumerate(FILTERS)}
    rows = []
    for order in map("".join, permutations(FILTERS)):
        masks = [sum(bit[f] for f in order[:k]) for k in range(len(order) + 1)]
        rows += [(order, k + 1, f, masks[k], masks[k + 1], bit[f]) for k, f in enumerate(order)]
    return spark.createDataFrame(rows, "filter_order string, step int, filter string, before int, after int, alone int")


def audit(flags: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``flags``: the columns of ``flagged``; no flag may be null. Parts come out with all 600 steps, zeros included; of no rows
    come no rows. Repeated rows count as often as they stand.
    """
    from .support import cut

    counts = cut(survivors(flags))  # 32 rows a part, read five times
    side = lambda name, *more: counts.select("part", F.col("subset").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("n", *more)])
    every = counts.where("subset = 0").select("part", F.col("n").alias("n_all")).join(counts.where("subset = 31").select("part", F.col("n").alias("n_none")), "part")
    # The table of steps has 600 rows, whatever the data.
    rows = side("before", "good", "toxic").join(F.broadcast(steps(flags.sparkSession)), "before").join(every, "part").withColumn("others", 31 - F.col("alone"))
    for name, more in (("after", ("good", "toxic")), ("alone", ()), ("others", ())):
        rows = rows.join(side(name, *more), ["part", name])
    n = F.col("n_before") - F.col("n_after")
    rows = rows.select(
        "part", "filter_order", F.col("step").cast("int"), "filter", F.col("n_after").alias("kept"), n.alias("removed"), (F.col("n_all") - F.col("n_alone") - n).alias("redundant"),
        (F.col("n_others") - F.col("n_none")).alias("unique_fails"), (F.col("good_before") - F.col("good_after")).alias("good_lost"), (F.col("toxic_before") - F.col("toxic_after")).alias("toxic_lost"),
    )
    total = rows.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return rows.join(total, ["part", "filter"])
