"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Documents of a source stand in a shuffled order (MD5 of their id), are laid end to end and cut into
equal blocks, of ``block`` words in a source of many words and of fewer in others, so that each has
``LEAST`` blocks or blocks of one word. Slot i of the schedule is the golden-ratio point i * ``STEP`` modulo
2^60, an integer, so that points stay distinct and even at any number of slots; cumulative targets, in blocks, map it
to a source. The slots of a source are ranked, and slot number r takes the source's block r modulo its
number of blocks, until the target is reached: sources of all sizes come to within half a block of theirs.
Any stretch of the schedule is near the target weights, and a source's blocks are taken equally often, to one.

Each source has ``SPARE`` slots more than it needs, for the schedule's discrepancy; what is over stays empty.

Bounds. A source may hold most rows: places within a source are sums over ranges of the
shuffled order, as many as sorting all rows takes, and then within a range; ranks of slots are counts over stretches of slots, and
then within a stretch. No window holds a whole source. One row per source (and range or stretch) is
all that is ever ordered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .support import cut

BLOCK = 64  # words in a block, at most
LEAST = 1024  # blocks that a source has at least, if it has as many words
SPARE = 16
WEIGHTS = (1, 2, 3)
CAP = 3  # a source gives at most so many times its words
BITS = 60  # points are below 2 to this power
STEP = 712544676207699905  # the golden ratio's share of 2^60
LIMB = (1 << 20) - 1
CELL_BITS = 10  # cells of the points' range, for an equality join of points and shares; more for more sources
STRETCH = 1 << 14  # slots ranked together
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, place) of every row: size in words (null text: 0), place in the shuffled order."""
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))
    return rows.withColumn("place", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")))


def targets(rows: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP, block: int = BLOCK) -> DataFrame:
    """``rows(source, size)``; returns a row per source: source, weight, source_size, target; blocks, and
    turns, the number of blocks that make the target; lo and hi, the source's share of the schedule; low and past, the same as points.

    Sources by code point, null last, take the weights in turn. Together they share the words of
    all rows; a source stops at ``cap`` times its own words and the excess goes to the others by
    weight, until none is above. In order of words per weight the stopped sources come first, so
    the level is the first one at which the next source isn't stopped.
    """
    by = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(named) - 1) % len(weights) + 1).cast("long")
    by = by.withColumn("weight", weight)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = Window.orderBy((cap * F.col("source_size")).cast("double") / F.col("weight"), F.col("source").isNull(), "source")
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    by = by.select(
        "source", "weight", "source_size", F.sum("source_size").over(whole).alias("total"),
        (F.sum("source_size").over(whole) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("left"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("share"),
        F.row_number().over(level).alias("n"),
    )
    free = cap * F.col("source_size") * F.col("share") > F.col("left") * F.col("weight")
    first = F.min(F.when(free, F.struct("n", "left", "share"))).over(whole)
    by = by.withColumn("first", first)
    open_ = F.coalesce(F.col("n") >= F.col("first.n"), F.lit(False))
    shared = F.col("first.left").cast("double") * F.col("weight") / F.col("first.share")
    by = by.withColumn("target", F.when(open_, shared).otherwise((cap * F.col("source_size")).cast("double")))
    size = F.col("source_size")
    by = by.withColumn("blocks", F.greatest(F.ceil(size / block), F.least(size, F.lit(LEAST))))
    by = by.withColumn("turns", F.coalesce(F.floor(F.col("target") * F.col("blocks") / F.nullif(size, F.lit(0)) + F.lit(0.5)), F.lit(0)))
    by = by.withColumn("slots", F.when(F.col("turns") > 0, F.col("turns") + SPARE).otherwise(0).cast("long"))
    upto = named.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by = by.withColumns({"upto": F.sum("slots").over(upto), "every": F.sum("slots").over(whole)})
    point = lambda n: F.when(F.col("every") > 0, F.expr(f"cast({n} as decimal(19, 0)) * {1 << BITS} div every")).otherwise(0)
    by = by.withColumns({"low": point("(upto - slots)"), "past": point("upto")})
    shares = [(F.col(c) / F.lit(1 << BITS)).alias(d) for c, d in (("low", "lo"), ("past", "hi"))]
    return by.select("source", "weight", "source_size", "target", "blocks", "turns", "slots", "low", "past", *shares)


def point(slot: Column) -> Column:
    """``slot * STEP`` modulo 2^60, in three limbs of 20 bits, so that no product leaves 64 bits."""
    i = [F.shiftright(slot, k).bitwiseAND(LIMB) for k in (0, 20, 40)]
    k = [STEP >> n & LIMB for n in (0, 20, 40)]
    middle = (i[0] * k[1] + i[1] * k[0]).bitwiseAND((1 << 40) - 1)
    high = (i[0] * k[2] + i[1] * k[1] + i[2] * k[0]).bitwiseAND(LIMB)
    return (i[0] * k[0] + F.shiftleft(middle, 20) + F.shiftleft(high, 40)).bitwiseAND((1 << BITS) - 1)


def block_of(word: Column) -> Column:
    """The block that a source's word lies in; block k begins at word ``k * source_size / blocks``, rounded down."""
    return F.call_function("div", _wide(word + 1) * F.col("blocks") - 1, F.col("source_size"))


def begin_of(part: Column) -> Column:
    return F.call_function("div", _wide(part) * F.col("source_size"), F.col("blocks"))


def _wide(number: Column) -> Column:
    """Products of words and blocks of 100 TB need more than 64 bits."""
    return number.cast("decimal(19, 0)")


def places(rows: DataFrame) -> DataFrame:
    """``rows`` with ``start``: the words before the row in its source's shuffled order.

    All rows are ordered by source and place in ranges, which grow in number with the rows; a source's places are sums
    over its ranges, and then within a range. Rows of one place (null or repeated ids) stand in order of size, and may be in several ranges.
    """
    tie = F.xxhash64(F.monotonically_increasing_id())  # equal rows can stand in any order
    ranges = cut(rows.orderBy(F.col("source").isNull(), "source", "place", F.col("id").isNull(), "id", "size", tie))
    ranges = ranges.withColumns({"range": F.spark_partition_id(), "nth": F.monotonically_increasing_id()})
    sums = ranges.groupBy("source", "range").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "range").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranges.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.join(sums, placed["source"].eqNullSafe(sums["s"]) & (placed["range"] == sums["r"]))
    return joined.withColumn("start", F.col("base") + F.col("inner")).drop("s", "r", "base", "inner", "range", "nth")


def schedule(shares: DataFrame) -> DataFrame:
    """The mix itself: (slot, source, turn, part), a row for each block that is taken, to be taken in order of ``slot``.

    turn: the row's rank among its source's; part: the block it takes. Slots that a source doesn't need any more have
    no row. No words: no rows.
    """
    spark = shares.sparkSession
    n, sources = shares.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count("*")).first()
    bits = max(CELL_BITS, sources.bit_length())
    points = spark.range(n).select(F.col("id").alias("slot"), point(F.col("id")).alias("x"))
    points = points.withColumn("cell", F.shiftright("x", BITS - bits))
    cells = shares.where("past > low").select("source", "low", "past", "blocks", "turns", F.explode(F.sequence(F.shiftright("low", BITS - bits), F.shiftright(F.col("past") - 1, BITS - bits))).alias("cell"))
    slots = points.join(cells, "cell").where("x >= low and x < past").select("slot", "source", "blocks", "turns", F.floor(F.col("slot") / STRETCH).alias("stretch"))
    counts = slots.groupBy("source", "stretch").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("source").alias("s"), F.col("stretch").alias("t"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "stretch").orderBy("slot")
    ranked = slots.withColumn("inner", F.row_number().over(inside) - 1)
    ranked = ranked.join(base, ranked["source"].eqNullSafe(base["s"]) & (ranked["stretch"] == base["t"]))
    ranked = ranked.withColumn("turn", F.col("base") + F.col("inner")).where("turn < turns")
    return ranked.select("slot", "source", "turn", (F.col("turn") % F.col("blocks")).alias("part"))


def mix(rows: DataFrame, shares: DataFrame) -> DataFrame:
    """``rows`` of ``sized`` with ``taken`` (words that the schedule takes, repeats counted),
    ``times`` (how often it takes the block in which the row begins) and the source's columns."""
    times = schedule(shares).groupBy("source", "part").agg(F.count("*").alias("times"))
    times = times.withColumnRenamed("source", "s").withColumnRenamed("part", "p")
    of = shares.select(F.col("source").alias("s"), "weight", "source_size", "target", "blocks")
    laid = places(rows)
    laid = cut(laid.join(of, laid["source"].eqNullSafe(of["s"])).drop("s"))
    end = F.col("start") + F.col("size")
    parts = laid.where("size > 0").select("source", "size", "start", "source_size", "blocks", F.explode(F.sequence(block_of(F.col("start")), block_of(end - 1))).alias("part"))
    met = parts.join(times, parts["source"].eqNullSafe(times["s"]) & (parts["part"] == times["p"]))
    words = F.least(end, begin_of(F.col("part") + 1)) - F.greatest(F.col("start"), begin_of(F.col("part")))
    begins = F.when(F.col("part") == block_of(F.col("start")), F.col("times"))
    taken = met.groupBy("source", "start").agg(F.sum(F.col("times") * words).alias("taken"), F.max(begins).alias("times"))
    taken = taken.select(F.col("source").alias("s"), F.col("start").alias("a"), "taken", "times")
    out = laid.join(taken, laid["source"].eqNullSafe(taken["s"]) & (laid["start"] == taken["a"]) & (laid["size"] > 0), "left").drop("s", "a")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("taken", "times")})


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, cap: int = CAP, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, weight, target, taken, times.

    A null text has no words and is never taken; a null source is a source of its own, the last;
    null ids share a place in the shuffled order; repeated rows stand beside each other, each with
    words of its own. Other columns are not looked at. If no document has a word, every target is 0.
    No rows: no rows.
    """
    rows = cut(sized(docs, id_col, text_col, source_col))
    shares = cut(targets(rows, weights, cap, block))
    return mix(rows, shares).select("id", "source", "size", "source_size", "weight", "target", "taken", "times")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, cap: int = CAP, block: int = BLOCK) -> DataFrame:
    """The mix as whole documents, columns as they were: each row stands as often as the schedule
    takes the block in which it begins, not at all if never; rows without words aren't taken.

    Rows that agree in id, source and size stand for one another: each is taken as often as all of
    them together are, shared out evenly to one, the first by hash of text and of all columns once more. So
    reruns agree. A null text has no words, a null source is one of its own. No rows: no rows.
    """
    found = mixed(docs, id_col, text_col, source_col, weights, cap, block)
    by = found.groupBy("id", "source", "size").agg(F.sum("times").alias("times"), F.count("*").alias("rows"))
    by = cut(by.where("times > 0").select(F.struct("id", "source", "size").alias("of"), "times", "rows"))
    text = F.col(text_col).cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    key = [F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size")]
    plain = [F.col(f"`{c}`") for c, t in docs.dtypes if "map" not in t]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *key, F.sha2(F.coalesce(text, F.lit("")), 256).alias("digest"), F.xxhash64(*plain).alias("all"))
    met = rows.join(by, rows["id"].eqNullSafe(by["of.id"]) & rows["source"].eqNullSafe(by["of.source"]) & (rows["size"] == by["of.size"]))
    own = met.where("rows = 1").select("row", "times")
    if not by.where("rows > 1").isEmpty():
        nth = F.row_number().over(Window.partitionBy("of").orderBy("digest", "all"))
        share = F.floor(F.col("times") / F.col("rows")) + (nth <= F.col("times") % F.col("rows")).cast("int")
        own = own.unionByName(met.where("rows > 1").select("row", share.alias("times")))
    return own.where("times > 0").withColumn("copy", F.explode(F.expr("sequence(1, times)"))).select("row.*")
