"""URL filters by dated lists, in DataFrame operations only.

A list is a log of dated entries: a pattern is added or removed at a time. Entries become validity
intervals, and every capture is judged by the intervals that hold at its fetch time, as the list was
then and not as it is now.

A pattern is a host or a domain above it ("example.org" covers "m.example.org"), or a host with the
first parts of a path ("example.org/ads" covers "example.org/ads/1"). Letter case doesn't count, in paths
neither. Captures of one host and as many parts of path as the list's longest pattern are of one site, whose
patterns are looked up once.

The as-of join works on each pattern and time that captures ask for once: these and the entries are
ordered by pattern and time in ranges, and a range knows the state in which the ranges before have left
the pattern. So neither a pattern's history nor its captures are ever gathered in one place. Captures then meet one row
for their site and time; one with a third of all captures is only the large side of a join against unique keys, which
adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .support import cut

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^:/?#]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]+)"


def host(url: Column) -> Column:
    """Lower-case host without dots at its end, null if the address has none. An address in brackets keeps them."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.+$", ""), F.lit(""))


def parts(url: Column, most: int = 1) -> Column:
    """The first ``most`` parts of the path in lower case, empty ones left out."""
    found = F.split(F.lower(F.regexp_extract(url, PATH, 1)), "/")
    return F.slice(F.filter(found, lambda x: x != ""), 1, most)


def intervals(entries: DataFrame) -> DataFrame:
    """``entries(pattern, action, at)``, action "add" or "remove"; returns (pattern, valid_from, valid_to).

    valid_to is open (null: still listed). Of several entries for a pattern at one time an "add"
    decides. Entries with a null in any column, or another action, say nothing. Repeated entries
    change nothing. Adds in a row make adjoining intervals, of which at most one holds at any time.
    """
    said = entries.where("action in ('add', 'remove')").dropna(subset=["pattern", "action", "at"])
    said = said.groupBy(F.lower("pattern").alias("pattern"), "at").agg(F.max((F.col("action") == "add").cast("int")).alias("listed"))
    then = F.lead("at").over(Window.partitionBy("pattern").orderBy("at"))
    return said.withColumn("valid_to", then).where("listed = 1").select("pattern", F.col("at").alias("valid_from"), "valid_to")


def patterns(host_col: Column, path: Column) -> Column:
    """Patterns that cover a site of a host and some parts of a path, each once."""
    labels = F.split(host_col, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    below = F.transform(path, lambda _, i: F.concat(host_col, F.lit("/"), F.array_join(F.slice(path, 1, i + 1), "/")))
    # an address in brackets or of numbers has no domain above it
    whole = host_col.startswith("[") | host_col.rlike(r"^[0-9.]+$")
    return F.concat(F.when(whole, F.array(host_col)).otherwise(above), below)


def as_of(asked: DataFrame, listed: DataFrame) -> DataFrame:
    """``asked(pattern, at)``, each once; the interval of ``listed(pattern, valid_from, valid_to)`` that holds at
    each, if any: (pattern, at, listed_from)."""
    state = F.struct(F.col("valid_from").alias("since"), F.col("valid_to").alias("until"))
    rows = listed.select("pattern", F.col("valid_from").alias("at"), F.lit(0).alias("asks"), state.alias("state"))
    kind = rows.schema["state"].dataType.simpleString()
    rows = rows.unionByName(asked.select("pattern", "at", F.lit(1).alias("asks"), F.lit(None).cast(kind).alias("state")))
    ranges = cut(rows.orderBy("pattern", "at", "asks"))  # an entry counts at its own time already
    ranges = ranges.withColumns({"range": F.spark_partition_id(), "nth": F.monotonically_increasing_id()})
    ends = ranges.groupBy("pattern", "range").agg(F.max("state").alias("end"))  # the last begun is the greatest
    earlier = Window.partitionBy("pattern").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("pattern", "range", F.max("end").over(earlier).alias("left"))
    inside = Window.partitionBy("pattern", "range").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = ranges.withColumn("state", F.last("state", ignorenulls=True).over(inside)).where("asks = 1").join(ends, ["pattern", "range"])
    met = met.withColumn("state", F.coalesce("state", "left")).where("state is not null and (state.until is null or at < state.until)")
    return met.select("pattern", "at", F.col("state.since").alias("listed_from"))


def judge(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """``captures`` with host, n_active, blocked, pattern and listed_from (columns of these names are replaced).

    pattern: the longest active pattern, of equal length the smallest; listed_from: since when it held.
    A capture without an address, host or time meets no entry and isn't blocked. Repeated captures
    are judged each. Empty lists block nothing.
    """
    added = ("host", "n_active", "blocked", "pattern", "listed_from")
    own = [F.col(f"`{c}`") for c in captures.columns if c.lower() not in added]
    listed = cut(intervals(entries))
    depth = listed.agg(F.max(F.size(F.split("pattern", "/")) - 1)).first()[0] or 0
    site = F.when(host(F.col(url_col)).isNotNull(), F.struct(host(F.col(url_col)).alias("host"), parts(F.col(url_col), depth).alias("path")))
    rows = captures.select(F.struct(*own).alias("row"), site.alias("site"), F.col(time_col).alias("at"))
    moments = rows.where("site is not null and at is not null").select("site", "at").distinct()
    wide = moments.select("site").distinct().select("site", F.explode(patterns(F.col("site.host"), F.col("site.path"))).alias("pattern"))
    known = cut(wide.join(listed.select("pattern").distinct(), "pattern", "left_semi"))
    questions = cut(moments.join(known, "site"))
    found = as_of(questions.select("pattern", "at").distinct(), listed)
    first = F.min(F.struct((-F.length("pattern")).alias("n"), "pattern", "listed_from")).alias("first")
    answers = questions.join(found, ["pattern", "at"]).groupBy(F.col("site").alias("s"), F.col("at").alias("t")).agg(F.count("*").cast("int").alias("n"), first)
    met = rows.join(answers, (rows["site"] == answers["s"]) & (rows["at"] == answers["t"]), "left")
    n = F.coalesce("n", F.lit(0))
    return met.select("row.*", F.col("site.host").alias("host"), n.alias("n_active"), (n > 0).alias("blocked"), F.col("first.pattern").alias("pattern"), F.col("first.listed_from").alias("listed_from"))


def allowed(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """The captures that no entry covered when they were fetched, columns as they were.

    A null or odd url, a null time and an empty list block nothing; repeated rows are judged alike, and each stays or goes. No rows: no rows.
    """
    tag = captures.select(F.struct(*[F.col(f"`{c}`") for c in captures.columns]).alias("capture"), F.col(url_col).alias("u"), F.col(time_col).alias("t"))
    return judge(tag, entries, "u", "t").where("not blocked").select("capture.*")
