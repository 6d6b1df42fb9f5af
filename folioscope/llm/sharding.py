"""Sharding by a lookup table that the shards' permutations fill, placement in DataFrame operations.

Each shard has a preference order over the slots of a table of prime size: from its own offset, by
its own step. Shards take turns; each claims the next slot of its order that is free, until all are
taken. Shards so hold the same number of slots, to one, and when a shard comes or goes few slots
change hands (the lookup table of Maglev, Eisenbud et al., NSDI 2016). The table has as many rows as
slots, whatever the data, so it is broadcast; a row's place is a hash modulo the table's size.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 65_537
SHARDS = 64


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def fill(names: list[str], slots: int = SLOTS) -> list[int]:
    """The number of the shard that holds each slot. ``slots`` has to be a prime above the shards' number."""
    if not names or len(set(names)) < len(names) or len(names) > slots:
        raise ValueError("shards need distinct names, and a slot each")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime")
    hashed = [hashlib.md5(n.encode()).hexdigest() for n in names]
    at = [int(h[:8], 16) % slots for h in hashed]
    step = [int(h[8:16], 16) % (slots - 1) + 1 for h in hashed]
    held, free = [-1] * slots, slots
    while free:
        for shard in range(len(names)):
            while held[at[shard]] >= 0:
                at[shard] = (at[shard] + step[shard]) % slots
            held[at[shard]] = shard
            free -= 1
            if not free:
                break
    return held


def lookup(spark, names: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard_id, shard): the filled table, from one constant."""
    numbers = F.split(F.lit(",".join(map(str, fill(names, slots)))), ",")
    labels = F.split(F.lit(",".join(names)), ",")
    rows = spark.range(slots).select(F.col("id").alias("slot"), F.get(numbers, F.col("id").cast("int")).cast("int").alias("shard_id"))
    return rows.withColumn("shard", F.get(labels, "shard_id"))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") % slots


def placed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``docs`` with ``slot``, ``shard_id`` and ``shard`` (columns of these names are replaced).

    A row's key is its id; rows with a null id are placed by the MD5 of their text (null: the empty
    text), so that they don't all meet in one shard. Equal keys, and so repeated rows, share a shard.
    No rows: no rows. No shuffle: rows stay where they were read.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))
    own = [c for c in docs.columns if c.lower() not in ("slot", "shard_id", "shard")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), slot_of(key, slots).alias("slot"))
    return rows.join(F.broadcast(lookup(docs.sparkSession, shard_names(shards), slots)), "slot").select("row.*", "slot", "shard_id", "shard")


def write_sharded(docs: DataFrame, path: str, rows_per_file: int = 1_000_000, **options) -> None:
    """Parquet under ``path``, a folder for each shard, files of about ``rows_per_file`` rows in each, dealt by
    row hash: as many tasks as files, so that they grow with the rows. Null ids and repeated rows are placed as ``placed`` says; of no rows come no files."""
    rows = placed(docs, **options)
    shards = options.get("shards", SHARDS)
    files = max(1, -(-docs.count() // (shards * rows_per_file)))
    deal = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, t in rows.dtypes if "map" not in t]), F.lit(files))
    rows.repartition(shards * files, F.col("shard_id"), deal).write.partitionBy("shard").parquet(path)
