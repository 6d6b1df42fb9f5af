"""Query of operator 7 and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sharding
from .support import table


def op7_shard_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 64 shards by a table of 65,537 slots."""
    rows = sharding.placed(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "slot", "shard_id", "shard")


QUERIES = {"op7_shard_lookup": op7_shard_lookup}
# The table is filled step by step, which SQL can't say well: the SQL gets it as a constant, made
# by the operator and held against a plain fill in tests/llm, and does the placing by itself.
SQL = {
    "op7_shard_lookup": f"""
WITH held AS (SELECT string_split('{",".join(map(str, sharding.fill(sharding.shard_names(sharding.SHARDS))))}', ',')::INTEGER[] AS shards),
k AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
        ('0x' || md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))))[1:8])::BIGINT % {sharding.SLOTS} AS slot FROM documents)
SELECT doc_id, n_bytes, slot, shards[slot + 1] AS shard_id, printf('shard-%05d', shards[slot + 1]) AS shard
FROM k, held
"""
}
