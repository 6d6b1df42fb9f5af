"""Tables of an index in folders by shard: only the folders that a question names are listed, opened and read."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from .local import local_rows


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


class Sharded:
    """Tables under ``root``, each with a column ``shard``, and a state that is written last."""

    FORMAT = 1  # of the tables; those of another are not read

    def __init__(self, spark: SparkSession, root: str, state: dict) -> None:
        self.spark, self.root, self.state = spark, root.rstrip("/"), state

    @classmethod
    def open(cls, spark: SparkSession, root: str, key: str):
        """The tables under ``root``, if they were made from what ``key`` names."""
        path = f"{root.rstrip('/')}/state.json"
        if not storage.exists(spark, path):
            return None
        state = json.loads(storage.read_text(spark, path))
        return cls(spark, root, state) if state["key"] == key and state.get("format", 1) == cls.FORMAT else None

    def finish(self) -> None:
        self.state["format"] = self.FORMAT
        storage.write_text(self.spark, f"{self.root}/state.json", json.dumps(self.state))

    def put(self, name: str, rows: DataFrame, key: str, shards: int, *order: str) -> None:
        """``rows`` by a hash of ``key``, sorted by ``order``: a shard may be many files, so that no key has to fit a task."""
        dealt = rows.withColumn("shard", shard_of(F.col(key), shards))
        dealt.repartitionByRange("shard", *order).sortWithinPartitions("shard", *order).write.partitionBy("shard").parquet(f"{self.root}/{name}")
        self.state.setdefault("tables", {})[name] = [dealt.schema.json(), shards]

    def put_whole(self, name: str, rows: DataFrame, key: str, shards: int, *order: str) -> None:
        """``put`` of shards that a task can write whole: ``rows`` are made once, as no sample of them says where shards are cut."""
        dealt = rows.withColumn("shard", shard_of(F.col(key), shards))
        dealt.repartition("shard").sortWithinPartitions("shard", *order).write.partitionBy("shard").parquet(f"{self.root}/{name}")
        self.state.setdefault("tables", {})[name] = [dealt.schema.json(), shards]

    def put_where_made(self, name: str, rows: DataFrame, key: str, shards: int, *order: str) -> None:
        """``put`` without a shuffle: every task of ``rows`` writes a file a shard, sorted by ``order``, so tasks should be large and shards few."""
        dealt = rows.withColumn("shard", shard_of(F.col(key), shards))
        dealt.sortWithinPartitions("shard", *order).write.partitionBy("shard").parquet(f"{self.root}/{name}")
        self.state.setdefault("tables", {})[name] = [dealt.schema.json(), shards]

    def table(self, name: str) -> DataFrame:
        return self._read(name, [f"{self.root}/{name}"])

    def of_keys(self, name: str, keys: list[str]) -> DataFrame:
        """Rows in the shards of some keys."""
        shards = self.state["tables"][name][1]
        hashed = {r[0] for r in local_rows(self.spark, [(k,) for k in keys], "k string").select(shard_of(F.col("k"), shards)).collect()} if keys else set()
        return self.of_shards(name, sorted(hashed))

    def of_shards(self, name: str, shards: list[int]) -> DataFrame:
        return self._read(name, [p for k in shards if storage.exists(self.spark, p := f"{self.root}/{name}/shard={k}")])

    def _read(self, name: str, paths: list[str]) -> DataFrame:
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(json.loads(self.state["tables"][name][0]))
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*paths)
