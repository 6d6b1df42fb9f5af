"""Rows that are on the driver already, as tables of Spark's own: no job and no Python worker reads them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def local_rows(spark: SparkSession, rows: list, schema: StructType | str) -> DataFrame:
    """A few thousand rows as a DataFrame."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    columns = {f.name: [r[i] for r in rows] for i, f in enumerate(kind.fields)}
    return spark.createDataFrame(pa.Table.from_pydict(columns, schema=to_arrow_schema(kind)), kind)


def one_of(column: str, values: list[str]) -> Column:
    """``column IN (values)`` as one expression, which scans are told of."""
    if not values:
        return F.lit(False)
    quoted = ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)
    return F.expr(f"`{column}` IN ({quoted})")
