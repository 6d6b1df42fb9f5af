"""Running sums over any number of rows, without a window over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import storage


def with_sum_before(rows: DataFrame, order: list[Column], value: str, name: str = "before") -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows that come earlier in ``order``.

    The rows are sorted in ranges, as many as the sort takes, and kept in the shared checkpoint folder, so that a range
    is the same wherever it is read; sums of ranges, a row each, are summed in one place, and rows within their range.
    """
    spark = rows.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(storage.shared_folder(spark))
    ranges = rows.orderBy(*order).checkpoint()
    ranges = ranges.withColumns({"range_of_rows": F.spark_partition_id(), "nth_of_rows": F.monotonically_increasing_id()})
    sums = ranges.groupBy("range_of_rows").agg(F.sum(value).alias("sum_of_range"))
    earlier = Window.orderBy("range_of_rows").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("range_of_rows", F.coalesce(F.sum("sum_of_range").over(earlier), F.lit(0)).alias("sum_of_earlier"))
    inside = Window.partitionBy("range_of_rows").orderBy("nth_of_rows").rowsBetween(Window.unboundedPreceding, -1)
    within = ranges.withColumn("sum_within", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(sums, "range_of_rows")
    return within.withColumn(name, F.col("sum_of_earlier") + F.col("sum_within")).drop("range_of_rows", "nth_of_rows", "sum_of_earlier", "sum_within")
