"""Nearest-rank percentiles over groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """One row a group with ``n`` and, for each name, the value at place ``round((n - 1) * p)`` of the sorted values.

    Equal values are counted before the shuffle, so a group costs a row for each distinct value and not for each row.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    group = Window.partitionBy(*keys)
    upto = F.sum("_c").over(group.orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counts = counts.withColumn("_upto", upto).withColumn("_n", F.sum("_c").over(group))
    picks = [F.min(F.when(F.col("_upto") > F.floor((F.col("_n") - 1) * p + 0.5), F.col("_v"))).alias(name) for name, p in wanted.items()]
    return counts.groupBy(*keys).agg(F.max("_n").alias("n"), *picks)
