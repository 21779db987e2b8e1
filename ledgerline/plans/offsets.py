"""Running totals over a whole ordered table without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.plans.scratch import materialize


def running_start(df: DataFrame, order: list[Column], amount: str, out: str, name: str = "ordered") -> DataFrame:
    """Add ``out``: the sum of ``amount`` over all rows before this one in ``order``.

    The table is range partitioned and written once with its partition number; one total per partition (as many
    rows as partitions) gets a running sum, is joined back, and the rest of the sum is a window inside the partition.
    Ties in ``order`` get distinct starts in the order in which they were written.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = dealt.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    dealt = materialize(dealt, name)
    totals = dealt.groupBy("_part").agg(F.sum(amount).alias("_total"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    joined = dealt.join(F.broadcast(totals), "_part")  # one row a partition
    return joined.withColumn(out, F.col("_base") + F.coalesce(F.sum(amount).over(within), F.lit(0))).drop("_part", "_row", "_base")
