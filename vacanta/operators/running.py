"""Running sums over a whole table without one task for all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacanta.sources.staging import stage


def running_total(df: DataFrame, order: Column, value: str, name: str) -> DataFrame:
    """``df`` with ``name``, the sum of ``value`` up to and with each row; ``order`` should be unique.

    Rows are dealt to ranges of the order, which are summed side by side; what the ranges before have
    is added from one number per range. The dealt rows are staged, so that both steps see the same
    ranges. Missing values count as nothing.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(df.repartitionByRange(parts, order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_range").agg(F.coalesce(F.sum(value), F.lit(0)).alias("total"))
    # As many numbers as there are ranges, put together in one row.
    each = totals.agg(F.array_sort(F.collect_list(F.struct("_range", "total"))).alias("each"))
    zero = F.lit(0).cast(totals.schema["total"].dataType)
    sum_before = lambda e: F.aggregate(F.filter("each", lambda o: o["_range"] < e["_range"]), zero, lambda s, o: s + o["total"])
    before = each.select(F.inline(F.transform("each", lambda e: F.struct(e["_range"].alias("_range"), sum_before(e).alias("_before")))))
    own = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = dealt.withColumn("_own", F.coalesce(F.sum(value).over(own), zero)).join(stage(before, "range-totals"), "_range")
    return summed.withColumn(name, F.col("_own") + F.col("_before")).drop("_range", "_own", "_before")
