"""Order over whole tables without one task that sees all rows: range-sorted partitions and what stands before each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawlake.sources.tables import written


def range_sorted(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` written in order, with ``_id`` that increases with it and the partition ``_part`` that each row stands in."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return written(rows.withColumn("_part", F.shiftright("_id", 33)), "sorted")


def running_sum(df: DataFrame, order: str, values: dict[str, Column]) -> DataFrame:
    """Add sums of ``values`` over all rows up to each one by ``order``, which is unique: a sum for each partition, and one within it."""
    rows = range_sorted(df.withColumns({f"_v_{n}": c for n, c in values.items()}), order)
    sums = rows.groupBy("_part").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    shift = sums.select("_part", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0.0)).alias(f"_b_{n}") for n in values])
    upto = Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(F.broadcast(shift), "_part").withColumns({n: F.sum(f"_v_{n}").over(upto) + F.col(f"_b_{n}") for n in values})
    return out.select(*df.columns, *values)


def grouped_number(df: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """Add the number, from 1, of each row within its group by ``order``; a group of any size spreads over partitions."""
    rows = range_sorted(df, group, order)
    held = rows.groupBy(group, "_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = held.select(group, "_part", (before - F.col("_first") + 1).alias("_shift"))
    return rows.join(shift, [group, "_part"]).withColumn(name, (F.col("_id") + F.col("_shift")).cast("int")).select(*df.columns, name)
