"""Rows of one table met with rows of another: broadcast if the other is small, in blocks otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drawlake.sources.tables import written

#: Most rows, and most bytes of their values, that are broadcast.
MOST_ROWS = 100_000
MOST_BYTES = 64 << 20
#: Least number of parts into which the left side of a block join is dealt, so that tasks outnumber blocks.
LEFT_PARTS = 16
#: Most pairs that one task forms, with a broadcast and in blocks.
PAIRS_OF_TASK = 4_000_000
PAIRS_OF_BLOCK = 200_000_000


def measured(df: DataFrame) -> tuple[int, int]:
    """Rows of ``df``, and about how many bytes their values take; one pass."""
    size = F.lit(0).cast("long")
    for field in df.schema.fields:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            own = F.octet_length(c)
        elif isinstance(kind, (T.ArrayType, T.MapType)):
            own = 8 * F.greatest(F.size(c), F.lit(0))
        elif isinstance(kind, T.StructType):
            own = F.lit(8 * len(kind.fields))
        else:
            own = F.lit(8)
        size = size + F.coalesce(own, F.lit(0)).cast("long")
    row = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return row[0], row[1]


def held(df: DataFrame) -> tuple[int, int]:
    """Rows of ``df``, and those of its largest partition; one pass."""
    row = df.groupBy(F.spark_partition_id().alias("_p")).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    return row[0], row[1]


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in partitions of about ``rows`` rows, if its largest one holds more."""
    total, largest = held(df)
    return df.repartition(-(-total // max(1, rows))) if largest > max(1, rows) else df


def paired(left: DataFrame, right: DataFrame, on: Column | None = None, most: int = MOST_ROWS) -> DataFrame:
    """All pairs of rows that meet ``on`` (all pairs, if it is None).

    ``right`` is broadcast if it has at most ``most`` rows and ``MOST_BYTES``; a left side that stands in so few partitions
    that a task would form more than ``PAIRS_OF_TASK`` pairs is dealt anew. A larger one is cut in blocks of about that
    size by a hash of its rows, and an equi-join on the block lets each task hold one block; pairs then stream
    through, and later sums by key merge the partial results of the blocks.
    """
    n, size = measured(right)
    rows, largest = held(left)
    blocks = max(-(-n // most), -(-size // MOST_BYTES))
    if blocks <= 1:
        if largest * n > PAIRS_OF_TASK:
            left = left.repartition(min(rows, -(-rows * n // PAIRS_OF_TASK)))
        right = F.broadcast(right)
        return left.crossJoin(right) if on is None else left.join(right, on)
    parts = max(LEFT_PARTS, -(-rows * n // (blocks * PAIRS_OF_BLOCK)))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    a = left.withColumn("_part", F.pmod(F.xxhash64(*left.columns), F.lit(parts))).withColumn("_block", each(blocks))
    b = right.withColumn("_other_block", F.pmod(F.xxhash64(*right.columns), F.lit(blocks))).withColumn("_other_part", each(parts))
    # by number, as few bytes that make many pairs would otherwise be put into few tasks
    a, b = a.repartition(blocks * parts, "_block", "_part"), b.repartition(blocks * parts, "_other_block", "_other_part")
    same = (F.col("_block") == F.col("_other_block")) & (F.col("_part") == F.col("_other_part"))
    out = a.join(b, same if on is None else same & on)
    return out.drop("_part", "_block", "_other_block", "_other_part")


def returned(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``found``, which holds what was found once for each value of ``keys`` (nulls alike)."""
    found = written(found, "found")
    n, size = measured(found)
    there = found.withColumnsRenamed({k: f"_at_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_at_{k}"))
    out = paired(rows, there, same) if n <= MOST_ROWS and size <= MOST_BYTES else rows.join(there, same)
    return out.drop(*[f"_at_{k}" for k in keys])
