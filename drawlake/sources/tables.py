"""Numeric text tables and written results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``; in one of our own only where that is unset and Spark is local."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(f"file://{tempfile.mkdtemp(prefix='drawlake-')}")
        base = _own[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(lines: DataFrame, name: str = "row_id", split: tuple[str, ...] = ()) -> DataFrame:
    """Add ``row_id`` from 1 in the order in which the rows stand.

    Rows are written once with an id that increases within a partition; one count for each partition gives the
    offsets. So no row passes through Python, and no partition is evaluated twice in two ways. With ``split``,
    columns that tell from which part of which file a row comes, these are counted and ordered instead of partitions.
    """
    rows = lines.withColumn("_id", F.monotonically_increasing_id())
    if not split:
        rows = rows.withColumn("_part", F.shiftright("_id", 33))  # the bits below count within a partition
    rows, keys = written(rows, "numbered"), list(split) or ["_part"]
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_id").alias("_first")).orderBy(*keys).collect()
    before, offsets = 0, []
    for r in sizes:
        offsets.append((*(r[k] for k in keys), before - r["_first"] + 1))
        before += r["_n"]
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    table = lines.sparkSession.createDataFrame(offsets, f"{kinds}, _shift long")
    return rows.join(F.broadcast(table), keys).withColumn(name, F.col("_id") + F.col("_shift")).drop(*keys, "_id", "_shift")


def parse_numeric(lines: DataFrame, items: list[int], text: str = "value") -> DataFrame:
    """Numeric items (1-based, in any order, 0 for a constant 0) of lines split by blank, tab, comma or semicolon.

    ``?`` is null. Adds ``i1, i2, ...`` and ``bad``, true if an item is missing or no number.
    """
    parts = F.split(F.trim(F.regexp_replace(text, r"[ \t,;]+", " ")), " ")
    out, bad = lines, F.lit(False)
    for n, item in enumerate(items, 1):
        token = F.get(parts, F.lit(item - 1)) if item else F.lit("0")
        number = F.when(token != "?", token).try_cast("double") if item else F.lit(0.0)
        out = out.withColumn(f"i{n}", number)
        bad = bad | F.coalesce((token != "?") & number.isNull(), F.lit(True)) if item else bad
    return out.withColumn("bad", bad)


def read_numeric(spark: SparkSession, path: str, items: list[int]) -> DataFrame:
    """``row_id, i1, ...`` of a text file, or of files in order of name; a bad or missing item is an error."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"))
    parsed = parse_numeric(numbered(lines, split=("_path", "_start")), items)
    wrong = parsed.where("bad").agg(F.min("row_id")).first()[0]
    if wrong is not None:
        raise ValueError(f"{path}: bad or missing number on line {wrong}")
    return parsed.drop("bad", "value")


def line_range(df: DataFrame, first: int, last: int, complement: bool = False) -> DataFrame:
    """Rows first..last by ``row_id``, or all others; a range beyond the rows is an error."""
    if not 1 <= first <= last or last > (df.agg(F.max("row_id")).first()[0] or 0):
        raise ValueError(f"no lines {first}:{last}")
    inside = F.col("row_id").between(first, last)
    return df.where(~inside if complement else inside)


def bind_columns(left: DataFrame, right: DataFrame | float, name: str = "constant") -> DataFrame:
    """Paste tables line by line; a number becomes a constant column. Unequal lengths are an error."""
    if not isinstance(right, DataFrame):
        return left.withColumn(name, F.lit(float(right)))
    both = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), "row_id", "full")
    checked = F.when(F.col("_l").isNull() | F.col("_r").isNull(), F.raise_error(F.lit("tables differ in length"))).otherwise(F.col("row_id"))
    return both.withColumn("row_id", checked.cast("long")).drop("_l", "_r")


def write_table(df: DataFrame, path: str, kind: str = "csv", header: bool = True) -> None:
    """Write rows as csv, parquet or json."""
    writer = df.write.mode("overwrite")
    (writer.option("header", header) if kind == "csv" else writer).format(kind).save(path)
