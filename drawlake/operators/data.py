"""Case tables: transformations, checks, splits, grids, indicators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drawlake.operators.pairing import dealt
from drawlake.sources.tables import numbered


def parse_transform(text: str) -> tuple[bool, float | str, float | str]:
    """``L+T xS`` as (take log, shift, scale); ``I`` is the identity, ``@`` stands for a value from training data."""
    m = re.fullmatch(r"(?:I|(L)?([+-](?:[\d.]+|@))?(?:x([\d.]+|@))?)", text)
    if not m:
        raise ValueError(f"bad transformation {text}")
    number = lambda s, none: none if s is None else "@" if s.endswith("@") else float(s)
    return bool(m[1]), number(m[2], 0.0), number(m[3], 1.0)


def parse_transforms(texts: list[str], n: int) -> list[tuple[bool, float | str, float | str]]:
    """One per column; a last ``...`` repeats the one before it."""
    if texts and texts[-1] == "...":
        texts = [*texts[:-1], *[texts[-2]] * (n - len(texts) + 1)]
    if len(texts) != n:
        raise ValueError("transformations do not match the columns")
    return [parse_transform(t) for t in texts]


def fit_transforms(train: DataFrame, columns: dict[str, tuple]) -> dict[str, tuple[bool, float, float]]:
    """Fill ``@``: shift is minus the mean, scale 1 over the population deviation (1 if that is 0), both after the log."""
    taken = {c: F.log(c) if t[0] else F.col(c).cast("double") for c, t in columns.items()}
    row = train.agg(*[f(x).alias(f"{n}_{c}") for c, x in taken.items() for n, f in (("m", F.avg), ("v", F.var_pop))]).first()
    out = {}
    for c, (log, shift, scale) in columns.items():
        sd = (row[f"v_{c}"] or 0.0) ** 0.5
        out[c] = (log, -row[f"m_{c}"] if shift == "@" else shift, (1 / sd if sd > 0 else 1.0) if scale == "@" else scale)
    return out


def transform(column: Column, spec: tuple[bool, float, float]) -> Column:
    """(value or its log, plus shift) times scale; the log of a value that is not positive is an error."""
    log, shift, scale = spec
    if log:
        column = F.when(column <= 0, F.raise_error(F.lit("log of a value that is not positive"))).otherwise(F.log(column))
    return (column + shift) * scale


def inverse_transform(column: Column, spec: tuple[bool, float, float]) -> Column:
    log, shift, scale = spec
    out = column / scale - shift
    return F.exp(out) if log else out


def check_targets(df: DataFrame, column: str, kind: str, classes: int | None = None) -> DataFrame:
    """Rows whose target breaks its kind: binary, class (0 to classes - 1), count; null targets are allowed."""
    x = F.col(column)
    whole = x == F.floor(x)
    good = {"binary": x.isin(0, 1), "class": whole & (x >= 0) & (x < (classes or 0)), "count": whole & (x >= 0)}[kind]
    return df.where(x.isNotNull() & ~good)


def split_exact(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """Mark exactly int(n * share + 0.5) rows as ``chosen``, by the order of a keyed hash.

    The threshold is found from counts of hash buckets; only the bucket it falls in is ranked.
    """
    h = F.xxhash64(F.col(key), F.lit(seed))
    hashed = df.withColumn("_h", h).withColumn("_b", F.shiftright(F.col("_h"), 48))
    counts = hashed.groupBy("_b").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("_b")) - F.col("n"))
    need = int(df.count() * share + 0.5)
    edge = counts.where((F.col("before") < need) & (F.col("before") + F.col("n") >= need)).first()
    if edge is None:
        return hashed.withColumn("chosen", F.lit(False)).drop("_h", "_b")
    ranked = hashed.where(F.col("_b") == edge["_b"]).withColumn("chosen", F.row_number().over(Window.orderBy("_h", key)) <= need - edge["before"])
    rest = hashed.where(F.col("_b") != edge["_b"]).withColumn("chosen", F.col("_b") < edge["_b"])
    return rest.unionByName(ranked).drop("_h", "_b")


def kfold_ranges(df: DataFrame, k: int, n: int | None = None) -> DataFrame:
    """Each row once per fold with ``fold`` and ``validation``: folds are contiguous blocks of ``row_id``."""
    n = n or df.count()
    own = F.floor((F.col("row_id") - 1) * k / F.lit(n)).cast("int")
    return df.withColumn("_own", own).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("validation", F.col("_own") == F.col("fold")).drop("_own")


def grid(spark: SparkSession, dims: list[tuple[float, float, float]]) -> DataFrame:
    """All multiples of mod within low..high (tolerance 1e-6 steps) of each (low, high, mod), as x1, x2, ..."""
    import math

    out = spark.range(1).select()
    for i, (low, high, mod) in enumerate(dims, 1):
        a, b = math.ceil(low / mod - 1e-6), math.floor(high / mod + 1e-6)
        steps = F.sequence(F.lit(a), F.lit(b)) if b >= a else F.array().cast("array<int>")
        out = out.withColumn(f"_{i}", F.explode(steps)).withColumn(f"x{i}", F.col(f"_{i}") * F.lit(float(mod))).drop(f"_{i}")
    return out


def grid_n(spark: SparkSession, dims: list[tuple[float, float, int]]) -> DataFrame:
    """size + 1 equally spaced points of each (low, high, size)."""
    out = spark.range(1).select()
    for i, (low, high, size) in enumerate(dims, 1):
        out = out.withColumn(f"_{i}", F.explode(F.sequence(F.lit(0), F.lit(size)))).withColumn(f"x{i}", low + F.col(f"_{i}") * ((high - low) / size)).drop(f"_{i}")
    return out


def case_indicators(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """``(key, split, hot)``: a 0/1 vector for each case, with a place for each training case (in order of ``key``)
    and one more that all test cases share."""
    own = numbered(train.select(key).orderBy(key), "_place").withColumn("split", F.lit("train"))
    rows = own.unionByName(test.select(key, F.lit(None).cast("long").alias("_place"), F.lit("test").alias("split")))
    n = train.count()
    place = F.coalesce(F.col("_place") - 1, F.lit(n)).cast("int")
    rows = dealt(rows, 20_000_000 // (n + 1))  # a row is as wide as there are training cases
    zeros = lambda k: F.array_repeat(F.lit(0), k)
    return rows.select(key, "split", F.concat(zeros(place), F.array(F.lit(1)), zeros(F.lit(n) - place)).alias("hot"))


def one_hot(column: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == column).cast("int"))
