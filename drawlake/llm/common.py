"""Shared pieces of the training-data operators: written intermediates and graph components."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where that is unset and Spark is local (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="drawlake-"))
    return f"file://{_own_dir[0]}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/drawlake/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, lost executors lose nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def held_out(doc_id: F.Column, parts: int, part: int) -> F.Column:
    """crc32 of the id as text, modulo ``parts``, equals ``part``; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def hash_share(doc_id: F.Column, seed: int) -> F.Column:
    """A deterministic uniform value in [0, 1) per id."""
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


#: Rows from which a key is heavy; and its share: a key of more than a ``HEAVY_SHARE``-th of all rows is.
HEAVY = 1024
HEAVY_SHARE = 1 << 16


def heavy_keys(counts: DataFrame, key: str, n: str) -> DataFrame:
    """Keys of ``counts`` that have more than ``HEAVY`` rows and more than a ``HEAVY_SHARE``-th of all, as a small local table.

    So there are fewer than ``HEAVY_SHARE``, and each of the other keys has at most that share of the rows.
    """
    bound = max(HEAVY, (counts.agg(F.sum(n)).first()[0] or 0) // HEAVY_SHARE)
    rows = counts.where(F.col(n) > bound).select(key).collect()
    return counts.sparkSession.createDataFrame([(r[0],) for r in rows], f"{key} {counts.schema[key].dataType.simpleString()}")


def skewed_join(rows: DataFrame, other: DataFrame, key: str, heavy: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left_semi) with ``other``, which has one row for each key.

    Rows of the ``heavy`` keys stay where they are and meet a broadcast of those few rows of ``other``; only the
    rest is shuffled, so no task gets the rows of a common key.
    """
    few = F.broadcast(heavy)
    hot = rows.join(few, key, "left_semi").join(F.broadcast(other.join(few, key, "left_semi")), key, how)
    return hot.unionByName(rows.join(few, key, "left_anti").join(other, key, how))


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` of longs -> ``(id, component)``, component being the smallest id reachable.

    Each round hooks every root to its smallest neighbouring root, flattens the hooks by pointer
    doubling and contracts the edges, which at least halves the roots that still have edges.
    Only edges, never the whole corpus, take part; every round ends in a written table.
    """
    edges = materialize(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    nodes = edges.select(F.col("u").alias("id")).union(edges.select("v")).distinct()
    members = materialize(nodes.withColumn("component", F.col("id")), "members")
    while not edges.isEmpty():
        hooks = edges.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("parent"))
        hooks = materialize(hooks, "hooks")
        while True:
            up = hooks.select(F.col("id").alias("parent"), F.col("parent").alias("grand"))
            hooks = materialize(hooks.join(up, "parent", "left").select("id", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved")), "hooks")
            if hooks.where("moved").isEmpty():
                break
            hooks = hooks.drop("moved")
        root = hooks.select(F.col("id").alias("component"), F.col("parent").alias("root"))
        members = materialize(members.join(root, "component", "left").select("id", F.coalesce("root", "component").alias("component")), "members")
        ends = edges
        for end in ("u", "v"):
            ends = ends.join(hooks.select(F.col("id").alias(end), F.col("parent").alias("r")), end, "left").withColumn(end, F.coalesce("r", end)).drop("r")
        edges = materialize(ends.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    return members
