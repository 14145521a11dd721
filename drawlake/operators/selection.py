"""Exact order statistics of pooled points by counts of leading bits, so that no case's draws meet in one place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drawlake.operators.pairing import MOST_BYTES, MOST_ROWS, measured
from drawlake.sources.tables import written

#: Bits told apart in the first round and in later ones; a cell's points are counted, never listed.
FIRST_BITS, NEXT_BITS = 16, 12
#: Once no wanted place stands among more points than this, the rest of their bits is taken in one round.
MOST_LAST = 4096
#: Draws expanded to points at once.
CHUNK = 8192
#: Parts that a case's draws are dealt to where they meet its places by a shuffle.
SALTS = 64


def ordered_bits(v: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers of the same order; NaN stands above all, zeros are equal."""
    bits = np.where(np.isnan(v), np.nan, v + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def from_bits(bits: np.ndarray) -> np.ndarray:
    bits = np.ascontiguousarray(bits, np.int64).view(np.uint64)
    return np.where(bits >> np.uint64(63), bits ^ np.uint64(1 << 63), ~bits).view(np.float64)


def _met(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows joined on columns that may be null."""
    other = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    same = None
    for c in on:
        one = left[c].eqNullSafe(other[f"_r_{c}"])
        same = one if same is None else same & one
    return left.join(other, same).drop(*[f"_r_{c}" for c in on])


def _cells(pool: DataFrame, keys: list[str], z: np.ndarray, done: int, bits: int) -> DataFrame:
    """``(keys, _prefix, _digit, _n)``: points of each case whose first ``done`` bits are ``_prefix``, by the next ``bits``."""
    groups, shift = [*keys, "_prefix"], np.uint64(64 - done - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = pa.Table.from_batches([batch.slice(start, CHUNK)])
                rows = part.select(groups).append_column("_row", pa.array(np.arange(part.num_rows)))
                held = rows.group_by(groups, use_threads=False).aggregate([("_row", "list")]).column("_row_list").combine_chunks()
                members, sizes = held.flatten().to_numpy(), held.value_lengths().to_numpy()
                code = np.empty(part.num_rows, np.uint64)
                code[members] = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
                number = lambda name: part.column(name).to_numpy().astype(np.float64)[:, None]
                points = ordered_bits(number("_m") + number("_s") * z)
                inside = np.ones(points.shape, bool)
                if done:
                    inside = points >> np.uint64(64 - done) == part.column("_prefix").to_numpy().astype(np.uint64)[:, None]
                digit = (points >> shift) & np.uint64((1 << bits) - 1)
                cell, n = np.unique(((code[:, None] << np.uint64(bits)) | digit)[inside], return_counts=True)
                first = members[np.cumsum(sizes) - sizes]
                out = part.select(groups).take(pa.array(first[(cell >> np.uint64(bits)).astype(np.int64)]))
                out = out.append_column("_digit", pa.array((cell & np.uint64((1 << bits) - 1)).astype(np.int64))).append_column("_n", pa.array(n.astype(np.int64)))
                yield from out.to_batches()

    schema = T.StructType([*(pool.schema[k] for k in groups), T.StructField("_digit", T.LongType()), T.StructField("_n", T.LongType())])
    return pool.select(*groups, "_m", "_s").mapInArrow(run, schema).groupBy(*groups, "_digit").agg(F.sum("_n").alias("_n"))


def selected(pool: DataFrame, keys: list[str], z: np.ndarray, wanted: DataFrame) -> DataFrame:
    """``(keys, _p, value)``: of the points ``_m + _s * z`` of each case of ``pool``, those at places ``_rank`` (from 0) of ``wanted(keys, _p, _rank)``.

    A radix selection: a round counts the points that share the leading bits found so far of a place by their next bits,
    in each task first, and goes on in the cell where the place falls. A task holds ``CHUNK`` draws, a case's counts are
    at most 65,536 rows, and at most five rounds read the draws, whatever their number; ties need none beside.
    The draws meet the open prefixes of their case by a broadcast if these are few, else by a shuffle on the case and a salt.
    """
    done, bits = 0, FIRST_BITS
    groups = [*keys, "_prefix"]
    wanted = wanted.withColumn("_prefix", F.lit(0).cast("long"))
    while done < 64:
        if not done:
            rows = pool.withColumn("_prefix", F.lit(0).cast("long"))
        else:
            open_ = wanted.select(*groups).distinct()
            n, size = measured(open_)
            if n <= MOST_ROWS and size <= MOST_BYTES:
                rows = _met(pool, F.broadcast(open_), keys)
            else:
                rows = _met(pool, open_.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*keys, "_salt"])
        cells = _cells(rows, keys, z, done, bits)
        upto = F.sum("_n").over(Window.partitionBy(*groups).orderBy("_digit"))
        hit = _met(wanted.drop("_n"), cells.withColumn("_before", upto - F.col("_n")), groups)
        hit = hit.where((F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_n")))
        wanted = written(hit.select(*keys, "_p", (F.col("_rank") - F.col("_before")).alias("_rank"), F.shiftleft("_prefix", bits).bitwiseOR(F.col("_digit")).alias("_prefix"), "_n"), "selected")
        done += bits
        bits = 64 - done if (wanted.agg(F.max("_n")).first()[0] or 0) <= MOST_LAST else min(NEXT_BITS, 64 - done)

    @F.pandas_udf("double")
    def decoded(bits: pd.Series) -> pd.Series:
        return pd.Series(from_bits(bits.to_numpy()))

    return wanted.select(*keys, "_p", decoded("_prefix").alias("value"))
