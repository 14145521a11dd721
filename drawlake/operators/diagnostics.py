"""Quantity tables, histograms, series analysis and weighted means."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawlake.functions.numeric import log_sum_exp_by
from drawlake.operators.ordered import range_sorted, running_sum
from drawlake.operators.pairing import MOST_ROWS
from drawlake.sources.tables import written


def parse_quantities(text: str) -> list[tuple[str, int, int | None]]:
    """``tw3@0:7b`` as (name, low, high) items; low is -1 for a quantity without positions."""
    out, at = [], 0
    for m in re.finditer(r"([A-Za-z#]\d*)(?:@(\d+)(?::(\d+))?)?", text):
        if m.start() != at:
            break
        at = m.end()
        out.append((m[1], int(m[2]) if m[2] else -1, int(m[3] or m[2]) if m[2] else None))
    if at != len(text):
        raise ValueError(f"bad quantities {text}")
    return out


def quantity_table(q: DataFrame, text: str) -> DataFrame:
    """One row per draw, a column for each quantity asked for in order (``w3@2`` style names); one that no draw has is an error."""
    names, wanted = [], []
    for name, low, high in parse_quantities(text):
        for p in [None] if high is None else range(low, high + 1):
            names.append(name if p is None else f"{name}@{p}")
            wanted.append((name, p))
    column = F.when(F.col("pos").isNull(), F.col("quantity")).otherwise(F.concat("quantity", F.lit("@"), "pos"))
    has = q.agg(*[F.max((F.col("quantity") == n) & (F.col("pos").isNull() if p is None else F.col("pos") == p)).alias(f"h{i}") for i, (n, p) in enumerate(wanted)]).first()
    unknown = [name for i, name in enumerate(names) if not has[f"h{i}"]]
    if unknown:
        raise ValueError(f"unknown quantities {', '.join(unknown)}")
    rows = q.where(F.col("quantity").isin(*{n for n, _ in wanted})).withColumn("_c", column)
    return rows.groupBy("log_id", "idx").pivot("_c", names).agg(F.first("value"))


def quantity_pairs(x: DataFrame, y: DataFrame) -> DataFrame:
    """Values of y against x by draw, in order of position; one value of a side serves all of the other.

    Other numbers of values that differ are an error.
    """
    draw = ["log_id", "idx"]
    sides = []
    for df, p, name in ((x, "px", "x"), (y, "py", "y")):
        w = Window.partitionBy(*draw)
        sides.append(df.select(*draw, F.col("pos").alias(p), F.col("value").alias(name)).withColumn(f"_r{name}", F.row_number().over(w.orderBy(p))).withColumn(f"_n{name}", F.count("*").over(w)))
    fits = (F.col("_nx") == F.col("_ny")) | (F.col("_nx") == 1) | (F.col("_ny") == 1)
    both = sides[0].join(sides[1], draw).where(~fits | (F.col("_nx") == 1) | (F.col("_ny") == 1) | (F.col("_rx") == F.col("_ry")))
    checked = F.when(fits, F.col("idx")).otherwise(F.raise_error(F.lit("numbers of values differ")).cast("long"))
    return both.withColumn("idx", checked).drop("_rx", "_ry", "_nx", "_ny")


def index_quantities(n: int, index: Column) -> dict[str, Column]:
    return {"t": index, f"t{n}": 1 + (index - 1) % n}


def position_quantities(n: int, pos: Column) -> dict[str, Column]:
    """Array positions, and their remainders."""
    return {"#": pos, f"#{n}": pos % n}


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """Count and share by equal bin of [low, high); shares are of all values, empty bins are shown."""
    b = F.floor(bins * (value - low) / (high - low))
    counted = df.where(value.isNotNull()).groupBy(F.when((value >= low) & (value < high), b).alias("bin")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    rows = df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(F.broadcast(counted.where("bin is not null")), "bin", "left").crossJoin(F.broadcast(total))
    n = F.coalesce("n", F.lit(0))
    return rows.select("bin", (low + (F.col("bin") + 0.5) * (high - low) / bins).alias("centre"), n.alias("n"), (n / F.col("total")).alias("share"))


def argmin(df: DataFrame, key: str, value: str, by: list[str]) -> DataFrame:
    """First key with the smallest value in each group."""
    return df.groupBy(*by).agg(F.min(F.struct(value, key)).alias("_m")).select(*by, F.col(f"_m.{key}").alias(key), F.col(f"_m.{value}").alias(value))


def tour_count(df: DataFrame) -> DataFrame:
    """Trips from inverse temperature 1 to the smallest one and back, per log.

    Draws are sorted by ranges, so one log spreads over tasks; trips are counted in each partition, and again between
    the last draw of a partition and the first of the log's next one.
    """
    ends = df.groupBy("log_id").agg(F.min("inv_temp").alias("_low"))
    few = ends.limit(MOST_ROWS + 1).count() <= MOST_ROWS
    marks = df.join(F.broadcast(ends) if few else ends, "log_id").where((F.col("inv_temp") == 1) | (F.col("inv_temp") == F.col("_low")))
    rows = range_sorted(marks.select("log_id", "idx", (F.col("inv_temp") == 1).alias("cold")), "log_id", "idx")
    before = F.lag("cold").over(Window.partitionBy("log_id", "_part").orderBy("_id"))
    inside = rows.withColumn("_b", (F.col("cold") & ~before).cast("long")).groupBy("log_id", "_part").agg(F.coalesce(F.sum("_b"), F.lit(0)).alias("n"), F.min_by("cold", "_id").alias("first"), F.max_by("cold", "_id").alias("last"))
    seam = F.col("first") & ~F.lag("last").over(Window.partitionBy("log_id").orderBy("_part"))
    return inside.withColumn("n", F.col("n") + F.coalesce(seam.cast("long"), F.lit(0))).groupBy("log_id").agg(F.sum("n").alias("tours"))


def top_magnitudes(df: DataFrame, by: list[str], value: Column, k: int) -> DataFrame:
    """The k largest absolute values of each group, in decreasing order."""
    w = Window.partitionBy(*by).orderBy(F.desc("magnitude"))
    return df.withColumn("magnitude", F.abs(value)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*by, "rank", "magnitude")


def series_moments(series: DataFrame, presumed: float | None = None) -> DataFrame:
    """Realizations, points, mean, and variance (divisor n) about the mean or a presumed one."""
    per = series.groupBy("realization").agg(F.count("value").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") ** 2).alias("s2"))
    n, mean = F.sum("n"), F.sum("s") / F.sum("n")
    centre = mean if presumed is None else F.lit(presumed)
    out = per.agg(F.count("*").alias("realizations"), n.alias("points"), mean.alias("mean"), (F.sum("s2") / n - 2 * centre * mean + centre * centre).alias("variance"))
    return out.withColumn("sd", F.sqrt("variance"))


def se_from_submeans(series: DataFrame, presumed: float | None = None) -> DataFrame:
    """Standard error from the realizations' means, if there are several of equal length."""
    per = _submeans(series)
    r = F.count("*")
    about = F.var_pop("m") if presumed is None else F.avg((F.col("m") - presumed) ** 2)
    return per.agg(r.alias("realizations"), F.when((r > 1) & (F.min("n") == F.max("n")), F.sqrt(about / (r - 1))).alias("se"))


def _submeans(series: DataFrame) -> DataFrame:
    return series.groupBy("realization").agg(F.count("value").alias("n"), F.avg("value").alias("m"))


def se_by_length(series: DataFrame) -> DataFrame:
    """``(n, realizations, se)``: the same for each length of realization; null where only one has it."""
    r = F.count("*")
    return _submeans(series).groupBy("n").agg(r.alias("realizations"), F.when(r > 1, F.sqrt(F.var_pop("m") / (r - 1))).alias("se"))


#: Fewest and most points of a block of a series.
BLOCKS = 1 << 12, 1 << 18
#: Into how many parts the pairs of blocks at one distance are dealt.
LAG_PARTS = 8


def _lag_sums(block: int, max_lag: int):
    """Sums of products and numbers of pairs by lag, from rows ``(k, x, px, y, py)``: values and places of two blocks k blocks apart.

    A task adds up all pairs of blocks of one distance, which come one after the other, before it gives them out.
    """

    def correlation(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Sums of x[i] * y[i + m] for m from 1 - len(x) to len(y) - 1."""
        size = 1 << (len(x) + len(y) - 2).bit_length()
        out = np.fft.irfft(np.conj(np.fft.rfft(x, size)) * np.fft.rfft(y, size), size) if size > 1 else x * y
        return np.concatenate([out[size - len(x) + 1 :], out[: len(y)]])

    def dense(values: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        n = int(places[-1]) + 1
        if len(places) == n:
            return values, None
        out, held = np.zeros(n), np.zeros(n)
        out[places], held[places] = values, 1.0
        return out, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, counts = None, None, None

        def given() -> pa.RecordBatch:
            lags = (now - 1) * block + 1 + np.arange(2 * block - 1)
            kept = (counts > 0) & (lags >= 0) & (lags <= max_lag)
            return pa.RecordBatch.from_arrays([pa.array(lags[kept]), pa.array(sums[kept]), pa.array(counts[kept])], ["lag", "s", "n"])

        for batch in batches:
            for k, *parts in zip(*(c.to_pylist() if i == 0 else c for i, c in enumerate(batch.columns))):
                if k != now:
                    if now is not None:
                        yield given()
                    now, sums, counts = k, np.zeros(2 * block - 1), np.zeros(2 * block - 1, np.int64)
                x, px, y, py = (p.values.to_numpy() for p in parts)
                (x, held_x), (y, held_y) = dense(x, px), dense(y, py)
                m = np.arange(1 - len(x), len(y))
                if held_x is None and held_y is None:
                    pairs = np.minimum(len(x), len(y) - m) - np.maximum(0, -m)
                else:
                    ones = [np.ones(len(v)) if h is None else h for v, h in ((x, held_x), (y, held_y))]
                    pairs = np.rint(correlation(*ones)).astype(np.int64)
                found = correlation(x, y)
                first = len(x) - 1 if k == 0 else 0  # within a block each pair counts once
                at = slice(block - 1 + int(m[first]), block + int(m[-1]))
                sums[at] += found[first:]
                counts[at] += pairs[first:]
        if now is not None:
            yield given()

    return run


def autocovariance(series: DataFrame, max_lag: int | None = None, presumed: float | None = None) -> DataFrame:
    """Mean product of deviations at each lag, over all pairs in all realizations; up to the longest realization without ``max_lag``.

    ``t`` counts from 1 within a realization; points that are missing or null are in no pair. Realizations are cut into
    blocks, and the products of two blocks at all lags come from one fast Fourier transform of each. So n points
    cost n log n for lags of at most a block, and n * max_lag / block beyond; no lag is cut off by a block's end.
    """
    known = series.where("value is not null")
    facts = known.agg(F.avg("value").alias("mean"), F.max("t").alias("longest")).first()
    longest = facts["longest"] or 1
    max_lag = longest - 1 if max_lag is None else min(max_lag, longest - 1)
    block = min(max(BLOCKS[0], 1 << (4 * max_lag).bit_length()), BLOCKS[1])
    centre = presumed if presumed is not None else facts["mean"] or 0.0
    cut = known.select("realization", F.floor((F.col("t") - 1) / block).alias("block"), F.struct(((F.col("t") - 1) % block).cast("int").alias("p"), (F.col("value") - float(centre)).alias("d")).alias("x"))
    held = cut.groupBy("realization", "block").agg(F.array_sort(F.collect_list("x")).alias("x"))
    held = written(held.select("realization", "block", F.col("x.d").alias("v"), F.col("x.p").alias("p")), "series-blocks")
    far = (max_lag + block - 1) // block
    last = (longest - 1) // block
    left = held.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(far).cast("long"), last - F.col("block")))))
    left = left.select("realization", (F.col("block") + F.col("k")).alias("block"), "k", F.col("v").alias("x"), F.col("p").alias("px"))
    both = left.hint("merge").join(held, ["realization", "block"])
    part = F.pmod(F.xxhash64("realization", "block"), F.lit(LAG_PARTS))
    dealt = both.select("k", "x", "px", F.col("v").alias("y"), F.col("p").alias("py"), part.alias("part")).repartition("k", "part").sortWithinPartitions("k").drop("part")
    found = dealt.mapInArrow(_lag_sums(block, max_lag), "lag long, s double, n long").groupBy("lag").agg(F.sum("s").alias("s"), F.sum("n").alias("pairs"))
    return found.select(F.col("lag").cast("int").alias("lag"), (F.col("s") / F.col("pairs")).alias("covariance"), "pairs")


def autocorrelation(series: DataFrame, max_lag: int | None = None, presumed: float | None = None) -> DataFrame:
    """Correlation by lag and 1 + 2 * its running sum; no rows if the variance is 0."""
    c = written(autocovariance(series, max_lag, presumed), "autocovariance")
    base = c.where("lag = 0").select(F.col("covariance").alias("_v"))
    rho = c.crossJoin(F.broadcast(base)).where("_v > 0").select("lag", (F.col("covariance") / F.col("_v")).alias("correlation"))
    return running_sum(rho, "lag", {"cumulative": F.col("correlation")}).withColumn("cumulative", 2 * F.col("cumulative") - 1)


def se_from_correlations(series: DataFrame, max_lag: int | None = None) -> DataFrame:
    """Standard error of the mean from autocovariances up to a lag, realizations weighted by their share squared.

    A realization of n points needs the sums of covariances, plain and times the lag, below n; these are running sums.
    """
    c = written(autocovariance(series, max_lag), "autocovariance")
    sums = running_sum(c, "lag", {"plain": F.when(F.col("lag") > 0, 2 * F.col("covariance")).otherwise(F.col("covariance")), "times": 2 * F.col("lag") * F.col("covariance")})
    top = c.agg(F.max("lag").alias("_top"))
    sizes = series.groupBy("realization").agg(F.count("*").alias("n")).crossJoin(F.broadcast(top)).withColumn("lag", F.least(F.col("n") - 1, F.col("_top")).cast("int"))
    own = sizes.join(sums, "lag").withColumn("v", F.col("plain") - F.col("times") / F.col("n"))
    return own.agg(F.sqrt(F.sum(F.col("v") * F.col("n")) / F.sum("n") ** 2).alias("se"))


def batch_means(df: DataFrame, k: int, value: Column, row: Column) -> DataFrame:
    """Means of consecutive k rows; a last batch that is not full is left out."""
    return df.groupBy(F.floor((row - 1) / k).alias("batch")).agg(F.avg(value).alias("mean"), F.count("*").alias("n")).where(F.col("n") == k).drop("n")


def weighted_batch_means(df: DataFrame, k: int, value: Column, log_weight: Column, row: Column) -> DataFrame:
    """Log weight sum and weighted mean of each full batch of k rows, in log space."""
    rows = df.select(F.floor((row - 1) / k).alias("batch"), value.alias("v"), log_weight.alias("lw"))
    top = rows.groupBy("batch").agg(F.max("lw").alias("top"), F.count("*").alias("n")).where(F.col("n") == k)
    w = F.exp(F.col("lw") - F.col("top"))
    out = rows.join(top, "batch").groupBy("batch", "top").agg(F.sum(w).alias("s"), F.sum(w * F.col("v")).alias("sv"))
    return out.select("batch", (F.col("top") + F.log("s")).alias("log_weight"), (F.col("sv") / F.col("s")).alias("mean"))


def mean_with_se(batches: DataFrame) -> DataFrame:
    """Weighted mean of batch means and its standard error."""
    top = batches.agg(F.max("log_weight").alias("top"))
    w = F.exp(F.col("log_weight") - F.col("top"))
    rows = batches.crossJoin(F.broadcast(top)).select(w.alias("w"), F.col("mean").alias("m"))
    total = rows.agg(F.sum("w").alias("tw"), (F.sum(F.col("w") * F.col("m")) / F.sum("w")).alias("mean"), F.count("*").alias("n"))
    spread = rows.crossJoin(F.broadcast(total)).agg(F.first("mean").alias("mean"), F.sqrt(F.sum((F.col("w") / F.col("tw") * (F.col("m") - F.col("mean"))) ** 2)).alias("se"), F.first("n").alias("n"))
    return spread


def weight_stats(df: DataFrame, log_weight: Column, by: list[str] | None = None) -> DataFrame:
    """Log mean weight and its error, variance of normalised weights (divisor n - 1), adjusted sample size, reduction, warning."""
    by = by or []
    rows = df.select(*by, log_weight.alias("lw"))
    top = rows.groupBy(*by).agg(F.max("lw").alias("top"))
    joined = rows.join(top, by) if by else rows.crossJoin(F.broadcast(top))
    w = F.exp(F.col("lw") - F.col("top"))
    s = joined.groupBy(*by).agg(F.first("top").alias("top"), F.count("*").alias("n"), F.avg(w).alias("m"), F.var_samp(w).alias("v"), F.var_samp("lw").alias("log_variance"))
    v = F.coalesce(F.col("v") / F.col("m") ** 2, F.lit(0.0))
    size = F.col("n") / (1 + v)
    return s.select(*by, "n", (F.col("top") + F.log("m")).alias("log_mean"), F.sqrt(v / F.col("n")).alias("log_mean_se"), v.alias("variance"), size.alias("adjusted_size"), (1 / (1 + v)).alias("reduction"), (size < 10).alias("warning"), F.coalesce("log_variance", F.lit(0.0)).alias("log_variance"))


def expectation(df: DataFrame, value: Column, log_weight: Column) -> DataFrame:
    """Weighted expectation: standard and jackknife estimates with errors, and the function's effective size."""
    rows = df.select(value.alias("a"), log_weight.alias("lw"))
    top = rows.agg(F.max("lw").alias("top"))
    rows = rows.crossJoin(F.broadcast(top)).select("a", F.exp(F.col("lw") - F.col("top")).alias("w"))
    total = rows.agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("a")).alias("sa"), F.count("*").alias("n"))
    rows = rows.crossJoin(F.broadcast(total))
    mean = F.col("sa") / F.col("sw")
    left_out = (F.col("sa") - F.col("w") * F.col("a")) / (F.col("sw") - F.col("w"))
    p = F.col("w") / F.col("sw")
    out = rows.agg(F.first("n").alias("n"), F.first(mean).alias("mean"), F.sum(p * (F.col("a") - mean) ** 2).alias("variance"), F.sum(p**2 * (F.col("a") - mean) ** 2).alias("e2"), F.avg(left_out).alias("lm"), F.var_pop(left_out).alias("lv"))
    n = F.col("n")
    return out.select("n", "mean", F.sqrt("variance").alias("sd"), F.sqrt("e2").alias("se"), (n * F.col("mean") - (n - 1) * F.col("lm")).alias("jackknife_mean"), F.sqrt((n - 1) * F.col("lv")).alias("jackknife_se"), (F.col("variance") / F.col("e2")).alias("effective_size"))


def normalizing_ratio(df: DataFrame, forward: Column, backward: Column) -> DataFrame:
    """Log of mean exp(forward) minus log of mean exp(backward)."""
    a = log_sum_exp_by(df, [], forward, "a", n=F.lit(1))
    b = log_sum_exp_by(df, [], backward, "b", m=F.lit(1))
    return a.crossJoin(b).select((F.col("a") - F.log("n") - F.col("b") + F.log("m")).alias("log_ratio"))


def marginal_likelihood(df: DataFrame, log_weight: Column) -> DataFrame:
    """Log of the mean weight with its relative error, and (sum w)^2 / sum w^2; the error is null for one draw or a size below 2."""
    top = df.agg(F.max(log_weight).alias("top"))
    w = F.exp(log_weight - F.col("top"))
    s = df.crossJoin(F.broadcast(top)).agg(F.first("top").alias("top"), F.count("*").alias("n"), F.sum(w).alias("s"), F.sum(w * w).alias("s2"))
    size = F.col("s") ** 2 / F.col("s2")
    return s.select("n", (F.log(F.col("s") / F.col("n")) + F.col("top")).alias("log_mean"), F.when((F.col("n") > 1) & (size >= 2), F.sqrt(F.greatest(1 / size - 1 / F.col("n"), F.lit(0.0)))).alias("se"), size.alias("effective_size"))
