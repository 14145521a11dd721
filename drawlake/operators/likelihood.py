"""Log likelihood of targets given outputs, guesses, and replicated targets."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drawlake.functions.numeric import HALF_LOG_2PI, array_log_sum_exp, lgamma, log_gamma


def gaussian(t: Column, o: Column, sd: Column) -> Column:
    """Missing targets count 0; the standardized residual is clipped to 1e10."""
    z = F.least(F.greatest((t - o) / sd, F.lit(-1e10)), F.lit(1e10))
    return F.when(t.isNull(), 0.0).otherwise(-z * z / 2 - F.log(sd) - HALF_LOG_2PI)


def student(t: Column, o: Column, sd: Column, alpha: float) -> Column:
    z = F.least(F.greatest((t - o) / sd, F.lit(-1e10)), F.lit(1e10))
    const = math.lgamma((alpha + 1) / 2) - math.lgamma(alpha / 2) - 0.5 * math.log(math.pi * alpha)
    return F.when(t.isNull(), 0.0).otherwise(const - F.log(sd) - (alpha + 1) / 2 * F.log1p(z * z / alpha))


def binary(t: Column, o: Column) -> Column:
    s = F.when(t == 1, o).otherwise(-o)
    return F.when(t.isNull(), 0.0).otherwise(F.least(s, F.lit(0.0)) - F.log1p(F.exp(-F.abs(s))))


def softmax(t: Column, outputs: Column) -> Column:
    return F.when(t.isNull(), 0.0).otherwise(F.get(outputs, t.cast("int")) - array_log_sum_exp(outputs))


def poisson(t: Column, log_rate: Column) -> Column:
    """A negative target -a means 'at most a'."""
    one = t * log_rate - F.exp(log_rate) - lgamma(t + 1)
    return F.when(t.isNull(), 0.0).when(t >= 0, one).otherwise(censored_poisson(-t, log_rate))


@F.pandas_udf(T.DoubleType())
def censored_poisson(most: pd.Series, log_rate: pd.Series) -> pd.Series:
    a, r = most.to_numpy(np.float64), log_rate.to_numpy(np.float64)
    known = np.isfinite(a) & np.isfinite(r) & (a >= 0)
    out = np.full(len(a), np.nan)
    order = np.flatnonzero(known)
    order = order[np.argsort(a[order], kind="stable")]
    for rows in np.array_split(order, max(1, len(order) // 256)):  # rows of like limits share a grid
        if len(rows):
            k = np.arange(int(a[rows].max()) + 1, dtype=np.float64)
            terms = np.where(k <= a[rows, None], k * r[rows, None] - np.exp(r[rows, None]) - log_gamma(k + 1), -np.inf)
            top = terms.max(1)
            out[rows] = top + np.log(np.exp(terms - top[:, None]).sum(1))
    return pd.Series(out).where(known, None).astype("Float64")


def survival(t: Column, log_hazard: Column) -> Column:
    """Constant hazard; a negative time is censored; the exponent is capped at 200."""
    h = F.least(log_hazard, F.lit(200.0))
    return F.when(t.isNull(), 0.0).when(t < 0, t * F.exp(h)).otherwise(h - t * F.exp(h))


def survival_pieces(cases: DataFrame, breaks: list[float], log_time: bool = False) -> DataFrame:
    """One row per case and time piece: piece, start, time_input, exposure and whether the event ends it.

    The last piece is open. A time on a break ends the piece before it. ``time_input`` is the time at which the hazard
    of a piece is evaluated: the first break, the middle of a piece (of its logs, with ``log_time``), the last break.
    """
    edges = [0.0, *breaks]
    scale = math.log if log_time else float
    inner = [(scale(a) + scale(b)) / 2 for a, b in zip(breaks[:-1], breaks[1:])]
    inputs = [scale(breaks[0]), *inner, scale(breaks[-1])]
    pieces = F.array(*[F.struct(F.lit(i).alias("piece"), F.lit(a).alias("start"), F.lit(b).cast("double").alias("stop"), F.lit(at).alias("time_input")) for i, (a, b, at) in enumerate(zip(edges, [*breaks, None], inputs))])
    rows = cases.withColumn("_t", F.abs("t")).withColumn("_p", F.explode(pieces)).where("_t > _p.start or (_p.start = 0 and _t = 0)")
    last = F.col("_p.stop").isNull() | (F.col("_t") <= F.col("_p.stop"))
    return rows.select(*cases.columns, "_p.piece", "_p.start", "_p.time_input", (F.least("_t", F.coalesce("_p.stop", "_t")) - F.col("_p.start")).alias("exposure"), (last & (F.col("t") >= 0)).alias("event"))


def survival_guess(log_hazard: Column) -> dict[str, Column]:
    h = F.exp(F.least(log_hazard, F.lit(200.0)))
    return {"mean": 1 / h, "median": math.log(2) / h}


def piecewise_median(hazards: Column, breaks: list[float]) -> Column:
    """Median time under hazards constant between breaks (an array of one more hazard than breaks)."""
    edges = [0.0, *breaks]
    out, before = F.lit(None).cast("double"), F.lit(0.0)
    for i, a in enumerate(edges):
        h = hazards[i]
        at = a + (math.log(2) - before) / h
        fits = at <= edges[i + 1] if i + 1 < len(edges) else F.lit(True)
        out = F.coalesce(out, F.when(fits, at))
        if i + 1 < len(edges):
            before = before + h * (edges[i + 1] - a)
    return out


def piecewise_mean(hazards: Column, breaks: list[float]) -> Column:
    """Mean time under hazards constant between breaks: each piece adds its share of the survivors' time."""
    edges = [0.0, *breaks]
    out, alive = F.lit(0.0), F.lit(1.0)
    for i, a in enumerate(edges):
        h = hazards[i]
        out = out + alive * (a + 1 / h)
        if i + 1 < len(edges):
            alive = alive * F.exp(-h * (edges[i + 1] - a))
            out = out - alive * (edges[i + 1] + 1 / h)
    return out


def joined_outputs(outputs: Column, parts: int) -> Column:
    """Outputs in groups of ``parts`` joined by log-sum-exp, one value per target."""
    n = (F.size(outputs) / parts).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: array_log_sum_exp(F.slice(outputs, i * parts + 1, F.lit(parts))))


def uniform(key: Column, seed: str) -> Column:
    """A value between 0 and 1 that depends on key and seed alone, however the rows are dealt."""
    digits = F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(seed))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def replicate(kind: str, key: Column, seed: str, o: Column, sd: Column | None = None, alpha: float | None = None) -> Column:
    """A random target from the predictive model: gaussian, t (``alpha`` degrees of freedom), binary, class (``o`` an
    array of log probabilities up to a constant), count (``o`` the log rate) or survival (``o`` the log hazard)."""
    u, v = uniform(key, f"{seed}u"), uniform(key, f"{seed}v")
    turn = F.cos(2 * math.pi * v)
    if kind == "gaussian":  # Box and Muller
        return o + sd * F.sqrt(-2 * F.log(u)) * turn
    if kind == "t":  # Bailey's form of the same
        return o + sd * F.sqrt(alpha * (F.pow(u, F.lit(-2 / alpha)) - 1)) * turn
    if kind == "binary":
        return (u < 1 / (1 + F.exp(-o))).cast("double")
    if kind == "class":
        p = F.transform(o, lambda x: F.exp(x - array_log_sum_exp(o)))
        upto = F.transform(F.sequence(F.lit(1), F.size(o) - 1), lambda n: F.aggregate(F.slice(p, F.lit(1), n), F.lit(0.0), lambda s, x: s + x))
        return F.size(F.filter(upto, lambda c: c <= u)).cast("double")
    if kind == "survival":
        return -F.log(u) / F.exp(o)
    if kind == "count":
        return _poisson_quantile(F.exp(o), u)
    raise ValueError(kind)


@F.pandas_udf(T.DoubleType())
def _poisson_quantile(rate: pd.Series, u: pd.Series) -> pd.Series:
    """Smallest k whose cumulative probability reaches u: bracket and halve on sums of log-space terms around the rate."""
    r, p = rate.to_numpy(np.float64), u.to_numpy(np.float64)
    out = np.full(len(r), np.nan)
    known = np.isfinite(r) & np.isfinite(p)
    spread = np.ceil(12 * np.sqrt(np.maximum(r, 1)) + 30)
    low = np.where(known, np.maximum(np.floor(r) - spread, 0), 0)
    width = np.where(known, np.floor(r) + spread - low + 1, 0).astype(np.int64)
    order = np.argsort(width, kind="stable")
    for rows in np.array_split(order, max(1, len(order) // 256)):  # rows of like rates share a grid
        rows = rows[known[rows]]
        for part in np.array_split(rows, max(1, int(len(rows) * width[rows].max(initial=0)) >> 21)):
            if len(part):
                k = low[part, None] + np.arange(width[part].max())
                mass = np.exp(k * np.log(r[part, None]) - r[part, None] - log_gamma(k + 1))
                total = np.cumsum(mass, axis=1)
                out[part] = low[part] + (total < p[part, None]).sum(1)
    return pd.Series(out)
