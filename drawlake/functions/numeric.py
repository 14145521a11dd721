"""Scalar functions, densities and log-space sums as columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EULER = 0.57721566490153286
HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)
#: Largest |z| that the normal quantile returns (fixed value).
MAX_Z = 5.612002
_STEP = 300.0


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Log of abs(gamma): Stirling's series beyond 12, the recurrence below, reflection for negative x; infinite at the poles."""
    x = np.asarray(x, np.float64)
    with np.errstate(all="ignore"):
        y = np.where(x < 0.5, 1 - x, x)
        shift = np.zeros_like(y)
        for _ in range(12):
            low = y < 12
            shift = shift + np.where(low, np.log(y), 0.0)
            y = np.where(low, y + 1, y)
        r = 1 / (y * y)
        series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r * (1 / 1188 - r * 691 / 360360))))) / y
        out = (y - 0.5) * np.log(y) - y + HALF_LOG_2PI + series - shift
        mirrored = math.log(math.pi) - np.log(np.abs(np.sin(np.pi * (x - np.round(x))))) - out
        out = np.where(x < 0.5, mirrored, out)
        return np.where((x <= 0) & (x == np.floor(x)), np.inf, out)


def tail(z: np.ndarray) -> np.ndarray:
    """Normal probability below -z for z >= 0: a power series up to 3, a continued fraction beyond."""
    z = np.asarray(z, np.float64)
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    near = np.minimum(z, 3.0)
    term, total = near.copy(), near.copy()
    for k in range(3, 95, 2):
        term = term * near * near / k
        total = total + term
    far = np.maximum(z, 3.0)
    fraction = far.copy()
    for k in range(60, 0, -1):
        fraction = far + k / fraction
    return np.where(z < 3, 0.5 - density * total, density / fraction)


def cdf(z: np.ndarray) -> np.ndarray:
    z = np.asarray(z, np.float64)
    low = tail(np.abs(z))
    return np.where(z < 0, low, 1 - low)


def quantiles(p: np.ndarray) -> np.ndarray:
    """Normal quantiles by bisection on the tail, abs(z) at most MAX_Z; not a number outside 0 to 1."""
    p = np.asarray(p, np.float64)
    half = np.minimum(p, 1 - p)
    lo, hi = np.zeros_like(half), np.full_like(half, MAX_Z)
    for _ in range(60):
        mid = (lo + hi) / 2
        above = tail(mid) > half
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    z = (lo + hi) / 2
    return np.where((p >= 0) & (p <= 1), np.where(p < 0.5, -z, z), np.nan)


def quantile(p: float) -> float:
    return float(quantiles(np.array([p]))[0])


def _by_batch(function) -> Column:
    """A pandas UDF of one numpy function; null stays null."""

    @F.pandas_udf(T.DoubleType())
    def run(x: pd.Series) -> pd.Series:
        known = x.notna().to_numpy()
        out = np.full(len(x), np.nan)
        out[known] = function(x.to_numpy(np.float64)[known])
        return pd.Series(out).where(known & ~np.isnan(out), None).astype("Float64")

    return run


def lgamma(x: Column) -> Column:
    """Log of the gamma function (no built-in exists)."""
    return _by_batch(log_gamma)(x)


def normal_cdf(x: Column) -> Column:
    return _by_batch(cdf)(x)


def normal_quantile(p: Column) -> Column:
    """Null outside 0 to 1."""
    return _by_batch(quantiles)(p)


def stratified_normal(n: int) -> list[float]:
    """The n normal quantiles at (i + 1/2) / n."""
    return quantiles((np.arange(n) + 0.5) / n).tolist()


def log_phi(z: Column) -> Column:
    return -z * z / 2 - HALF_LOG_2PI


def sign(x: Column) -> Column:
    return F.when(x > 0, 1.0).when(x < 0, -1.0).otherwise(F.when(x.isNotNull(), 0.0))


def theta(x: Column) -> Column:
    return F.when(x >= 0, 1.0).otherwise(F.when(x.isNotNull(), 0.0))


def delta(x: Column) -> Column:
    return F.when(x == 0, 1.0).otherwise(F.when(x.isNotNull(), 0.0))


def frac(x: Column) -> Column:
    """Fraction of x; for negative x it is 1 minus the fraction of -x, so frac(-1) is 1."""
    return F.when(x >= 0, x % 1).otherwise(1 - (-x) % 1)


def times(a: Column, b: Column) -> Column:
    """Product that is 0 whenever the left side is 0."""
    return F.when(a == 0, 0.0).otherwise(a * b)


def add_logs(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def sub_logs(a: Column, b: Column) -> Column:
    """log(exp(a) - exp(b)), a above b."""
    return a + F.log1p(-F.exp(b - a))


def log_sum_exp(*parts: Column) -> Column:
    top = F.greatest(*parts) if len(parts) > 1 else parts[0]
    return top + F.log(sum((F.exp(p - top) for p in parts), F.lit(0.0)))


def bound(value: Column, use) -> Column:
    """``use(v)`` with ``v`` standing for ``value``, which is computed once however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def array_log_sum_exp(values: Column) -> Column:
    """log of the sum of exp over an array, which is built once."""

    def total(s: Column) -> Column:
        return s["top"] + F.log(F.aggregate(s["v"], F.lit(0.0), lambda a, x: a + F.exp(x - s["top"])))

    return bound(values, lambda v: bound(F.struct(v.alias("v"), F.array_max(v).alias("top")), total))


def log_sum_exp_by(df: DataFrame, keys: list[str], value: Column, name: str, **sums: Column) -> DataFrame:
    """log of the sum of exp(value) by ``keys``, with further plain sums by name.

    Values are summed within steps of 300 (map-side), so no maximum has to be found first.
    """
    step = F.floor(value / _STEP)
    parts = df.where(value.isNotNull()).groupBy(*keys, step.alias("_step")).agg(F.sum(F.exp(value - step * _STEP)).alias("_s"), *[F.sum(c).alias(n) for n, c in sums.items()])
    top = parts.groupBy(*keys).agg(F.max("_step").alias("_top"), F.collect_list(F.struct("_step", "_s")).alias("_all"), *[F.sum(n).alias(n) for n in sums])
    total = F.aggregate("_all", F.lit(0.0), lambda a, p: a + p["_s"] * F.exp((p["_step"] - F.col("_top")) * _STEP))
    return top.select(*keys, (F.col("_top") * _STEP + F.log(total)).alias(name), *sums)


def normal_energy(x: Column, mean: Column, variance: Column) -> Column:
    """Minus log density of a normal."""
    return (x - mean) ** 2 / (2 * variance) + 0.5 * F.log(2 * math.pi * variance)


def exp_gamma_energy(x: Column, shape: Column, rate: Column) -> Column:
    """Minus log density of the log of a gamma variable."""
    return lgamma(shape) - shape * F.log(rate) - shape * x + rate * F.exp(x)


def exp_gamma2_energy(x: Column, alpha: Column, mean: Column) -> Column:
    """The same with shape alpha/2 and rate alpha/(2 mean)."""
    return exp_gamma_energy(x, alpha / 2, alpha / (2 * mean))


def bernoulli_energy(x: Column, p: Column) -> Column:
    return F.when(x == 1, -F.log(p)).when(x == 0, -F.log1p(-p))


def vector(x: pd.Series) -> np.ndarray:
    return np.stack(x.to_list()).astype(np.float64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix product without the threads of a linear-algebra library, which can block in forked workers."""
    return np.einsum("ik,kj->ij", a, b)
