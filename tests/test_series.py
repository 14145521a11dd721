import math

import numpy as np
import pytest

from drawlake.operators import diagnostics as A
from drawlake.operators import ordered


def frame(spark, runs):
    rows = [(r, t + 1, None if v is None or math.isnan(v) else float(v)) for r, x in runs.items() for t, v in enumerate(x)]
    return spark.createDataFrame(rows, "realization int, t long, value double").repartition(5)


def direct(runs, max_lag, presumed=None):
    mean = np.nanmean(np.concatenate(list(runs.values()))) if presumed is None else presumed
    out = {}
    for lag in range(max_lag + 1):
        products = np.concatenate([(x[: len(x) - lag] - mean) * (x[lag:] - mean) for x in runs.values() if len(x) > lag] or [np.zeros(0)])
        products = products[~np.isnan(products)]
        if len(products):
            out[lag] = (products.mean(), len(products))
    return out


def same(got, want):
    assert set(got) == set(want) and all(got[k] == (pytest.approx(want[k][0], abs=1e-9), want[k][1]) for k in want)


@pytest.mark.parametrize("blocks", [A.BLOCKS, (4, 16), (1, 5)])
@pytest.mark.parametrize("max_lag", [None, 0, 8, 40, 500])
def test_all_lags_against_direct_sums(spark, monkeypatch, blocks, max_lag):
    """Whatever the blocks, no pair is lost at any lag; missing points are in none."""
    monkeypatch.setattr(A, "BLOCKS", blocks)
    rng = np.random.default_rng(1)
    runs = {0: rng.normal(size=90).cumsum(), 1: rng.normal(size=20), 2: rng.normal(size=1), 3: rng.normal(size=64)}
    runs[0][[3, 4, 50]] = np.nan
    runs[3][-1] = np.nan
    got = {r.lag: (r.covariance, r.pairs) for r in A.autocovariance(frame(spark, runs), max_lag).collect()}
    same(got, direct(runs, 89 if max_lag is None else min(max_lag, 89)))


def test_lags_beyond_a_block_of_twenty_points(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCKS", (5, 5))
    got = {r.lag: r.pairs for r in A.autocovariance(frame(spark, {0: np.arange(20.0)}), 8).collect()}
    assert got == {lag: 20 - lag for lag in range(9)}


def test_long_series_at_the_default_lag(spark):
    """All 200,000 lags of a series; some are held against direct sums, all numbers of pairs are."""
    x = np.random.default_rng(2).normal(size=200_000).cumsum() / 100
    table = spark.range(200_000).selectExpr("1 AS realization", "id + 1 AS t")
    values = spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(x)], "t long, value double")
    got = {r.lag: (r.covariance, r.pairs) for r in A.autocovariance(table.join(values, "t")).collect()}
    assert len(got) == 200_000 and all(n == 200_000 - lag for lag, (_, n) in got.items())
    d = x - x.mean()
    for lag in (0, 1, 999, 65_536, 131_071, 131_072, 150_000, 199_999):
        assert got[lag][0] == pytest.approx(np.mean(d[: len(d) - lag] * d[lag:]), rel=1e-7, abs=1e-9)


def test_presumed_mean_and_no_rows(spark):
    runs = {0: np.random.default_rng(3).normal(size=30)}
    got = {r.lag: (r.covariance, r.pairs) for r in A.autocovariance(frame(spark, runs), 5, presumed=0.25).collect()}
    same(got, direct(runs, 5, 0.25))
    assert A.autocovariance(frame(spark, runs).limit(0), 5).count() == 0


def test_standard_error_by_the_formula(spark):
    rng = np.random.default_rng(4)
    runs = {i: rng.normal(size=n).cumsum() for i, n in enumerate((40, 25, 3))}
    for max_lag in (6, None):
        c = {k: v for k, (v, _) in direct(runs, 39 if max_lag is None else max_lag).items()}
        v = {i: sum(c[lag] * (1 if lag == 0 else 2 * (1 - lag / len(x))) for lag in c if lag < len(x)) for i, x in runs.items()}
        want = math.sqrt(sum(v[i] * len(x) for i, x in runs.items())) / 68
        assert A.se_from_correlations(frame(spark, runs), max_lag).first().se == pytest.approx(want)


def test_running_sum(spark):
    rows = [(i, float(i * i % 17)) for i in np.random.default_rng(5).permutation(500).tolist()]
    df = spark.createDataFrame(rows, "k int, v double")
    got = {r.k: r.s for r in ordered.running_sum(df, "k", {"s": df["v"]}).collect()}
    assert got == pytest.approx(dict(enumerate(np.cumsum([i * i % 17 for i in range(500)]))))
