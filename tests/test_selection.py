import numpy as np
import pytest
from pyspark.sql import functions as F

from drawlake.functions.numeric import stratified_normal
from drawlake.operators import draws, predict, selection


def test_bits_keep_order():
    v = np.array([-np.inf, -1e300, -2.0, -5e-324, 0.0, 5e-324, 1.0, 1e300, np.inf, np.nan])
    bits = selection.ordered_bits(v)
    assert (np.diff(bits.astype(object)) > 0).all() and np.array_equal(selection.from_bits(bits.view(np.int64)), v, equal_nan=True)
    assert selection.ordered_bits(np.array([-0.0])) == selection.ordered_bits(np.array([0.0]))


@pytest.mark.parametrize("broadcast", [True, False])
def test_selection_equals_sorting(spark, monkeypatch, broadcast):
    """Cases of 1 to 30,000 draws, ties, a null key, infinite, null and equal values: as sorted, gathered or counted."""
    if not broadcast:
        monkeypatch.setattr(selection, "MOST_ROWS", 0)
    monkeypatch.setattr(selection, "MOST_LAST", 500)
    rng = np.random.default_rng(3)
    rows = [(1, 0, 1.5, 0.0)] + [(2, 0, float(a), 0.3) for a in rng.normal(size=30_000)] + [(3, 0, 7.0, 0.0)] * 2000
    rows += [(None, 1, float(a), float(b)) for a, b in zip(rng.normal(size=200) * 1e3, rng.exponential(size=200))]
    rows += [(4, None, float(a), 1.0) for a in rng.integers(-2, 3, 50)] + [(5, 0, np.inf, 1.0), (5, 0, -np.inf, 1.0), (6, 0, None, 1.0), (6, 0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k long, g int, m double, s double").repartition(5)
    run = lambda most: {(r.k, r.g): list(r)[2:] for r in predict.pooled_quantiles(df, ["k", "g"], F.col("m"), F.col("s"), gathered=most).collect()}
    z, want = np.array(stratified_normal(101)), {}
    for key in {r[:2] for r in rows}:
        own = [r for r in rows if r[:2] == key]
        v = np.sort(np.concatenate([np.nan * z if r[2] is None else r[2] + r[3] * z for r in own]))
        n, low = len(v), [int(0.5 + f * len(v)) for f in (0.1, 0.01)]
        with np.errstate(invalid="ignore"):  # the middle of two infinities
            want[key] = [(v[n // 2] + v[(n - 1) // 2]) / 2, *(x for p in low for x in (v[p], v[n - 1 - p]))]
    for most in (1024, 100_000):
        got = run(most)
        assert got.keys() == want.keys()
        for key, values in want.items():
            assert got[key] == [None if np.isnan(v) else v for v in values], key


def test_selection_of_no_rows(spark):
    df = spark.createDataFrame([], "k long, m double, s double")
    assert predict.pooled_quantiles(df, ["k"], F.col("m"), F.col("s")).count() == 0
    assert predict.pooled_quantiles(df, ["k"], F.col("m"), F.col("s"), gathered=-1).count() == 0


@pytest.mark.parametrize("width", [4, 65_536])
def test_states_as_of_many_indexes(spark, monkeypatch, width):
    """As a loop that walks the records, with ranges that hold no record, repeated rows and rows with nulls."""
    monkeypatch.setattr(draws, "RANGE", width)
    rng = np.random.default_rng(5)
    records = [(str(rng.integers(3)), "abc"[rng.integers(3)], int(i), float(rng.integers(4))) for i in rng.choice([*range(-5, 40), *range(90, 100)], 60)]
    records += [*records[:5], ("0", "a", None, 1.0), (None, "a", 3, 1.0), ("0", None, 3, 1.0), ("2", "c", 50, None)]
    asked = [(log, int(i)) for log in ("0", "1", "2", "9") for i in (-9, 0, 7, 39, 60, 60, 95, 200)] + [("0", None), (None, 5)]
    df = spark.createDataFrame(records, "log_id string, type string, idx long, value double")
    got = sorted(tuple(r) for r in draws.states_as_of(df, spark.createDataFrame(asked, "log_id string, at long")).collect())
    want = set()
    for log, at in asked[:-1]:
        for kind in "abc":
            held = [(i, v is not None, v) for name, k, i, v in records if name == log and k == kind and i is not None and at is not None and i <= at]
            if held:
                best = max(held)
                want.add((log, at, kind, best[0], best[2]))
    assert got == sorted(want)
    one = sorted(tuple(r) for r in draws.state_as_of(df.where("log_id = '1' and idx is not null and type is not null"), 39).select("type", "idx").collect())
    assert one == sorted((k, i) for log, at, k, i, _ in got if log == "1" and at == 39)
