import numpy as np
import pytest
from pyspark.sql import functions as F

from drawlake.operators import covariance as G
from drawlake.operators import diagnostics, draws
from drawlake.streaming.monitor import monitored


def test_numbers_and_tours_of_one_large_log(spark):
    """Logs that span partitions are numbered and toured as by a loop over their draws."""
    rng = np.random.default_rng(1)
    rows = [(log, int(i), float(t)) for log, n in (("a", 900), ("b", 3), ("c", 40)) for i, t in zip(rng.permutation(5 * n)[:n], rng.choice([1.0, 0.5, 0.25], n))]
    df = spark.createDataFrame(rows, "log_id string, idx long, inv_temp double").repartition(7)
    got = {(r.log_id, r.idx): r.new_idx for r in draws.at_temperature(df, 1.0, also_highest=True).collect()}
    want, tours = {}, {}
    for log in "abc":
        own = sorted((i, t) for name, i, t in rows if name == log)
        low = min(t for _, t in own)
        ends = [(i, t) for i, t in own if t in (1.0, low)]
        want |= {(log, i): k for k, (i, _) in enumerate(ends, 1)}
        tours[log] = sum(b == 1.0 and a != 1.0 for (_, a), (_, b) in zip(ends, ends[1:]))
    assert got == want
    assert {r.log_id: r.tours for r in diagnostics.tour_count(df).collect()} == tours


@pytest.mark.parametrize("low, high, num", [(1, 1000, 7), (3, 990, 500), (5, 5, 4), (0, 1000, 1), (1, 100, 100_000), (17, 900, 2)])
def test_even_selection(spark, low, high, num):
    held = sorted(np.random.default_rng(2).choice(1000, 300, replace=False).tolist())
    df = spark.createDataFrame([("a", int(i)) for i in held], "log_id string, idx long")
    n = min(num, high - low + 1)
    targets = {int(low + i * (high - low) / max(n - 1, 1) + 0.5) for i in range(n)}
    edges = sorted(targets) + [high + 1]
    want = {min(own) for a, b in zip(edges, edges[1:]) if (own := [i for i in held if a <= i < b and i <= high])}
    assert {r.idx for r in draws.select_evenly(df, low, high, num).collect()} == want


def test_monitor_goes_on_from_its_checkpoint(spark, tmp_path):
    """Two arrivals, one file an epoch, and a call with nothing new."""
    source, folder, kind = str(tmp_path / "in"), str(tmp_path / "out"), "k string, i long, v double"
    run = lambda: sorted(tuple(r) for r in monitored(spark, source, spark.createDataFrame([], kind).schema, ["k"], "i", "v", folder, files=1).collect())
    spark.createDataFrame([("a", 1, 2.0), ("b", 2, 5.0)], kind).repartition(2).write.parquet(source)
    assert run() == [("a", 1, 1, 2.0, 2.0, 2.0), ("b", 1, 2, 5.0, 5.0, 5.0)]
    spark.createDataFrame([("a", 7, 4.0), ("c", 9, 1.0)], kind).write.mode("append").parquet(source)
    want = [("a", 2, 7, 3.0, 2.0, 4.0), ("b", 1, 2, 5.0, 5.0, 5.0), ("c", 1, 9, 1.0, 1.0, 1.0)]
    assert run() == want and run() == want


def test_spectrum_is_proved(spark):
    """A slowly falling spectrum: every value is within its bound of the exact one, and too few rounds are an error."""
    x = np.random.default_rng(4).normal(size=(400, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "i long, a double, b double")
    spec = G.Spec(parts=[(0.0, [1.0, 0.5], 1.0)], noise=0.1)
    want = np.linalg.eigvalsh(spec.matrix(x, x) + 0.01 * np.eye(400))[::-1][:10]
    got = G.leading_spectrum(df, ["a", "b"], "i", spec, 10).orderBy("rank").collect()
    assert [r.eigenvalue for r in got] == pytest.approx(list(want), rel=1e-8)
    assert all(abs(r.eigenvalue - w) <= r.bound + 1e-10 for r, w in zip(got, want))
    with pytest.raises(ValueError, match="bound"):
        G.leading_spectrum(df, ["a", "b"], "i", spec, 10, rounds=2)
    few = df.where("i < 30")
    every = np.linalg.eigvalsh(spec.matrix(x[:30], x[:30]) + 0.01 * np.eye(30))[::-1]
    assert [r.eigenvalue for r in G.leading_spectrum(few, ["a", "b"], "i", spec, 30).orderBy("rank").collect()] == pytest.approx(list(every))
