"""Work that has to stay bounded, or grow with the input only, on larger tables."""

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from drawlake.operators import covariance as G
from drawlake.functions.numeric import stratified_normal
from drawlake.operators import data, fields, mixture, pairing
from drawlake.operators.pairing import dealt
from drawlake.plans.registry import ORACLE_SQL, QUERIES


def test_few_partitions_that_make_many_pairs_are_dealt_anew(spark, monkeypatch):
    monkeypatch.setattr(pairing, "PAIRS_OF_TASK", 10)
    left, right = spark.range(20, numPartitions=1).withColumnRenamed("id", "a"), spark.range(5).withColumnRenamed("id", "b")
    out = pairing.paired(left, right)
    assert out.groupBy(F.spark_partition_id()).count().count() > 3
    assert sorted(map(tuple, out.collect())) == [(a, b) for a in range(20) for b in range(5)]


def test_noise_meets_cases_before_they_are_paired(spark):
    train = spark.createDataFrame([(i, i / 3.0) for i in range(6)], "i long, x double")
    out = G.train_covariance(train, ["x"], G.Spec(constant=0.5), noise=train.select("i", (F.col("x") + 1).alias("variance")))
    assert {(r.i, r.j): r.c for r in out.collect()} == pytest.approx({(i, j): 0.25 + (i == j) * (i / 3 + 1) for i in range(6) for j in range(6)})


def test_a_case_has_one_noise_and_stays_without(spark):
    train = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 3.0), (None, 4.0)], "i long, x double")
    noise = spark.createDataFrame([(1, 0.5), (1, 0.5), (2, 1.0)], "i long, variance double")
    got = [(r.i or 0, r.j or 0, r.c) for r in G.train_covariance(train, ["x"], G.Spec(constant=0.5), noise=noise).collect()]
    assert sorted(got) == sorted((i, j, 0.25 + (i == j > 0) * i / 2) for i in (0, 1, 1, 2) for j in (0, 1, 1, 2))


@pytest.mark.parametrize("name", ["g1_covariance", "g1_covariance_parts", "g2_noise_by_case", "g2_train_covariance"])
def test_equal_covariances_are_stored_close_together(spark, tmp_path, name):
    """All pairs of a table with itself, a missing input among them, take about half the bytes of an order row by row."""
    duckdb.sql(f"COPY (SELECT range AS s_suppkey, CASE WHEN range <> 5 THEN round(hash(range) % 1099999 / 100.0 - 999.99, 2) END AS s_acctbal FROM range(701)) TO '{tmp_path}/supplier.parquet'")
    QUERIES[name](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    got, want = f"'{tmp_path}/out/*.parquet'", ORACLE_SQL[name].replace("FROM supplier", f"FROM '{tmp_path}/supplier.parquet'")
    met = duckdb.sql(f"SELECT count(*), count(DISTINCT (g.i, g.j)), count(g.c), count(w.c), max(abs(g.c - w.c)) FROM {got} g JOIN ({want}) w ON g.i = w.i AND g.j = w.j").fetchall()[0]
    assert met[:4] == (701**2, 701**2, 700**2, 700**2) and met[4] < 1.5e-6
    assert duckdb.sql(f"SELECT count(*) FROM {got}").fetchall() == [(701**2,)]
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 6 * 701**2


def test_places_are_evaluated_once(spark, monkeypatch):
    """Receptors at one place, and a draw's sources at one place, are one row when pairs are formed."""
    met = []
    paired = fields.paired
    monkeypatch.setattr(fields, "paired", lambda a, b, *more: met.append((a.count(), b.count())) or paired(a, b, *more))
    src = spark.createDataFrame([("a", k % 2, k, 5.0 + k % 3, 0.5, 0.2, 1.0 + k, 2.0) for k in range(60)], "log_id string, idx long, src long, x double, y double, z double, q double, u double")
    rec = spark.createDataFrame([(k, k % 4 * 2.0, 0.1, 0.5) for k in range(80)], "receptor long, x double, y double, z double")
    every = src.crossJoin(rec.select("receptor", F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("z").alias("rz")))
    every = every.withColumn("v", fields.plume(F.col("x") - F.col("rx"), F.col("y") - F.col("ry"), F.col("z"), F.col("rz"), F.col("u"), fields.Flow())).cache()
    want = {(r.idx, r.receptor): r.s for r in every.groupBy("idx", "receptor").agg(F.sum(F.col("v") * F.sqrt("q")).alias("s")).collect()}
    assert {(r.idx, r.receptor): r.total for r in fields.receptor_total(src, rec, fields.Flow(), 2.0).collect()} == pytest.approx(want)
    want = {r.src: (r.s, r.m) for r in every.groupBy("src").agg(F.sum("v").alias("s"), F.max("v").alias("m")).collect()}
    got = {r.src: (r.total, r.peak) for r in fields.source_plume(src, rec, fields.Flow()).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    assert met == [(4, 6), (4, 3)]


def test_equal_points_are_one_in_kernel_density(spark, monkeypatch):
    met = []
    paired = G.paired
    monkeypatch.setattr(G, "paired", lambda a, b, *more: met.append([sum(len(r[0]) for r in s.collect()) for s in (a, b)]) or paired(a, b, *more))
    train = spark.createDataFrame([(k % 7 / 2.0, k % 3 / 1.0) for k in range(90)] + [(None, 1.0)], "x double, y double")
    test = spark.createDataFrame([(k, k % 5 / 1.5, float(k % 2)) for k in range(40)] + [(99, 400.0, 0.0)], "k long, x double, y double")
    a = np.array([(r.x, r.y) for r in train.dropna().collect()])
    log_k = {r.k: -((np.array([r.x, r.y]) - a) ** 2).sum(1) / 0.5 - np.log(2 * np.pi * 0.25) for r in test.collect()}
    want = {k: v.max() + np.log(np.exp(v - v.max()).mean()) for k, v in log_k.items()}
    got = {r.k: r.log_density for r in G.kernel_density(train, test, "k", ["x", "y"], 0.5).collect()}
    assert got == pytest.approx(want) and met == [[11, 21]]


def test_dense_cells_meet_by_sums_of_their_points(spark, monkeypatch):
    """Cells with many points meet without their pairs, near or far; lone points, borders of cells and copies count as before."""
    blocks = []
    paired = G.paired
    monkeypatch.setattr(G, "paired", lambda a, b, *more: blocks.append((a.where("_at IS NOT NULL").count(), b.where("_of IS NOT NULL").count())) or paired(a, b, *more))
    monkeypatch.setattr(G, "DENSE", 30)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.uniform(-0.7, 1.2, (1500, 2)), rng.uniform(0, 0.5, (300, 2)) + [20, 0], [[0.5, 0.5], [0.5, 0.5], [-0.5, 0.0], [9.0, 9.0]]])
    z = np.concatenate([rng.uniform(-0.9, 1.3, (900, 2)), rng.uniform(0, 0.5, (200, 2)) + [40, 1], [[0.5, 0.5], [0.0, -0.5], [300.0, 4.0], [6e8, 0.0]]])
    frame = lambda v: spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(v)], "k long, x double, y double")
    log_k = -((z[:, None] - x[None]) ** 2).sum(2) / 0.5 - np.log(2 * np.pi * 0.25)
    want = log_k.max(1) + np.log(np.exp(log_k - log_k.max(1, keepdims=True)).mean(1))
    got = {r.k: r.log_density for r in G.kernel_density(frame(x).drop("k"), frame(z), "k", ["x", "y"], 0.5).collect()}
    assert [got[k] for k in range(len(z))] == pytest.approx(want.tolist(), rel=1e-13, abs=1e-12)
    assert len(got) == len(z) and min(blocks[0]) > 5
    made, exp = [], np.exp
    z, x = [rng.uniform(3, 4, 1500) for _ in range(2)], [rng.uniform(-1, 0, 2000) for _ in range(2)]
    plain = G._log_kernels(z, x, np.zeros(2000), None, None)
    monkeypatch.setattr(np, "exp", lambda v: made.append(np.size(v)) or exp(v))
    assert G._log_kernels(z, x, np.zeros(2000), np.full(2, 3.5), np.full(2, -0.5)) == pytest.approx(plain, rel=1e-14)
    assert sum(made) == 2000


def test_predictions_from_many_cases_equal_those_of_full_factors(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, *map(float, rng.uniform(-1, 10, 1)), float(i % 17) / 10) for i in range(900)]
    train = spark.createDataFrame(rows, "i long, a double, b double").withColumns({"t": F.sin("a"), "f": F.cos("a"), "v": 0.1 + F.col("i") % 5 / 10})
    test = spark.createDataFrame([(i, *map(float, rng.uniform(-1, 11, 2))) for i in range(120)], "k long, a double, b double")
    spec = G.Spec(constant=0.5, linear=[0.3, 0.2], parts=[(0.1, [0.4, 0.6], 2.0)], noise=0.3, jitter=0.1)
    found = []
    for most in (3000, 100):
        monkeypatch.setattr(G, "MOST_TRAIN", most)
        out = G.gp_predictions(train, test, "k", ["a", "b"], [(1, spec), (2, spec), (3, spec)], "t", "i", {1: "f"}, {2: "v"})
        found.append({(r.idx, r.k): (r.mean, r.variance) for r in out.collect()})
    want, got = (np.array([f[k] for k in sorted(found[0])]) for f in found)
    assert len(got) == 360 and np.abs(got - want).max() < 1e-7
    monkeypatch.setattr(G, "MOST_RANK", 5)
    with pytest.raises(ValueError, match="rank"):
        G.gp_predictions(train, test, "k", ["a", "b"], [(1, spec)], "t", "i")


def test_wide_indicator_rows_are_dealt(spark, monkeypatch):
    ids = spark.range(1, 31, numPartitions=1).withColumnRenamed("id", "k")
    monkeypatch.setattr(data, "dealt", lambda df, rows: dealt(df, min(rows, 4)))
    out = data.case_indicators(ids.where("k % 3 > 0"), ids.where("k % 3 = 0"), "k")
    assert out.groupBy(F.spark_partition_id()).count().count() > 4
    place = {k: i for i, k in enumerate(k for k in range(1, 31) if k % 3)}
    assert {r.k: r.hot for r in out.collect()} == {k: [int(i == place.get(k, 20)) for i in range(21)] for k in range(1, 31)}


def test_latent_averages_run_on_arrays(spark):
    df = spark.createDataFrame([(0.3, 0.5, 2.0), (-1.0, 0.1, 0.0)], "m double, v double, t double")
    out = df.select(G.binary_probability(F.col("m"), F.col("v")).alias("p"), G.count_prediction(F.col("t"), F.col("m"), F.col("v"))["mean"].alias("c"), G.class_probabilities([F.col("m"), F.lit(0.0)], [F.col("v"), F.lit(0.2)]).alias("q"))
    assert "ArrowEvalPython" in out._jdf.queryExecution().executedPlan().toString()
    z = np.array(stratified_normal(100))
    for r, (m, v) in zip(out.collect(), [(0.3, 0.5), (-1.0, 0.1)]):
        at = m + np.sqrt(v) * z
        assert (r.p, r.c, sum(r.q)) == pytest.approx(((1 / (1 + np.exp(-at))).mean(), np.exp(at).mean(), 1.0))


def test_sql_of_detectors_holds_far_from_observations():
    """A likelihood of exp(-5000) is no error and no 0 in the SQL."""
    db = duckdb.connect()
    db.execute("CREATE TABLE customer AS SELECT CAST(9 AS BIGINT) AS c_custkey")
    db.execute("CREATE TABLE supplier AS SELECT CAST(28 + 2520 * i AS BIGINT) AS s_suppkey, 0 AS s_nationkey, 9000.0 AS s_acctbal FROM range(4000) r(i)")
    assert db.execute(f"SELECT log_prob FROM ({ORACLE_SQL['c3_detector_prediction']})").fetchone()[0] < -1000


def exchanges(df):
    """Columns and numbers of partitions of the shuffles of the plan of ``df``."""
    return re.findall(r"Exchange hashpartitioning\((.*), (\d+)\)", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("kind", ["real", "binary"])
def test_cases_meet_components_without_a_shuffle_of_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(mixture, "ROWS_OF_TASK", 30)
    rng = np.random.default_rng(4)
    t = {(c, k): None if (c + k) % 5 == 0 else float(rng.integers(0, 2)) for c in range(40) for k in (0, 1)}
    params = {(i, g, k): (float(rng.normal()), 0.5 + g / 3) for i in (1, 2) for g in range(1, 4) for k in (0, 1)}
    cases = spark.createDataFrame([(*k, v) for k, v in t.items()], "case_id long, target int, t double")
    comps = spark.createDataFrame([("m", i, g, k, *v) for (i, g, k), v in params.items()], "log_id string, idx long, comp long, target int, offset double, sd double")
    freq = spark.createDataFrame([("m", i, g, g) for i in (1, 2) for g in range(1, 4)], "log_id string, idx long, comp long, n long")
    own = spark.createDataFrame([("m", i, c, 1 + c % 3) for i in (1, 2) for c in range(40)], "log_id string, idx long, case_id long, comp long")

    def log_one(v, m, s):
        if v is None:
            return 0.0
        return -((v - m) ** 2) / (2 * s * s) - np.log(s * np.sqrt(2 * np.pi)) if kind == "real" else -np.log1p(np.exp(m if v == 0 else -m))

    want = {(c, i, g): sum(log_one(t[c, k], *params[i, g, k]) for k in (0, 1)) for c in range(40) for i in (1, 2) for g in range(1, 4)}
    density = mixture.component_log_density(cases, comps, kind)
    assert {(r.case_id, r.idx, r.comp): r.log_density for r in density.collect()} == pytest.approx(want)
    weight = mixture.weights(freq, 0.0, finite=3)
    plain = mixture.responsibilities(density, weight)
    every = [x for x in exchanges(plain) if x[0].startswith("case_id")]
    assert every and all(c.count("#") == 1 and int(n) == 32 for c, n in every)
    left = mixture.left_out_responsibilities(density, freq, own)
    for found, mass in ((plain, lambda c, g: g), (left, lambda c, g: g - (g == 1 + c % 3))):
        got = {(r.case_id, r.idx, r.comp): r.p for r in found.collect()}
        for c in range(40):
            for i in (1, 2):
                p = np.array([mass(c, g) * np.exp(want[c, i, g]) for g in range(1, 4)])
                assert [got.get((c, i, g), 0.0) for g in range(1, 4)] == pytest.approx(p / p.sum())
    assert set(int(n) for c, n in exchanges(left) if "case_id" in c and c.count("#") == 3) == {8}


def test_new_component_is_dealt_by_cases(spark, monkeypatch):
    monkeypatch.setattr(mixture, "ROWS_OF_TASK", 20)
    cases = spark.range(60, numPartitions=1).selectExpr("id AS case_id", "0 AS target", "id / 10.0D AS t")
    hypers = spark.createDataFrame([("m", i, 0, 0.5 * i, 1.0, 0.7) for i in (1, 2)], "log_id string, idx long, target int, mean double, sd double, noise double")
    out = mixture.new_component_log_density(cases, hypers, points=40)
    z = np.array(stratified_normal(40))
    want = {(c, i): np.log(np.mean(np.exp(-((c / 10 - 0.5 * i - z) ** 2) / (2 * 0.49)) / (0.7 * np.sqrt(2 * np.pi)))) for c in range(60) for i in (1, 2)}
    assert {(r.case_id, r.idx): r.log_density for r in out.collect()} == pytest.approx(want)
    assert exchanges(out) and all(c.count("#") == 1 and int(n) == 12 for c, n in exchanges(out))
