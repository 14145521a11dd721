import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from drawlake.functions import formula as formulas
from drawlake.functions import numeric as N
from drawlake.operators import covariance as G
from drawlake.operators import data, diagnostics, draws, fields, likelihood, mixture, network, pairing, predict, tree
from drawlake.sources import tables
from drawlake.streaming.monitor import monitor


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 1


def test_names_of_sql_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_formula_examples(spark):
    names = {"x": F.lit(2.0), "y": F.lit(-1.0)}
    for text, want in (("2x+1", 5), ("x^3", 8), ("-x^2", -4), ("[x+1]{x-1}", 3), ("3E2x", 600), ("Frac(y)", 1), ("Theta(0)+Delta(0)", 2), ("0Log(0)", 0), ("LogSumExp(x,x)", 2 + math.log(2)), ("x ~ Normal(2, 1)", 0.5 * math.log(2 * math.pi))):
        assert value(spark, formulas.formula(text, names=names)) == pytest.approx(want), text
    for bad in ("x+", "q", "x~Sin(1)", "(x,y)", "x)"):
        with pytest.raises(ValueError):
            formulas.formula(bad, names=names)


def test_log_sum_exp_of_extremes(spark):
    df = spark.createDataFrame([("a", 1000.0), ("a", 1000.0), ("b", -1000.0), ("b", None)], "k string, v double")
    got = {r.k: r.l for r in N.log_sum_exp_by(df, ["k"], F.col("v"), "l").collect()}
    assert got["a"] == pytest.approx(1000 + math.log(2)) and got["b"] == pytest.approx(-1000)


def test_reader_separators_and_errors(spark, tmp_path):
    (tmp_path / "t").write_text("1, 2\t?;4\n 5 6 7 8\n")
    rows = tables.read_numeric(spark, str(tmp_path / "t"), [4, 0, 3, 1]).orderBy("row_id").collect()
    assert [tuple(r)[1:] for r in rows] == [(4.0, 0.0, None, 1.0), (8.0, 0.0, 7.0, 5.0)]
    with pytest.raises(ValueError):
        tables.read_numeric(spark, str(tmp_path / "t"), [5])
    with pytest.raises(ValueError):
        tables.line_range(spark.createDataFrame([(1,)], "row_id long"), 1, 2)


def test_range_forms(spark):
    df = spark.range(1, 21).select(F.lit("a").alias("log_id"), F.col("id").alias("idx"))
    assert [r.idx for r in draws.select_range(df, "5:12%3").collect()] == [6, 9, 12]
    assert [r.idx for r in draws.select_range(df, "5:12%3", "low").collect()] == [5, 8, 11]
    assert [r.idx for r in draws.select_range(df, "7").collect()] == [7]
    assert draws.select_evenly(df, 1, 20, 100).count() == 20


def test_transforms_round_trip(spark):
    assert data.parse_transforms(["L", "I", "..."], 4)[3] == (False, 0.0, 1.0)
    spec = data.fit_transforms(spark.createDataFrame([(3.0,), (3.0,)], "x double"), {"x": data.parse_transform("+@x@")})["x"]
    assert spec == (False, -3.0, 1.0)
    spec = data.parse_transform("L-1x4")
    assert value(spark, data.inverse_transform(data.transform(F.lit(2.5), spec), spec)) == pytest.approx(2.5)
    with pytest.raises(Exception):
        value(spark, data.transform(F.lit(0.0), spec))


def test_exact_split(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    out = data.split_exact(df, "k", 0.25, 3)
    assert out.where("chosen").count() == 250 and out.select("k").distinct().count() == 1000


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.5,), (-1.0,)], "x double")
    rows = diagnostics.histogram(df, F.col("x"), 0.0, 1.0, 2).orderBy("bin").collect()
    assert [(r.n, r.share) for r in rows] == [(1, 0.25), (1, 0.25)]


def test_series_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=500).cumsum() / 10
    s = spark.createDataFrame([(0, i + 1, float(v)) for i, v in enumerate(x)], "realization int, t long, value double")
    d = x - x.mean()
    got = {r.lag: r.covariance for r in diagnostics.autocovariance(s, 5).collect()}
    for lag in range(6):
        assert got[lag] == pytest.approx(np.mean(d[: len(d) - lag] * d[lag:]))
    assert got[0] == pytest.approx(diagnostics.series_moments(s).first().variance)


def test_likelihood_special_cases(spark):
    assert value(spark, likelihood.gaussian(F.lit(None).cast("double"), F.lit(0.0), F.lit(1.0))) == 0
    assert value(spark, likelihood.binary(F.lit(1.0), F.lit(-1000.0))) == pytest.approx(-1000)
    assert value(spark, likelihood.survival(F.lit(-2.0), F.lit(0.0))) == pytest.approx(-2)
    assert value(spark, likelihood.poisson(F.lit(-1.0), F.lit(0.0))) == pytest.approx(math.log(2) - 1)


def test_class_ties_take_the_lowest(spark):
    df = spark.createDataFrame([(1, 0.4, 0.4, 0.2)], "k int, a double, b double, c double")
    assert predict.predict_mode(df, ["k"], ["a", "b", "c"]).first().mode == 0


def test_log_prob_ignores_a_constant(spark):
    df = spark.createDataFrame([(1, -1.0, 0.5), (1, -3.0, 2.0)], "k int, l double, w double")
    a, b = (predict.predict_log_prob(df, ["k"], F.col("l"), F.col("w") * c).first().log_prob for c in (1.0, 1e6))
    assert a == pytest.approx(b)


def test_quantiles_by_position(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0)], "k int, m double, s double")
    r = predict.pooled_quantiles(df, ["k"], F.col("m"), F.col("s")).first()
    assert r.median == pytest.approx(0, abs=1e-9) and r.q10 == pytest.approx(-r.q90) and r.q10 == pytest.approx(N.quantile(10.5 / 101))


def test_gp_against_numpy(spark):
    rng = np.random.default_rng(1)
    x, t, z = rng.normal(size=(20, 2)), rng.normal(size=20), rng.normal(size=(5, 2))
    spec = G.Spec(constant=0.3, linear=[0.2, 0.1], parts=[(0.0, [1.0, 0.5], 2.0)], noise=0.2)
    test = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(z)], "k long, a double, b double")
    got = G.gp_predict(x, t, test, "k", ["a", "b"], [(1, spec)]).orderBy("k").collect()
    k, kk = spec.matrix(x, x) + 0.04 * np.eye(20), spec.matrix(z, x)
    want = kk @ np.linalg.solve(k, t)
    assert [r["mean"] for r in got] == pytest.approx(list(want))


def test_gp_variances_latent_values_and_noise_by_case(spark):
    rng = np.random.default_rng(2)
    x, t, z, f, v = rng.normal(size=(20, 2)), rng.normal(size=20), rng.normal(size=(5, 2)), rng.normal(size=20), rng.uniform(0.1, 1, 20)
    spec = G.Spec(constant=0.3, linear=[0.2, 0.1], parts=[(0.0, [1.0, 0.5], 2.0)], noise=0.2, jitter=0.3)
    test = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(z)], "k long, a double, b double")
    table = spark.createDataFrame([(idx, i, float(y)) for idx, own in ((2, f), (3, v)) for i, y in reversed(list(enumerate(own)))], "idx long, i long, y double")
    values, variances = (G.packed_by_draw(table.where(f"idx = {idx}"), "i", "y") for idx in (2, 3))
    got = {(r["idx"], r["k"]): r for r in G.gp_predict(x, t, test, "k", ["a", "b"], [(1, spec), (2, spec), (3, spec)], values, variances).collect()}
    kk, own = spec.matrix(z, x), np.diag(spec.matrix(z, z)) + 0.09
    for idx, noise, target in ((1, np.full(20, 0.04), t), (2, np.zeros(20), f), (3, v, t)):
        k = spec.matrix(x, x) + np.diag(0.09 + noise)
        assert [got[idx, i]["mean"] for i in range(5)] == pytest.approx(list(kk @ np.linalg.solve(k, target)))
        assert [got[idx, i]["variance"] for i in range(5)] == pytest.approx(list(own - (kk * np.linalg.solve(k, kk.T).T).sum(1)))


def test_chain_shaped_tree(spark):
    n = 9
    rows = [(1, -i, -(i - 1) if i > 1 else 0, i / 20) for i in range(1, n)] + [(1, i, -i, 1.0) for i in range(1, n)] + [(1, n, -(n - 1), 1.0)]
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, divt double")
    depth = {r.leaf: r.depth for r in tree.leaf_depths(tree.tour(nodes)).collect()}
    assert depth[n] == n - 1 and depth[1] == 1 and tree.invalid_trees(nodes).count() == 0
    assert tree.invalid_trees(nodes.where("node <> 3")).count() == 1


def test_relabel_is_stable(spark):
    a = spark.createDataFrame([("l", 1, i, c) for i, c in enumerate([5, 5, 2, 2, 9])], "log_id string, idx int, case_id int, comp int")
    names = {r.comp: r.new_comp for r in mixture.relabel(mixture.frequencies(a)).collect()}
    assert names == {2: 1, 5: 2, 9: 3}


def test_monitor_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 4.0)], "log_id string, idx long, value double")
    df.write.parquet(src)
    seen = []
    monitor(spark, src, df.schema, ["log_id"], "idx", "value", str(tmp_path / "cp"), lambda b, e: seen.append(b.collect())).awaitTermination()
    assert (seen[-1][0].n, seen[-1][0]["last"], seen[-1][0]["mean"]) == (2, 2, 3.0)


@pytest.mark.parametrize("name", ["s12_fit_transform", "d5_at_temperature", "a3_autocovariance", "p9_score", "m7_mixture_log_prob", "k4_energy", "c4_intensity_grid"])
def test_queries_against_sql(spark, sf_dir, name):
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    df = entry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    want = con.sql("SELECT " + ", ".join(f'"{c}"' for c in cols) + f" FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(str, want))


def test_special_functions_in_batches():
    x = np.r_[np.linspace(-4.3, 30, 200), 1e5]
    assert N.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-12) and np.isinf(N.log_gamma(np.array([0.0, -3.0]))).all()
    z = np.linspace(-7, 7, 201)
    assert N.cdf(z) == pytest.approx([0.5 * math.erfc(-v / math.sqrt(2)) for v in z], rel=1e-11)
    assert N.cdf(N.quantiles(np.array([1e-6, 0.3, 0.999]))) == pytest.approx([1e-6, 0.3, 0.999]) and np.isnan(N.quantiles(np.array([1.5]))[0])


def test_special_functions_keep_nulls(spark):
    df = spark.createDataFrame([(0.5,), (None,), (2.0,)], "p double")
    assert [r.v for r in df.select(N.normal_quantile(F.col("p")).alias("v")).collect()] == [pytest.approx(0, abs=1e-12), None, None]
    assert [r.v for r in df.select(N.lgamma(F.col("p")).alias("v")).collect()] == pytest.approx([math.lgamma(0.5), None, 0.0])


def test_pairs_in_blocks(spark):
    left, right = spark.range(7).withColumnRenamed("id", "a"), spark.range(30).withColumnRenamed("id", "b")
    want = sorted((a, b) for a in range(7) for b in range(30))
    for most in (100, 4):
        assert sorted(map(tuple, pairing.paired(left, right, most=most).collect())) == want
        assert pairing.paired(left, right, F.col("a") == F.col("b"), most).count() == 7


def test_numbered_keeps_order(spark):
    df = spark.range(1000, numPartitions=7).select((F.col("id") * 3).alias("k")).where("k % 4 > 0")
    rows = tables.numbered(df).orderBy("k").collect()
    assert [r.row_id for r in rows] == list(range(1, len(rows) + 1)) and tables.numbered(df.limit(0)).count() == 0


def test_unknown_quantities_and_counts(spark):
    q = spark.createDataFrame([("a", 1, "w", 1, 2.0), ("a", 1, "w", 2, 3.0), ("a", 1, "v", 1, 5.0)], "log_id string, idx long, quantity string, pos int, value double")
    for text in ("z", "w@1:3", "wz"):
        with pytest.raises(ValueError):
            diagnostics.quantity_table(q, text)
    w, v = q.where("quantity = 'w'"), q.where("quantity = 'v'")
    assert sorted((r.x, r.y) for r in diagnostics.quantity_pairs(w, v).collect()) == [(2.0, 5.0), (3.0, 5.0)]
    three = v.unionByName(v.withColumn("pos", F.lit(2))).unionByName(v.withColumn("pos", F.lit(3)))
    with pytest.raises(Exception, match="numbers of values differ"):
        diagnostics.quantity_pairs(w, three).collect()


def test_run_quantities_by_modifier(spark):
    c = {"log_weight": F.lit(-7.0), "delta": F.lit(2000.0), "consecutive_accepts": F.lit(-4), "proposals": F.lit(0), "rejects": F.lit(0)}
    got = [value(spark, draws.run_quantity(*a)) for a in (("Q", c), ("Q", c, 0), ("Q", c, 5), ("D", c), ("C", c, 0), ("C", c, 1), ("C", c, 2), ("r", c))]
    assert got == pytest.approx([math.exp(-7), -7, -5, 1000, 0, 4, 4 * 2 * (1 - math.exp(-1.2 - 4)), None])


def test_append_and_copy_ranges(spark):
    t = spark.createDataFrame([(3, 1.0), (9, 2.0)], "idx long, value double")
    s = spark.createDataFrame([(2, 5.0), (4, 6.0), (8, 7.0)], "idx long, value double")
    assert sorted(map(tuple, draws.append_draws(t, s, "3:8").collect())) == [(3, 1.0), (9, 2.0), (10, 6.0), (11, 7.0)]
    assert sorted(map(tuple, draws.append_draws(t, s, at_last=True).collect())) == [(3, 1.0), (9, 2.0), (9, 5.0), (10, 6.0), (11, 7.0)]
    r = spark.createDataFrame([(-1, "S", 0.0), (2, "q", 1.0), (4, "b", 2.0), (6, "q", 3.0)], "idx long, type string, value double")
    assert sorted(r.idx for r in draws.copy_draws(r, 5, 10, ("b",), "2:6%2").collect()) == [-1, 5, 15]


def test_new_component_is_never_lost(spark):
    weight = spark.createDataFrame([("m", 1, 1, 0.75), ("m", 1, 0, 0.25)], "log_id string, idx long, comp long, weight double")
    known = spark.createDataFrame([(7, "m", 1, 1, -1.0)], "case_id long, log_id string, idx long, comp long, log_density double")
    with pytest.raises(ValueError):
        mixture.mixture_log_prob(known, weight)
    assert mixture.mixture_log_prob(known, weight, new=known.withColumn("comp", F.lit(0).cast("long"))).first().log_prob == pytest.approx(-1)
    cases = spark.createDataFrame([(7, 0, 1.0), (7, 1, None)], "case_id long, target int, t double")
    hypers = spark.createDataFrame([("m", 1, 0, 0.0, 1.0, 1.0), ("m", 1, 1, 0.0, 1.0, 1.0)], "log_id string, idx long, target int, mean double, sd double, noise double")
    got = mixture.new_component_log_density(cases, hypers, points=2000).first().log_density
    assert got == pytest.approx(-0.25 - 0.5 * math.log(4 * math.pi), abs=2e-3)


def test_new_component_averages_its_noise(spark):
    """The exact average over the noise's prior is what very many random noises give; alpha 0 or null is a fixed noise."""
    cases = spark.createDataFrame([(7, 0, 1.3)], "case_id long, target int, t double")
    hypers = spark.createDataFrame([("m", i, 0, 0.2, 0.7, 0.9, a) for i, a in enumerate((0.0, None, 3.0))], "log_id string, idx long, target int, mean double, sd double, noise double, alpha double")
    got = {r.idx: r.log_density for r in mixture.new_component_log_density(cases, hypers, points=2000).collect()}
    rng = np.random.default_rng(0)
    sd = 0.9 / np.sqrt(rng.gamma(1.5, 1 / 1.5, 400_000))
    want = np.log(np.mean(np.exp(-((1.3 - rng.normal(0.2, 0.7, 400_000)) ** 2) / (2 * sd * sd)) / (sd * math.sqrt(2 * math.pi))))
    assert got[2] == pytest.approx(want, abs=5e-3) and got[0] == got[1] != pytest.approx(got[2], abs=5e-3)


def test_array_log_sum_exp_builds_its_array_once(spark):
    """Time grows with the array, not with its square."""
    import time

    took = []
    for n in (300, 3000):
        values = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.sin(i + F.col("id")))
        df = spark.range(2000).select(N.array_log_sum_exp(values).alias("v"))
        start = time.time()
        total = df.agg(F.sum("v")).first()[0]
        took.append(time.time() - start)
    assert took[1] < 40 * max(took[0], 0.2)
    want = sum(np.log(np.exp(np.sin(np.arange(1, 3001) + i)).sum()) for i in range(2000))
    assert total == pytest.approx(want)


def test_draw_weights_count(spark):
    weight = spark.createDataFrame([("m", 1, 1, 1.0), ("m", 2, 1, 1.0)], "log_id string, idx long, comp long, weight double")
    density = spark.createDataFrame([(7, "m", 1, 1, 0.0), (7, "m", 2, 1, math.log(3.0))], "case_id long, log_id string, idx long, comp long, log_density double")
    w = spark.createDataFrame([("m", 1, 3.0), ("m", 2, 1.0)], "log_id string, idx long, w double")
    assert mixture.mixture_log_prob(density, weight, w).first().log_prob == pytest.approx(math.log(6 / 4))


def test_plume_is_downwind_of_the_source(spark):
    flow = fields.Flow(0.2, 0.1, 0.3, 0.05)
    assert value(spark, fields.plume(F.lit(-1.0), F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(2.0), flow)) == 0
    sy, sz = 0.2 * 3 / math.sqrt(1.3), 0.3 * 3 / math.sqrt(1.15)
    n = lambda v: math.exp(-v * v / 2) / math.sqrt(2 * math.pi)
    want = n(0.5 / sy) / sy * (n(0.4 / sz) + n(1.6 / sz)) / sz / 2
    assert value(spark, fields.plume(F.lit(3.0), F.lit(0.5), F.lit(1.0), F.lit(0.6), F.lit(2.0), flow)) == pytest.approx(want)
    assert [value(spark, fields.active(F.lit(2.0), F.lit(2.0), F.lit(t), F.lit(1.0), F.lit(3.0))) for t in (1.9, 2.0, 4.0, 4.1)] == [False, True, True, False]


def test_receptors_without_source_get_zero(spark):
    src = spark.createDataFrame([("a", 1, 0.0, 0.0, 1.0, 4.0, 2.0)], "log_id string, idx long, x double, y double, z double, q double, u double")
    rec = spark.createDataFrame([(1, -2.0, 0.0, 1.0), (2, 5.0, 0.0, 1.0)], "receptor long, x double, y double, z double")
    none = spark.createDataFrame([("a", 1), ("a", 2)], "log_id string, idx long")
    got = {(r.idx, r.receptor): r.total for r in fields.receptor_total(src, rec, fields.Flow(), draws=none).collect()}
    assert got[1, 1] > 0 and got[1, 2] == got[2, 1] == got[2, 2] == 0


def test_replicates_do_not_depend_on_partitions(spark):
    df = spark.range(4000)
    column = {k: likelihood.replicate(k, F.col("id"), "s", F.array(F.lit(0.0), F.lit(math.log(3.0))) if k == "class" else F.lit(1.0), F.lit(0.5), 5.0).alias(k) for k in ("gaussian", "t", "binary", "class", "count", "survival")}
    a, b = (sorted(map(tuple, df.repartition(n).select("id", *column.values()).collect())) for n in (1, 7))
    assert a == b
    mean = dict(zip(column, np.mean([r[1:] for r in a], axis=0)))
    for kind, want in {"gaussian": 1, "t": 1, "binary": 1 / (1 + math.exp(-1)), "class": 0.75, "count": math.e, "survival": math.exp(-1)}.items():
        assert mean[kind] == pytest.approx(want, abs=0.08), kind


def test_quantiles_refuse_weights(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0, 1.0), (1, 1.0, 1.0, 2.0)], "k int, m double, s double, w double")
    with pytest.raises(ValueError):
        predict.pooled_quantiles(df, ["k"], F.col("m"), F.col("s"), w=F.col("w"))
    assert predict.pooled_quantiles(df, ["k"], F.col("m"), F.col("s"), w=F.lit(1.0)).count() == 1


def test_network_gradient_against_differences(spark):
    rng = np.random.default_rng(2)
    x, t = rng.normal(size=(40, 2)), rng.normal(size=40)
    df = spark.createDataFrame([(float(a), float(b), float(c), i % 4 == 0) for i, ((a, b), c) in enumerate(zip(x, t))], "a double, b double, t double, v boolean")
    start = {"ih": [rng.normal(size=(2, 3))], "bh": [rng.normal(size=3)], "ho": [rng.normal(size=(3, 1))], "io": rng.normal(size=(2, 1)), "bo": rng.normal(size=1)}
    net = network.Network(["tanh"])
    trace = network.network_fit(df, ["a", "b"], "t", start, net, steps=3, step=0.5, validation="v")
    train = np.arange(40) % 4 > 0
    loss = lambda p: ((net.output(x[train], p)[:, 0] - t[train]) ** 2).sum() / 2
    assert trace[0][1] == pytest.approx(2 * loss(start) / 30) and trace[0][2] == pytest.approx(np.mean((net.output(x[~train], start)[:, 0] - t[~train]) ** 2))
    for name, at in (("ih", (1, 2)), ("bh", (0,)), ("ho", (2, 0)), ("io", (0, 0)), ("bo", (0,))):
        own = lambda p: p[name][0] if name in ("ih", "bh", "ho") else p[name]
        ends = []
        for h in (1e-5, -1e-5):
            p = {k: [v[0].copy()] if isinstance(v, list) else v.copy() for k, v in start.items()}
            own(p)[at] += h
            ends.append(loss(p))
        moved = (own(start)[at] - own(trace[1][3])[at]) / (0.5 / 31)
        assert moved == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-5)
    assert network.early_stop(trace)[2] == min(r[2] for r in trace)


def test_leading_spectrum_against_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "i long, a double, b double")
    spec = G.Spec(constant=0.3, linear=[0.2, 0.1], parts=[(0.0, [1.0, 0.5], 2.0)], noise=0.2)
    want, vectors = np.linalg.eigh(spec.matrix(x, x) + 0.04 * np.eye(60))
    got = G.leading_spectrum(df, ["a", "b"], "i", spec, 4).orderBy("rank").collect()
    assert [r.eigenvalue for r in got] == pytest.approx(list(want[::-1][:4]), rel=1e-6)
    assert abs(np.dot(got[0].vector, vectors[:, -1])) == pytest.approx(1, abs=1e-5)


def test_covariance_column_and_matrix_agree(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(6, 3)), 1)
    spec = G.Spec(constant=0.3, linear=[0.2, 0.1, 0.4], spread=1, spreads=frozenset({1}), omit=frozenset({0}), parts=[G.Part(0.1, [1.0, 0.5, 0.2], 1.5, delta=frozenset({2}), omit=frozenset({0})), G.Part(0.0, [0.3, 0.3, 0.3], 2.0, times=frozenset({0, 2}))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i long, a double, b double, c double")
    got = {(r.i, r.j): r.c for r in G.covariance(df, df.withColumnRenamed("i", "j"), ["a", "b", "c"], spec).collect()}
    want = spec.matrix(x, x)
    assert all(got[i, j] == pytest.approx(want[i, j]) for i in range(6) for j in range(6))
    assert spec.diagonal(x) == pytest.approx(np.diag(want))


def test_pieces_take_their_hazard_inputs(spark):
    df = spark.createDataFrame([(1, 3.0), (2, -0.5)], "case_id long, t double")
    rows = likelihood.survival_pieces(df, [0.5, 2.0, 2.5], log_time=True).orderBy("case_id", "piece").collect()
    assert [r.time_input for r in rows] == pytest.approx([math.log(0.5), 0.0, (math.log(2) + math.log(2.5)) / 2, math.log(2.5), math.log(0.5)])
    assert [r.exposure for r in rows] == pytest.approx([0.5, 1.5, 0.5, 0.5, 0.5]) and [r.event for r in rows] == [False, False, False, True, False]


def test_files_are_read_in_order_of_name(spark, tmp_path):
    for name, n in (("b", 3), ("a", 2), ("c", 400)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{ord(name)} {i}\n" for i in range(n)))
    rows = tables.read_numeric(spark, str(tmp_path), [1, 2]).orderBy("row_id").collect()
    assert [(r.row_id, r.i1, r.i2) for r in rows] == [(k + 1, float(ord(n)), float(i)) for k, (n, i) in enumerate([*(("a", i) for i in range(2)), *(("b", i) for i in range(3)), *(("c", i) for i in range(400))])]


def test_draws_in_blocks_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(7)
    made = [("a", i, {"ih": [rng.normal(size=(2, 3))], "ho": [rng.normal(size=(3, 1))], "bo": rng.normal(size=1)}) for i in range(5)]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(30, 2)))], "k long, a double, b double")
    net = network.Network(["tanh"])
    results = lambda: [sorted(map(tuple, x.collect())) for x in (predict.net_forward(df, "k", ["a", "b"], made, net), predict.hidden_spread(df, ["a", "b"], made, net), predict.difference_variance(df, ["a", "b"], "a", [0.5], made, net))]
    whole = results()
    monkeypatch.setattr(predict, "BLOCK_BYTES", 200)
    assert len(predict.draw_blocks(made)) == 3 and results() == whole
