"""Queries of likelihoods, prediction and covariance functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from drawlake.functions.numeric import stratified_normal
from drawlake.operators import covariance as G
from drawlake.operators import data
from drawlake.operators import likelihood as L
from drawlake.operators import network as N
from drawlake.operators import predict as P
from drawlake.operators.pairing import dealt
from drawlake.plans.base import CASES, DRAWS, NETS, PAIRS, cases, draws, nets, pairs, query, rounded, table

_GAUSS = "(-pow((t - o) / sd, 2) / 2 - ln(sd) - 0.5 * ln(2 * pi()))"


def _sum(spark, d, value):
    return rounded(pairs(spark, d).groupBy("case_id").agg(F.sum(value).alias("log_prob")))


@query(f"SELECT case_id, round(sum({_GAUSS}), 6) AS log_prob FROM {PAIRS} GROUP BY case_id")
def l1_gaussian(spark, d):
    return _sum(spark, d, L.gaussian(F.col("t"), F.col("o"), F.col("sd")))


@query(f"SELECT case_id, round(sum(lgamma(2.5) - lgamma(2) - 0.5 * ln(4 * pi()) - ln(sd) - 2.5 * ln(1 + pow((t - o) / sd, 2) / 4)), 6) AS log_prob FROM {PAIRS} GROUP BY case_id")
def l2_student(spark, d):
    return _sum(spark, d, L.student(F.col("t"), F.col("o"), F.col("sd"), 4.0))


@query(f"SELECT case_id, round(sum(-ln(1 + exp(CASE WHEN b = 1 THEN -o ELSE o END))), 6) AS log_prob FROM {PAIRS} GROUP BY case_id")
def l3_binary(spark, d):
    return _sum(spark, d, L.binary(F.col("b"), F.col("o")))


@query(f"SELECT case_id, round(sum(CASE CAST(case_id % 3 AS INTEGER) WHEN 0 THEN o WHEN 1 THEN x2 ELSE sd END - ln(exp(o) + exp(x2) + exp(sd))), 6) AS log_prob FROM {PAIRS} GROUP BY case_id")
def l4_softmax(spark, d):
    return _sum(spark, d, L.softmax(F.col("case_id") % 3, F.array("o", "x2", "sd")))


@query(f"SELECT case_id, idx, round(CASE WHEN case_id % 4 = 0 THEN (SELECT ln(sum(exp(k * o / 4 - exp(o / 4) - lgamma(k + 1)))) FROM range(CAST(case_id % 5 + 1 AS BIGINT)) r(k)) ELSE (case_id % 5) * o / 4 - exp(o / 4) - lgamma(case_id % 5 + 1) END, 6) AS log_prob FROM {PAIRS} WHERE NOT (case_id % 4 = 0 AND case_id % 5 = 0)")
def l5_poisson(spark, d):
    k = F.col("case_id")
    t = F.when(k % 4 == 0, -(k % 5)).otherwise(k % 5).cast("double")
    return rounded(pairs(spark, d).where("not (case_id % 4 = 0 and case_id % 5 = 0)").select("case_id", "idx", L.poisson(t, F.col("o") / 4).alias("log_prob")))


_SURV = "(SELECT *, CASE WHEN case_id % 4 = 0 THEN -1 ELSE 1 END * (0.1 + (case_id % 23) / 10.0) AS s FROM " + PAIRS + ")"


def _surv(spark, d, rows):
    k = F.col("case_id")
    return rows.withColumn("t", F.when(k % 4 == 0, -1).otherwise(1) * (0.1 + (k % 23) / 10.0))


@query(f"SELECT case_id, round(sum(CASE WHEN s < 0 THEN s * exp(o / 4) ELSE o / 4 - s * exp(o / 4) END), 6) AS log_prob FROM {_SURV} GROUP BY case_id")
def l6_survival(spark, d):
    return rounded(_surv(spark, d, pairs(spark, d)).groupBy("case_id").agg(F.sum(L.survival(F.col("t"), F.col("o") / 4)).alias("log_prob")))


@query(f"""WITH b(piece, start, stop, inp) AS (VALUES (0, 0.0, 0.5, 0.5), (1, 0.5, 1.0, 0.75), (2, 1.0, 1e30, 1.0)),
c AS (SELECT case_id, x1, CASE WHEN case_id % 4 = 0 THEN -1 ELSE 1 END * (0.1 + (case_id % 23) / 10.0) AS t FROM {CASES})
SELECT case_id, round(sum(CASE WHEN abs(t) <= stop AND t >= 0 THEN x1 / 10 + inp ELSE 0 END - (least(abs(t), stop) - start) * exp(x1 / 10 + inp)), 6) AS log_prob, count(*) AS pieces
FROM c JOIN b ON abs(t) > start GROUP BY case_id""")
def l7_survival_pieces(spark, d):
    rows = L.survival_pieces(_surv(spark, d, cases(spark, d).select("case_id", "x1")), [0.5, 1.0])
    h = F.col("x1") / 10 + F.col("time_input")
    return rounded(rows.groupBy("case_id").agg(F.sum(F.when(F.col("event"), h).otherwise(0.0) - F.col("exposure") * F.exp(h)).alias("log_prob"), F.count("*").alias("pieces")))


@query(f"SELECT case_id, [round(ln(exp(x1) + exp(x2)), 6), round(ln(exp(t) + exp(b)), 6)] AS outputs FROM {CASES}")
def l8_joined_outputs(spark, d):
    return cases(spark, d).select("case_id", F.transform(L.joined_outputs(F.array("x1", "x2", "t", "b"), 2), lambda x: F.round(x, 6)).alias("outputs"))


@query(f"SELECT case_id, round(1 / exp(x1 / 5), 6) AS mean, round(ln(2) / exp(x1 / 5), 6) AS median, round(CASE WHEN ln(2) / exp(x1 / 5) <= 0.5 THEN ln(2) / exp(x1 / 5) ELSE 0.5 + (ln(2) - 0.5 * exp(x1 / 5)) / exp(x2) END, 6) AS pieces, round(1 / exp(x1 / 5) + exp(-0.5 * exp(x1 / 5)) * (1 / exp(x2) - 1 / exp(x1 / 5)), 6) AS pieces_mean FROM {CASES}")
def l9_survival_guess(spark, d):
    g = L.survival_guess(F.col("x1") / 5)
    two = L.piecewise_median(F.array(F.exp(F.col("x1") / 5), F.exp("x2")), [0.5])
    mean = L.piecewise_mean(F.array(F.exp(F.col("x1") / 5), F.exp("x2")), [0.5])
    return rounded(cases(spark, d).select("case_id", g["mean"].alias("mean"), g["median"].alias("median"), two.alias("pieces"), mean.alias("pieces_mean")))


def _uniform(seed):
    """The SQL of ``L.uniform`` of the case."""
    return f"((CAST('0x' || substr(md5(case_id || ':{seed}'), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0)"


@query(f"""SELECT case_id, round(x1 + 0.5 * sqrt(-2 * ln({_uniform('au')})) * cos(2 * pi() * {_uniform('av')}), 6) AS real,
round(x1 + 0.5 * sqrt(4 * (pow({_uniform('bu')}, -0.5) - 1)) * cos(2 * pi() * {_uniform('bv')}), 6) AS heavy,
CAST({_uniform('cu')} < 1 / (1 + exp(-x1)) AS DOUBLE) AS bin,
CAST(CASE WHEN exp(x1) / (exp(x1) + exp(x2) + exp(t)) > {_uniform('du')} THEN 0 WHEN (exp(x1) + exp(x2)) / (exp(x1) + exp(x2) + exp(t)) > {_uniform('du')} THEN 1 ELSE 2 END AS DOUBLE) AS class,
round(-ln({_uniform('eu')}) / exp(x2), 6) AS surv,
CAST((SELECT min(k) FROM (SELECT k, sum(exp(k * x2 - exp(x2) - lgamma(k + 1))) OVER (ORDER BY k) AS upto FROM range(60) r(k)) WHERE upto >= {_uniform('fu')}) AS DOUBLE) AS count FROM {CASES}""")
def l10_replicate(spark, d):
    k, x1, x2 = F.col("case_id"), F.col("x1"), F.col("x2")
    kinds = {"real": ("gaussian", "a", x1, F.lit(0.5)), "heavy": ("t", "b", x1, F.lit(0.5), 4.0), "bin": ("binary", "c", x1), "class": ("class", "d", F.array("x1", "x2", "t")), "surv": ("survival", "e", x2), "count": ("count", "f", x2)}
    return rounded(cases(spark, d).select("case_id", *[L.replicate(kind, k, *rest).alias(name) for name, (kind, *rest) in kinds.items()]))


_NET_SQL = f"SELECT case_id, 'n' AS log_id, idx, CAST(0 AS INTEGER) AS j, round(bias + w1 * tanh(w1 * x1 + w2 * x2 + 0.1) + w2 * tanh(0.5 * x1 - w1 * x2 - 0.2) + 0.3 * x2, 6) AS o FROM {CASES} CROSS JOIN {NETS}"


def _draws(spark, d):
    out = []
    for r in nets(spark, d).orderBy("idx").collect():  # nations: a fixed number of rows
        out.append((r.log_id, r.idx, {"ih": [np.array([[r.w1, 0.5], [r.w2, -r.w1]])], "bh": [np.array([0.1, -0.2])], "ho": [np.array([[r.w1], [r.w2]])], "io": np.array([[0.0], [0.3]]), "bo": np.array([r.bias])}))
    return out


@query(_NET_SQL)
def p1_net_forward(spark, d):
    return rounded(P.net_forward(cases(spark, d), "case_id", ["x1", "x2"], _draws(spark, d), N.Network(["tanh"])))


# two layers with offsets; the first layer omits the second input, the outputs the first one
@query(f"""WITH a AS (SELECT *, tanh(w1 * (x1 + 0.1) + 0.05) + 0.3 AS h FROM {CASES} CROSS JOIN {NETS})
SELECT case_id, 'n' AS log_id, idx, CAST(0 AS INTEGER) AS j, round(bias + 0.3 * (x2 - 0.2) + w2 * h + 0.5 * sqrt(2) * sin(sqrt(2) * (0.2 * (x1 + 0.1) + w2 * (x2 - 0.2) + w1 * h)), 6) AS o FROM a""")
def p1_offsets_omit(spark, d):
    draws = [(r.log_id, r.idx, {"ti": np.array([0.1, -0.2]), "th": [np.array([0.3]), None], "ih": [np.array([[r.w1], [9.0]]), np.array([[0.2], [r.w2]])], "hh": [np.array([[r.w1]])], "bh": [np.array([0.05]), None], "ho": [np.array([[r.w2]]), np.array([[0.5]])], "io": np.array([[9.0], [0.3]]), "bo": np.array([r.bias])}) for r in nets(spark, d).orderBy("idx").collect()]  # nations: a fixed number of rows
    return rounded(P.net_forward(cases(spark, d), "case_id", ["x1", "x2"], draws, N.Network(["tanh", "sin"], omit={0: [1], -1: [0]})))


@query(f"SELECT case_id, 'n' AS log_id, idx, CAST(0 AS INTEGER) AS j, round(w1 * tanh(w1 * x1 + w2 * x2 + 0.1) + w2 * tanh(0.5 * x1 - w1 * x2 - 0.2), 6) AS o FROM {CASES} CROSS JOIN {NETS}")
def p2_net_components(spark, d):
    return rounded(P.net_forward(cases(spark, d), "case_id", ["x1", "x2"], _draws(spark, d), N.Network(["tanh"], keep={0})))


@query(f"SELECT case_id, round(sum(w / (1 + exp(-o))) / sum(w), 6) AS mean FROM {PAIRS} GROUP BY case_id")
def p3_model_guess(spark, d):
    return rounded(P.predict_mean(pairs(spark, d), ["case_id"], 1 / (1 + F.exp(-F.col("o"))), F.col("w")))


@query(f"SELECT case_id, round(sum(w * o) / sum(w), 6) AS mean FROM {PAIRS} GROUP BY case_id")
def p4_predict_mean(spark, d):
    return rounded(P.predict_mean(pairs(spark, d), ["case_id"], F.col("o"), F.col("w")))


# evaluation of networks and reduction in one pass
@query(f"""WITH o AS (SELECT case_id, t, sd, exp(log_weight - 2.4) AS w, bias + w1 * tanh(w1 * x1 + w2 * x2 + 0.1) + w2 * tanh(0.5 * x1 - w1 * x2 - 0.2) + 0.3 * x2 AS y FROM {CASES} CROSS JOIN {NETS})
SELECT case_id, CAST(0 AS INTEGER) AS j, round(sum(w * y) / sum(w), 6) AS mean, round(ln(sum(w * exp(-pow((t - y) / sd, 2) / 2) / (sd * sqrt(2 * pi()))) / sum(w)), 6) AS log_prob FROM o GROUP BY case_id""")
def p5_net_predict(spark, d):
    few = nets(spark, d).orderBy("idx").collect()  # nations: a fixed number of rows
    out = P.net_predict(cases(spark, d), "case_id", ["x1", "x2"], _draws(spark, d), N.Network(["tanh"]), [r.log_weight for r in few], ["t"], [r.sd for r in few])
    return rounded(out)


_LP = f"(SELECT case_id, ln(sum(w * exp({_GAUSS})) / sum(w)) AS log_prob FROM {PAIRS} GROUP BY case_id)"


def _log_prob(spark, d):
    return P.predict_log_prob(pairs(spark, d), ["case_id"], L.gaussian(F.col("t"), F.col("o"), F.col("sd")), F.col("w"))


@query(f"SELECT case_id, round(log_prob, 6) AS log_prob FROM {_LP}")
def p5_predict_log_prob(spark, d):
    return rounded(_log_prob(spark, d))


@query(f"WITH m AS (SELECT case_id, avg(exp(o) / (exp(o) + exp(x2) + exp(sd))) AS a, avg(exp(x2) / (exp(o) + exp(x2) + exp(sd))) AS b FROM {PAIRS} GROUP BY case_id) SELECT case_id, round(a, 6) AS a, round(b, 6) AS b, CAST(CASE WHEN a >= b AND a >= 1 - a - b THEN 0 WHEN b >= 1 - a - b THEN 1 ELSE 2 END AS INTEGER) AS mode FROM m")
def p6_predict_mode(spark, d):
    s = F.exp("o") + F.exp("x2") + F.exp("sd")
    means = pairs(spark, d).groupBy("case_id").agg(F.avg(F.exp("o") / s).alias("a"), F.avg(F.exp("x2") / s).alias("b"))
    return rounded(P.predict_mode(means.withColumn("c", 1 - F.col("a") - F.col("b")), ["case_id"], ["a", "b", "c"]).drop("c"))


@query(f"WITH m AS (SELECT case_id, any_value(b) AS b, sum(w / (1 + exp(-o))) / sum(w) AS p FROM {PAIRS} GROUP BY case_id) SELECT case_id, round(p, 6) AS p, CAST(p > 0.5 AS INTEGER) AS mode, CAST((p > 0.5) <> (b = 1) AS INTEGER) AS wrong FROM m")
def p6_binary_mode(spark, d):
    p = P.predict_mean(pairs(spark, d), ["case_id"], 1 / (1 + F.exp(-F.col("o"))), F.col("w")).join(cases(spark, d).select("case_id", "b"), "case_id")
    return rounded(p.select("case_id", F.col("mean").alias("p"), *[c.alias(n) for n, c in P.binary_mode(F.col("mean"), F.col("b")).items()]))


_Z101 = ", ".join(map(repr, stratified_normal(101)))


@query(f"WITH v AS (SELECT case_id, list_sort(flatten(list([o + sd * z for z in [{_Z101}]]))) AS v FROM {PAIRS} GROUP BY case_id) SELECT case_id, round((list_extract(v, len(v) // 2 + 1) + list_extract(v, (len(v) - 1) // 2 + 1)) / 2, 6) AS median, " + ", ".join(f"round(list_extract(v, CAST(floor(0.5 + {f} * len(v)) AS BIGINT) + 1), 6) AS q{a}, round(list_extract(v, len(v) - CAST(floor(0.5 + {f} * len(v)) AS BIGINT)), 6) AS q{b}" for f, a, b in ((0.1, 10, 90), (0.01, "01", 99))) + " FROM v")
def p7_median_quantiles(spark, d):
    return rounded(P.pooled_quantiles(pairs(spark, d), ["case_id"], F.col("o"), F.col("sd")))


@query(f"WITH v AS (SELECT log_id, v, row_number() OVER (PARTITION BY log_id ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY log_id) AS n FROM (SELECT log_id, value + (0.05 + (idx % 11) / 50.0) * unnest([{_Z101}]) AS v FROM {DRAWS})) SELECT log_id, round((max(v) FILTER (r = n // 2) + max(v) FILTER (r = (n - 1) // 2)) / 2, 6) AS median, " + ", ".join(f"round(max(v) FILTER (r = floor(0.5 + {f} * n)), 6) AS q{a}, round(max(v) FILTER (r = n - 1 - floor(0.5 + {f} * n)), 6) AS q{b}" for f, a, b in ((0.1, 10, 90), (0.01, "01", 99))) + " FROM v GROUP BY log_id")
def p7_selected_quantiles(spark, d):
    """Each log's draws pooled: all orders in four groups, so the places are found by counts."""
    return rounded(P.pooled_quantiles(draws(spark, d), ["log_id"], F.col("value"), 0.05 + (F.col("idx") % 11) / 50.0))


@query(f"SELECT case_id, round(sum(w * exp(o / 5)) / sum(w), 6) AS mean_of_medians FROM {PAIRS} GROUP BY case_id")
def p8_mean_of_medians(spark, d):
    return rounded(P.mean_of_medians(pairs(spark, d), ["case_id"], F.exp(F.col("o") / 5), F.col("w")))


def _score_sql(*names):
    return "count(*) AS n, " + ", ".join(f"round(avg({x}), 6) AS {n}, round(sqrt((avg({x} * {x}) - pow(avg({x}), 2)) / (count({x}) - 1)), 6) AS {n}_se" for n, x in names)


@query(f"WITH m AS (SELECT case_id, any_value(t) AS t, sum(w * o) / sum(w) AS m FROM {PAIRS} GROUP BY case_id) SELECT {_score_sql(('log_prob', 'log_prob'), ('squared', 'pow(t - m, 2)'), ('absolute', 'abs(t - m)'))} FROM m JOIN {_LP} USING (case_id)")
def p9_score(spark, d):
    rows = pairs(spark, d)
    both = P.predict_mean(rows, ["case_id"], F.col("o"), F.col("w")).join(_log_prob(spark, d), "case_id").join(cases(spark, d).select("case_id", "t"), "case_id")
    e = F.col("t") - F.col("mean")
    return rounded(P.score(both, {"log_prob": F.col("log_prob"), "squared": e * e, "absolute": F.abs(e)}))


@query(f"""WITH m AS (SELECT case_id, avg(exp(o) / (exp(o) + exp(x2) + exp(sd))) AS a, avg(exp(x2) / (exp(o) + exp(x2) + exp(sd))) AS b, avg(exp(sd) / (exp(o) + exp(x2) + exp(sd))) AS c FROM {PAIRS} GROUP BY case_id),
e AS (SELECT CAST((CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END) <> case_id % 3 AS DOUBLE) AS wr, pow(a - CAST(case_id % 3 = 0 AS DOUBLE), 2) + pow(b - CAST(case_id % 3 = 1 AS DOUBLE), 2) + pow(c - CAST(case_id % 3 = 2 AS DOUBLE), 2) AS sq, ln(CASE case_id % 3 WHEN 0 THEN a WHEN 1 THEN b ELSE c END) AS lp FROM m)
SELECT {_score_sql(('wrong', 'wr'), ('squared', 'sq'), ('log_prob', 'lp'))} FROM e""")
def p9_class_score(spark, d):
    s = F.exp("o") + F.exp("x2") + F.exp("sd")
    means = pairs(spark, d).groupBy("case_id").agg(F.avg(F.exp("o") / s).alias("a"), F.avg(F.exp("x2") / s).alias("b"), F.avg(F.exp("sd") / s).alias("c"))
    return rounded(P.score(means, P.class_scores([F.col("a"), F.col("b"), F.col("c")], F.col("case_id") % 3)))


@query(f"""WITH m AS (SELECT case_id, any_value(t) AS t0, any_value(b) AS t1, sum(w * o) / sum(w) AS m0, sum(w / (1 + exp(-o))) / sum(w) AS m1 FROM {PAIRS} GROUP BY case_id),
e AS (SELECT case_id, 0 AS j, t0 - m0 AS e FROM m UNION ALL SELECT case_id, 1, t1 - m1 FROM m), s AS (SELECT j, e * e AS sq, abs(e) AS ab FROM e UNION ALL SELECT NULL, sum(e * e), sum(abs(e)) FROM e GROUP BY case_id)
SELECT CAST(j AS INTEGER) AS j, {_score_sql(('squared', 'sq'), ('absolute', 'ab'))} FROM s GROUP BY j""")
def p9_target_scores(spark, d):
    rows = pairs(spark, d)
    w = F.col("w")
    means = rows.groupBy("case_id").agg(F.first("t").alias("t0"), F.first("b").alias("t1"), (F.sum(w * F.col("o")) / F.sum(w)).alias("m0"), (F.sum(w / (1 + F.exp(-F.col("o")))) / F.sum(w)).alias("m1"))
    each = means.select("case_id", F.posexplode(F.array(F.col("t0") - F.col("m0"), F.col("t1") - F.col("m1"))).alias("j", "e"))
    return rounded(P.target_scores(each, F.col("e")))


@query(f"WITH m AS (SELECT case_id, sum(w / (1 + exp(-o))) / sum(w) AS p FROM {PAIRS} GROUP BY case_id) SELECT {_score_sql(('log_prob', '(p * ln(p) + (1 - p) * ln(1 - p))'), ('wrong', 'least(p, 1 - p)'), ('squared', '(p * (1 - p))'))} FROM m")
def p10_expected_score(spark, d):
    p = P.predict_mean(pairs(spark, d), ["case_id"], 1 / (1 + F.exp(-F.col("o"))), F.col("w"))
    return rounded(P.score(p, P.expected_binary_scores(F.col("mean"))))


@query(f"SELECT case_id, round(avg(exp(o / 5 + 0.1 + sd * sd / 50)), 6) AS raw, round(avg({_GAUSS} + ln(5) - (o / 5 + 0.1)), 6) AS log_prob FROM {PAIRS} GROUP BY case_id")
def p11_raw_scale(spark, d):
    spec = (True, -0.1, 5.0)
    return rounded(pairs(spark, d).groupBy("case_id").agg(F.avg(P.raw_scale(F.col("o"), F.col("sd") * F.col("sd"), spec)).alias("raw"), F.avg(P.raw_log_prob(L.gaussian(F.col("t"), F.col("o"), F.col("sd")), F.exp(F.col("o") / 5 + 0.1), spec)).alias("log_prob")))


_GRID = "(SELECT i * (n + 1) + j + 1 AS case_id, lo1 + i * (hi1 - lo1) / n AS x1, lo2 + j * (hi2 - lo2) / n AS x2 FROM (SELECT CAST(floor(sqrt(count(*))) AS BIGINT) AS n, min(c_acctbal / 1000) AS lo1, max(c_acctbal / 1000) AS hi1, min((c_custkey % 17) / 10.0) AS lo2, max((c_custkey % 17) / 10.0) AS hi2 FROM customer) m CROSS JOIN LATERAL (SELECT unnest(range(n + 1)) AS i) p CROSS JOIN LATERAL (SELECT unnest(range(n + 1)) AS j) q)"


@query(_NET_SQL.replace(CASES, _GRID).replace("SELECT case_id,", "SELECT round(x1, 6) AS x1, round(x2, 6) AS x2,"))
def p12_evaluate_on_grid(spark, d):
    """Outputs over a grid that spans the cases and has about as many points."""
    m = cases(spark, d).agg(F.count("*").alias("n"), *[f(c).alias(f"{n}{i}") for i, c in enumerate(("x1", "x2")) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    size = int(m["n"] ** 0.5)
    points = data.grid_n(spark, [(m["lo0"], m["hi0"], size), (m["lo1"], m["hi1"], size)])
    points = points.withColumn("case_id", F.xxhash64("x1", "x2"))
    out = P.net_forward(points, "case_id", ["x1", "x2"], _draws(spark, d), N.Network(["tanh"]), keep=["x1", "x2"])
    return rounded(out.drop("case_id"))


@query(f"SELECT idx, round(-avg({_GAUSS}), 6) AS minus_log_prob, round(avg(abs(t - o)), 6) AS absolute, round(avg(pow(t - o, 2)), 6) AS squared FROM {PAIRS} GROUP BY idx")
def p13_draw_losses(spark, d):
    return rounded(pairs(spark, d).groupBy("idx").agg((-F.avg(L.gaussian(F.col("t"), F.col("o"), F.col("sd")))).alias("minus_log_prob"), F.avg(F.abs(F.col("t") - F.col("o"))).alias("absolute"), F.avg((F.col("t") - F.col("o")) ** 2).alias("squared")))


@query(f"WITH p AS (SELECT idx, exp(o) / (exp(o) + exp(x2) + exp(sd)) AS a, exp(x2) / (exp(o) + exp(x2) + exp(sd)) AS b, exp(sd) / (exp(o) + exp(x2) + exp(sd)) AS c FROM {PAIRS}) SELECT idx, round(avg(1 - greatest(a, b, c)), 6) AS class_error, round(avg(-a * ln(a) - b * ln(b) - c * ln(c)), 6) AS entropy FROM p GROUP BY idx")
def p13_class_losses(spark, d):
    s = F.exp("o") + F.exp("x2") + F.exp("sd")
    losses = P.expected_class_losses(F.array(F.exp("o") / s, F.exp("x2") / s, F.exp("sd") / s))
    return rounded(pairs(spark, d).groupBy("idx").agg(*[F.avg(c).alias(n) for n, c in losses.items()]))


def _net_at(x1):
    return f"(w1 * tanh(w1 * ({x1}) + w2 * x2 + 0.1) + w2 * tanh(0.5 * ({x1}) - w1 * x2 - 0.2))"


@query(f"SELECT 'n' AS log_id, idx, width, round(avg(pow({_net_at('x1 + width / 2')} - {_net_at('x1 - width / 2')}, 2)), 6) AS mean_square FROM {CASES} CROSS JOIN {NETS} CROSS JOIN (VALUES (0.5::DOUBLE), (1.0::DOUBLE)) v(width) GROUP BY idx, width")
def p14_difference_variance(spark, d):
    return rounded(P.difference_variance(cases(spark, d), ["x1", "x2"], "x1", [0.5, 1.0], _draws(spark, d), N.Network(["tanh"])))


@query(f"SELECT 'n' AS log_id, idx, CAST(0 AS INTEGER) AS layer, CAST(u AS INTEGER) AS unit, round(stddev_pop(CASE u WHEN 0 THEN tanh(w1 * x1 + w2 * x2 + 0.1) ELSE tanh(0.5 * x1 - w1 * x2 - 0.2) END), 6) AS sd FROM {CASES} CROSS JOIN {NETS} CROSS JOIN range(2) r(u) GROUP BY idx, u")
def p15_hidden_spread(spark, d):
    return rounded(P.hidden_spread(cases(spark, d), ["x1", "x2"], _draws(spark, d), N.Network(["tanh"])))


@query(f"SELECT 'n' AS log_id, idx, CAST(0 AS INTEGER) AS layer, round(sqrt(var_pop(tanh(w1 * x1 + w2 * x2 + 0.1)) + var_pop(tanh(0.5 * x1 - w1 * x2 - 0.2))) / 2, 6) AS spread FROM {CASES} CROSS JOIN {NETS} GROUP BY idx")
def p15_hidden_spread_scalar(spark, d):
    return rounded(P.hidden_spread_scalar(P.hidden_spread(cases(spark, d), ["x1", "x2"], _draws(spark, d), N.Network(["tanh"]))))


@query("SELECT label, CAST(i % 4 AS BIGINT) AS \"group\", round(sqrt(avg(pow(CAST(v AS DOUBLE), 2))), 6) AS rms FROM (SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY ALL")
def p16_parameter_rms(spark, d):
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    return rounded(P.parameter_rms(e, ["label"], (F.col("i") % 4).cast("long"), F.col("v").cast("double")))


@query(f"""WITH RECURSIVE n AS (SELECT count(*) + 1 AS n FROM customer), m AS (SELECT sum(x1 * x1) AS a11, sum(x1 * x2) AS a12, sum(x2 * x2) AS a22, sum(x1) AS s1, sum(x2) AS s2, sum(t) AS st, sum(x1 * t) AS t1, sum(x2 * t) AS t2, sum(t * t) AS tt, count(*) AS k FROM {CASES}),
g(step, u, v, c) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
SELECT step + 1, u - 0.02 / n * (u * a11 + v * a12 + c * s1 - t1), v - 0.02 / n * (u * a12 + v * a22 + c * s2 - t2), c - 0.02 / n * (u * s1 + v * s2 + c * k - st) FROM g, m, n WHERE step < 4)
SELECT step, round((u * u * a11 + v * v * a22 + c * c * k + tt + 2 * (u * v * a12 + u * c * s1 + v * c * s2 - u * t1 - v * t2 - c * st)) / k, 6) AS loss FROM g, m""")
def p17_batch_gradient(spark, d):
    trace = P.gradient_fit(cases(spark, d), ["x1", "x2"], "t", steps=5, step=0.02)
    return rounded(spark.createDataFrame([(t, loss) for t, loss, _ in trace], "step int, loss double"))


_LAYERED = {"ih": [np.array([[0.3], [0.2]]), np.array([[-0.4], [0.7]])], "hh": [np.array([[0.5]])], "bh": [np.array([0.1]), np.array([0.05])], "ho": [np.array([[0.2]]), np.array([[0.6]])], "io": np.array([[0.0], [0.1]]), "bo": np.array([-0.3])}
_PARTS = [("ih", 0, 0, "d0 * x1"), ("ih", 0, 1, "d0 * x2"), ("ih", 1, 0, "d1 * x1"), ("ih", 1, 1, "0.0 * d1"), ("hh", 0, 0, "d1 * h0"), ("bh", 0, 0, "d0"), ("bh", 1, 0, "d1"), ("ho", 0, 0, "e * h0"), ("ho", 1, 0, "e * h1"), ("io", -1, 0, "e * x1"), ("io", -1, 1, "e * x2"), ("bo", -1, 0, "e")]


# back-propagation by hand: a tanh unit, a sine unit above it that omits the second input, logistic output
@query(f"""WITH a AS (SELECT *, tanh(0.3 * x1 + 0.2 * x2 + 0.1) AS h0 FROM {CASES}), b AS (SELECT *, 0.5 * h0 - 0.4 * x1 + 0.05 AS s1 FROM a),
c AS (SELECT *, sqrt(2) * sin(sqrt(2) * s1) AS h1, 2 * cos(sqrt(2) * s1) AS slope1 FROM b), e AS (SELECT *, 1 / (1 + exp(-(0.6 * h1 + 0.2 * h0 + 0.1 * x2 - 0.3))) - b AS e FROM c),
g AS (SELECT *, 0.6 * e * slope1 AS d1, (0.2 * e + 0.5 * 0.6 * e * slope1) * (1 - h0 * h0) AS d0 FROM e)
""" + " UNION ALL ".join(f"SELECT '{n}' AS part, CAST({layer} AS INTEGER) AS layer, CAST({i} AS INTEGER) AS place, round(avg({x}), 6) AS gradient FROM g" for n, layer, i, x in _PARTS))
def p17_layered_gradient(spark, d):
    rows = cases(spark, d)
    found = N.network_gradient(rows, ["x1", "x2"], "b", _LAYERED, N.Network(["tanh", "sin"], omit={1: [1]}), "binary")
    sums = spark.createDataFrame(found, "part string, layer int, place int, total double")  # one row a parameter
    return rounded(sums.crossJoin(F.broadcast(rows.agg(F.count("*").alias("n")))).select("part", "layer", "place", (F.col("total") / F.col("n")).alias("gradient")))


_CLASS_START = {"io": np.array([[0.1, 0.0, -0.1], [0.0, 0.2, 0.0]]), "bo": np.array([0.1, 0.0, 0.0])}
_CLASS_AT = lambda s: [f"exp({s}.a{j} * x1 + {s}.b{j} * x2 + {s}.c{j})" for j in range(3)]


def _class_step(name, before):
    e = _CLASS_AT(before)
    p = [f"{x} / ({' + '.join(e)}) - CAST(case_id % 3 = {j} AS DOUBLE)" for j, x in enumerate(e)]
    moved = ", ".join(f"any_value({before}.{v}{j}) - 0.5 / (count(*) + 1) * sum(({p[j]}) * {x}) AS {v}{j}" for j in range(3) for v, x in (("a", "x1"), ("b", "x2"), ("c", "1")))
    return f"{name} AS (SELECT {moved} FROM {CASES} CROSS JOIN {before})"


def _class_loss(i):
    e = _CLASS_AT(f"s{i}")
    return f"SELECT CAST({i} AS INTEGER) AS step, round(-avg(ln(CASE case_id % 3 WHEN 0 THEN {e[0]} WHEN 1 THEN {e[1]} ELSE {e[2]} END / ({' + '.join(e)}))), 6) AS loss FROM {CASES} CROSS JOIN s{i}"


@query("WITH s0 AS (SELECT 0.1 AS a0, 0.0 AS a1, -0.1 AS a2, 0.0 AS b0, 0.2 AS b1, 0.0 AS b2, 0.1 AS c0, 0.0 AS c1, 0.0 AS c2), " + ", ".join(_class_step(f"s{i + 1}", f"s{i}") for i in range(2)) + " " + " UNION ALL ".join(map(_class_loss, range(3))))
def p17_class_fit(spark, d):
    rows = cases(spark, d).withColumn("k", F.col("case_id") % 3)
    trace = N.network_fit(rows, ["x1", "x2"], "k", _CLASS_START, N.Network([]), steps=3, step=0.5, loss="class")
    return rounded(spark.createDataFrame([(t, float(loss)) for t, loss, _, _ in trace], "step int, loss double"))


@query()
def p17_network_ensemble(spark, d):
    """Networks from two starts, trained on two halves and stopped early on the other half; their mean prediction."""
    rows = cases(spark, d).withColumn("first", F.col("case_id") % 2 == 0).withColumn("second", F.col("case_id") % 2 == 1)
    chosen = []
    for k, half in enumerate(("first", "second")):
        rng = np.random.default_rng(k)
        start = {"ih": [rng.normal(0, 0.3, (2, 4))], "bh": [np.zeros(4)], "ho": [rng.normal(0, 0.3, (4, 1))], "bo": np.zeros(1)}
        trace = N.network_fit(rows, ["x1", "x2"], "t", start, N.Network(["tanh"]), steps=6, step=0.05, validation=half)
        chosen.append(("e", k, N.early_stop(trace)[3]))
    return P.predict_mean(P.net_forward(rows, "case_id", ["x1", "x2"], chosen, N.Network(["tanh"])), ["case_id"], F.col("o"), F.lit(1.0))


@query(f"SELECT case_id, idx, c AS label, round(exp(-pow(t - o - c, 2)) / sum(exp(-pow(t - o - c, 2))) OVER (PARTITION BY case_id, idx), 6) AS p FROM {PAIRS} CROSS JOIN (VALUES (0), (1)) v(c)")
def p18_class_from_joint(spark, d):
    rows = pairs(spark, d).withColumn("label", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("l", -((F.col("t") - F.col("o") - F.col("label")) ** 2))
    return rounded(P.class_from_joint(rows, ["case_id", "idx"], "label", "l"))


_SPEC = G.Spec(constant=0.5, linear=[0.3, 0.2], parts=[(0.1, [0.4, 0.6], 2.0)], noise=0.3, jitter=0.01)
_TRAIN = "(SELECT s_suppkey AS i, s_acctbal / 1000 AS x1, (s_suppkey % 17) / 10.0 AS x2 FROM supplier)"
_COV_SQL = "(0.25 + 0.09 * a.x1 * b.x1 + 0.04 * a.x2 * b.x2 + exp(0.2 - 0.16 * pow(a.x1 - b.x1, 2) - 0.36 * pow(a.x2 - b.x2, 2)))"


def _train(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("i"), (F.col("s_acctbal") / 1000).alias("x1"), ((k % 17) / 10.0).alias("x2"), (F.sin(F.col("s_acctbal") / 1000)).alias("t"))


@query(f"SELECT a.i, b.i AS j, round({_COV_SQL}, 6) AS c FROM {_TRAIN} a CROSS JOIN {_TRAIN} b")
def g1_covariance(spark, d):
    return rounded(G.own_covariance(_train(spark, d), ["x1", "x2"], _SPEC))


@query(f"SELECT a.i, b.i AS j, round({_COV_SQL} + CASE WHEN a.i = b.i THEN 0.0901 WHEN abs(a.i - b.i) = 1 THEN 0.045 ELSE 0 END, 6) AS c FROM {_TRAIN} a CROSS JOIN {_TRAIN} b")
def g2_train_covariance(spark, d):
    return rounded(G.train_covariance(_train(spark, d), ["x1", "x2"], _SPEC, {1: 0.5}))


_PARTS = G.Spec(constant=0.5, linear=[0.3, 0.2], spread=1, spreads=frozenset({0}), parts=[G.Part(0.1, [0.4, 0.6], 1.0, delta=frozenset({1})), G.Part(-0.2, [0.3, 0.3], -1, omit=frozenset({1}), times=frozenset({1}))])


@query(f"SELECT a.i, b.i AS j, round(0.13 * a.x1 * b.x1 + 0.04 * a.x2 * b.x2 + exp(0.2 - 0.4 * abs(a.x1 - b.x1) - CASE WHEN a.x2 = b.x2 THEN 0 ELSE 0.6 END) + exp(-0.4) / (1 + pow(0.3 * (a.x1 - b.x1), 2)) * a.x2 * b.x2, 6) AS c FROM {_TRAIN} a CROSS JOIN {_TRAIN} b")
def g1_covariance_parts(spark, d):
    return rounded(G.own_covariance(_train(spark, d), ["x1", "x2"], _PARTS, keep={"linear", "0", "1"}))


@query(f"SELECT a.i, b.i AS j, round({_COV_SQL} + CASE WHEN a.i = b.i THEN 0.0001 + 0.1 + (a.i % 5) / 10.0 ELSE 0 END, 6) AS c FROM {_TRAIN} a CROSS JOIN {_TRAIN} b")
def g2_noise_by_case(spark, d):
    t = _train(spark, d)
    return rounded(G.train_covariance(t, ["x1", "x2"], _SPEC, noise=t.select("i", (0.1 + (F.col("i") % 5) / 10.0).alias("variance"))))


def _gp(spark, d):
    return G.gp_predictions(_train(spark, d), cases(spark, d), "case_id", ["x1", "x2"], [(1, _SPEC), (2, G.Spec(constant=0.4, parts=[(0.0, [0.5, 0.5], 2.0)], noise=0.4))], "t", "i")


@query()
def g3_gp_predict(spark, d):
    return _gp(spark, d)


@query()
def g3_gp_latent(spark, d):
    """Draws with latent values of their own, and one with a noise variance for each training case."""
    train = _train(spark, d).withColumns({"f1": F.sin(F.col("x1") / 2), "f2": F.sin(F.col("x1") * 2 / 2), "v3": 0.1 + (F.col("i") % 5) / 10.0})
    spec = G.Spec(constant=0.5, linear=[0.3, 0.2], parts=[(0.1, [0.4, 0.6], 2.0)], noise=0.3, jitter=0.1)
    return G.gp_predictions(train, cases(spark, d), "case_id", ["x1", "x2"], [(k, spec) for k in (1, 2, 3)], "t", "i", {1: "f1", 2: "f2"}, {3: "v3"})


@query()
def g4_gp_class_probability(spark, d):
    p = _gp(spark, d).withColumn("p", G.binary_probability(F.col("mean"), F.col("variance")))
    return p.groupBy("case_id").agg(F.avg("p").alias("p"))


_Z100 = ", ".join(map(repr, stratified_normal(100)))
_ORDERS = [[(k * (2 * j + 1) + j) % 101 for k in range(101)] for j in range(3)]
_TRIPLES = ", ".join(f"[{', '.join(repr(stratified_normal(101)[order[k]]) for order in _ORDERS)}]" for k in range(101))


@query(f"""WITH l AS (SELECT case_id, x1 / 5 AS m, 0.1 + x2 / 4 AS v, CAST(case_id % 4 AS INTEGER) AS k, t, b FROM {CASES}),
z AS (SELECT *, [1 / (1 + exp(-(m + sqrt(v) * z))) for z in [{_Z100}]] AS ps, [exp(m + sqrt(v) * z) for z in [{_Z100}]] AS rs FROM l),
c AS (SELECT case_id, [[exp(m + sqrt(v) * q[1]), exp(0.3 + sqrt(0.2::DOUBLE) * q[2]), exp(v + sqrt(0.5::DOUBLE) * q[3])] for q in [{_TRIPLES}]] AS e FROM l)
SELECT case_id, round(-pow(t - m, 2) / (2 * (v + 0.09)) - 0.5 * ln(2 * pi() * (v + 0.09)), 6) AS real_log_prob, round(list_avg(ps), 6) AS p, round(ln(CASE WHEN b = 1 THEN list_avg(ps) ELSE 1 - list_avg(ps) END), 6) AS binary_log_prob,
round(list_avg(rs), 6) AS count_mean, round(ln(list_avg([pow(r, k) * exp(-r) for r in rs])) - lgamma(k + 1), 6) AS count_log_prob,
[round(list_avg([x[1] / (x[1] + x[2] + x[3]) for x in e]), 6), round(list_avg([x[2] / (x[1] + x[2] + x[3]) for x in e]), 6), round(list_avg([x[3] / (x[1] + x[2] + x[3]) for x in e]), 6)] AS classes FROM z JOIN c USING (case_id)""")
def g4_latent_predictions(spark, d):
    """Predictions of all kinds of target from a Gaussian latent value of known mean and variance."""
    m, v, k = F.col("x1") / 5, 0.1 + F.col("x2") / 4, (F.col("case_id") % 4).cast("double")
    p = G.binary_probability(m, v)
    count = G.count_prediction(k, m, v)
    classes = G.class_probabilities([m, F.lit(0.3), v], [v, F.lit(0.2), F.lit(0.5)])
    out = dealt(cases(spark, d), 50_000).select("case_id", G.gaussian_log_prob(F.col("t"), m, v, 0.3).alias("real_log_prob"), p.alias("p"), F.log(F.when(F.col("b") == 1, p).otherwise(1 - p)).alias("binary_log_prob"), count["mean"].alias("count_mean"), count["log_prob"].alias("count_log_prob"), classes.alias("classes"))
    return rounded(out).withColumn("classes", F.transform("classes", lambda x: F.round(x, 6)))


@query()
def g5_covariance_spectrum(spark, d):
    return G.leading_spectrum(_train(spark, d), ["x1", "x2"], "i", _SPEC, 10)


@query("SELECT s_suppkey, round(0.5 * pow(s_acctbal / 10000, 2) + exp(0.2) * (1 - exp(-pow(abs(s_acctbal) / 5000, 2))), 6) AS relevance FROM supplier")
def g6_relevance(spark, d):
    a = F.col("s_acctbal")
    return rounded(table(spark, d, "supplier").select("s_suppkey", G.relevance(a / 10000, F.lit(0.1), F.abs(a) / 5000, 2.0).alias("relevance")))


@query(f"SELECT case_id, round(ln(avg(exp(-(pow(c.x1 - a.x1, 2) + pow(c.x2 - a.x2, 2)) / 0.5))) - 2 * (0.5 * ln(2 * pi()) + ln(0.5)), 6) AS log_density FROM {CASES} c CROSS JOIN {_TRAIN} a GROUP BY case_id")
def g7_kernel_density(spark, d):
    return rounded(G.kernel_density(_train(spark, d), cases(spark, d), "case_id", ["x1", "x2"], 0.5))
