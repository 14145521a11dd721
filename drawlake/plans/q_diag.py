"""Queries of quantity tables, series and weighted means."""

from __future__ import annotations

from pyspark.sql import functions as F

from drawlake.functions.numeric import log_sum_exp_by
from drawlake.operators import diagnostics as A
from drawlake.operators import draws as D
from drawlake.plans.base import DRAWS, ITERS, SERIES, draws, iters, query, rounded, series, table

_Q = "(SELECT 'a' AS log_id, l_orderkey AS idx, 'w' AS quantity, l_linenumber AS pos, l_quantity AS value FROM lineitem)"
_WEIGHTS = f"(SELECT *, exp(log_weight - (SELECT max(log_weight) FROM {DRAWS})) AS w FROM {DRAWS})"


def _q(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("value")).select(F.lit("a").alias("log_id"), F.col("l_orderkey").alias("idx"), F.lit("w").alias("quantity"), F.col("l_linenumber").alias("pos"), "value")


@query("SELECT 'a' AS log_id, l_orderkey AS idx, max(l_quantity) FILTER (WHERE l_linenumber = 1) AS w_1, max(l_quantity) FILTER (WHERE l_linenumber = 2) AS w_2, max(l_quantity) FILTER (WHERE l_linenumber = 3) AS w_3 FROM lineitem GROUP BY l_orderkey")
def q1_quantity_table(spark, d):
    t = A.quantity_table(_q(spark, d), "w@1:3")
    return t.select("log_id", "idx", *[F.col(f"`w@{i}`").alias(f"w_{i}") for i in (1, 2, 3)])


@query("SELECT 'a' AS log_id, l_orderkey AS idx, l_linenumber AS px, max(l_quantity) AS x, o_totalprice AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, l_linenumber, o_totalprice")
def q2_quantity_pairs(spark, d):
    y = table(spark, d, "orders").select(F.lit("a").alias("log_id"), F.col("o_orderkey").alias("idx"), F.lit(None).cast("int").alias("pos"), F.col("o_totalprice").alias("value"))
    return A.quantity_pairs(_q(spark, d), y).drop("py")


@query(f"SELECT idx, idx AS t, 1 + (idx - 1) % 4 AS t4 FROM {DRAWS}")
def q3_index_quantities(spark, d):
    return draws(spark, d).select("idx", *[c.alias(n) for n, c in A.index_quantities(4, F.col("idx")).items()])


@query("SELECT l_orderkey AS idx, l_linenumber AS \"#\", l_linenumber % 3 AS \"#3\", max(l_quantity) AS value FROM lineitem GROUP BY ALL")
def q3_positions(spark, d):
    return _q(spark, d).select("idx", *[c.alias(n) for n, c in A.position_quantities(3, F.col("pos")).items()], "value")


@query(f"WITH b AS (SELECT floor(20 * (value - 0.5) / 3.5) AS bin FROM {DRAWS} WHERE value >= 0.5 AND value < 4) SELECT r.g AS bin, round(0.5 + (r.g + 0.5) * 3.5 / 20, 6) AS centre, count(b.bin) AS n, round(count(b.bin) / (SELECT count(*) FROM orders), 6) AS share FROM range(20) r(g) LEFT JOIN b ON b.bin = r.g GROUP BY r.g")
def q4_histogram(spark, d):
    return rounded(A.histogram(draws(spark, d), F.col("value"), 0.5, 4.0, 20))


@query(f"""SELECT log_id, idx, round(exp(log_weight), 6) AS q, round(log_weight * 29.123 - 4, 6) AS q0, round(greatest(log_weight * 29.123 - 4, -2), 6) AS q2, round(least(log_weight * 5000, 1000), 6) AS d, round(least(log_weight * 5000, 700), 6) AS d700,
round(idx * 0.7 / 60, 6) AS k, CASE WHEN idx % 3 > 0 THEN round((idx % 2) / (idx % 3), 6) END AS r, CASE WHEN idx % 5 > 0 THEN round((idx % 11) / (idx % 5), 6) END AS e,
CAST(greatest(idx % 41 - 20, 0) AS DOUBLE) AS c0, CAST(greatest(20 - idx % 41, 0) AS DOUBLE) AS c1, round(9 * (greatest(20 - idx % 41, 0) / 3.0) * (1 - exp(-0.6 * (greatest(20 - idx % 41, 0) / 3.0) - pow(greatest(20 - idx % 41, 0) / 3.0, 2))), 6) AS c3 FROM {DRAWS}""")
def q5_run_quantities(spark, d):
    i, w = F.col("idx"), F.col("log_weight")
    c = {"proposals": i % 3, "rejects": i % 2, "slice_calls": i % 5, "slice_evals": i % 11, "log_weight": w, "delta": w * 5000, "time_ms": i * 700, "consecutive_accepts": i % 41 - 20}
    low = c | {"log_weight": w * 29.123 - 4}
    q = {"q": D.run_quantity("Q", c), "q0": D.run_quantity("Q", low, 0), "q2": D.run_quantity("Q", low, 2), "d": D.run_quantity("D", c), "d700": D.run_quantity("D", c, 700), "k": D.run_quantity("k", c), "r": D.run_quantity("r", c), "e": D.run_quantity("e", c)}
    q |= {f"c{n}": D.run_quantity("C", c, n) for n in (0, 1, 3)}
    return rounded(draws(spark, d).select("log_id", "idx", *[x.alias(n) for n, x in q.items()]))


_PLACE = "CASE inv_temp WHEN 0.125 THEN 0 WHEN 0.25 THEN 1 WHEN 0.5 THEN 2 WHEN 0.75 THEN 3 ELSE 4 END"


@query(f"SELECT log_id, idx, CAST(inv_temp AS DOUBLE) AS inv_temp, CAST({_PLACE} AS INTEGER) AS temp_index, CAST(idx % 2 * 2 - 1 AS INTEGER) AS temp_dir, CAST({_PLACE} + CASE WHEN idx % 2 = 1 THEN 1 ELSE 0 END AS INTEGER) AS upper_end FROM {ITERS}")
def q6_temperature(spark, d):
    temps = spark.createDataFrame([(0, 0.125), (1, 0.25), (2, 0.5), (3, 0.75), (4, 1.0)], "temp_index int, inv_temp double")
    rows = iters(spark, d).withColumn("temp_dir", (F.col("idx") % 2 * 2 - 1).cast("int"))
    return D.temperature_quantities(rows, temps).select("log_id", "idx", "inv_temp", "temp_index", "temp_dir", "upper_end")


@query("SELECT l_suppkey, arg_min(l_orderkey, (l_extendedprice, l_orderkey)) AS l_orderkey, min(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY l_suppkey")
def q7_argmin(spark, d):
    return A.argmin(table(spark, d, "lineitem"), "l_orderkey", "l_extendedprice", ["l_suppkey"])


@query(f"WITH m AS (SELECT log_id, idx, inv_temp = 1 AS cold FROM {ITERS} WHERE inv_temp IN (1, 0.125)), l AS (SELECT log_id, cold AND NOT lag(cold) OVER (PARTITION BY log_id ORDER BY idx) AS b FROM m) SELECT log_id, coalesce(count(*) FILTER (WHERE b), 0) AS tours FROM l GROUP BY log_id")
def q8_tour_count(spark, d):
    return A.tour_count(iters(spark, d))


@query("SELECT c_nationkey, CAST(r AS INTEGER) AS rank, m AS magnitude FROM (SELECT c_nationkey, abs(c_acctbal) AS m, row_number() OVER (PARTITION BY c_nationkey ORDER BY abs(c_acctbal) DESC) AS r FROM customer) WHERE r <= 3")
def q9_top_magnitudes(spark, d):
    return A.top_magnitudes(table(spark, d, "customer"), ["c_nationkey"], F.col("c_acctbal"), 3)


@query(f"SELECT count(DISTINCT realization) AS realizations, count(*) AS points, round(avg(value), 6) AS mean, round(var_pop(value), 6) AS variance, round(stddev_pop(value), 6) AS sd FROM {SERIES}")
def a1_series_moments(spark, d):
    return rounded(A.series_moments(series(spark, d)))


@query(f"WITH p AS (SELECT realization, count(*) AS n, avg(value) AS m FROM {SERIES} GROUP BY realization) SELECT n, count(*) AS realizations, CASE WHEN count(*) > 1 THEN round(sqrt(var_pop(m) / (count(*) - 1)), 6) END AS se FROM p GROUP BY n")
def a2_se_from_submeans(spark, d):
    return rounded(A.se_by_length(series(spark, d)))


_COV = f"s AS (SELECT realization, t, value - (SELECT avg(value) FROM {SERIES}) AS d FROM {SERIES}), c AS (SELECT b.t - a.t AS lag, avg(a.d * b.d) AS covariance, count(*) AS pairs FROM s a JOIN s b ON a.realization = b.realization AND b.t BETWEEN a.t AND a.t + 10 GROUP BY ALL)"


@query(f"WITH {_COV} SELECT CAST(lag AS INTEGER) AS lag, round(covariance, 6) AS covariance, pairs FROM c")
def a3_autocovariance(spark, d):
    return rounded(A.autocovariance(series(spark, d), 10))


_ALL = _COV.replace("AND b.t BETWEEN a.t AND a.t + 10", "AND b.t >= a.t")


@query(f"WITH {_ALL} SELECT CAST(lag AS INTEGER) AS lag, round(covariance, 6) AS covariance, pairs FROM c")
def a3_all_lags(spark, d):
    """Up to the longest realization less 1."""
    return rounded(A.autocovariance(series(spark, d)))


@query(f"WITH {_COV}, r AS (SELECT lag, covariance / (SELECT covariance FROM c WHERE lag = 0) AS rho FROM c) SELECT CAST(lag AS INTEGER) AS lag, round(rho, 6) AS correlation, round(2 * sum(rho) OVER (ORDER BY lag) - 1, 6) AS cumulative FROM r")
def a4_autocorrelation(spark, d):
    return rounded(A.autocorrelation(series(spark, d), 10))


@query(f"WITH {_COV}, n AS (SELECT realization, count(*) AS n FROM {SERIES} GROUP BY realization), v AS (SELECT realization, n, sum(CASE WHEN lag = 0 THEN covariance ELSE 2 * (1 - lag / n) * covariance END) AS v FROM n JOIN c ON lag < n GROUP BY ALL) SELECT round(sqrt(sum(v * n) / pow(sum(n), 2)), 6) AS se FROM v")
def a5_se_from_correlations(spark, d):
    return rounded(A.se_from_correlations(series(spark, d), 10))


@query("SELECT CAST(floor(o_orderkey / 50) AS BIGINT) AS batch, round(avg(o_totalprice / 100000), 6) AS mean FROM orders GROUP BY batch HAVING count(*) = 50")
def a6_batch_means(spark, d):
    return rounded(A.batch_means(draws(spark, d), 50, F.col("value"), F.col("idx") + 1))


_BATCH = f"(SELECT CAST(floor(idx / 50) AS BIGINT) AS batch, ln(sum(exp(log_weight))) AS log_weight, sum(exp(log_weight) * value) / sum(exp(log_weight)) AS mean FROM {DRAWS} GROUP BY batch HAVING count(*) = 50)"


def _batches(spark, d):
    return A.weighted_batch_means(draws(spark, d), 50, F.col("value"), F.col("log_weight"), F.col("idx") + 1)


@query(f"SELECT batch, round(log_weight, 6) AS log_weight, round(mean, 6) AS mean FROM {_BATCH}")
def a7_weighted_batch_means(spark, d):
    return rounded(_batches(spark, d))


@query(f"WITH b AS (SELECT exp(log_weight) AS w, mean AS m FROM {_BATCH}), t AS (SELECT sum(w) AS tw, sum(w * m) / sum(w) AS mean, count(*) AS n FROM b) SELECT round(t.mean, 6) AS mean, round(sqrt(sum(pow(w / tw * (m - t.mean), 2))), 6) AS se, t.n FROM b, t GROUP BY t.mean, t.n")
def a8_mean_with_se(spark, d):
    return rounded(A.mean_with_se(_batches(spark, d)))


_STATS = "count(*) AS n, round(ln(avg(exp(lw))), 6) AS log_mean, round(sqrt(var_samp(exp(lw)) / pow(avg(exp(lw)), 2) / count(*)), 6) AS log_mean_se, round(var_samp(exp(lw)) / pow(avg(exp(lw)), 2), 6) AS variance, round(count(*) / (1 + var_samp(exp(lw)) / pow(avg(exp(lw)), 2)), 4) AS adjusted_size, round(1 / (1 + var_samp(exp(lw)) / pow(avg(exp(lw)), 2)), 6) AS reduction, count(*) / (1 + var_samp(exp(lw)) / pow(avg(exp(lw)), 2)) < 10 AS warning, round(var_samp(lw), 6) AS log_variance"


@query(f"SELECT {_STATS} FROM (SELECT log_weight * 4 AS lw FROM {DRAWS})")
def a9_weight_stats(spark, d):
    return rounded(A.weight_stats(draws(spark, d), F.col("log_weight") * 4)).withColumn("adjusted_size", F.round("adjusted_size", 4))


@query(f"SELECT CAST(inv_temp AS DOUBLE) AS inv_temp, {_STATS} FROM (SELECT inv_temp, (idx % 97) / 20.0 AS lw FROM {ITERS}) GROUP BY inv_temp")
def a10_ais_by_temperature(spark, d):
    return rounded(A.weight_stats(iters(spark, d), (F.col("idx") % 97) / 20.0, ["inv_temp"])).withColumn("adjusted_size", F.round("adjusted_size", 4))


@query(f"""WITH t AS (SELECT sum(w) AS sw, sum(w * value) AS sa, count(*) AS n FROM {_WEIGHTS}),
j AS (SELECT t.n, sa / sw AS mean, w / sw AS p, value AS a, (sa - w * value) / (sw - w) AS l FROM {_WEIGHTS}, t)
SELECT n, round(mean, 6) AS mean, round(sqrt(sum(p * pow(a - mean, 2))), 6) AS sd, round(sqrt(sum(p * p * pow(a - mean, 2))), 6) AS se,
round(n * mean - (n - 1) * avg(l), 6) AS jackknife_mean, round(sqrt((n - 1) * var_pop(l)), 6) AS jackknife_se, round(sum(p * pow(a - mean, 2)) / sum(p * p * pow(a - mean, 2)), 3) AS effective_size FROM j GROUP BY n, mean""")
def a11_expectation(spark, d):
    return rounded(A.expectation(draws(spark, d), F.col("value"), F.col("log_weight"))).withColumn("effective_size", F.round("effective_size", 3))


@query(f"SELECT round(ln(avg(exp(value))) - ln(avg(exp(-value))), 6) AS log_ratio FROM {DRAWS}")
def a12_normalizing_ratio(spark, d):
    return rounded(A.normalizing_ratio(draws(spark, d), F.col("value"), -F.col("value")))


@query(f"SELECT log_id, round(ln(sum(exp(value))), 6) AS total, count(*) AS n FROM {DRAWS} GROUP BY log_id")
def a13_logsumexp(spark, d):
    return rounded(log_sum_exp_by(draws(spark, d), ["log_id"], F.col("value"), "total", n=F.lit(1)))


@query(f"SELECT count(*) AS n, round(ln(avg(exp(log_weight))), 6) AS log_mean, round(sqrt(sum(w * w) / pow(sum(w), 2) - 1.0 / count(*)), 6) AS se, round(pow(sum(w), 2) / sum(w * w), 3) AS effective_size FROM {_WEIGHTS}")
def a14_marginal_likelihood(spark, d):
    return rounded(A.marginal_likelihood(draws(spark, d), F.col("log_weight"))).withColumn("effective_size", F.round("effective_size", 3))
