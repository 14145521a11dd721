"""Queries of case preparation and draw selection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from drawlake.functions import formula as formulas
from drawlake.functions import numeric as N
from drawlake.operators import data, draws as D
from drawlake.plans.base import CASES, DRAWS, ITERS, cases, draws, iters, query, r6, rounded, table
from drawlake.sources import tables as S

_LINE = "c_custkey || ' ,' || CASE WHEN c_custkey % 5 = 0 THEN '?' ELSE CAST(c_nationkey AS VARCHAR) END || chr(9) || c_custkey % 3"


@query(f"SELECT c_custkey, CAST(c_custkey % 3 AS DOUBLE) AS i1, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_nationkey AS DOUBLE) END AS i2, CAST(0 AS DOUBLE) AS i3, false AS bad FROM customer")
def s1_read_numeric(spark, d):
    k = F.col("c_custkey")
    lines = table(spark, d, "customer").select("c_custkey", F.concat(k.cast("string"), F.lit(" ,"), F.when(k % 5 == 0, "?").otherwise(F.col("c_nationkey").cast("string")), F.lit("\t"), (k % 3).cast("string")).alias("value"))
    return S.parse_numeric(lines, [3, 2, 0]).drop("value")


@query("SELECT c_custkey + 1 AS row_id, c_acctbal FROM customer WHERE NOT (c_custkey + 1 BETWEEN 11 AND 100)")
def s2_line_range(spark, d):
    return S.line_range(table(spark, d, "customer").select((F.col("c_custkey") + 1).alias("row_id"), "c_acctbal"), 11, 100, complement=True)


@query("SELECT s_suppkey + 1 AS row_id, s_suppkey FROM supplier")
def s3_with_row_id(spark, d):
    return S.numbered(table(spark, d, "supplier").select("s_suppkey").repartitionByRange(4, "s_suppkey").sortWithinPartitions("s_suppkey"))


@query("SELECT c_custkey AS row_id, c_acctbal, c_nationkey, CAST(2.5 AS DOUBLE) AS constant FROM customer")
def s4_bind_columns(spark, d):
    c = table(spark, d, "customer").withColumnRenamed("c_custkey", "row_id")
    return S.bind_columns(S.bind_columns(c.select("row_id", "c_acctbal"), c.select("row_id", "c_nationkey")), 2.5)


@query('SELECT c_custkey, c_acctbal AS "w3@2" FROM customer')
def s5_write_table(spark, d):
    path = S.scratch_path(spark, "table")
    S.write_table(table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("w3@2")), path)
    return spark.read.option("header", True).schema("c_custkey long, `w3@2` double").csv(path)


@query(f"WITH s AS (SELECT idx, value FROM {DRAWS} WHERE log_id = '1'), t AS (SELECT idx, value FROM {DRAWS} WHERE log_id = '0') SELECT idx, value FROM t UNION ALL SELECT (SELECT max(idx) FROM t) + row_number() OVER (ORDER BY idx), value FROM s")
def s6_append_draws(spark, d):
    q = draws(spark, d).select("log_id", "idx", "value")
    return D.append_draws(q.where("log_id = '0'").select("idx", "value"), q.where("log_id = '1'").select("idx", "value"))


@query(f"WITH s AS (SELECT idx, value FROM {DRAWS} WHERE log_id = '1' AND idx BETWEEN 7 AND (SELECT max(idx) // 2 FROM {DRAWS}) AND idx % 3 = 0), t AS (SELECT idx, value FROM {DRAWS} WHERE log_id = '0') SELECT idx, value FROM t UNION ALL SELECT (SELECT max(idx) FROM t) + row_number() OVER (ORDER BY idx) - 1, value FROM s")
def s6_append_at_last(spark, d):
    q = draws(spark, d).select("log_id", "idx", "value")
    half = q.agg(F.max("idx")).first()[0] // 2
    return D.append_draws(q.where("log_id = '0'").select("idx", "value"), q.where("log_id = '1'").select("idx", "value"), f"7:{half}%3", at_last=True)


@query(f"SELECT CAST(100 + 2 * (dense_rank() OVER (ORDER BY idx) - 1) AS BIGINT) AS idx, o_orderpriority AS type, value FROM {DRAWS} WHERE idx BETWEEN 5 AND (SELECT max(idx) // 2 FROM {DRAWS}) AND idx % 2 = 0")
def s7_copy_range(spark, d):
    q = draws(spark, d).select("idx", F.col("o_orderpriority").alias("type"), "value")
    return D.copy_draws(q, 100, 2, chosen=f"5:{q.agg(F.max('idx')).first()[0] // 2}%2")


@query(f"SELECT CAST(10 + 5 * (dense_rank() OVER (ORDER BY idx) - 1) AS BIGINT) AS idx, o_orderpriority AS type, value FROM {DRAWS} WHERE o_orderpriority <> '5-LOW'")
def s7_copy_draws(spark, d):
    return D.copy_draws(draws(spark, d).select("idx", F.col("o_orderpriority").alias("type"), "value"), 10, 5, ("5-LOW",))


_RECORDS = "(SELECT CAST(l_suppkey AS VARCHAR) AS log_id, l_orderkey AS idx, l_returnflag AS type, l_linenumber AS size FROM lineitem)"


def _records(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("log_id"), F.col("l_orderkey").alias("idx"), F.col("l_returnflag").alias("type"), F.col("l_linenumber").alias("size"))


@query(f"SELECT log_id, idx, list({{'type': type, 'size': size}} ORDER BY type, size) AS records FROM {_RECORDS} GROUP BY log_id, idx")
def s8_list_records(spark, d):
    return D.list_records(_records(spark, d))


@query(f"SELECT log_id, max(idx) AS last FROM {_RECORDS} GROUP BY log_id")
def s9_last_index(spark, d):
    return D.last_index(_records(spark, d))


@query("SELECT a.o_orderkey AS type FROM orders a FULL JOIN (SELECT * FROM orders WHERE o_orderkey % 7 <> 0) b USING (o_orderkey) WHERE b.o_custkey IS NULL OR a.o_totalprice IS DISTINCT FROM CASE WHEN b.o_orderkey % 11 = 0 THEN 0 ELSE b.o_totalprice END")
def s10_draws_equal(spark, d):
    o = table(spark, d, "orders")
    a = o.select(F.col("o_orderkey").alias("type"), F.col("o_totalprice").alias("payload"))
    b = a.where("type % 7 <> 0").withColumn("payload", F.when(F.col("type") % 11 == 0, 0.0).otherwise(F.col("payload")))
    return D.differing_records(a, b)


@query("SELECT o_orderkey, round((ln(o_totalprice) - 10) * 2, 6) AS a, round(o_totalprice / 1000, 6) AS b FROM orders")
def s11_transform_columns(spark, d):
    specs = data.parse_transforms(["L-10x2", "x0.001"], 2)
    return rounded(table(spark, d, "orders").select("o_orderkey", *[data.transform(F.col("o_totalprice"), s).alias(n) for n, s in zip("ab", specs)]))


@query("WITH m AS (SELECT avg(ln(o_totalprice)) AS m, stddev_pop(ln(o_totalprice)) AS s FROM orders WHERE o_orderkey % 3 = 0) SELECT o_orderkey, round((ln(o_totalprice) - m) / s, 6) AS z FROM orders, m")
def s12_fit_transform(spark, d):
    o = table(spark, d, "orders")
    spec = data.fit_transforms(o.where("o_orderkey % 3 = 0"), {"o_totalprice": data.parse_transform("L+@x@")})["o_totalprice"]
    return rounded(o.select("o_orderkey", data.transform(F.col("o_totalprice"), spec).alias("z")))


@query("SELECT o_orderkey, round(o_totalprice, 4) AS back FROM orders")
def s13_inverse_transform(spark, d):
    spec = data.parse_transform("L+3x0.5")
    return table(spark, d, "orders").select("o_orderkey", F.round(data.inverse_transform(data.transform(F.col("o_totalprice"), spec), spec), 4).alias("back"))


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 40")
def s14_check_targets(spark, d):
    return data.check_targets(table(spark, d, "lineitem").select("l_orderkey", "l_quantity"), "l_quantity", "class", 40)


@query("SELECT CAST(round(count(*) * 0.3) AS BIGINT) AS n, count(*) - CAST(round(count(*) * 0.3) AS BIGINT) AS rest FROM orders")
def s15_split_exact(spark, d):
    marked = data.split_exact(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.3, 1)
    return marked.agg(F.sum(F.col("chosen").cast("long")).alias("n"), F.sum((~F.col("chosen")).cast("long")).alias("rest"))


@query("WITH c AS (SELECT c_custkey + 1 AS row_id, CAST(floor(c_custkey * 4 / (SELECT count(*) FROM customer)) AS INTEGER) AS own FROM customer) SELECT row_id, CAST(f AS INTEGER) AS fold, own = f AS validation FROM c, range(4) r(f)")
def s16_kfold_ranges(spark, d):
    return data.kfold_ranges(table(spark, d, "customer").select((F.col("c_custkey") + 1).alias("row_id")), 4)


@query(f"SELECT case_id, round(min(abs(x1 - g * 0.5)), 6) AS gap FROM {CASES}, range(-4, 21) r(g) GROUP BY case_id")
def s17_grid(spark, d):
    g = data.grid(spark, [(-2.0, 10.0, 0.5)])
    return rounded(cases(spark, d).crossJoin(F.broadcast(g.withColumnRenamed("x1", "g"))).groupBy("case_id").agg(F.min(F.abs(F.col("x1") - F.col("g"))).alias("gap")))


@query(f"SELECT case_id, round(min(abs(x1 - (-1 + g * 11.0 / 8))), 6) AS gap FROM {CASES}, range(0, 9) r(g) GROUP BY case_id")
def s18_grid_n(spark, d):
    g = data.grid_n(spark, [(-1.0, 10.0, 8)])
    return rounded(cases(spark, d).crossJoin(F.broadcast(g.withColumnRenamed("x1", "g"))).groupBy("case_id").agg(F.min(F.abs(F.col("x1") - F.col("g"))).alias("gap")))


@query("SELECT vec_id, list_transform(range(10), lambda i: CASE WHEN i = label THEN 1 ELSE 0 END) AS hot FROM embeddings")
def s19_one_hot(spark, d):
    return table(spark, d, "embeddings").select("vec_id", data.one_hot(F.col("label"), 10).alias("hot"))


@query("WITH n AS (SELECT count(*) AS n FROM supplier WHERE s_suppkey % 3 > 0) SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN 'train' ELSE 'test' END AS split, list_transform(range(n + 1), lambda i: CASE WHEN i = CASE WHEN s_suppkey % 3 > 0 THEN row_number - 1 ELSE n END THEN 1 ELSE 0 END) AS hot FROM (SELECT s_suppkey, row_number() OVER (PARTITION BY s_suppkey % 3 > 0 ORDER BY s_suppkey) AS row_number FROM supplier), n")
def s19_case_indicators(spark, d):
    t = table(spark, d, "supplier").select("s_suppkey")
    return data.case_indicators(t.where("s_suppkey % 3 > 0"), t.where("s_suppkey % 3 = 0"), "s_suppkey")


@query(f"SELECT log_id, idx, value FROM {DRAWS} WHERE idx BETWEEN 5 AND (SELECT max(idx) - 100 FROM {DRAWS}) AND idx % 3 = 0")
def d1_select_range(spark, d):
    q = draws(spark, d).select("log_id", "idx", "value")
    return D.select_range(q, f"5:{q.agg(F.max('idx')).first()[0] - 100}%3")


@query(f"WITH m AS (SELECT max(idx) AS m FROM {DRAWS}), t AS (SELECT m, unnest([CAST(floor(10 + i * (m - 10) / 24.0 + 0.5) AS BIGINT) for i in range(25)]) AS t FROM m) SELECT DISTINCT log_id, idx FROM (SELECT log_id, min(idx) AS idx FROM {DRAWS}, t WHERE idx BETWEEN t AND m GROUP BY log_id, t.t)")
def d2_select_evenly(spark, d):
    q = draws(spark, d).select("log_id", "idx")
    return D.select_evenly(q, 10, q.agg(F.max("idx")).first()[0], 25)


@query(f"SELECT log_id, idx FROM {ITERS} WHERE time_ms / 60000.0 BETWEEN 5 AND 60")
def d3_select_time(spark, d):
    return D.select_time(iters(spark, d), 5, 60).select("log_id", "idx")


@query("SELECT 'a' AS log_id, o_orderkey AS idx FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'b', o_orderkey FROM orders WHERE o_orderkey % 2 = 1")
def d4_union_logs(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("idx"))
    return D.union_logs(("a", o.where("idx % 2 = 0")), ("b", o.where("idx % 2 = 1"))).select("log_id", "idx")


@query(f"SELECT log_id, idx, CAST(row_number() OVER (PARTITION BY log_id ORDER BY idx) AS INTEGER) AS new_idx FROM {ITERS} WHERE inv_temp IN (1.0, 0.125)")
def d5_at_temperature(spark, d):
    return D.at_temperature(iters(spark, d), 1.0, also_highest=True).select("log_id", "idx", "new_idx")


@query("SELECT CAST(user_id AS VARCHAR) AS log_id, event_type AS type, max(event_id) AS idx, arg_max(value, event_id) AS value FROM events WHERE event_id <= (SELECT max(event_id) // 2 FROM events) GROUP BY ALL")
def d6_state_as_of(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("log_id"), F.col("event_type").alias("type"), F.col("event_id").alias("idx"), "value")
    return D.state_as_of(e, e.agg(F.max("idx")).first()[0] // 2)


@query("WITH e AS (SELECT CAST(user_id % 4 AS VARCHAR) AS log_id, event_type AS type, event_id AS idx, value FROM events), q AS (SELECT * FROM (SELECT DISTINCT log_id, type FROM e), (SELECT idx AS at FROM e WHERE idx % 10 = 0)) SELECT q.log_id, q.at, q.type, e.idx, e.value FROM q ASOF JOIN e ON q.log_id = e.log_id AND q.type = e.type AND q.at >= e.idx")
def d6_states_as_of(spark, d):
    """State of four logs at every tenth index."""
    e = table(spark, d, "events").select((F.col("user_id") % 4).cast("string").alias("log_id"), F.col("event_type").alias("type"), F.col("event_id").alias("idx"), "value")
    at = e.where("idx % 10 = 0").select(F.col("idx").alias("at")).join(F.broadcast(e.select("log_id").distinct()))
    return D.states_as_of(e, at)


@query(f"SELECT log_id, idx, round(log_weight + (idx % 10) / 10.0, 6) AS log_weight FROM {DRAWS} WHERE idx % 2 = 0")
def d7_reweight(spark, d):
    q = draws(spark, d).select("log_id", "idx", "log_weight")
    extra = q.where("idx % 2 = 0").select("log_id", "idx", ((F.col("idx") % 10) / 10.0).alias("add"))
    return rounded(D.reweight(q, extra))


@query(f"SELECT log_id, idx FROM {DRAWS} WHERE idx IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def d8_require_complete(spark, d):
    q = draws(spark, d).select("log_id", "idx")
    has = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("idx")).distinct().join(q, "idx")
    return D.require_complete(q, has)


@query(f"WITH h AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R') SELECT log_id, count(k) AS kept, count(*) - count(k) AS dropped FROM {DRAWS} LEFT JOIN h ON k = idx GROUP BY log_id")
def d8_incomplete_counts(spark, d):
    q = draws(spark, d).select("log_id", "idx")
    has = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("idx")).distinct().join(q, "idx")
    return D.incomplete_counts(q, has)


@query(f"SELECT case_id, round(CASE WHEN x1 = 0 THEN 0 ELSE 2 * x1 * (x2 + 1) END - sin(x1) * exp(-abs(x2)) + pow(x1, 3) / pi(), 6) AS f, round(ln(1 + exp(x2)), 6) AS g FROM {CASES}")
def f1_formula(spark, d):
    c = formulas.with_definitions(cases(spark, d), {"f": "2x1(x2+1) - Sin(x1)Exp[-Abs(x2)] + x1^3/Pi", "g": "Log{1+Exp(x2)}"})
    return rounded(c.select("case_id", "f", "g"))


@query(f"SELECT case_id, round(cos(x1) + tan(x2) + sinh(x2) + cosh(x2) + tanh(x1) + sqrt(abs(x1)), 6) AS f FROM {CASES}")
def f2_functions(spark, d):
    return rounded(cases(spark, d).select("case_id", formulas.formula("Cos(x1)+Tan(x2)+Sinh(x2)+Cosh(x2)+Tanh(x1)+Sqrt(Abs(x1))", cases(spark, d)).alias("f")))


@query(f"SELECT case_id, CAST(sign(x1) AS DOUBLE) AS s, CAST(x1 >= 1 AS DOUBLE) AS h, CAST(x2 = 0 AS DOUBLE) AS z, round(CASE WHEN x1 >= 0 THEN x1 - floor(x1) ELSE 1 - (-x1 - floor(-x1)) END, 6) AS f FROM {CASES}")
def f3_steps(spark, d):
    x1, x2 = F.col("x1"), F.col("x2")
    return cases(spark, d).select("case_id", N.sign(x1).alias("s"), N.theta(x1 - 1).alias("h"), N.delta(x2).alias("z"), r6(N.frac(x1)).alias("f"))


@query(f"SELECT case_id, round(lgamma(x2 + 0.5), 6) AS g FROM {CASES}")
def f4_lgamma(spark, d):
    return rounded(cases(spark, d).select("case_id", N.lgamma(F.col("x2") + 0.5).alias("g")))


@query(f"SELECT case_id, round(ln(exp(x1) + exp(x2) + exp(t)), 6) AS l, round(ln(exp(greatest(x1, t) + 1) - exp(least(x1, t))), 6) AS m FROM {CASES}")
def f5_log_sum_exp(spark, d):
    x, y, t = (F.col(c) for c in ("x1", "x2", "t"))
    return rounded(cases(spark, d).select("case_id", N.log_sum_exp(x, y, t).alias("l"), N.sub_logs(F.greatest(x, t) + 1, F.least(x, t)).alias("m")))


@query(f"SELECT case_id, round(pow(t - x2, 2) / 4 + 0.5 * ln(4 * pi()), 6) AS n FROM {CASES}")
def f6_normal(spark, d):
    c = cases(spark, d)
    return rounded(c.select("case_id", formulas.formula("t ~ Normal(x2, 2)", c).alias("n")))


@query(f"SELECT case_id, round(lgamma(2.5) - 2.5 * ln(1.5) - 2.5 * x2 + 1.5 * exp(x2), 6) AS g FROM {CASES}")
def f7_exp_gamma(spark, d):
    return rounded(cases(spark, d).select("case_id", N.exp_gamma_energy(F.col("x2"), F.lit(2.5), F.lit(1.5)).alias("g")))


@query(f"SELECT case_id, round(CASE WHEN b = 1 THEN -ln(0.3) ELSE -ln(0.7) END, 6) AS e FROM {CASES}")
def f8_bernoulli(spark, d):
    return rounded(cases(spark, d).select("case_id", N.bernoulli_energy(F.col("b"), F.lit(0.3)).alias("e")))


@query(f"SELECT case_id, round(x1 * x1 + x2, 6) AS v FROM {CASES}")
def f9_external(spark, d):
    @F.pandas_udf("double")
    def hyp(a, b):
        return a * a + b

    formulas.register("Hyp", hyp)
    c = cases(spark, d)
    return rounded(c.select("case_id", formulas.formula("Hyp(x1, x2)", c).alias("v")))


_SERIES = "CASE WHEN x2 = 0 THEN 0 ELSE list_sum([exp((2 * n + 1) * ln(x2) - (n + 1) * ln(2) - lgamma(n + 1.5) + 0.5 * ln(pi())) for n in range(60)]) END"


@query(f"SELECT case_id, round(-x2 * x2 / 2 - 0.5 * ln(2 * pi()), 6) AS log_phi, round(0.5 + exp(-x2 * x2 / 2) / sqrt(2 * pi()) * {_SERIES}, 6) AS cdf, round(0.5 - exp(-x2 * x2 / 2) / sqrt(2 * pi()) * {_SERIES}, 6) AS mirrored, round(x2, 6) AS back FROM {CASES}")
def f10_normal_functions(spark, d):
    x = F.col("x2")
    return rounded(cases(spark, d).select("case_id", N.log_phi(x).alias("log_phi"), N.normal_cdf(x).alias("cdf"), N.normal_cdf(-x).alias("mirrored"), N.normal_quantile(N.normal_cdf(x)).alias("back")))
