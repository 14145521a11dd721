"""Queries of mixtures, trees, sources, particles and the monitor."""

from __future__ import annotations

from pyspark.sql import functions as F

from drawlake.functions.numeric import stratified_normal
from drawlake.operators import fields as C
from drawlake.operators import mixture as M
from drawlake.operators import particles as K
from drawlake.operators import tree as T
from drawlake.plans.base import query, rounded, table
from drawlake.sources.tables import scratch_path
from drawlake.streaming.monitor import monitored

_COMP = "(ascii(l_returnflag) * 2 + CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)"
_ASSIGN = f"(SELECT CAST(l_suppkey % 5 AS VARCHAR) AS log_id, CAST(l_suppkey AS BIGINT) AS idx, l_orderkey * 10 + l_linenumber AS case_id, CAST({_COMP} AS BIGINT) AS comp, l_quantity AS q FROM lineitem)"
_FREQ = f"(SELECT log_id, idx, comp, count(*) AS n FROM {_ASSIGN} GROUP BY ALL)"
_NAMES = f"(SELECT *, CAST(row_number() OVER (PARTITION BY log_id, idx ORDER BY n DESC, comp) AS INTEGER) AS new_comp FROM {_FREQ})"


def _assign(spark, d):
    comp = F.ascii("l_returnflag") * 2 + F.when(F.col("l_linestatus") == "O", 1).otherwise(0)
    return table(spark, d, "lineitem").select((F.col("l_suppkey") % 5).cast("string").alias("log_id"), F.col("l_suppkey").cast("long").alias("idx"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("case_id"), comp.cast("long").alias("comp"), F.col("l_quantity").alias("q"))


@query(f"SELECT * FROM {_FREQ}")
def m1_frequencies(spark, d):
    return M.frequencies(_assign(spark, d))


@query(f"SELECT * FROM {_NAMES}")
def m2_relabel(spark, d):
    return M.relabel(M.frequencies(_assign(spark, d)))


@query(f"WITH s AS (SELECT log_id, idx, new_comp, n / sum(n) OVER (PARTITION BY log_id, idx) AS s, sum(n) OVER (PARTITION BY log_id, idx ORDER BY new_comp) / sum(n) OVER (PARTITION BY log_id, idx) AS c FROM {_NAMES}) SELECT a.log_id, a.idx, a.new_comp, round(a.s, 6) AS share, round(a.c, 6) AS cumulative, (SELECT min(new_comp) FROM s b WHERE b.idx = a.idx AND b.log_id = a.log_id AND b.c >= 0.8 - 1e-12) AS needed FROM s a")
def m3_shares(spark, d):
    names = M.relabel(M.frequencies(_assign(spark, d)))
    return rounded(M.shares(names).join(M.components_needed(names, 20), M.DRAW))


_COMPS = "(SELECT 'm' AS log_id, CAST(n_nationkey % 5 AS BIGINT) AS idx, CAST(n_nationkey AS BIGINT) AS comp, CAST(v AS INTEGER) AS target, n_regionkey + v / 2.0 AS \"offset\", 0.5 + n_nationkey / 50.0 AS sd FROM nation CROSS JOIN range(2) r(v))"
_MCASES = "(SELECT c_custkey AS case_id, CAST(v AS INTEGER) AS target, CASE WHEN v = 0 THEN c_acctbal / 2500 WHEN c_custkey % 6 = 0 THEN NULL ELSE (c_custkey % 40) / 10.0 END AS t FROM customer CROSS JOIN range(2) r(v))"
_MWEIGHT = "(SELECT 'm' AS log_id, CAST(n_nationkey % 5 AS BIGINT) AS idx, CAST(n_nationkey AS BIGINT) AS comp, (1 + n_regionkey) / sum(1 + n_regionkey) OVER (PARTITION BY n_nationkey % 5) AS weight FROM nation)"
_DENS = f"(SELECT case_id, log_id, idx, comp, sum(coalesce(-pow(t - \"offset\", 2) / (2 * sd * sd) - ln(sd) - 0.5 * ln(2 * pi()), 0)) AS log_density FROM {_MCASES} JOIN {_COMPS} USING (target) GROUP BY ALL)"


def _comps(spark, d):
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    rows = table(spark, d, "nation").withColumn("v", F.explode(F.array(F.lit(0), F.lit(1))))
    return rows.select(F.lit("m").alias("log_id"), (n % 5).cast("long").alias("idx"), n.cast("long").alias("comp"), F.col("v").alias("target"), (r + F.col("v") / 2.0).alias("offset"), (0.5 + n / 50.0).alias("sd"))


def _mcases(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").withColumn("v", F.explode(F.array(F.lit(0), F.lit(1))))
    return rows.select(k.alias("case_id"), F.col("v").alias("target"), F.when(F.col("v") == 0, F.col("c_acctbal") / 2500).when(k % 6 != 0, (k % 40) / 10.0).alias("t"))


def _mweight(spark, d):
    freq = table(spark, d, "nation").select(F.lit("m").alias("log_id"), (F.col("n_nationkey") % 5).cast("long").alias("idx"), F.col("n_nationkey").cast("long").alias("comp"), (1 + F.col("n_regionkey")).cast("long").alias("n"))
    return M.weights(freq, 0.0, finite=5)


@query(f"SELECT a.log_id, a.idx, a.case_id, CAST(0 AS INTEGER) AS target, a.comp / 10.0 AS \"offset\", n FROM {_ASSIGN} a JOIN {_FREQ} f USING (log_id, idx, comp)")
def m4_case_values(spark, d):
    a = _assign(spark, d)
    f = M.frequencies(a)
    comps = f.select(*M.DRAW, "comp", F.lit(0).alias("target"), (F.col("comp") / 10.0).alias("offset"))
    return M.case_values(a, comps, f)


@query(f"WITH s AS (SELECT log_id, idx, sum(n) AS s FROM {_FREQ} GROUP BY ALL) SELECT log_id, idx, comp, round(n / (s + 2.5), 6) AS weight FROM {_FREQ} JOIN s USING (log_id, idx) UNION ALL SELECT log_id, idx, 0, round(2.5 / (s + 2.5), 6) FROM s")
def m5_weights(spark, d):
    return rounded(M.weights(M.frequencies(_assign(spark, d)), 2.5))


@query(f"SELECT case_id, log_id, idx, comp, round(weight * exp(log_density) / sum(weight * exp(log_density)) OVER (PARTITION BY case_id, log_id, idx), 6) AS p FROM {_DENS} JOIN {_MWEIGHT} USING (log_id, idx, comp)")
def m6_responsibilities(spark, d):
    return rounded(M.responsibilities(M.component_log_density(_mcases(spark, d), _comps(spark, d)), _mweight(spark, d)))


_OWN = "(SELECT 'm' AS log_id, CAST(k AS BIGINT) AS idx, c_custkey AS case_id, CAST(k + 5 * (c_custkey % 5) AS BIGINT) AS comp FROM customer CROSS JOIN range(5) r(k))"
_MFREQ = "(SELECT 'm' AS log_id, CAST(n_nationkey % 5 AS BIGINT) AS idx, CAST(n_nationkey AS BIGINT) AS comp, 1 + n_regionkey AS n FROM nation)"


@query(f"WITH r AS (SELECT d.case_id, log_id, idx, d.comp, (n - CASE WHEN o.comp = d.comp THEN 1 ELSE 0 END) * exp(log_density) AS l FROM {_DENS} d JOIN {_MFREQ} USING (log_id, idx, comp) JOIN {_OWN} o USING (log_id, idx, case_id)) SELECT case_id, log_id, idx, comp, round(l / sum(l) OVER (PARTITION BY case_id, log_id, idx), 6) AS p FROM r WHERE l > 0")
def m6_left_out(spark, d):
    n = F.col("n_nationkey")
    freq = table(spark, d, "nation").select(F.lit("m").alias("log_id"), (n % 5).cast("long").alias("idx"), n.cast("long").alias("comp"), (1 + F.col("n_regionkey")).cast("long").alias("n"))
    own = table(spark, d, "customer").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    own = own.select(F.lit("m").alias("log_id"), F.col("k").cast("long").alias("idx"), F.col("c_custkey").alias("case_id"), (F.col("k") + 5 * (F.col("c_custkey") % 5)).cast("long").alias("comp"))
    density = M.component_log_density(_mcases(spark, d), _comps(spark, d))
    return rounded(M.left_out_responsibilities(density, freq, own).where("p > 0"))


_Z20 = ", ".join(map(repr, stratified_normal(20)))
_HYPERS = "(SELECT 'm' AS log_id, CAST(r_regionkey AS BIGINT) AS idx, CAST(v AS INTEGER) AS target, 1 + r_regionkey / 4.0 + v AS mean, 0.5 + v / 4.0 AS hsd, 0.8 + r_regionkey / 10.0 AS noise FROM region CROSS JOIN range(2) r(v))"
_NEW_REAL = f"(SELECT case_id, log_id, idx, CAST(0 AS BIGINT) AS comp, sum(CASE WHEN t IS NULL THEN 0 ELSE ln(list_avg([exp(-pow(t - mean - hsd * z, 2) / (2 * noise * noise)) / (noise * sqrt(2 * pi())) for z in [{_Z20}]])) END) AS log_density FROM {_MCASES} JOIN {_HYPERS} USING (target) GROUP BY case_id, log_id, idx)"
_W_DRAWS = "(SELECT 'm' AS log_id, CAST(r_regionkey AS BIGINT) AS idx, 1 + r_regionkey / 2.0 AS w FROM region)"


def _hypers(spark, d):
    r, v = F.col("r_regionkey"), F.col("v")
    rows = table(spark, d, "region").withColumn("v", F.explode(F.array(F.lit(0), F.lit(1))))
    return rows.select(F.lit("m").alias("log_id"), r.cast("long").alias("idx"), v.alias("target"), (1 + r / 4.0 + v).alias("mean"), (0.5 + v / 4.0).alias("sd"), (0.8 + r / 10.0).alias("noise"))


def _weights_with_new(spark, d):
    n = F.col("n_nationkey")
    freq = table(spark, d, "nation").select(F.lit("m").alias("log_id"), (n % 5).cast("long").alias("idx"), (n + 1).cast("long").alias("comp"), (1 + F.col("n_regionkey")).cast("long").alias("n"))
    return M.weights(freq, 2.5)


def _draw_weights(spark, d):
    r = F.col("r_regionkey")
    return table(spark, d, "region").select(F.lit("m").alias("log_id"), r.cast("long").alias("idx"), (1 + r / 2.0).alias("w"))


# component numbers count from 1 here, as 0 is the new component
@query(f"""WITH s AS (SELECT n_nationkey % 5 AS idx, 2.5 + sum(1 + n_regionkey) AS s FROM nation GROUP BY 1),
w AS (SELECT 'm' AS log_id, idx, CAST(n_nationkey + 1 AS BIGINT) AS comp, (1 + n_regionkey) / s AS weight FROM nation JOIN s ON idx = n_nationkey % 5 UNION ALL SELECT 'm', idx, 0, 2.5 / s FROM s),
a AS (SELECT case_id, log_id, idx, comp + 1 AS comp, log_density FROM {_DENS} UNION ALL SELECT case_id, log_id, idx, comp, log_density FROM {_NEW_REAL})
SELECT case_id, round(ln(sum(w * weight * exp(log_density)) / (SELECT sum(w) FROM {_W_DRAWS})), 6) AS log_prob FROM a JOIN w USING (log_id, idx, comp) JOIN {_W_DRAWS} USING (log_id, idx) GROUP BY case_id""")
def m7_mixture_log_prob(spark, d):
    cases = _mcases(spark, d)
    known = M.component_log_density(cases, _comps(spark, d)).withColumn("comp", F.col("comp") + 1)
    new = M.new_component_log_density(cases, _hypers(spark, d), points=20)
    return rounded(M.mixture_log_prob(known, _weights_with_new(spark, d), _draw_weights(spark, d), new))


# noise of the new component averaged over its prior: a Student density, with a fixed noise where alpha is 0
_STUDENT = "CASE WHEN alpha = 0 THEN exp(-pow(t - mean - hsd * z, 2) / (2 * noise * noise)) / (noise * sqrt(2 * pi())) ELSE exp(lgamma((alpha + 1) / 2) - lgamma(alpha / 2)) / (sqrt(pi() * alpha) * noise) * pow(1 + pow((t - mean - hsd * z) / noise, 2) / alpha, -(alpha + 1) / 2) END"


@query(f"SELECT case_id, log_id, idx, CAST(0 AS BIGINT) AS comp, round(sum(CASE WHEN t IS NULL THEN 0 ELSE ln(l) END), 6) AS log_density FROM (SELECT case_id, log_id, idx, target, any_value(t) AS t, avg({_STUDENT}) AS l FROM {_MCASES} JOIN (SELECT *, idx * 1.5 AS alpha FROM {_HYPERS}) USING (target) CROSS JOIN (SELECT unnest([{_Z20}]) AS z) GROUP BY ALL) GROUP BY case_id, log_id, idx")
def m7_new_component(spark, d):
    hypers = _hypers(spark, d).withColumn("alpha", F.col("idx") * 1.5)
    return rounded(M.new_component_log_density(_mcases(spark, d), hypers, points=20))


_BCASES = "(SELECT c_custkey AS case_id, CAST(v AS INTEGER) AS target, CASE WHEN c_custkey % 7 = v THEN NULL WHEN v = 0 THEN CAST(c_acctbal > 4000 AS INTEGER) ELSE c_nationkey % 2 END AS t FROM customer CROSS JOIN range(2) r(v))"


@query(f"""WITH s AS (SELECT n_nationkey % 5 AS idx, 2.5 + sum(1 + n_regionkey) AS s FROM nation GROUP BY 1),
w AS (SELECT 'm' AS log_id, idx, CAST(n_nationkey + 1 AS BIGINT) AS comp, (1 + n_regionkey) / s AS weight FROM nation JOIN s ON idx = n_nationkey % 5 UNION ALL SELECT 'm', idx, 0, 2.5 / s FROM s),
a AS (SELECT case_id, log_id, idx, comp + 1 AS comp, sum(CASE WHEN t IS NULL THEN 0 ELSE -ln(1 + exp(CASE WHEN t = 0 THEN "offset" ELSE -"offset" END)) END) AS l FROM {_BCASES} JOIN {_COMPS} USING (target) GROUP BY ALL
UNION ALL SELECT case_id, log_id, idx, 0, sum(CASE WHEN t IS NULL THEN 0 ELSE ln(list_avg([1 / (1 + exp(CASE WHEN t = 0 THEN mean + hsd * z ELSE -mean - hsd * z END)) for z in [{_Z20}]])) END) FROM {_BCASES} JOIN {_HYPERS} USING (target) GROUP BY ALL)
SELECT case_id, round(ln(sum(weight * exp(l)) / 5), 6) AS log_prob FROM a JOIN w USING (log_id, idx, comp) GROUP BY case_id""")
def m7_binary_log_prob(spark, d):
    k, v = F.col("c_custkey"), F.col("v")
    rows = table(spark, d, "customer").withColumn("v", F.explode(F.array(F.lit(0), F.lit(1))))
    t = F.when(k % 7 != v, F.when(v == 0, (F.col("c_acctbal") > 4000).cast("long")).otherwise((F.col("c_nationkey") % 2).cast("long")))
    cases = rows.select(k.alias("case_id"), v.alias("target"), t.alias("t"))
    known = M.component_log_density(cases, _comps(spark, d), "binary").withColumn("comp", F.col("comp") + 1)
    new = M.new_component_log_density(cases, _hypers(spark, d), "binary", points=20)
    return rounded(M.mixture_log_prob(known, _weights_with_new(spark, d), new=new))


@query(f"SELECT log_id, idx, comp, CAST(0 AS INTEGER) AS target, count(*) AS n, round(avg(q / 10), 6) AS mean, round((2.0 / 4 + sum(q / 10) / 0.25) / (1 / 4.0 + count(*) / 0.25), 6) AS offset_mean, round(1 / (1 / 4.0 + count(*) / 0.25), 6) AS offset_variance FROM {_ASSIGN} GROUP BY ALL")
def m8_component_stats(spark, d):
    rows = _assign(spark, d).withColumn("case_id", F.struct("case_id", "q"))
    cases = rows.select("case_id").distinct().withColumn("target", F.lit(0)).withColumn("t", F.col("case_id.q") / 10)
    return rounded(M.component_stats(rows.drop("q"), cases, 2.0, 2.0, 0.5))


@query(f"SELECT log_id, idx, count(*) AS n, round(sum(pow(q / 10 - comp / 50.0, 2)), 4) AS squares, CAST(3 + count(*) AS DOUBLE) AS shape, round((3.0 + count(*)) / (3.0 * 0.25 + sum(pow(q / 10 - comp / 50.0, 2))), 6) AS precision FROM {_ASSIGN} GROUP BY log_id, idx")
def m8_pooled_noise(spark, d):
    rows = _assign(spark, d).withColumn("case_id", F.struct("case_id", "q"))
    cases = rows.select("case_id").distinct().withColumn("target", F.lit(0)).withColumn("t", F.col("case_id.q") / 10)
    comps = M.frequencies(rows).select(*M.DRAW, "comp", F.lit(0).alias("target"), (F.col("comp") / 50.0).alias("offset"))
    return rounded(M.pooled_noise(rows.drop("q"), cases, comps, 3.0, 0.5)).withColumn("squares", F.round("squares", 4))


@query("SELECT c_custkey AS case_id, round(ln(0.4 * CASE WHEN c_custkey % 2 = 1 THEN 0.9 ELSE 0.1 END * CASE WHEN c_nationkey % 2 = 1 THEN 0.2 ELSE 0.8 END + 0.6 * CASE WHEN c_custkey % 2 = 1 THEN 0.3 ELSE 0.7 END * CASE WHEN c_nationkey % 2 = 1 THEN 0.5 ELSE 0.5 END), 6) AS log_prob FROM customer")
def m9_known_mixture(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), (F.col("c_custkey") % 2).alias("b1"), (F.col("c_nationkey") % 2).alias("b2"))
    return rounded(M.bernoulli_mixture_log_prob(c, ["b1", "b2"], [(0.4, [0.9, 0.2]), (0.6, [0.3, 0.5])]).select("case_id", "log_prob"))


# trees: a heap of 31 nodes for each supplier; nodes from 16 are leaves (1 to 16), others have negative numbers
_NODES = "(SELECT s_suppkey AS tree, CASE WHEN h >= 16 THEN h - 15 ELSE -h END AS node, CASE WHEN h = 1 THEN 0 ELSE -(h // 2) END AS parent, CASE WHEN h >= 16 THEN 1.0 ELSE floor(log2(h)) / 5 + 0.1 + (s_suppkey % 7) / 100.0 END AS divt, h FROM supplier CROSS JOIN range(1, 32) r(h))"
_ANC = f"(SELECT n.tree, n.node, -(n.h >> k) AS ancestor, k AS hops, n.h FROM {_NODES} n CROSS JOIN (SELECT CAST(g AS INTEGER) AS k FROM range(1, 5) q(g)) WHERE (n.h >> k) >= 1)"


def _nodes(spark, d):
    h = F.col("h")
    rows = table(spark, d, "supplier").withColumn("h", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(31).cast("long"))))
    time = F.when(h >= 16, 1.0).otherwise(F.floor(F.log2(h) + 1e-9) / 5 + 0.1 + (F.col("s_suppkey") % 7) / 100.0)
    return rows.select(F.col("s_suppkey").alias("tree"), F.when(h >= 16, h - 15).otherwise(-h).alias("node"), F.when(h == 1, 0).otherwise(-F.shiftright(h, 1)).alias("parent"), time.alias("divt"))


@query(f"SELECT tree, node, ancestor, CAST(hops AS BIGINT) AS hops FROM {_ANC}")
def t1_ancestors(spark, d):
    return T.ancestors(_nodes(spark, d))


@query(f"WITH l AS (SELECT tree, ancestor AS node, count(*) AS leaves FROM {_ANC} WHERE node > 0 GROUP BY tree, ancestor), c AS (SELECT n.tree, n.parent, n.node, coalesce(l.leaves, 1) AS leaves FROM {_NODES} n LEFT JOIN l USING (tree, node) WHERE parent <> 0) SELECT tree, parent AS node, count(*) AS children, CAST(sum(leaves) AS BIGINT) AS leaves, [CAST(x AS BIGINT) for x in list(leaves ORDER BY node)] AS by_child FROM c GROUP BY tree, parent")
def t2_node_table(spark, d):
    return T.node_table(T.tour(_nodes(spark, d))).withColumn("by_child", F.col("by_child.leaves"))


@query(f"SELECT tree, node AS leaf, CAST(max(hops) AS BIGINT) AS depth FROM {_ANC} WHERE node > 0 GROUP BY tree, node")
def t3_leaf_depth(spark, d):
    return T.leaf_depths(T.tour(_nodes(spark, d)))


@query(f"SELECT tree, round(avg(depth), 6) AS average, CAST(max(depth) AS BIGINT) AS deepest FROM (SELECT tree, node, max(hops) AS depth FROM {_ANC} WHERE node > 0 GROUP BY tree, node) GROUP BY tree")
def t3_depth_summary(spark, d):
    return rounded(T.depth_summary(T.leaf_depths(T.tour(_nodes(spark, d)))))


@query(f"SELECT tree, round(avg(divt), 6) AS mean_divt, [round(x, 6) for x in list_slice(list(divt ORDER BY divt, node), 1, 3)] AS earliest FROM {_NODES} WHERE node < 0 GROUP BY tree")
def t4_divergence_times(spark, d):
    s = T.divergence_summary(_nodes(spark, d), 3)
    return rounded(s).withColumn("earliest", F.transform("earliest", lambda x: F.round(x, 6)))


def _asked(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("tree"), (1 + F.col("s_suppkey") % 16).alias("a"), (1 + (F.col("s_suppkey") * 7) % 16).alias("b"), (1 + (F.col("s_suppkey") * 5 + 3) % 16).alias("c"))


_ASKED = "(SELECT s_suppkey AS tree, 1 + s_suppkey % 16 AS a, 1 + (s_suppkey * 7) % 16 AS b, 1 + (s_suppkey * 5 + 3) % 16 AS c FROM supplier)"
_LCA = f"(SELECT q.tree, q.a, q.b, CASE WHEN q.a = q.b THEN 1.0 ELSE (SELECT max(n.divt) FROM {_ANC} x JOIN {_ANC} y ON x.tree = y.tree AND x.ancestor = y.ancestor JOIN {_NODES} n ON n.tree = x.tree AND n.node = x.ancestor WHERE x.tree = q.tree AND x.node = q.a AND y.node = q.b) END AS divt FROM @asked q)"


@query(f"SELECT tree, a, b, round(divt, 6) AS divt FROM {_LCA.replace('@asked', _ASKED)}")
def t5_common_ancestor(spark, d):
    return rounded(T.common_ancestor(_asked(spark, d).select("tree", "a", "b"), T.tour(_nodes(spark, d))))


@query(f"SELECT q.tree, q.a, q.b, q.c, ab.divt > ac.divt AS closer FROM {_ASKED} q JOIN {_LCA.replace('@asked', _ASKED)} ab ON ab.tree = q.tree JOIN {_LCA.replace('@asked', '(SELECT tree, a, c AS b FROM ' + _ASKED + ')')} ac ON ac.tree = q.tree")
def t6_triples(spark, d):
    return T.triples(_asked(spark, d), T.tour(_nodes(spark, d)))


@query(f"SELECT tree, node AS leaf, CAST(-(h >> 2) AS BIGINT) AS cluster FROM {_NODES} WHERE node > 0")
def t7_cut(spark, d):
    return T.cut(_nodes(spark, d), 0.4)


@query(f"SELECT tree, node, round(0.5 * divt - ln(1 - divt) + 0.25 * (1 / (1 - divt) - 1), 6) AS e, round(divt, 6) AS back FROM {_NODES} WHERE node < 0")
def t8_divergence_function(spark, d):
    e = T.cumulative_divergence(F.col("divt"), 0.5, 1.0, 0.25)
    return rounded(_nodes(spark, d).where("node < 0").select("tree", "node", e.alias("e"), T.inverse_divergence(e, 0.5, 1.0, 0.25).alias("back")))


@query(f"SELECT n.tree, round(sum(ln(1 / (1 - n.divt)) - (SELECT sum(1.0 / i) FROM range(1, CAST(16 / pow(2, floor(log2(n.h))) AS BIGINT)) r(i)) * (-ln(1 - n.divt) + ln(1 - coalesce(p.divt, 0)))), 6) AS log_prob FROM {_NODES} n LEFT JOIN {_NODES} p ON p.tree = n.tree AND p.node = n.parent WHERE n.node < 0 GROUP BY n.tree")
def t9_divergence_log_prob(spark, d):
    return rounded(T.divergence_log_prob(T.tour(_nodes(spark, d)), 0.0, 1.0, 0.0))


@query(f"SELECT tree, node AS leaf, round(4 * ln(0.5), 6) AS log_prob FROM {_NODES} WHERE node > 0")
def t10_path_log_prob(spark, d):
    n = _nodes(spark, d)
    return rounded(T.path_log_prob(n, T.tour(n)))


_SRC = "(SELECT CAST(s_nationkey % 3 AS VARCHAR) AS log_id, CAST(s_nationkey AS BIGINT) AS idx, s_suppkey AS src, (s_suppkey % 40) / 4.0 AS x, (s_suppkey % 9) / 3.0 AS y, (s_suppkey % 5) / 5.0 AS z, 1 + abs(s_acctbal) / 1000 AS q, (s_suppkey % 7) / 1.0 AS start, (s_suppkey % 7) / 1.0 + 5 AS stop, 2.0 AS u FROM supplier)"
_REC = "(SELECT c_custkey AS receptor, (c_custkey % 60) / 4.0 - 5 AS x, (c_custkey % 7) / 2.0 AS y, 0.5 AS z, 6.0 AS t FROM customer)"
# source at (x, y, z), receptor r downwind where s.x > r.x; density n(v) = exp(-v^2/2) / sqrt(2 pi)
_PLUMES = f"""(SELECT s.*, r.receptor, r.t, s.x - r.x AS xd, 0.12 * (s.x - r.x) / sqrt(1 + 0.05 * (s.x - r.x)) AS sy, 0.1 * (s.x - r.x) / sqrt(1 + 0.02 * (s.x - r.x)) AS sz, s.y - r.y AS yd, s.z - r.z AS down, s.z + r.z AS mirror FROM {_SRC} s JOIN {_REC} r ON s.x > r.x)"""
_PLUME = "(exp(-pow(yd / sy, 2) / 2) / sy * (exp(-pow(down / sz, 2) / 2) + exp(-pow(mirror / sz, 2) / 2)) / sz / (2 * pi()) / u)"
_FLOW = C.Flow(0.12, 0.05, 0.1, 0.02)


def _sources(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select((F.col("s_nationkey") % 3).cast("string").alias("log_id"), F.col("s_nationkey").cast("long").alias("idx"), k.alias("src"), ((k % 40) / 4.0).alias("x"), ((k % 9) / 3.0).alias("y"), ((k % 5) / 5.0).alias("z"), (1 + F.abs("s_acctbal") / 1000).alias("q"), ((k % 7) / 1.0).alias("start"), ((k % 7) / 1.0 + 5).alias("stop"), F.lit(2.0).alias("u"))


def _receptors(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("receptor"), ((k % 60) / 4.0 - 5).alias("x"), ((k % 7) / 2.0).alias("y"), F.lit(0.5).alias("z"), F.lit(6.0).alias("t"))


@query(f"SELECT src, round(sum({_PLUME}), 6) AS total, round(max({_PLUME}), 6) AS peak FROM {_PLUMES} GROUP BY src UNION ALL SELECT src, 0, 0 FROM {_SRC} WHERE x <= (SELECT min(x) FROM {_REC})")
def c1_plume(spark, d):
    return rounded(C.source_plume(_sources(spark, d), _receptors(spark, d), _FLOW))


_TOTAL = f"(SELECT a.log_id, a.idx, a.receptor, coalesce(sum({_PLUME} * sqrt(q)) FILTER (WHERE 6 - xd / 2 >= start AND 6 - xd / 2 <= stop), 0) AS total FROM (SELECT DISTINCT log_id, idx, receptor FROM {_SRC} CROSS JOIN {_REC}) a LEFT JOIN {_PLUMES} p ON p.log_id = a.log_id AND p.idx = a.idx AND p.receptor = a.receptor GROUP BY ALL)"


def _totals(spark, d):
    return C.receptor_total(_sources(spark, d), _receptors(spark, d), _FLOW, power=2.0, timed=True)


@query(f"SELECT log_id, idx, receptor, round(total, 6) AS total FROM {_TOTAL}")
def c2_receptor_total(spark, d):
    return rounded(_totals(spark, d))


_Z101 = ", ".join(map(repr, stratified_normal(101)))
_PICK = "round((list_extract(v, len(v) // 2 + 1) + list_extract(v, (len(v) - 1) // 2 + 1)) / 2, 6) AS median, " + ", ".join(f"round(list_extract(v, CAST(floor(0.5 + {f} * len(v)) AS BIGINT) + 1), 6) AS q{a}, round(list_extract(v, len(v) - CAST(floor(0.5 + {f} * len(v)) AS BIGINT)), 6) AS q{b}" for f, a, b in ((0.1, 10, 90), (0.01, "01", 99)))


# far from what was observed likelihoods underflow, so they are averaged relative to the largest of a receptor
@query(f"""WITH g AS (SELECT t.*, exp(-2 + idx / 20.0) AS sd, (receptor % 9) / 20.0 AS value FROM {_TOTAL} t),
l AS (SELECT *, -pow((value - total) / sd, 2) / 2 - ln(sd) - 0.5 * ln(2 * pi()) AS l FROM g), p AS (SELECT *, max(l) OVER (PARTITION BY receptor) AS top FROM l),
v AS (SELECT receptor, list_sort(flatten(list([total + sd * z for z in [{_Z101}]]))) AS v FROM p GROUP BY receptor)
SELECT p.receptor, round(avg(total), 6) AS mean, CASE WHEN p.receptor % 4 > 0 THEN round(any_value(top) + ln(avg(exp(l - top))), 6) END AS log_prob, any_value(m.median) AS median, any_value(m.q10) AS q10, any_value(m.q90) AS q90, any_value(m.q01) AS q01, any_value(m.q99) AS q99
FROM p JOIN (SELECT receptor, {_PICK} FROM v) m USING (receptor) GROUP BY p.receptor""")
def c3_detector_prediction(spark, d):
    draws = _sources(spark, d).select("log_id", "idx", (-2 + F.col("idx") / 20.0).alias("log_width")).distinct()
    k = F.col("c_custkey")
    observed = table(spark, d, "customer").select(k.alias("receptor"), F.when(k % 4 > 0, (k % 9) / 20.0).alias("value"))
    return rounded(C.detector_prediction(_totals(spark, d), draws, observed))


@query(f"""WITH w AS (SELECT DISTINCT log_id, idx, 1 + idx / 10.0 AS w FROM {_SRC}), c AS (SELECT least(floor(6 * x / 9.75), 5) AS a, least(floor(4 * y / (8 / 3.0)), 3) AS b, start, stop, w * q AS v FROM {_SRC} JOIN w USING (log_id, idx))
SELECT CAST(i AS INTEGER) AS x_cell, CAST(j AS INTEGER) AS y_cell, CAST(k AS INTEGER) AS t_cell, round(coalesce(sum(v * greatest(1 - (greatest(start - 2.4 * k, 0) + greatest(2.4 * (k + 1) - stop, 0)) / 2.4, 0)), 0) / (SELECT sum(w) FROM w), 6) AS intensity FROM range(6) p(i) CROSS JOIN range(4) q(j) CROSS JOIN range(5) r(k) LEFT JOIN c ON a = i AND b = j GROUP BY i, j, k""")
def c4_intensity_grid(spark, d):
    s = _sources(spark, d)
    w = s.select("log_id", "idx", (1 + F.col("idx") / 10.0).alias("w")).distinct()
    return rounded(C.intensity_grid(s, w, {"x": (0.0, 9.75, 6), "y": (0.0, 8 / 3.0, 4)}, times=(12.0, 5)))


@query(f"SELECT log_id, idx, count(*) AS n, round(sum(q), 6) AS total_q, round(max(q), 6) AS max_q, [round(x, 6) for x in list_reverse_sort(list(q))] AS sorted_q, round(sum(q * 5), 6) AS released, CAST(5 AS DOUBLE) AS mean_duration FROM (SELECT * REPLACE (sqrt(q) AS q) FROM {_SRC}) GROUP BY ALL")
def c5_source_quantities(spark, d):
    return rounded(C.source_quantities(_sources(spark, d), 2.0)).withColumn("sorted_q", F.transform("sorted_q", lambda x: F.round(x, 6)))


# particles: each three parts of an embedding are a molecule, configurations by label and id
_MOLS = "(SELECT CAST(label AS VARCHAR) AS log_id, vec_id // 50 AS idx, vec_id * 1000 + k AS mol, [CAST(embedding[3 * k + i] AS DOUBLE) - floor(CAST(embedding[3 * k + i] AS DOUBLE)) for i in [1, 2, 3]] AS c, 4.0 AS len FROM (SELECT *, unnest(range(len(embedding) // 3)) AS k FROM embeddings))"
_DIST = f"(SELECT a.log_id, a.idx, a.mol AS i, b.mol AS j, 16 * list_sum([pow(a.c[k] - b.c[k] - round(a.c[k] - b.c[k]), 2) for k in [1, 2, 3]]) AS d2 FROM {_MOLS} a JOIN {_MOLS} b ON a.log_id = b.log_id AND a.idx = b.idx AND a.mol < b.mol)"
# the same with one configuration for each label
_BIG = f"(SELECT * REPLACE (CAST(0 AS BIGINT) AS idx) FROM {_MOLS})"


def _mols(spark, d):
    e = table(spark, d, "embeddings")
    e = e.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.size("embedding") / 3).cast("int") - 1)))
    c = F.transform(F.slice("embedding", 3 * F.col("k") + 1, 3), lambda x: x.cast("double") - F.floor(x.cast("double")))
    return e.select(F.col("label").cast("string").alias("log_id"), F.floor(F.col("vec_id") / 50).alias("idx"), (F.col("vec_id") * 1000 + F.col("k")).alias("mol"), c.alias("c"), F.lit(4.0).alias("len"))


@query(f"SELECT mol, [round(4 * (x + 0.5 - floor(x + 0.5)), 6) for x in c] AS c FROM {_MOLS}")
def k1_wrapped(spark, d):
    return _mols(spark, d).select("mol", F.transform(K.wrapped(F.col("c"), F.col("len"), half=True), lambda x: F.round(x, 6)).alias("c"))


@query(f"SELECT log_id, idx, i, j, round(d2, 6) AS d2 FROM {_DIST}")
def k2_pair_distances(spark, d):
    return rounded(K.pairs(_mols(spark, d)).drop("len"))


@query(f"WITH b AS (SELECT log_id, idx, i AS mol, d2 FROM {_DIST} UNION ALL SELECT log_id, idx, j, d2 FROM {_DIST}) SELECT log_id, idx, mol, round(sqrt(min(d2)), 6) AS nearest, round(sqrt(max(d2)), 6) AS farthest FROM b GROUP BY ALL")
def k3_neighbours(spark, d):
    return rounded(K.every_neighbour(_mols(spark, d)))


@query(f"SELECT a.log_id, CAST(0 AS BIGINT) AS idx, round(sqrt(min(d2)), 6) AS nearest, round(sqrt(max(d2)), 6) AS farthest FROM (SELECT a.log_id, 16 * (pow(a.x - b.x - round(a.x - b.x), 2) + pow(a.y - b.y - round(a.y - b.y), 2) + pow(a.z - b.z - round(a.z - b.z), 2)) AS d2 FROM (SELECT *, c[1] AS x, c[2] AS y, c[3] AS z FROM {_BIG}) a JOIN (SELECT *, c[1] AS x, c[2] AS y, c[3] AS z FROM {_BIG}) b ON a.log_id = b.log_id AND a.mol < b.mol) a GROUP BY ALL")
def k3_extremes(spark, d):
    mols = _mols(spark, d).withColumn("idx", F.lit(0).cast("long"))
    return rounded(K.pair_extremes(mols))


@query(f"SELECT log_id, idx, round(sum(least(4 * (1 / pow(d2, 6) - 1 / pow(d2, 3)), 10)), 6) AS energy FROM {_DIST} GROUP BY ALL")
def k4_energy(spark, d):
    return rounded(K.energy(K.pairs(_mols(spark, d)), 10.0))


@query(f"SELECT log_id, idx, round(sum(least(4 * (1 / pow(d2, 6) - 1 / pow(d2, 3)), 10)), 6) AS energy FROM {_DIST} WHERE d2 <= 1.21 GROUP BY ALL")
def k4_energy_within(spark, d):
    """Energy of the pairs at most 1.1 apart, found by cells."""
    return rounded(K.energy(K.pairs_within(_mols(spark, d), 1.1), 10.0))


@query(f"WITH n AS (SELECT log_id, idx, count(*) AS n FROM {_MOLS} GROUP BY ALL), v AS (SELECT log_id, idx, sum(CASE WHEN 4 * (1 / pow(d2, 6) - 1 / pow(d2, 3)) >= 10 THEN 0 ELSE 24 * (2 / pow(d2, 6) - 1 / pow(d2, 3)) END) AS v FROM {_DIST} GROUP BY ALL) SELECT log_id, idx, round(v, 6) AS virial, CAST(64 AS DOUBLE) AS volume, round(n / 64, 6) AS density, round((n * 1.5 + v / 3) / 64, 6) AS pressure FROM n JOIN v USING (log_id, idx)")
def k5_pressure(spark, d):
    m = _mols(spark, d)
    return rounded(K.pressure(K.pairs(m), m, 1.5, 10.0))


@query("SELECT user_id, event_type, count(*) AS n, max(event_id) AS last, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY ALL")
def w1_monitor(spark, d):
    """A stream over the event files, whatever their number: the pattern names a file as well as a folder of files."""
    schema = table(spark, d, "events").schema
    return rounded(monitored(spark, f"{d}/events.parque[t]", schema, ["user_id", "event_type"], "event_id", "value", scratch_path(spark, "monitor")))
