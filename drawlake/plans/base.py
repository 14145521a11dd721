"""Registration of queries and the derived inputs they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: Column) -> Column:
    return F.round(x, 6) + 0.0


def rounded(df: DataFrame) -> DataFrame:
    """Doubles rounded to six places, for comparison with SQL."""
    return df.select(*[r6(F.col(f"`{c}`")).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


# draws from orders: four logs by customer, price in 100 000 as value, its tenth as log weight
DRAWS = "(SELECT CAST(o_custkey % 4 AS VARCHAR) AS log_id, o_orderkey AS idx, o_totalprice / 100000 AS value, o_totalprice / 1000000 AS log_weight, o_custkey, o_orderpriority FROM orders)"
# iteration records: inverse temperature by priority, cpu time from the date
ITERS = "(SELECT CAST(o_custkey % 4 AS VARCHAR) AS log_id, o_orderkey AS idx, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 1.0 WHEN '2' THEN 0.75 WHEN '3' THEN 0.5 WHEN '4' THEN 0.25 ELSE 0.125 END AS inv_temp, o_orderkey * 700 AS time_ms FROM orders)"
SERIES = "(SELECT user_id AS realization, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, value / 10 AS value FROM events)"
# cases from customers, draws of a linear model from nations
CASES = "(SELECT c_custkey AS case_id, c_acctbal / 1000 AS x1, (c_custkey % 17) / 10.0 AS x2, (c_acctbal / 2000 + (c_custkey % 7) / 5.0) AS t, CASE WHEN c_acctbal > 4000 THEN 1.0 ELSE 0.0 END AS b FROM customer)"
NETS = "(SELECT 'n' AS log_id, CAST(n_nationkey AS BIGINT) AS idx, 0.4 + n_nationkey / 100.0 AS w1, (n_nationkey % 5) / 10.0 AS w2, 0.1 + n_regionkey / 10.0 AS bias, 0.5 + n_regionkey / 5.0 AS sd, n_nationkey / 10.0 AS log_weight FROM nation)"
PAIRS = f"(SELECT c.*, d.log_id, d.idx, d.sd, d.log_weight, d.bias + d.w1 * c.x1 + d.w2 * c.x2 AS o, exp(d.log_weight - 2.4) AS w FROM {CASES} c CROSS JOIN {NETS} d)"


def draws(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select((F.col("o_custkey") % 4).cast("string").alias("log_id"), F.col("o_orderkey").alias("idx"), (F.col("o_totalprice") / 100000).alias("value"), (F.col("o_totalprice") / 1000000).alias("log_weight"), "o_custkey", "o_orderpriority")


def iters(spark: SparkSession, d: str) -> DataFrame:
    level = F.substring("o_orderpriority", 1, 1)
    temp = F.when(level == "1", 1.0).when(level == "2", 0.75).when(level == "3", 0.5).when(level == "4", 0.25).otherwise(0.125)
    return table(spark, d, "orders").select((F.col("o_custkey") % 4).cast("string").alias("log_id"), F.col("o_orderkey").alias("idx"), temp.alias("inv_temp"), (F.col("o_orderkey") * 700).alias("time_ms"))


def series(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("realization"), F.row_number().over(w).cast("long").alias("t"), (F.col("value") / 10).alias("value"))


def cases(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("case_id"), (F.col("c_acctbal") / 1000).alias("x1"), ((k % 17) / 10.0).alias("x2"), (F.col("c_acctbal") / 2000 + (k % 7) / 5.0).alias("t"), F.when(F.col("c_acctbal") > 4000, 1.0).otherwise(0.0).alias("b"))


def nets(spark: SparkSession, d: str) -> DataFrame:
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    return table(spark, d, "nation").select(F.lit("n").alias("log_id"), n.cast("long").alias("idx"), (0.4 + n / 100.0).alias("w1"), ((n % 5) / 10.0).alias("w2"), (0.1 + r / 10.0).alias("bias"), (0.5 + r / 5.0).alias("sd"), (n / 10.0).alias("log_weight"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    from drawlake.operators.predict import cross

    rows = cross(cases(spark, d), nets(spark, d))
    return rows.withColumn("o", F.col("bias") + F.col("w1") * F.col("x1") + F.col("w2") * F.col("x2")).withColumn("w", F.exp(F.col("log_weight") - 2.4))
