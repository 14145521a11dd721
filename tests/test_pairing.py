from pyspark.sql import functions as F

from drawlake.operators import pairing


def test_wide_rows_are_not_broadcast(spark, monkeypatch):
    """Few rows of many bytes go in blocks, and the pairs stay the same."""
    left = spark.range(7).withColumnRenamed("id", "a")
    right = spark.range(30).select(F.col("id").alias("b"), F.array_repeat(F.lit(1.0), 100).alias("v"), F.repeat(F.lit("x"), 50).alias("s"))
    assert pairing.measured(right) == (30, 30 * (8 + 800 + 50)) and pairing.measured(right.limit(0)) == (0, 0)
    want = sorted((a, b) for a in range(7) for b in range(30))
    for most in (pairing.MOST_BYTES, 3000):
        monkeypatch.setattr(pairing, "MOST_BYTES", most)
        assert sorted((r.a, r.b) for r in pairing.paired(left, right).collect()) == want
        assert sorted((r.a, r.b) for r in pairing.paired(left, right, F.col("a") < F.col("b")).collect()) == [(a, b) for a, b in want if a < b]
        assert pairing.paired(left, right.limit(0)).count() == 0
