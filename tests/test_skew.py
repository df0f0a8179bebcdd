from pyspark.sql import functions as F

from fixloom.operators.skew import hot_keys, per_key_totals, salted_join


def test_totals_match_group_by(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 400).cast("string"))).alias("key"), F.when(F.col("id") % 5 > 0, F.col("id") % 50).alias("v"), (F.col("id") % 2 == 0).alias("flag"), F.lit(1).alias("n_rows"), F.lit("x").alias("_key"))
    got = {tuple(r) for r in per_key_totals(df, "key", F.col("v"), {"m": F.col("flag")}).collect()}
    want = {tuple(r) for r in df.groupBy("key").agg(F.count("*"), F.countDistinct("v"), F.sum(F.col("flag").cast("long"))).collect()}
    assert got == want
    assert per_key_totals(df.limit(0), "key", F.col("v"), {"m": F.col("flag")}).count() == 0
    assert [r.key for r in hot_keys(df, "key", 0.3).collect()] == ["hot"]


def test_salted_join(spark):
    rows = spark.range(2000).select("id", F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") == 1, None).otherwise(F.col("id").cast("string")).alias("k"))
    small = spark.createDataFrame([("hot", 1), ("3", 2), ("none", 3)], "k string, v int")
    for how in ("left", "inner"):
        a = salted_join(rows, small, "k", F.col("id"), how).select("id", "k", "v")
        b = rows.join(small, "k", how).select("id", "k", "v")
        assert a.count() == b.count() and a.exceptAll(b).isEmpty()
    assert salted_join(rows.limit(0), small, "k", F.col("id")).count() == 0


def test_totals_of_input_splits(spark):
    """Without distinct values: one reduction, sums beyond 2**53 exact, NULL a key, thousands of keys in slices."""
    big = 2**60 + 1
    df = spark.range(60_000, numPartitions=5).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 1000 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 25_000)).alias("k"), F.when(F.col("id") == 4, big).otherwise(F.lit(1)).alias("v"), F.lit("x").alias("_key"))
    got = {r.k: (r.n_rows, r.s) for r in per_key_totals(df, "k", None, {"s": F.col("v")}).collect()}
    want = {r.k: (r.n, r.s) for r in df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s")).collect()}
    assert got == want and len(want) > 15_000 and max(s for _, s in want.values()) > 2**60
    assert per_key_totals(df.limit(0), "k", None, {}).count() == 0
