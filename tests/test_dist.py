import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from equilens.operators import dist


def test_exact_kth_and_median_with_narrowing(spark):
    rnd = random.Random(3)
    vals = [float(rnd.randint(0, 300)) for _ in range(5001)] + [7.0] * 2000   # heavy tie
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    s = sorted(vals)
    got = dist.exact_kth(df, "x", [0, 1234, 3500, len(s) - 1], local_max=500, splits=16)
    assert got == [s[0], s[1234], s[3500], s[-1]]
    assert dist.exact_median(df, "x") == float(np.median(vals))
    even = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (20.0,)], "x double")
    assert dist.exact_medians(even, ["x"])["x"] == 6.0


def test_k_smallest_equals_row_number(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["a", "b", "c"]), rnd.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "row_id long, s string, u double")
    quotas = spark.createDataFrame([("a", 100), ("b", 0), ("c", 5000)], "s string, quota long")
    got = {r[0] for r in dist.k_smallest(df, ["s"], quotas, "u").select("row_id").collect()}
    w = Window.partitionBy("s").orderBy("u", "row_id")
    exp = {r[0] for r in df.join(quotas, "s").withColumn("rn", F.row_number().over(w))
           .where("rn <= quota").select("row_id").collect()}
    assert got == exp
    flagged = dist.k_smallest_flag(df, ["s"], quotas, "u")
    assert flagged.count() == 3000


def test_bucket_prefix_matches_cumsum(spark):
    rnd = random.Random(7)
    vals = [(float(rnd.randint(0, 50)), float(rnd.gauss(0, 1))) for _ in range(4000)]
    df = spark.createDataFrame(vals, "a double, b double")
    long = dist.bucketed_long(df, ["a", "b"], splits=8)
    hist = long.groupBy("feature", "__b", "value").agg(F.count(F.lit(1)).alias("cnt"))
    pc = dist.bucket_prefix(hist, ["feature"], "value", ["cnt"]).toPandas()
    for f, g in pc.groupby("feature"):
        g = g.sort_values("value")
        assert (g["cnt_before"].to_numpy() == (g["cnt"].cumsum() - g["cnt"]).to_numpy()).all()


def test_asof_lookup_with_hot_entry(spark):
    # entries tile [0, 1000): one entry holds 600 positions (a hot value)
    table = spark.createDataFrame([(0, 0, 100, "a"), (0, 100, 600, "hot"), (0, 700, 300, "z")],
                                  "p int, start long, len long, v string")
    totals = spark.createDataFrame([(0, 1000)], "p int, total long")
    probes = spark.createDataFrame([(0, i) for i in range(0, 1000, 7)], "p int, pos long")
    dist.ASOF_BUCKET_ROWS, old = 10, dist.ASOF_BUCKET_ROWS
    try:
        out = dist.asof_lookup(probes, table, ["p"], "pos", "start", "len", ["v"], totals).collect()
    finally:
        dist.ASOF_BUCKET_ROWS = old
    exp = {i: ("a" if i < 100 else "hot" if i < 700 else "z") for i in range(0, 1000, 7)}
    assert {r["pos"]: r["v"] for r in out} == exp


def test_sample_n_is_deterministic(spark):
    df = spark.range(5000).withColumnRenamed("id", "row_id")
    a = sorted(r[0] for r in dist.sample_n(df, 123, 9).collect())
    b = sorted(r[0] for r in dist.sample_n(df.repartition(7), 123, 9).collect())
    assert a == b and len(a) == 123


def test_small_lookup_equals_asof_lookup(spark):
    nan = float("nan")
    for sizes in ([5], [1, 900, 1, 2, 96], [3] * 50):
        starts = [sum(sizes[:i]) for i in range(len(sizes))]
        values = [nan if i == 3 else -1.5 * i for i in range(len(sizes))]
        table = spark.createDataFrame([(0, s, n, v) for s, n, v in zip(starts, sizes, values)], "p int, start long, len long, v double")
        probes = spark.range(sum(sizes)).select(F.lit(0).alias("p"), F.col("id").alias("pos"))
        totals = spark.createDataFrame([(0, sum(sizes))], "p int, total long")
        want = dist.asof_lookup(probes, table, ["p"], "pos", "start", "len", ["v"], totals)
        got = dist.small_lookup(probes, table, "pos", "start", ["v"])
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
