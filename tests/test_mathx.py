import math
import statistics

import duckdb
from pyspark.sql import functions as F

from equilens.functions import mathx as M


def test_known_values(spark):
    df = spark.createDataFrame([(1.96, 0.975)], "x double, p double")
    r = df.select(M.norm_cdf(F.col("x")).alias("c"), M.norm_ppf(F.col("p")).alias("q"),
                  M.two_sided_p(F.lit(1.96)).alias("pv")).first()
    assert abs(r["c"] - 0.9750021048517795) < 1e-15
    assert abs(r["q"] - 1.9599639845400536) < 1e-12
    assert abs(r["pv"] - 2 * (1 - 0.9750021048517795)) < 1e-15


def test_cdf_ppf_grid_against_python(spark):
    xs = [i / 10 for i in range(-90, 91, 7)]
    ps = [1e-9, 1e-4, 0.01, 0.2, 0.425, 0.5, 0.575, 0.8, 0.99, 0.9999, 1 - 1e-9]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for row in df.select("x", M.norm_cdf(F.col("x")).alias("c")).collect():
        assert abs(row["c"] - 0.5 * math.erfc(-row["x"] / math.sqrt(2))) < 1e-14
    dp = spark.createDataFrame([(p,) for p in ps], "p double")
    nd = statistics.NormalDist()
    for row in dp.select("p", M.norm_ppf(F.col("p")).alias("q")).collect():
        assert abs(row["q"] - nd.inv_cdf(row["p"])) < 1e-9 * max(1, abs(row["q"]))


def test_staged_versions_match(spark):
    df = spark.createDataFrame([(0.3, 0.7), (-2.5, 0.001), (8.0, 0.999)], "x double, p double")
    a = df.select(M.norm_cdf(F.col("x")).alias("c"), M.norm_ppf(F.col("p")).alias("q")).collect()
    b = M.with_norm_ppf(M.with_norm_cdf(df, {"c": "x"}), {"q": "p"}).select("c", "q").collect()
    assert a == b


def test_hash_uniform_matches_duckdb(spark):
    ids = list(range(0, 5000, 37))
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    s = {r["id"]: r["u"] for r in df.select("id", M.hash_uniform(42, "split", "id").alias("u")).collect()}
    con = duckdb.connect()
    d = dict(con.execute(f"SELECT i, {M.hash_uniform_sql(42, 'split', 'i')} FROM "
                         f"(SELECT unnest({ids}) AS i)").fetchall())
    assert s == d
    assert all(0 <= v < 1 for v in s.values())


def test_py_twin():
    assert abs(M.py_norm_cdf(1.96) - 0.9750021048517795) < 1e-15
    assert M.py_norm_cdf(-40) == 0.0
