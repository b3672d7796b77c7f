import tempfile

from pyspark.sql import functions as F

import __spark_entry__ as E
from equilens.streaming import monitor

from paths import SF001


def test_monitor_matches_batch(spark):
    out = tempfile.mkdtemp(prefix="eq-stream-") + "/verdicts"
    q = monitor.start_monitor(monitor.decisions_stream(spark, SF001), ["c_mktsegment", "r_name", "n_name"],
                              out, "orders_lines", checkpoint=out + "_ckpt")
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    last = got.agg(F.max("batch_id")).first()[0]
    s = {r["sensitive"]: r for r in got.where(F.col("batch_id") == last).collect()}
    b = {r["sensitive"]: r for r in E.queries()["fairness_orders"](spark, SF001).collect()}
    assert set(s) == set(b)
    for k in b:
        assert s[k]["priv"] == b[k]["priv"] and abs(s[k]["dpd"] - b[k]["dpd"]) < 1e-6


def test_windowed_counts_plan(spark):
    w = monitor.windowed_counts(monitor.decisions_stream(spark, SF001), ["r_name"], window="90 days")
    assert w.isStreaming


def test_windowed_monitor_matches_batch_per_window(spark):
    from equilens.operators import fairness as fx
    from equilens.sources.tables import read_table
    out = tempfile.mkdtemp(prefix="eq-wstream-") + "/verdicts"
    q = monitor.start_monitor(monitor.decisions_stream(spark, SF001), ["r_name"], out, "lines",
                              checkpoint=out + "_ckpt", windowed=True, window="365 days",
                              watermark="0 seconds")
    q.awaitTermination(300)
    got = {r["dataset"]: r for r in spark.read.parquet(out).collect()}
    assert got, "no closed window was emitted"
    # batch twin: the same rows, the window start as the dataset label, all windows at once
    li = read_table(spark, SF001, "lineitem", ["l_orderkey", "l_shipdate", "l_returnflag", "l_discount"])
    o = read_table(spark, SF001, "orders", ["o_orderkey", "o_custkey"])
    c = read_table(spark, SF001, "customer", ["c_custkey", "c_nationkey"])
    n = read_table(spark, SF001, "nation", ["n_nationkey", "n_regionkey"])
    r = read_table(spark, SF001, "region", ["r_regionkey", "r_name"])
    j = (li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey)
           .join(n, F.col("c_nationkey") == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey))
    ws = F.window(F.col("l_shipdate").cast("timestamp"), "365 days").start.cast("string")
    rows = j.select(F.concat(F.lit("lines|"), ws).alias("ds"),
                    (F.col("l_returnflag") == "R").cast("int").alias("y"),
                    (F.col("l_discount") >= 0.05).cast("int").alias("pred"), "r_name")
    batch = {b["dataset"]: b for b in fx.fairness(rows, ["r_name"], F.col("ds")).collect()}
    for name, g in got.items():
        assert batch[name]["priv"] == g["priv"] and abs(batch[name]["dpd"] - g["dpd"]) < 1e-9
