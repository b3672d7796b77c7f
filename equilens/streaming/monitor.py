"""Continuous fairness monitoring with Structured Streaming.

Per-group confusion counts are sums, so they are kept incrementally in
streaming state: the same unpivot + grouped counts as the batch operator,
either as running totals (update mode) or per event-time window with a
watermark (append mode, late rows within the watermark still counted).
Each micro-batch hands the (small) count table to the batch fairness
operator in ``foreachBatch`` and appends the verdicts to a table.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fairness as fx
from ..session import ensure_checkpoint_dir
from ..sources.tables import read_table, sized_broadcast


def decisions_stream(spark: SparkSession, sf_dir: str, max_files: int = 1) -> DataFrame:
    """Frame A as a stream: new lineitem files are scored by the rule
    (discount >= 0.05), labelled (returnflag 'R') and joined to the static
    order / customer / nation / region tables (stream-static joins)."""
    path = os.path.join(sf_dir, "lineitem.parquet")
    schema = spark.read.parquet(path).schema
    # new files are picked up as they land, as lineitem*.parquet or inside such folders
    li = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
          .parquet(os.path.join(sf_dir, "lineitem*.parquet"))
          .select("l_orderkey", "l_shipdate", "l_returnflag", "l_discount"))
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    cust = read_table(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment", "c_nationkey"])
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    region = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    geo = sized_broadcast(nation.join(region, nation.n_regionkey == region.r_regionkey)
                          .select("n_nationkey", "n_name", "r_name"), 10_000)
    j = (li.join(orders, li.l_orderkey == orders.o_orderkey)
           .join(cust, F.col("o_custkey") == cust.c_custkey)
           .join(geo, F.col("c_nationkey") == F.col("n_nationkey")))
    return j.select(F.col("l_shipdate").cast("timestamp").alias("ts"),
                    (F.col("l_returnflag") == "R").cast("int").alias("y"),
                    (F.col("l_discount") >= 0.05).cast("int").alias("pred"),
                    "c_mktsegment", "r_name", "n_name")


def _long_counts(stream: DataFrame, sensitive: Sequence[str], keys: dict | None = None) -> DataFrame:
    keys = keys or {}
    long = stream.select(*[v.alias(k) for k, v in keys.items()], "y", "pred", F.inline(F.array(*[
        F.struct(F.lit(c).alias("sensitive"), F.col(c).cast("string").alias("grp"))
        for c in sensitive])))
    return long.groupBy(*keys, "sensitive", "grp").agg(
        F.count(F.lit(1)).cast("long").alias("n"), F.sum("pred").cast("long").alias("n_pred_pos"),
        F.sum("y").cast("long").alias("n_pos"), F.sum(F.col("y") * F.col("pred")).cast("long").alias("n_tp"))


def running_counts(stream: DataFrame, sensitive: Sequence[str]) -> DataFrame:
    """Running per-(sensitive, group) confusion counts (stateful aggregation)."""
    return _long_counts(stream, sensitive)


def windowed_counts(stream: DataFrame, sensitive: Sequence[str], ts: str = "ts",
                    window: str = "30 days", watermark: str = "7 days") -> DataFrame:
    """Per event-time window counts; rows later than the watermark are dropped
    by Spark, windows are emitted once final (append mode)."""
    s = stream.withWatermark(ts, watermark)
    return _long_counts(s, sensitive, {"w": F.window(ts, window)})


def fairness_of_counts(counts: DataFrame, dataset: str, by: Sequence[str] = ()) -> DataFrame:
    """Batch fairness from a (sensitive, grp, counts) table (one micro-batch)."""
    g = counts.select(*by, F.lit(dataset).alias("dataset"), "sensitive", "grp",
                      F.lit(None).cast("double").alias("grp_key"), *fx.COUNT_COLS)
    g = g.withColumns({
        "rate": F.col("n_pred_pos") / F.col("n"),
        "tpr": F.when(F.col("n_pos") == 0, 0.0).otherwise(F.col("n_tp") / F.col("n_pos")),
        "fpr": F.when(F.col("n") == F.col("n_pos"), 0.0).otherwise(
            (F.col("n_pred_pos") - F.col("n_tp")) / (F.col("n") - F.col("n_pos")))})
    if by:
        g = g.withColumn("dataset", F.concat_ws("|", F.lit(dataset), *[F.col(b).cast("string") for b in by]))
    return fx.fairness_from_extremes(fx.extreme_groups(g))


def start_monitor(stream: DataFrame, sensitive: Sequence[str], out_path: str, dataset: str,
                  checkpoint: str | None = None, windowed: bool = False, ts: str = "ts",
                  window: str = "30 days", watermark: str = "7 days", available_now: bool = True):
    """Start the monitor: counts in streaming state, fairness per micro-batch
    written to its own ``batch_id`` partition of the Parquet table at ``out_path``."""
    spark = stream.sparkSession
    ckpt = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{dataset}"
    if windowed:
        counts = windowed_counts(stream, sensitive, ts, window, watermark)
        mode = "append"
    else:
        # the result table is one row per (sensitive, group): complete mode hands
        # every micro-batch the full running totals
        counts = running_counts(stream, sensitive)
        mode = "complete"

    def sink(batch: DataFrame, batch_id: int) -> None:
        if windowed:
            b = batch.select(F.col("w.start").cast("string").alias("window_start"), "sensitive", "grp",
                             *fx.COUNT_COLS)
            f = fairness_of_counts(b, dataset, ["window_start"])
        else:
            f = fairness_of_counts(batch, dataset)
        # one folder per batch, overwritten: a batch that is tried again is not written twice
        f.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch_id={batch_id}")

    w = counts.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
