"""Audit frames built from the driver tables (FIXTURES.md section 3).

A ``orders_lines``  lineitem x orders x customer x nation x region, y = returnflag 'R',
                    pred = discount >= 0.05, sensitive c_mktsegment, r_name, n_name.
B ``documents``     documents x labels, y = toxic, pred = n_chars >= median (joined rows).
C ``orders_tab``    orders x customer x nation x region, id o_orderkey, y = status 'F'.
D ``vectors``       embeddings, 64 features, y = (label = 0).
E ``dirty``         frame C with nulls / '?' tokens set by a rule on o_orderkey.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dist import exact_median
from ..operators.fairness import confusion_counts
from ..sources.tables import read_table, sized_broadcast

SENSITIVE_A = ["c_mktsegment", "r_name", "n_name"]
SENSITIVE_B = ["lang", "source"]
SENSITIVE_C = ["c_mktsegment", "r_name"]
NUMERIC_C = ["o_totalprice", "c_acctbal"]
CATEGORICAL_C = ["o_orderpriority", "c_mktsegment", "r_name"]
DIM_MAX_ROWS = 10_000


def _geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation x region, size-checked before the broadcast hint."""
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    region = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    geo = nation.join(sized_broadcast(region, DIM_MAX_ROWS),
                      nation.n_regionkey == region.r_regionkey)
    return sized_broadcast(geo.select("n_nationkey", "n_name", "r_name"), DIM_MAX_ROWS)


def orders_lines_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame A at row level (one row per lineitem): y, pred and the three sensitive columns."""
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_returnflag", "l_discount"])
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    cust = read_table(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment", "c_nationkey"])
    j = (li.join(orders, li.l_orderkey == orders.o_orderkey)
           .join(cust, F.col("o_custkey") == cust.c_custkey)
           .join(_geo(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey")))
    return j.select((F.col("l_returnflag") == "R").cast("int").alias("y"),
                    (F.col("l_discount") >= 0.05).cast("int").alias("pred"),
                    *SENSITIVE_A)


def orders_lines_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame A pre-aggregated below every join (eager aggregation).

    Counts are sums, so aggregating lineitem by order, then orders by customer,
    then customers by (segment, nation) before each join is exact for inner
    joins. The big lineitem x orders join shuffles one small row per order
    instead of every line, and a hot order or customer key is collapsed by the
    map-side partial aggregate before it reaches a shuffle.
    """
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_returnflag", "l_discount"])
    li = li.select("l_orderkey", (F.col("l_returnflag") == "R").cast("int").alias("y"),
                   (F.col("l_discount") >= 0.05).cast("int").alias("pred"))
    per_order = confusion_counts(li, ["l_orderkey"])
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    per_cust = confusion_counts(per_order.join(orders, per_order.l_orderkey == orders.o_orderkey),
                                ["o_custkey"])
    cust = read_table(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment", "c_nationkey"])
    per_seg = confusion_counts(per_cust.join(cust, per_cust.o_custkey == cust.c_custkey),
                               ["c_mktsegment", "c_nationkey"])
    geo = _geo(spark, sf_dir)
    return per_seg.join(geo, per_seg.c_nationkey == geo.n_nationkey).select(
        *SENSITIVE_A, "n", "n_pred_pos", "n_pos", "n_tp")


def documents_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame B: labelled documents (text column never read); pred = n_chars >= median."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "lang", "source", "n_chars"])
    labels = read_table(spark, sf_dir, "labels", ["doc_id", "toxic"])
    j = docs.join(labels, "doc_id")
    med = exact_median(j, "n_chars")
    return j.select("doc_id", "lang", "source", "n_chars",
                    F.col("toxic").cast("int").alias("y"),
                    (F.col("n_chars") >= F.lit(med)).cast("int").alias("pred"))


def orders_tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame C: one row per order with two numeric and three categorical features."""
    orders = read_table(spark, sf_dir, "orders",
                        ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                         "o_orderpriority"])
    cust = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_acctbal",
                                                  "c_mktsegment"])
    j = (orders.join(cust, orders.o_custkey == cust.c_custkey)
               .join(_geo(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey")))
    return j.select(F.col("o_orderkey").alias("row_id"),
                    (F.col("o_orderstatus") == "F").cast("int").alias("y"),
                    "o_totalprice", "c_acctbal", "o_orderpriority", "c_mktsegment", "r_name")


def dirty_tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame E: frame C with c_acctbal NULL when row_id % 17 = 0 and
    o_orderpriority '?' when row_id % 19 = 0 (a rule, not a sample)."""
    c = orders_tab(spark, sf_dir)
    return c.select(
        "row_id", "y", "o_totalprice",
        F.when(F.col("row_id") % 17 == 0, F.lit(None).cast("double"))
         .otherwise(F.col("c_acctbal")).alias("c_acctbal"),
        F.when(F.col("row_id") % 19 == 0, F.lit("?"))
         .otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
        "c_mktsegment", "r_name")


def vectors(spark: SparkSession, sf_dir: str, dims: int = 64) -> DataFrame:
    """Frame D: embeddings as columns f00..f63, y = (label = 0), s_parity = label % 2."""
    e = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    return e.select(F.col("vec_id").alias("row_id"),
                    (F.col("label") == 0).cast("int").alias("y"),
                    (F.col("label") % 2).cast("int").alias("s_parity"),
                    *[F.col("embedding")[i].cast("double").alias(f"f{i:02d}") for i in range(dims)])
