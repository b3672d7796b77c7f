"""Scale checks on physical plans: no single-partition exchange in row-level
queries, scans read only the needed columns."""
import pytest

import __spark_entry__ as E

from paths import SF001

ROW_LEVEL = ["fairness_orders", "fairness_docs", "stratified_split", "ks_two_sample", "avg_rank",
             "prepare", "copula_sample_indep", "knn_minority", "linear_shap", "null_tokens"]


def _plan(df):
    df.write.format("noop").mode("overwrite").save()      # final adaptive plan
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ROW_LEVEL)
def test_no_single_partition_exchange(spark, name):
    plan = _plan(E.queries()[name](spark, SF001))
    assert "SinglePartition" not in plan, plan


def test_lineitem_scan_is_pruned(spark):
    plan = _plan(E.queries()["fairness_orders"](spark, SF001))
    scans = [line for line in plan.split("\n") if "FileScan parquet" in line and "l_orderkey" in line]
    assert scans and all("l_extendedprice" not in s and "l_shipdate" not in s for s in scans)
