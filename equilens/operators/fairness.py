"""Group fairness: per-group confusion counts, privileged/unprivileged pick,
DPD / DIR / EOD, pooled two-proportion z-test, verdict, bias score.

Plan shape: one scan of the scored rows, a partial+final hash aggregate over
the *combination* of sensitive values (map-side combine keeps the shuffle at
"distinct combinations per partition"), then a generator (``inline``) unpivots
the small combination table into (sensitive, group) rows and a second tiny
aggregate sums them. Everything after that runs on a table of
#sensitive x #groups rows. No per-column loop of jobs, no window over data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.mathx import safe_div, two_sided_p
from ..spec import Thresholds

COUNT_COLS = ("n", "n_pred_pos", "n_pos", "n_tp")


def confusion_counts(df: DataFrame, keys: Sequence[str], y: str = "y",
                     pred: str = "pred") -> DataFrame:
    """Per-key counts n, n_pred_pos, n_pos, n_tp from row-level y/pred (0/1).

    If ``df`` already carries the four count columns (a pre-aggregated input)
    they are summed instead, so the operator composes across join levels.
    """
    if all(c in df.columns for c in COUNT_COLS):
        aggs = [F.sum(c).cast("long").alias(c) for c in COUNT_COLS]
    else:
        yv, pv = F.col(y).cast("long"), F.col(pred).cast("long")
        aggs = [F.count(F.lit(1)).cast("long").alias("n"),
                F.sum(pv).cast("long").alias("n_pred_pos"),
                F.sum(yv).cast("long").alias("n_pos"),
                F.sum(yv * pv).cast("long").alias("n_tp")]
    return df.groupBy(*keys).agg(*aggs)


def _group_key(df: DataFrame, c: str) -> tuple[Column, Column]:
    """(label string, numeric order key). Numeric groups order by value, so
    '10' does not sort before '9'; string groups order lexically."""
    dt = df.schema[c].dataType
    if isinstance(dt, NumericType):
        v = F.col(c).cast("double")
        label = F.when(v == F.floor(v), F.col(c).cast("long").cast("string")).otherwise(
            v.cast("string"))
        return label, v
    return F.col(c).cast("string"), F.lit(None).cast("double")


def group_rates(df: DataFrame, sensitive: Sequence[str], dataset: str | Column = "data",
                y: str = "y", pred: str = "pred") -> DataFrame:
    """Per (dataset, sensitive, grp): n, n_pred_pos, n_pos, n_tp, rate, tpr, fpr.

    ``df`` holds rows (y, pred) or pre-aggregated count columns. ``dataset``
    is a literal name or a column of ``df`` (several datasets in one pass).
    """
    ds_col = F.lit(dataset) if isinstance(dataset, str) else dataset
    df = df.withColumn("__ds", ds_col)
    combos = confusion_counts(df, ["__ds", *sensitive], y, pred)
    structs = []
    for c in sensitive:
        label, key = _group_key(df, c)
        structs.append(F.struct(F.lit(c).alias("sensitive"), label.alias("grp"),
                                key.alias("grp_key"),
                                *[F.col(k).alias(k) for k in COUNT_COLS]))
    long = combos.select(F.col("__ds").alias("dataset"), F.inline(F.array(*structs)))
    g = long.groupBy("dataset", "sensitive", "grp", "grp_key").agg(
        *[F.sum(k).cast("long").alias(k) for k in COUNT_COLS])
    return g.select(
        "dataset", "sensitive", "grp", "grp_key", *COUNT_COLS,
        safe_div(F.col("n_pred_pos"), F.col("n")).alias("rate"),
        safe_div(F.col("n_tp"), F.col("n_pos")).alias("tpr"),
        safe_div(F.col("n_pred_pos") - F.col("n_tp"), F.col("n") - F.col("n_pos")).alias("fpr"),
    )


def extreme_groups(rates: DataFrame) -> DataFrame:
    """Privileged = highest rate, unprivileged = lowest; ties -> smallest group.

    Done with ``min(struct(...))`` aggregates (struct order = rate, then group
    order key, then label), so no window and no sort of data rows.
    """
    payload = ["grp", "rate", "tpr", "fpr", "n", "n_pred_pos"]
    # 0.0 - rate keeps +0.0 for a zero rate (no -0.0 ordering surprises)
    priv = F.min(F.struct((F.lit(0.0) - F.col("rate")).alias("k0"), F.col("grp_key").alias("k1"),
                          F.col("grp").alias("k2"), *[F.col(c) for c in payload]))
    unpriv = F.min(F.struct(F.col("rate").alias("k0"), F.col("grp_key").alias("k1"),
                            F.col("grp").alias("k2"), *[F.col(c) for c in payload]))
    agg = rates.groupBy("dataset", "sensitive").agg(
        F.count(F.lit(1)).cast("long").alias("n_groups"), priv.alias("p"), unpriv.alias("u"))
    cols = [F.col("dataset"), F.col("sensitive"), F.col("n_groups"),
            F.col("p.grp").alias("priv"), F.col("u.grp").alias("unpriv")]
    for side, tag in (("p", "priv"), ("u", "unpriv")):
        cols += [F.col(f"{side}.rate").alias(f"rate_{tag}"), F.col(f"{side}.tpr").alias(f"tpr_{tag}"),
                 F.col(f"{side}.fpr").alias(f"fpr_{tag}"), F.col(f"{side}.n").alias(f"n_{tag}"),
                 F.col(f"{side}.n_pred_pos").alias(f"s_{tag}")]
    return agg.select(*cols)


def verdict(dpd: Column, dir_: Column, eod: Column, p: Column,
            t: Thresholds = Thresholds()) -> Column:
    """FAIL if DIR outside [lo, hi], DPD above limit, or EOD above limit with p below
    the significance level; strict comparisons, in this order."""
    return (F.when((dir_ < t.dir_lo) | (dir_ > t.dir_hi), F.lit("FAIL"))
             .when(dpd > t.dpd, F.lit("FAIL"))
             .when((eod > t.eod) & (p < t.p), F.lit("FAIL"))
             .otherwise(F.lit("PASS")))


def fairness_from_extremes(ext: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    one = F.col("n_groups") < 2
    pp, pu = F.col("rate_priv"), F.col("rate_unpriv")
    n_p = F.greatest(F.col("n_priv"), F.lit(1)).cast("double")
    n_u = F.greatest(F.col("n_unpriv"), F.lit(1)).cast("double")
    q = (F.col("s_priv") + F.col("s_unpriv")).cast("double") / F.greatest(
        F.col("n_priv") + F.col("n_unpriv"), F.lit(1))
    se = F.sqrt(q * (1.0 - q) * (1.0 / n_p + 1.0 / n_u))
    z_raw = F.when(se == 0, F.lit(0.0)).otherwise((pp - pu) / se)
    out = ext.select(
        "dataset", "sensitive", "n_groups", "priv", "unpriv",
        F.when(one, 0.0).otherwise(F.abs(pp - pu)).alias("dpd"),
        F.when(one, 1.0).when(pp > 0, pu / pp).otherwise(1.0).alias("dir"),
        F.when(one, 0.0).otherwise(F.greatest(
            F.abs(F.col("tpr_priv") - F.col("tpr_unpriv")),
            F.abs(F.col("fpr_priv") - F.col("fpr_unpriv")))).alias("eod"),
        F.when(one, 0.0).otherwise(z_raw).alias("z"),
    )
    out = out.withColumn("p_value", F.when(one, 1.0).otherwise(two_sided_p(F.col("z"))))
    out = out.withColumn(
        "bias_score",
        (F.col("dpd") + F.greatest(F.lit(0.0), 1.0 - F.col("dir")) + F.col("eod")) / 3.0)
    return out.withColumn("verdict", verdict(F.col("dpd"), F.col("dir"), F.col("eod"),
                                             F.col("p_value"), t))


def fairness(df: DataFrame, sensitive: Sequence[str], dataset: str | Column = "data",
             y: str = "y", pred: str = "pred", thresholds: Thresholds = Thresholds()) -> DataFrame:
    """All sensitive columns in one plan: (dataset, sensitive, n_groups, priv, unpriv,
    dpd, dir, eod, z, p_value, bias_score, verdict)."""
    return fairness_from_extremes(extreme_groups(group_rates(df, sensitive, dataset, y, pred)),
                                  thresholds)


def fairness_summary(fair: DataFrame) -> DataFrame:
    """Per dataset: mean DPD/DIR/EOD/bias score and the number of failing columns."""
    return fair.groupBy("dataset").agg(
        F.avg("dpd").alias("dpd_avg"), F.avg("dir").alias("dir_avg"),
        F.avg("eod").alias("eod_avg"), F.avg("bias_score").alias("bias_score"),
        F.count(F.when(F.col("verdict") == "FAIL", 1)).cast("long").alias("fail_count"))


def compare_fairness(before: DataFrame, after: DataFrame,
                     metrics: Sequence[str] = ("dpd", "dir", "eod", "p_value", "bias_score")
                     ) -> DataFrame:
    """Join two fairness tables on (dataset, sensitive): metric_before / metric_after,
    verdicts, and the bias-score reduction in percent (null when before is 0)."""
    b = before.select("dataset", "sensitive", *[F.col(m).alias(f"{m}_before") for m in metrics],
                      F.col("verdict").alias("verdict_before"))
    a = after.select("dataset", "sensitive", *[F.col(m).alias(f"{m}_after") for m in metrics],
                     F.col("verdict").alias("verdict_after"))
    out = b.join(a, ["dataset", "sensitive"], "full_outer")
    if "bias_score" in metrics:
        out = out.withColumn(
            "bias_reduction_pct",
            F.when(F.col("bias_score_before") > 0,
                   100.0 * (F.col("bias_score_before") - F.col("bias_score_after"))
                   / F.col("bias_score_before")))
    return out


def verdict_grid(fair: DataFrame, settings: dict[str, Thresholds]) -> DataFrame:
    """Re-judge each fairness row under several named threshold settings.

    The settings are a fixed parameter list, attached as a literal array and
    exploded (a generator, no join).
    """
    grid = F.array(*[F.struct(F.lit(k).alias("setting"), F.lit(t.dpd).alias("dpd_limit"),
                              F.lit(t.dir_lo).alias("dir_lo"), F.lit(t.dir_hi).alias("dir_hi"),
                              F.lit(t.eod).alias("eod_limit"), F.lit(t.p).alias("p_limit"))
                     for k, t in settings.items()])
    j = fair.select("dataset", "sensitive", "dpd", "dir", "eod", "p_value",
                    F.inline(grid))
    v = (F.when((F.col("dir") < F.col("dir_lo")) | (F.col("dir") > F.col("dir_hi")), F.lit("FAIL"))
          .when(F.col("dpd") > F.col("dpd_limit"), F.lit("FAIL"))
          .when((F.col("eod") > F.col("eod_limit")) & (F.col("p_value") < F.col("p_limit")),
                F.lit("FAIL"))
          .otherwise(F.lit("PASS")))
    return j.select("dataset", "sensitive", "setting", v.alias("verdict"))
