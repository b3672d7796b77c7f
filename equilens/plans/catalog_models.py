"""Registered queries, continued: neighbours, copulas, rule-based explanations, intervals, CSV scans.

The rule model of these queries is the deterministic risk score on the prepared features of frame C,
so that explanations and leakage have exact answers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import augment as ax
from ..operators import explain as xx
from ..operators import model as mx
from ..operators import report as rp
from ..operators import resample as rs
from ..operators import surrogate as sg
from ..sources import tables as src
from . import frames
from .catalog import (FEATS_C, LINEAR_BETA, VEC_FEATS, _ml_split, _scratch, _train_prepared, _vectors, register, rounded)

RULE_OFFSET = 0.3
LIME_DRAWS = 200


# The rule's offset per variant of the rule-scored runs
VARIANT_OFFSETS = {"baseline": 0.3, "smote": 0.25, "cf": 0.2, "gan": 0.15, "smote_gan": 0.1, "full": -0.2}
RUN_SEEDS = (42, 43)


def rule_with(offset: float):
    """sigmoid(weights times prepared features - offset)"""
    return lambda x: mx.logistic_score([F.lit(b) * x[c] for c, b in LINEAR_BETA.items()], offset)


rule = rule_with(RULE_OFFSET)


@register("knn_all")
def q_knn_all(spark, sf):
    return rounded(ax.knn(_vectors(spark, sf), VEC_FEATS, 5))


@register("kernel_shap")
def q_kernel_shap(spark, sf):
    """Exact Shapley values of the rule for every test row."""
    tr, te = _ml_split(spark, sf)
    return rounded(sg.lattice_shap(rule, te, FEATS_C, xx.background_means(tr, FEATS_C), ["s_c_mktsegment"]))


@register("kernel_shap_forest")
def q_kernel_shap_forest(spark, sf):
    """The same of a fitted forest."""
    tr, te = _ml_split(spark, sf)
    r = mx.train_eval(tr, te, FEATS_C, "rf")
    return rounded(sg.lattice_shap(r.model, te, FEATS_C, xx.background_means(tr, FEATS_C), ["s_c_mktsegment"]))


@register("lime")
def q_lime(spark, sf):
    """Local surrogates of the rule for every test row."""
    tr, te = _ml_split(spark, sf)
    return rounded(sg.local_surrogate(rule, te, tr, FEATS_C, LIME_DRAWS, 42))


@register("lime_lr")
def q_lime_lr(spark, sf):
    tr, te = _ml_split(spark, sf)
    r = mx.train_eval(tr, te, FEATS_C, "lr")
    return rounded(sg.local_surrogate(r.model, te, tr, FEATS_C, LIME_DRAWS, 42))


@register("leakage_rule")
def q_leakage_rule(spark, sf):
    """Accuracy of the rule on real test rows and on these with synthetic ones mixed in."""
    _, te = _ml_split(spark, sf)
    return rounded(mx.leakage_test(rule, FEATS_C, te, ax.smote(te, FEATS_C, [], seed=42)))


@register("minmax_scores")
def q_minmax_scores(spark, sf):
    _, te = _ml_split(spark, sf)
    raw = sum((F.lit(b) * F.col(c) for c, b in LINEAR_BETA.items()), F.lit(0.0))
    return rounded(mx.minmax_scores(te.select("row_id", raw.alias("raw")), "raw"))


@register("bootstrap_docs")
def q_bootstrap_docs(spark, sf):
    """Accuracy of frame B's rule per language with its bootstrap interval."""
    b = frames.documents_frame(spark, sf)
    hit = b.select("doc_id", "lang", (F.col("y") == F.col("pred")).cast("double").alias("hit"))
    return rounded(rs.bootstrap_means(hit, "hit", "doc_id", by=["lang"]))


def _dirty_csv(spark, sf):
    """``customer`` as CSV text with missing words, bad numbers and broken lines, by rules on the key."""
    c = src.read_table(spark, sf, "customer")
    k = F.col("c_custkey")
    bal = F.when(k % 7 == 0, "NA").when(k % 13 == 0, "12.x").when(k % 29 == 0, "N/A").otherwise(F.col("c_acctbal").cast("string"))
    seg = F.when(k % 11 == 0, "?").when(k % 31 == 0, "").otherwise(F.col("c_mktsegment"))
    line = F.concat_ws(",", k.cast("string"), F.col("c_name"), F.col("c_nationkey").cast("string"), bal, seg)
    line = F.when(k % 17 == 0, F.concat_ws(",", k.cast("string"), F.col("c_name"))).when(
        k % 37 == 0, F.concat(line, F.lit(",more"))).otherwise(line)
    path = _scratch(spark, "dirty_csv")
    c.select(line.alias("value")).write.text(path)
    return src.scan_csv(spark, path, c.schema, header=False, null_tokens=["?"])


@register("csv_quarantine")
def q_csv_quarantine(spark, sf):
    return rounded(_dirty_csv(spark, sf).rows)


@register("csv_rejects")
def q_csv_rejects(spark, sf):
    return _dirty_csv(spark, sf).rejects


@register("stable_ids")
def q_stable_ids(spark, sf):
    """Ids of lineitem rows that share many columns: as many ids as rows, without gaps."""
    from .registry import _with_id
    li = src.read_table(spark, sf, "lineitem", ["l_quantity", "l_discount", "l_returnflag"])
    t = _with_id(li)
    return t.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")).join(
        t.agg(F.countDistinct("row_id").alias("n_ids"), F.min("row_id").alias("low"), F.max("row_id").alias("high")), F.lit(True))


@register("encode_large")
def q_encode_large(spark, sf):
    """Codes of order keys as text from a dictionary too large to broadcast, by the train half."""
    from ..operators import prep as px
    li = src.read_table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber"])
    li = li.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 1, "first").when(
        F.col("l_linenumber") == 2, F.lit(None)).otherwise(F.col("l_orderkey").cast("string")).alias("key"))
    enc = px.fit_encoder(li.where(F.col("l_orderkey") % 3 != 0), ["key"])
    return px.encode(li, enc, ["key"], broadcast_rows=100)


# ---------------------------------------------------------------------------
# Run history (A3-A8, T2-T10, V2-V4, Y1, Y2) of rule-scored audits
# ---------------------------------------------------------------------------
def rule_runs(spark, sf):
    """A two-seed sweep of frame C scored with the rules, in a run store; a run is saved twice, as a retry
    would, and the sweep is asked for again."""
    from ..session import cut_lineage
    from .audit import config_of, sweep
    from .history import RunStore
    from .registry import fixture_loaders
    store = RunStore(spark, _scratch(spark, "runs"))
    options = {"rules": {k: rule_with(v) for k, v in VARIANT_OFFSETS.items()}, "leakage": True, "domain": "Orders"}
    loaders = {"orders_tab": fixture_loaders(sf)["orders_tab"], "gone": lambda spark: spark.table("no_such_table")}

    def run():
        return sweep(spark, loaders, RUN_SEEDS, model_kind="rule", run_xai=True, store=store, **options)
    _, failed = run()
    config = config_of("rule", True, options)
    store.save(cut_lineage(store.runs(config).where(F.col("seed") == RUN_SEEDS[-1]), "retry"), config)
    runs, _ = sweep(spark, {"orders_tab": loaders["orders_tab"]}, RUN_SEEDS, model_kind="rule", run_xai=True, store=store, **options)
    return store, runs, failed


@register("runs_flat")
def q_runs_flat(spark, sf):
    """Flattened run rows (A6), the failures of the sweep beside them."""
    _, runs, failed = rule_runs(spark, sf)
    flat = rp.flatten_runs(runs)
    part = [F.get_json_object(f"fairness_{t}", f"$.{m}").cast("double").alias(f"{m}_{t}")
            for t in ("before", "after") for m in ("dpd_avg", "dir_avg", "eod_avg", "bias_score", "fail_count")]
    n_failed = failed.groupBy("seed").agg(F.count(F.lit(1)).alias("n_failed"))
    return rounded(flat.select("dataset", "seed", "n_train", "n_test", "feature_count", "sensitive",
                               *[f"accuracy_{k}" for k in VARIANT_OFFSETS], "shap_topk", "lime_topk", *part).join(n_failed, "seed"))


@register("runs_summary")
def q_runs_summary(spark, sf):
    """Audit summary kept by the store (A7) with the seed statistics (Y2)."""
    store, runs, _ = rule_runs(spark, sf)
    store.refresh_summary()
    summ = store.refresh_summary(["orders_tab"]).drop("runtime_sec", "shap_flagged")
    return rounded(summ.join(rp.seed_stats(runs, "accuracy_full"), "dataset"))


@register("runs_tables")
def q_runs_tables(spark, sf):
    """Report tables and figure series over the saved runs, as (tab, key, col, value, text)."""
    from .audit import summary_from_runs
    _, runs, _ = rule_runs(spark, sf)
    ds = src.cut_lineage(summary_from_runs(runs, k=2), "summary")

    def long(df, tab, key, texts=()):
        skip = {"pos", "k", *key}
        return df.select(F.lit(tab).alias("tab"), F.concat_ws("/", *[F.col(f"`{k}`") for k in key]).alias("key"), F.inline(F.array(*[
            F.struct(F.lit(c).alias("col"), (F.lit(None) if c in texts else F.col(f"`{c}`")).cast("double").alias("value"),
                     (F.col(f"`{c}`") if c in texts else F.lit(None)).cast("string").alias("text"))
            for c in df.columns if c not in skip])))
    tabs = [(rp.tab_leakage(ds), "T2", ["Dataset"], ["Inflated?"]), (rp.tab_stability(ds), "T3", ["Dataset"], []),
            (rp.tab_ablation(ds), "T4", ["Dataset"], []), (rp.tab_fairness(ds), "T5", ["Dataset"], ["Verdict"]),
            (rp.tab_attribution(ds), "T6", ["Dataset", "Feature"], ["Note"]), (rp.tab_consistency(ds), "T7", ["Dataset"], []),
            (rp.reduction_series(ds), "V2", ["Dataset", "Feature"], []), (rp.stability_bars(ds), "V3", ["dataset"], ["gain_label"]),
            (rp.leakage_series(ds), "V4", ["dataset"], [])]
    out = None
    for df, tab, key, texts in tabs:
        x = long(df, tab, key, texts)
        out = x if out is None else out.unionByName(x)
    return rounded(out)


@register("runs_statistics")
def q_runs_statistics(spark, sf):
    """Changes over the runs with bootstrap intervals, p-values and effect sizes (T10 from Y4 and Y5)."""
    _, runs, _ = rule_runs(spark, sf)
    return rounded(rp.tab_statistics(rp.statistics_from_runs(runs)).drop("pos"))
