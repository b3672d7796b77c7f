"""Registered queries: (spark, sf_dir) -> DataFrame over the driver tables.

Every query reads whole tables (no id subsets, no row caps); floating
outputs are rounded to 6 places (``r6``) so they compare with the oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..functions.mathx import r6
from ..operators import fairness as fx
from ..spec import Thresholds
from . import frames

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double column (oracle hygiene: 6 places, no -0.0)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(r6(F.col(f.name), places).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# ---------------------------------------------------------------------------
# Fairness (F1-F11)
# ---------------------------------------------------------------------------
def _fair_a(spark, sf):
    return fx.fairness(frames.orders_lines_counts(spark, sf), frames.SENSITIVE_A, "orders_lines")


def _fair_b(spark, sf):
    return fx.fairness(frames.documents_frame(spark, sf), frames.SENSITIVE_B, "documents")


@register("group_rates_orders")
def q_group_rates_orders(spark, sf):
    r = fx.group_rates(frames.orders_lines_counts(spark, sf), frames.SENSITIVE_A, "orders_lines")
    return rounded(r.drop("grp_key"))


@register("extreme_groups_orders")
def q_extreme_groups_orders(spark, sf):
    r = fx.group_rates(frames.orders_lines_counts(spark, sf), frames.SENSITIVE_A, "orders_lines")
    e = fx.extreme_groups(r)
    return rounded(e.select("dataset", "sensitive", "n_groups", "priv", "unpriv",
                            "rate_priv", "rate_unpriv", "n_priv", "n_unpriv"))


@register("fairness_orders")
def q_fairness_orders(spark, sf):
    return rounded(_fair_a(spark, sf))


@register("fairness_orders_rowlevel")
def q_fairness_orders_rowlevel(spark, sf):
    """Same answer as fairness_orders, from the row-level join (no eager aggregation)."""
    return rounded(fx.fairness(frames.orders_lines_rows(spark, sf), frames.SENSITIVE_A,
                               "orders_lines"))


@register("fairness_docs")
def q_fairness_docs(spark, sf):
    return rounded(_fair_b(spark, sf))


@register("fairness_summary")
def q_fairness_summary(spark, sf):
    return rounded(fx.fairness_summary(_fair_a(spark, sf).unionByName(_fair_b(spark, sf))))


@register("ztest")
def q_ztest(spark, sf):
    f = _fair_a(spark, sf).unionByName(_fair_b(spark, sf))
    return rounded(f.select("dataset", "sensitive", "priv", "unpriv", "z", "p_value"))


VERDICT_SETTINGS = {
    "default": Thresholds(),
    "strict": Thresholds(dpd=0.05, dir_lo=0.9, dir_hi=1.0 / 0.9, eod=0.05, p=0.05),
    "lenient": Thresholds(dpd=0.2, dir_lo=0.6, dir_hi=1.0 / 0.6, eod=0.2, p=0.01),
}


@register("verdict_grid")
def q_verdict_grid(spark, sf):
    f = _fair_a(spark, sf).unionByName(_fair_b(spark, sf))
    return fx.verdict_grid(f, VERDICT_SETTINGS)


# ---------------------------------------------------------------------------
# Stage 1: preparation
# ---------------------------------------------------------------------------
from ..operators import prep as px  # noqa: E402
from ..sources.tables import read_table  # noqa: E402
from ..spec import AuditSpec  # noqa: E402

SPEC_C = AuditSpec(name="orders_tab", label="y", sensitive=frames.SENSITIVE_C, id_col="row_id",
                   features=frames.NUMERIC_C + frames.CATEGORICAL_C)
SPEC_E = AuditSpec(name="dirty", label="y", sensitive=frames.SENSITIVE_C, id_col="row_id",
                   features=frames.NUMERIC_C + frames.CATEGORICAL_C, null_tokens=["?"])


@register("keep_columns")
def q_keep_columns(spark, sf):
    c = read_table(spark, sf, "customer")
    return px.keep_columns(c, ["c_custkey", "c_mktsegment", "c_phone", "c_acctbal"])


@register("drop_columns")
def q_drop_columns(spark, sf):
    return px.drop_columns(read_table(spark, sf, "customer"), ["c_name", "c_comment"])


@register("normalise_names")
def q_normalise_names(spark, sf):
    c = read_table(spark, sf, "customer", ["c_custkey", "c_mktsegment"])
    c = c.toDF(" C_CustKey ", "Segment")
    return px.normalise_names(c, {"segment": "market_segment"})


@register("null_tokens")
def q_null_tokens(spark, sf):
    e = px.null_tokens(frames.dirty_tab(spark, sf), ["?"])
    return rounded(e.select("row_id", "c_acctbal", "o_orderpriority"))


@register("drop_missing")
def q_drop_missing(spark, sf):
    e = px.drop_missing(px.null_tokens(frames.dirty_tab(spark, sf), ["?"]))
    return rounded(e)


@register("label_from")
def q_label_from(spark, sf):
    o = read_table(spark, sf, "orders", ["o_orderkey", "o_orderstatus", "o_orderpriority",
                                         "o_totalprice"])
    return o.select("o_orderkey",
                    px.label_from("o_orderstatus", "eq", "F").alias("y_eq"),
                    px.label_from("o_orderpriority", "ne", "1-URGENT", strip_chars=".").alias("y_ne"),
                    px.label_from("o_totalprice", "ge", 100000.0).alias("y_ge"))


@register("to_binary_string")
def q_to_binary_string(spark, sf):
    o = read_table(spark, sf, "orders", ["o_orderkey", "o_orderstatus"])
    return px.to_binary(o, "o_orderstatus", "y").select("o_orderkey", "y")


@register("to_binary_float")
def q_to_binary_float(spark, sf):
    o = read_table(spark, sf, "orders", ["o_orderkey", "o_totalprice"])
    return px.to_binary(o, "o_totalprice", "y").select("o_orderkey", "y")


@register("to_binary_int")
def q_to_binary_int(spark, sf):
    li = read_table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber"])
    b = px.to_binary(li, "l_linenumber", "y")
    return b.groupBy("y").agg(F.count(F.lit(1)).cast("long").alias("n"))


@register("impute_median")
def q_impute_median(spark, sf):
    e = frames.dirty_tab(spark, sf)
    filled, _ = px.impute(e.select("row_id", "c_acctbal", "o_totalprice"),
                          ["c_acctbal", "o_totalprice"], [])
    return rounded(filled)


@register("impute_mode")
def q_impute_mode(spark, sf):
    e = px.null_tokens(frames.dirty_tab(spark, sf), ["?"])
    filled, _ = px.impute(e.select("row_id", "o_orderpriority", "r_name"), [],
                          ["o_orderpriority", "r_name"])
    return filled


@register("split_quotas")
def q_split_quotas(spark, sf):
    c = frames.orders_tab(spark, sf)
    counts = {int(r[0]): int(r[1]) for r in c.groupBy("y").count().collect()}
    q = px.split_quotas(counts)
    return spark.createDataFrame([(k, counts[k], v[0], v[1]) for k, v in q.items()],
                                 "y int, n long, n_train long, n_test long")


@register("stratified_split")
def q_stratified_split(spark, sf):
    return px.stratified_split(frames.orders_tab(spark, sf).select("row_id", "y"), "y", 0.2, 42)


@register("stratified_split_docs")
def q_stratified_split_docs(spark, sf):
    b = frames.documents_frame(spark, sf).select(F.col("doc_id").alias("row_id"), "y")
    return px.stratified_split(b, "y", 0.2, 7)


def _train_c(spark, sf):
    c = frames.orders_tab(spark, sf)
    return px.stratified_split(c, "y", 0.2, 42)


@register("fit_encoder")
def q_fit_encoder(spark, sf):
    s = _train_c(spark, sf)
    return px.fit_encoder(s.where(F.col("split") == "train"), frames.CATEGORICAL_C)


@register("encode_unseen")
def q_encode_unseen(spark, sf):
    o = read_table(spark, sf, "orders", ["o_orderkey", "o_orderpriority"])
    enc = px.fit_encoder(o.where(F.col("o_orderpriority") != "1-URGENT"), ["o_orderpriority"])
    return px.encode(o, enc, ["o_orderpriority"]).select(
        "o_orderkey", F.col("o_orderpriority").alias("code"))


@register("scale")
def q_scale(spark, sf):
    s = _train_c(spark, sf)
    st = px.fit_scaler(s.where(F.col("split") == "train"), frames.NUMERIC_C)
    return rounded(px.scale(s.select("row_id", "split", *frames.NUMERIC_C), st))


def _prepared_c(spark, sf):
    return px.prepare(frames.orders_tab(spark, sf), SPEC_C, seed=42)


@register("prepare")
def q_prepare(spark, sf):
    out, _ = _prepared_c(spark, sf)
    return rounded(out)


@register("prepare_dirty")
def q_prepare_dirty(spark, sf):
    out, _ = px.prepare(frames.dirty_tab(spark, sf), SPEC_E, seed=42)
    return rounded(out)


@register("apply_prep")
def q_apply_prep(spark, sf):
    _, state = _prepared_c(spark, sf)
    return rounded(px.apply_prep(frames.dirty_tab(spark, sf), state))


@register("profile")
def q_profile(spark, sf):
    out, st = _prepared_c(spark, sf)
    return rounded(px.profile(out, st.features))


# ---------------------------------------------------------------------------
# Stage 2: sampling, augmentation (G1-G19) and fidelity
# ---------------------------------------------------------------------------
from ..operators import augment as ax  # noqa: E402
from ..operators import fidelity as fid  # noqa: E402
from ..operators.dist import sample_n  # noqa: E402

FEATS_C = frames.NUMERIC_C + frames.CATEGORICAL_C
LINE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
VEC_FEATS = [f"f{i:02d}" for i in range(64)]


def _train_prepared(spark, sf):
    out, _ = _prepared_c(spark, sf)
    return out.where(F.col("split") == "train").drop("split")


@register("class_balance")
def q_class_balance(spark, sf):
    return ax.class_balance(_train_prepared(spark, sf))


@register("sample_n")
def q_sample_n(spark, sf):
    o = read_table(spark, sf, "orders", ["o_orderkey", "o_totalprice"]).withColumnRenamed(
        "o_orderkey", "row_id")
    return rounded(sample_n(o, 1000, 42))


@register("stratified_sample")
def q_stratified_sample(spark, sf):
    o = read_table(spark, sf, "orders", ["o_orderkey", "o_orderpriority"]).withColumnRenamed(
        "o_orderkey", "row_id")
    return ax.stratified_sample(o, 1500, "o_orderpriority", seed=0)


@register("stratified_sample_nulls")
def q_stratified_sample_nulls(spark, sf):
    o = read_table(spark, sf, "orders", ["o_orderkey", "o_orderpriority"]).select(
        F.col("o_orderkey").alias("row_id"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderpriority")).alias("key"))
    return ax.stratified_sample(o, 1500, "key", seed=0)


@register("smote_duplicates")
def q_smote_duplicates(spark, sf):
    """SMOTE and counterfactual row counts over lineitem columns full of equal rows."""
    from .registry import _with_id
    li = read_table(spark, sf, "lineitem", ["l_quantity", "l_discount", "l_returnflag", "l_linestatus"])
    t = _with_id(li.select(F.col("l_quantity").cast("double").alias("q"), F.col("l_discount").cast("double").alias("d"),
                           ((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.09)
                            & (F.col("l_quantity") > 40)).cast("int").alias("y"),
                           (F.col("l_linestatus") == "O").cast("double").alias("s_o"),
                           (F.col("l_linestatus") == "O").cast("double").alias("o")))
    sm = ax.smote(t, ["q", "d"], ["s_o"], "y", seed=42)
    cf = ax.counterfactual(t, ["o"], ["q", "d", "o"])
    return sm.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("synth_id").alias("n_ids")).unionByName(
        cf.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("synth_id").alias("n_ids")))


@register("counterfactual")
def q_counterfactual(spark, sf):
    cf = ax.counterfactual(_train_prepared(spark, sf), frames.SENSITIVE_C, FEATS_C, seed=42)
    return rounded(cf.drop("synth_id"))


@register("avg_rank")
def q_avg_rank(spark, sf):
    li = read_table(spark, sf, "lineitem", LINE_NUM)
    return rounded(ax.avg_rank(li, LINE_NUM).drop("score"))


@register("norm_scores")
def q_norm_scores(spark, sf):
    li = read_table(spark, sf, "lineitem", LINE_NUM)
    return rounded(ax.avg_rank(li, LINE_NUM).select("feature", "value", "u", "score"))


@register("copula_corr")
def q_copula_corr(spark, sf):
    return rounded(ax.copula_corr(_train_prepared(spark, sf), FEATS_C))


@register("copula_sample_indep")
def q_copula_sample_indep(spark, sf):
    li = read_table(spark, sf, "lineitem", LINE_NUM)
    n = li.count()
    return rounded(ax.copula_sample(li, LINE_NUM, n, seed=42, L=None, label=None))


@register("copula_sample")
def q_copula_sample(spark, sf):
    tr = _train_prepared(spark, sf)
    s_cols = [f"s_{c}" for c in frames.SENSITIVE_C]
    return rounded(ax.copula_fit_sample(tr, FEATS_C, tr.count(), 42, s_cols))


def _vectors(spark, sf):
    return frames.vectors(spark, sf)


@register("knn_minority")
def q_knn_minority(spark, sf):
    v = _vectors(spark, sf).where(F.col("y") == 1)
    return rounded(ax.knn(v, VEC_FEATS, 5))


@register("smote_vectors")
def q_smote_vectors(spark, sf):
    return rounded(ax.smote(_vectors(spark, sf), VEC_FEATS, ["s_parity"], "y", seed=42))


@register("smote_orders")
def q_smote_orders(spark, sf):
    tr = _train_prepared(spark, sf)
    return rounded(ax.smote(tr, FEATS_C, [f"s_{c}" for c in frames.SENSITIVE_C], "y", seed=42))


@register("resample_sensitive")
def q_resample_sensitive(spark, sf):
    tr = _train_prepared(spark, sf)
    probes = spark.range(tr.count()).withColumnRenamed("id", "synth_id")
    return rounded(ax.resample_sensitive(tr, [f"s_{c}" for c in frames.SENSITIVE_C], probes,
                                         42, "resample"))


@register("augment_full")
def q_augment_full(spark, sf):
    tr = _train_prepared(spark, sf)
    return rounded(ax.augment_batches(tr, FEATS_C, frames.SENSITIVE_C, 42, ("full",))["full"])


@register("ks_two_sample")
def q_ks_two_sample(spark, sf):
    li = read_table(spark, sf, "lineitem", LINE_NUM + ["l_returnflag"])
    return rounded(fid.ks_two_sample(li, LINE_NUM, F.col("l_returnflag") == "R"))


@register("chi2_two_sample")
def q_chi2_two_sample(spark, sf):
    li = read_table(spark, sf, "lineitem", ["l_linestatus", "l_returnflag", "l_discount"])
    return rounded(fid.chi2_two_sample(li, ["l_linestatus", "l_returnflag"],
                                       F.col("l_discount") >= 0.05))


@register("fidelity_docs")
def q_fidelity_docs(spark, sf):
    d = read_table(spark, sf, "documents", ["doc_id", "n_chars", "lang", "source"])
    lab = read_table(spark, sf, "labels", ["doc_id"]).withColumn("__lab", F.lit(1))
    j = d.join(lab, "doc_id", "left")
    return rounded(fid.fidelity(j, ["n_chars"], ["lang", "source"], F.col("__lab").isNotNull()))


@register("fidelity_cf")
def q_fidelity_cf(spark, sf):
    tr = _train_prepared(spark, sf)
    real = tr.select(*FEATS_C, F.lit("real").alias("origin"))
    cf = ax.counterfactual(tr, frames.SENSITIVE_C, FEATS_C, seed=42).select(*FEATS_C, "origin")
    return rounded(fid.fidelity(real.unionByName(cf), frames.NUMERIC_C, frames.CATEGORICAL_C))


# ---------------------------------------------------------------------------
# Stage 3-6: scoring, metrics, attributions, audit records (M, X, A)
# ---------------------------------------------------------------------------
from ..functions.mathx import hash_uniform  # noqa: E402
from ..operators import explain as xx  # noqa: E402
from ..operators import model as mx  # noqa: E402
from ..operators import report as rp  # noqa: E402

# The rule-based risk model for frame C (weights on raw columns)
RISK_OFFSET = 1.2
RISK_OFFSET_AFTER = 0.8


def risk_terms():
    return [F.col("o_totalprice") / 150000.0, F.col("c_acctbal") / 5000.0,
            F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 0.4).otherwise(0.0),
            F.when(F.col("c_mktsegment") == "AUTOMOBILE", 0.3).otherwise(0.0),
            F.when(F.col("r_name") == "EUROPE", -0.25).otherwise(0.0)]


def _risk_scored(spark, sf, offset=RISK_OFFSET):
    c = frames.orders_tab(spark, sf)
    p = mx.logistic_score(risk_terms(), offset)
    return c.select("row_id", "y", "c_mktsegment", "r_name", p.alias("proba")).withColumn(
        "pred", mx.threshold(F.col("proba")))


@register("logistic_score")
def q_logistic_score(spark, sf):
    return rounded(_risk_scored(spark, sf).select("row_id", "proba", "pred"))


@register("classification_metrics")
def q_classification_metrics(spark, sf):
    return rounded(mx.classification_metrics(_risk_scored(spark, sf), by=["c_mktsegment"]))


@register("fairness_orders_tab")
def q_fairness_orders_tab(spark, sf):
    return rounded(fx.fairness(_risk_scored(spark, sf), frames.SENSITIVE_C, "orders_tab"))


@register("compare_fairness")
def q_compare_fairness(spark, sf):
    b = fx.fairness(_risk_scored(spark, sf), frames.SENSITIVE_C, "orders_tab")
    a = fx.fairness(_risk_scored(spark, sf, RISK_OFFSET_AFTER), frames.SENSITIVE_C, "orders_tab")
    return rounded(fx.compare_fairness(b, a))


# Linear attribution weights on the prepared features of frame C
LINEAR_BETA = {"o_totalprice": 0.9, "c_acctbal": 0.35, "o_orderpriority": -0.2,
               "c_mktsegment": 0.15, "r_name": -0.1}


def _linear_attr(spark, sf, seed=42):
    out, _ = _prepared_c(spark, sf)
    train = out.where(F.col("split") == "train")
    test = out.where(F.col("split") == "test")
    means = xx.background_means(train, FEATS_C)
    return xx.linear_shap(test, LINEAR_BETA, means, ["s_c_mktsegment"])


@register("linear_shap")
def q_linear_shap(spark, sf):
    return rounded(_linear_attr(spark, sf))


@register("importance")
def q_importance(spark, sf):
    return rounded(xx.importance(_linear_attr(spark, sf)))


@register("attribution_disparity")
def q_attribution_disparity(spark, sf):
    return rounded(xx.attribution_disparity(_linear_attr(spark, sf), "s_c_mktsegment"))


@register("flag_features")
def q_flag_features(spark, sf):
    return rounded(xx.flag_features(_linear_attr(spark, sf), "s_c_mktsegment"))


@register("top_features")
def q_top_features(spark, sf):
    return xx.top_features(xx.importance(_linear_attr(spark, sf)), FEATS_C, 3)


CONSISTENCY_SEEDS = (42, 43, 44, 45, 46)


@register("topk_consistency")
def q_topk_consistency(spark, sf):
    out, _ = _prepared_c(spark, sf)
    train = out.where(F.col("split") == "train")
    test = out.where(F.col("split") == "test")
    imps = None
    means = xx.background_means(train, FEATS_C)
    for s in CONSISTENCY_SEEDS:
        # a random half of the test rows per seed; the background stays fixed
        ex = test.where(hash_uniform(s, "explain", "row_id") < 0.5)
        imp = xx.importance(xx.linear_shap(ex, LINEAR_BETA, means)).withColumn("run_id", F.lit(s))
        imps = imp if imps is None else imps.unionByName(imp)
    return rounded(xx.topk_consistency(imps, FEATS_C, 2))


def _rule_accuracy(df, name):
    m = mx.classification_metrics(df)
    return m.select(F.lit(name).alias("dataset"), "accuracy")


@register("audit_record")
def q_audit_record(spark, sf):
    fa = _fair_a(spark, sf)
    fb = _fair_b(spark, sf)
    acc = _rule_accuracy(frames.orders_lines_rows(spark, sf), "orders_lines").unionByName(
        _rule_accuracy(frames.documents_frame(spark, sf), "documents"))
    rec = rp.audit_record(fa.unionByName(fb), acc, None, frames.SENSITIVE_A + frames.SENSITIVE_B)
    return rounded(rec.select("dataset", "accuracy", "overall_verdict", "plain_summary",
                              F.size("fairness").cast("int").alias("n_checks")))


@register("audit_markdown")
def q_audit_markdown(spark, sf):
    fa, fb = _fair_a(spark, sf), _fair_b(spark, sf)
    acc = _rule_accuracy(frames.orders_lines_rows(spark, sf), "orders_lines").unionByName(
        _rule_accuracy(frames.documents_frame(spark, sf), "documents"))
    rec = rp.audit_record(fa.unionByName(fb), acc, None, frames.SENSITIVE_A + frames.SENSITIVE_B)
    return rp.audit_markdown(rec)


# --- model-based (Spark ML) operators: rows-only checks -------------------
def _ml_split(spark, sf):
    out, st = _prepared_c(spark, sf)
    return (out.where(F.col("split") == "train").drop("split"),
            out.where(F.col("split") == "test").drop("split"))


@register("train_eval_lr")
def q_train_eval_lr(spark, sf):
    tr, te = _ml_split(spark, sf)
    return rounded(mx.train_eval(tr, te, FEATS_C, "lr").metrics)


@register("train_eval_rf")
def q_train_eval_rf(spark, sf):
    tr, te = _ml_split(spark, sf)
    return rounded(mx.train_eval(tr, te, FEATS_C, "rf").metrics)


@register("ablate")
def q_ablate(spark, sf):
    tr, te = _ml_split(spark, sf)
    return rounded(mx.ablate(tr, te, FEATS_C, frames.SENSITIVE_C, model_kind="lr"))


@register("tree_shap")
def q_tree_shap(spark, sf):
    tr, te = _ml_split(spark, sf)
    r = mx.train_eval(tr, te, FEATS_C, "rf")
    ex = te
    return rounded(xx.tree_shap(r.model, ex, FEATS_C, ["s_c_mktsegment"]))


@register("audit_one_orders")
def q_audit_one_orders(spark, sf):
    from .audit import audit_one
    return rounded(rp.flatten_runs(audit_one(frames.orders_tab(spark, sf), SPEC_C, "rf", 42).run)
                   .drop("runtime_sec", "stage_seconds"))


# ---------------------------------------------------------------------------
# Sources and sinks (S1-S10), leakage test
# ---------------------------------------------------------------------------
from ..session import ensure_checkpoint_dir  # noqa: E402
from ..sources import tables as src  # noqa: E402


def _scratch(spark, name):
    import uuid
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/io/{name}-{uuid.uuid4().hex}"


@register("csv_roundtrip")
def q_csv_roundtrip(spark, sf):
    """customer -> ';'-separated CSV with a header and '?' for NULL -> read back."""
    c = read_table(spark, sf, "customer")
    path = _scratch(spark, "customer_csv")
    c.write.option("header", True).option("sep", ";").option("nullValue", "?").csv(path)
    back = src.read_csv(spark, path, c.schema, header=True, sep=";", null_tokens=["?"])
    return rounded(back)


@register("csv_noheader_roundtrip")
def q_csv_noheader_roundtrip(spark, sf):
    """nation -> header-less CSV with leading spaces -> read back with a fixed schema."""
    n = read_table(spark, sf, "nation")
    path = _scratch(spark, "nation_csv")
    n.select(*[F.concat(F.lit(" "), F.col(c).cast("string")).alias(c) for c in n.columns]) \
        .write.option("header", False).option("ignoreLeadingWhiteSpace", False).csv(path)
    return src.read_csv(spark, path, n.schema, header=False, skip_leading_space=True)


@register("json_roundtrip")
def q_json_roundtrip(spark, sf):
    """fairness records -> JSON sink -> read back with the same schema."""
    f = rounded(_fair_a(spark, sf))
    path = _scratch(spark, "fair_json")
    src.write_json(f, path)
    return spark.read.schema(f.schema).json(path)


@register("leakage_test")
def q_leakage_test(spark, sf):
    from ..operators import augment as ax2
    tr, te = _ml_split(spark, sf)
    r = mx.train_eval(tr, te, FEATS_C, "lr")
    syn = ax2.smote(te, FEATS_C, [], seed=42)
    return rounded(mx.leakage_test(r.model, FEATS_C, te, syn))


@register("runs_report")
def q_runs_report(spark, sf):
    """Two-seed audit sweep of frame C (logistic regression, no attributions) ->
    run history -> audit summary rows (A7) joined with seed statistics (Y2)."""
    from .audit import sweep
    from .registry import fixture_loaders
    runs, failed = sweep(spark, {"orders_tab": fixture_loaders(sf)["orders_tab"]}, [42, 43],
                         model_kind="lr", run_xai=False)
    problems = failed.collect()
    if problems:
        raise RuntimeError(f"{len(problems)} runs failed, first: {problems[0]}")
    summ = rp.audit_summary(runs).drop("runtime_sec", "shap_flagged")
    stats = rp.seed_stats(runs, "accuracy_full")
    return rounded(summ.join(stats, "dataset"))
