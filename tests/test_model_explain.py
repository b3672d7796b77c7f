import numpy as np
from pyspark.sql import functions as F

from equilens.operators import explain as xx
from equilens.operators import model as mx
from equilens.operators import surrogate as sg
from equilens.session import cut_observed


def test_metrics_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, pred int")
    r = mx.classification_metrics(df).first()
    assert (r["accuracy"], r["f1"], r["precision"], r["recall"]) == (1.0, 0.0, 0.0, 0.0)


def _toy(spark, n=400):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(n):
        a, b, g = rng.normal(), rng.normal(), int(rng.integers(0, 2))
        y = int(a + 0.5 * b + 0.3 * g + rng.normal(scale=0.5) > 0)
        rows.append((i, y, float(g), a, b, float(g)))
    return spark.createDataFrame(rows, "row_id long, y int, s_g double, a double, b double, g double")


def test_lr_and_sampling_shap_additivity(spark):
    df = _toy(spark)
    feats = ["a", "b", "g"]
    r = mx.train_eval(df, df, feats, "lr", s_cols=["s_g"])
    acc = r.metrics.first()["accuracy"]
    assert acc > 0.7
    means = xx.background_means(df, feats)
    ex = df.limit(20)
    phi = xx.sampling_shap(r.model, ex, feats, means, n_perm=4, seed=3)
    tot = {row["row_id"]: row["s"] for row in phi.groupBy("row_id").agg(F.sum("phi").alias("s")).collect()}
    px = {row["row_id"]: row["proba"] for row in mx.score(r.model, ex, feats, ["row_id"]).collect()}
    bg = spark.createDataFrame([tuple(means[c] for c in feats)], ", ".join(f"{c} double" for c in feats))
    f0 = mx.score(r.model, bg, feats).first()["proba"]
    assert all(abs(tot[i] - (px[i] - f0)) < 1e-9 for i in tot)
    lin = xx.linear_shap(ex, xx.lr_coefficients(r.model, feats), means, ["s_g"])
    assert lin.count() == 20 * 3


def test_flags_topk_consistency(spark):
    attr = spark.createDataFrame([(1, 0.0, "a", 1.0), (2, 1.0, "a", 0.5), (1, 0.0, "b", 0.1),
                                  (2, 1.0, "b", 0.1)], "row_id long, s_g double, feature string, phi double")
    fl = {r["feature"]: r["flagged"] for r in xx.flag_features(attr, "s_g").collect()}
    assert fl == {"a": True, "b": False}
    imp = spark.createDataFrame([(1, "a", 3.0), (1, "b", 2.0), (1, "c", 1.0), (1, "d", 0.0),
                                 (2, "a", 0.0), (2, "b", 3.0), (2, "c", 2.0), (2, "d", 1.0)],
                                "run_id int, feature string, mean_abs double")
    c = xx.topk_consistency(imp, ["a", "b", "c", "d"], 3).first()
    assert (c["inter"], c["uni"], c["consistency"]) == (2, 4, 0.5)
    one = xx.topk_consistency(imp.where("run_id = 1"), ["a", "b", "c", "d"], 3).first()
    assert one["consistency"] == 1.0


def test_lime_shapes(spark):
    df = _toy(spark, 200)
    feats = ["a", "b", "g"]
    r = mx.train_eval(df, df, feats, "lr")
    w = xx.lime(r.model, df.limit(5), df, feats, n_samples=60, seed=1, top=2)
    assert w.count() == 10
    imp = {row["feature"]: row["mean_abs"] for row in xx.lime_importance(w, 5).collect()}
    assert "a" in imp


def test_minmax_scores(spark):
    df = spark.createDataFrame([(-2.0,), (0.0,), (2.0,)], "s double")
    got = [round(r[0], 6) for r in mx.minmax_scores(df, "s").orderBy("s").select("proba").collect()]
    assert got == [0.0, 0.5, 1.0]


def test_fitted_models_score_in_a_session_with_observed_queries(spark):
    df = _toy(spark)
    cut_observed(df, "observed", n=F.count(F.lit(1)))
    for kind in ("lr", "rf"):
        r = mx.train_eval(df, df, ["a", "b", "g"], kind, s_cols=["s_g"])
        assert not r.model.hasSummary
        m = r.metrics.first()
        assert m["n"] == df.count() and m["accuracy"] > 0.7


def test_no_partition_of_a_fit_grows_with_the_table(spark, monkeypatch):
    seen = []

    class Learner:
        def __init__(self, **kw):
            pass

        def fit(self, data):
            seen.append(data.rdd.glom().map(len).collect())

    monkeypatch.setattr(mx, "RandomForestClassifier", Learner)
    monkeypatch.setattr(mx, "FIT_ROWS", 50, raising=False)
    mx.fit_model(_toy(spark, 1600).coalesce(1), ["a", "b", "g"], "rf")
    assert sum(seen[0]) == 1600 and max(seen[0]) <= 50


def test_attributions_use_all_cores_for_a_table_in_one_partition(spark):
    df = _toy(spark).coalesce(1)
    feats = ["a", "b", "g"]
    cores = spark.sparkContext.defaultParallelism
    rule = lambda x: mx.logistic_score([x["a"], x["b"]])
    rows = lambda out: sum(1 for n in out.rdd.glom().map(len).collect() if n)
    assert rows(sg.lattice_shap(rule, df, feats, xx.background_means(df, feats))) >= cores
    assert rows(xx.tree_shap(mx.fit_model(df, feats, "rf"), df, feats)) >= cores


def test_ablation_fits_on_the_copies_of_all_rows(spark, monkeypatch):
    df = _toy(spark, 1100)
    seen = {}
    fit = mx.fit_model

    def counted(train, *a):
        seen[len(seen)] = train.count()
        return fit(train, *a)
    monkeypatch.setattr(mx, "fit_model", counted)
    out = mx.ablate(df, df, ["a", "b", "g"], ["g"], ("baseline", "cf"), "lr").collect()
    assert [r["augmentation"] for r in out] == ["baseline", "cf"]
    assert seen == {0: 1100, 1: 1100 * 3}


def test_rows_are_dealt_out_before_forests_score_them(spark):
    df = _toy(spark, 60).coalesce(1)
    m = mx.fit_model(df, ["a", "b", "g"], "lr")
    assert mx.score_all({"x": m}, df, ["a", "b", "g"], ["row_id"]).rdd.getNumPartitions() > 1
    assert mx.score_all({"x": lambda x: x["a"]}, df, ["a", "b", "g"], ["row_id"]).rdd.getNumPartitions() == 1


def test_steps_side_by_side(spark):
    import threading

    import pytest

    from equilens.session import together
    both = threading.Barrier(2, timeout=60)
    got = together(spark, {"b": lambda: (both.wait(), spark.range(3).count())[1], "a": lambda: (both.wait(), 7)[1]})
    assert got == {"b": 3, "a": 7} and list(got) == ["b", "a"]

    def bad(text):
        raise ValueError(text)
    with pytest.raises(ValueError, match="first"):
        together(spark, {"x": lambda: 1, "y": lambda: bad("first"), "z": lambda: bad("second")}, 1)
