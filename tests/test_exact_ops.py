"""Neighbours, ranks, quantiles, dictionaries, surrogates, intervals, scans and run stores against
brute-force versions."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equilens.functions.mathx import norm_ppf
from equilens.operators import augment as ax
from equilens.operators import dist, knn, prep, quantiles, ranks, report, resample, surrogate
from equilens.operators import explain as xx
from equilens.plans import registry
from equilens.plans.history import RunStore
from equilens.sources import tables as src


# --- G2 ---------------------------------------------------------------------
def brute_knn(pts, ids, k):
    out = {}
    for i, p in enumerate(pts):
        d = np.sqrt(((pts - p) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if j != i][:k]
        out[ids[i]] = [(ids[j], d[j]) for j in order]
    return out


def rows_of(df):
    got = {}
    for r in df.orderBy("base_id", "rank").collect():
        assert r["rank"] == len(got.get(r["base_id"], [])) + 1
        got.setdefault(r["base_id"], []).append((r["nn_id"], r["dist"]))
    return got


@pytest.mark.parametrize("kind", ["clusters", "grid", "copies", "few"])
def test_knn_equals_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    if kind == "clusters":
        pts = np.concatenate([rng.normal(c, 0.3, size=(60, 4)) for c in (0, 5, 9, 20)])
    elif kind == "grid":                                   # many ties
        pts = rng.integers(0, 4, size=(250, 3)).astype(float)
    elif kind == "copies":                                 # a third of all rows is one vector
        pts = np.concatenate([np.tile([1.0, 2.0], (80, 1)), rng.normal(size=(160, 2))])
    else:
        pts = rng.normal(size=(3, 2))
    ids = rng.permutation(len(pts)) + 100
    names = [f"f{j}" for j in range(pts.shape[1])]
    df = spark.createDataFrame([(int(i), *map(float, p)) for i, p in zip(ids, pts)],
                               ", ".join(["row_id long", *[f"{c} double" for c in names]]))
    got = rows_of(knn.knn(df, names, 5, block_rows=16))
    want = brute_knn(pts, ids, 5)
    assert set(got) == set(want)
    for i in want:
        assert [n for n, _ in got[i]] == [n for n, _ in want[i]] and np.allclose([d for _, d in got[i]], [d for _, d in want[i]])
        assert all(n != i for n, _ in got[i])


def test_knn_visits_few_cells_of_clustered_points(spark):
    rng = np.random.default_rng(4)
    work = {}
    for n in (500, 4000):
        pts = rng.uniform(size=(n, 2))
        df = spark.createDataFrame(pd.DataFrame({"row_id": range(n), "a": pts[:, 0], "b": pts[:, 1]}))
        stats = {}
        knn.knn(df, ["a", "b"], 5, block_rows=32, stats=stats)
        work[n] = stats["visited"] / stats["cells"]
    assert work[4000] < 2 * work[500] and work[4000] < 25


def test_knn_of_no_points(spark):
    assert knn.knn(spark.createDataFrame([], "row_id long, a double"), ["a"], 3).collect() == []


# --- G8, G10 ----------------------------------------------------------------
def test_scores_on_wide_rows(spark):
    rng = np.random.default_rng(0)
    n = 3000
    a = rng.normal(size=n)
    b = np.where(rng.uniform(size=n) < 0.4, 7.0, np.round(rng.normal(size=n), 1))     # a heavy value and ties
    pdf = pd.DataFrame({"row_id": range(n), "a": a, "b": b})
    rows = [(int(i), float(x), None if i % 10 == 0 else float(y)) for i, x, y in zip(pdf.row_id, a, b)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double")
    out = ranks.with_scores(df, ["a", "b"], splits=32)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "feature" not in plan
    got = out.toPandas().set_index("row_id").sort_index()
    for c in ("a", "b"):
        s = pd.Series([r[1 if c == "a" else 2] for r in rows])
        u = (s.rank(method="average") / (s.notna().sum() + 1)).clip(1e-6, 1 - 1e-6)
        want = spark.createDataFrame(pd.DataFrame({"i": range(n), "u": u})).withColumn(
            "z", norm_ppf(F.col("u"))).toPandas().set_index("i").sort_index()["z"]
        assert (got[c].isna() == s.isna()).all()
        assert np.allclose(got[c].dropna(), want[s.notna()])


def test_value_cuts_find_heavy_values(spark):
    df = spark.createDataFrame([(float(i % 3 == 0) * 5.0 + (i % 3 != 0) * i,) for i in range(900)], "x double")
    (limits, heavy), = ranks.value_cuts(df, ["x"], 16)
    assert heavy == {5.0} and math.nextafter(5.0, math.inf) in limits


# --- P12 --------------------------------------------------------------------
@pytest.mark.parametrize("gathered", [50, 100_000])
def test_exact_ranks(spark, gathered):
    rnd = random.Random(2)
    n = 4000
    rows = [(rnd.gauss(0, 1), float(rnd.choice([1, 1, 1, 2, 9])), None if i % 3 else float(i), float("nan"),
             rnd.choice([-math.inf, 0.0, math.inf, rnd.random()])) for i in range(n)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    want = {c: sorted(r[i] for r in rows if r[i] is not None and r[i] == r[i]) for i, c in enumerate("abcde")}
    ks = {c: [0, len(v) // 3, len(v) - 1, 0.5] if v else [0.5] for c, v in want.items()}
    got = quantiles.exact_ranks(df, ks, grid=32, gathered=gathered)
    for c, v in want.items():
        if not v:
            assert got[c] is None
        else:
            mid = (len(v) - 1) / 2
            assert got[c] == [v[0], v[len(v) // 3], v[-1], (v[math.floor(mid)] + v[math.ceil(mid)]) / 2]
    with pytest.raises(ValueError):
        quantiles.exact_ranks(df, {"a": [n]})


# --- P15, P16, S7 -----------------------------------------------------------
def test_large_dictionaries(spark):
    rows = [(i, "hot" if i % 3 == 0 else None if i % 7 == 0 else f"v{i % 500:03d}") for i in range(4000)]
    df = spark.createDataFrame(rows, "row_id long, k string")
    enc = prep.fit_encoder(df.where("row_id % 5 != 0"), ["k"])
    values = sorted({v for i, v in rows if v is not None and i % 5})
    assert {r["value"]: r["code"] for r in enc.collect()} == {v: j for j, v in enumerate(values)}
    code = {v: float(j) for j, v in enumerate(values)}
    for most in (10, 100_000):
        got = {r["row_id"]: r["k"] for r in prep.encode(df, enc, ["k"], broadcast_rows=most).collect()}
        assert got == {i: code.get(v, 0.0) for i, v in rows}


def test_numbers_along_an_order(spark):
    df = spark.createDataFrame([(g, x) for g in "ab" for x in random.Random(1).sample(range(1000), 300)], "g string, x int")
    got = dist.numbered(df, ["x"], "n", ["g"]).toPandas()
    for _, part in got.groupby("g"):
        assert list(part.sort_values("x")["n"]) == list(range(300))


def test_row_ids_follow_content(spark, tmp_path):
    rows = [("a", 1)] * 5 + [("b", None)] * 3 + [(f"r{i}", i) for i in range(50)]
    one = registry._with_id(spark.createDataFrame(rows, "k string, v int").repartition(1))
    two = registry._with_id(spark.createDataFrame(rows[::-1], "k string, v int").repartition(7))
    key = lambda df: sorted((r["row_id"], r["k"], r["v"]) for r in df.collect())
    assert key(one) == key(two) and [r[0] for r in key(one)] == list(range(58))


# --- G6, G7 -----------------------------------------------------------------
def test_counterfactual_domains_in_chunks(spark, monkeypatch):
    rows = [(i, i % 2, float(i % 7), float(i % 7) - 3, float(i)) for i in range(21)]
    df = spark.createDataFrame(rows, "row_id long, y int, s_g double, g double, x double")
    whole = sorted(map(tuple, ax.counterfactual(df, ["g"], ["g", "x"]).collect()), key=repr)
    monkeypatch.setattr(ax, "VARIANT_CHUNK", 3)
    assert sorted(map(tuple, ax.counterfactual(df, ["g"], ["g", "x"]).collect()), key=repr) == whole
    assert len(whole) == 21 * 8 and len({r[0] for r in whole}) == len(whole)


# --- X4, X8 -----------------------------------------------------------------
def _rule(x):
    return 1 / (1 + F.exp(-(x["a"] * x["b"] + 0.5 * x["c"])))


def _rule_py(v):
    return 1 / (1 + math.exp(-(v["a"] * v["b"] + 0.5 * v["c"])))


def test_lattice_shap_equals_permutations(spark):
    rng = np.random.default_rng(6)
    rows = [(i, float(i % 2), *map(float, rng.normal(size=3))) for i in range(20)]
    df = spark.createDataFrame(rows, "row_id long, s_g double, a double, b double, c double")
    means = {"a": 0.2, "b": -0.4, "c": 1.0}
    got = {(r["row_id"], r["feature"]): r["phi"] for r in surrogate.lattice_shap(_rule, df, list("abc"), means, ["s_g"]).collect()}
    for i, _, *x in rows:
        x = dict(zip("abc", x))
        for f in "abc":
            total = 0.0
            for order in itertools.permutations("abc"):
                have = dict(means)
                for g in order[:order.index(f)]:
                    have[g] = x[g]
                before = _rule_py(have)
                total += _rule_py({**have, f: x[f]}) - before
            assert got[i, f] == pytest.approx(total / 6, abs=1e-12)
    with pytest.raises(ValueError):
        surrogate.lattice_shap(_rule, df, [f"f{i}" for i in range(13)], {})


def test_lattice_shap_of_a_fitted_model_is_additive(spark):
    from equilens.operators import model as mx
    rng = np.random.default_rng(1)
    rows = [(i, int(x[0] + x[1] * x[2] > 0), *map(float, x)) for i, x in enumerate(rng.normal(size=(300, 3)))]
    df = spark.createDataFrame(rows, "row_id long, y int, a double, b double, c double")
    m = mx.fit_model(df, list("abc"), "lr")
    means = xx.background_means(df, list("abc"))
    phi = surrogate.lattice_shap(m, df.limit(15), list("abc"), means).groupBy("row_id").agg(F.sum("phi").alias("s")).collect()
    p = {r["row_id"]: r["proba"] for r in mx.score(m, df, list("abc"), ["row_id"]).collect()}
    f0 = mx.score(m, spark.createDataFrame([tuple(means.values())], "a double, b double, c double"), list("abc")).first()["proba"]
    assert all(r["s"] == pytest.approx(p[r["row_id"]] - f0, abs=1e-9) for r in phi)


def test_column_elimination_solves_systems(spark):
    rng = np.random.default_rng(2)
    n = 6
    rows, want = [], {}
    for i in range(10):
        m = rng.normal(size=(n, n))
        m = m @ m.T + np.eye(n)
        b = rng.normal(size=n)
        want[i] = np.linalg.solve(m, b)
        rows.append((i, *[float(m[p, q]) for p in range(n) for q in range(p, n)], *map(float, b)))
    names = [f"a{p}_{q}" for p in range(n) for q in range(p, n)] + [f"b{p}" for p in range(n)]
    df = spark.createDataFrame(rows, ", ".join(["id long", *[f"{c} double" for c in names]]))
    for r in surrogate.solve_columns(df, "a", "b", n, "x").collect():
        assert np.allclose([r[f"x{p}"] for p in range(n)], want[r["id"]])


def test_local_surrogate_equals_the_grouped_fit(spark):
    from equilens.operators import model as mx
    rng = np.random.default_rng(5)
    rows = [(i, int(x[0] - x[1] > 0), *map(float, x)) for i, x in enumerate(rng.normal(size=(200, 3)))]
    df = spark.createDataFrame(rows, "row_id long, y int, a double, b double, c double")
    m = mx.fit_model(df, list("abc"), "lr")
    key = lambda d: {(r["row_id"], r["feature"]): r["weight"] for r in d.collect()}
    one = key(surrogate.local_surrogate(m, df.limit(8), df, list("abc"), 60, 3, top=2))
    two = key(xx.lime(m, df.limit(8), df, list("abc"), 60, 3, top=2))
    assert set(one) == set(two) and len(one) == 16
    assert all(one[k] == pytest.approx(two[k], abs=1e-9) for k in one)


# --- Y4 ---------------------------------------------------------------------
def test_bootstrap_is_mergeable_and_covers(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "g" if i % 2 else None, float(x)) for i, x in enumerate(rng.normal(3.0, 1.0, size=600))] + [(9999, "g", None)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    one = {r["g"]: tuple(r) for r in resample.bootstrap_means(df.repartition(1), "v", "id", n_boot=500, by=["g"]).collect()}
    two = {r["g"]: tuple(r) for r in resample.bootstrap_means(df.repartition(5), "v", "id", n_boot=500, by=["g"]).collect()}
    assert set(one) == set(two) == {"g", None}
    for g in one:
        assert one[g][1] == 300 and np.allclose(one[g][2:], two[g][2:])
        assert one[g][3] < one[g][2] < one[g][4] and 0.1 < one[g][4] - one[g][3] < 0.4
    alone = resample.bootstrap_means(df, "v", "id", n_boot=200).first()
    assert alone["n"] == 600


def test_bootstrap_weights_are_poisson():
    w = np.searchsorted(np.floor(np.array(resample.poisson_cuts()) * resample.PRIME).astype(np.int64),
                        resample.draws(np.arange(1, 400, dtype=np.int64) * 7919 % resample.PRIME, np.arange(1, 2001, dtype=np.int64)), side="right")
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.15 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.08
    assert [round((w == k).mean(), 2) for k in range(3)] == [0.37, 0.37, 0.18]


# --- S2, S3, P11 ------------------------------------------------------------
def test_scan_csv_quarantine(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("id,age,name\n1,30,ann\n2,NA,bob\n3,x1,?\n4,5\n5,6,a,b\n6, 7 ,None\n\n7,,\"q,r\"\n")
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("age", T.DoubleType()), T.StructField("name", T.StringType())])
    got = src.scan_csv(spark, str(p), schema, null_tokens=["?"])
    assert sorted(map(tuple, got.rows.collect())) == [(1, 30.0, "ann"), (2, None, "bob"), (3, None, None), (6, 7.0, None), (7, None, "q,r")]
    assert sorted(map(tuple, got.rejects.collect())) == [
        ("broken line", None, "4,5", 1), ("broken line", None, "5,6,a,b", 1), ("not of the type", "age", "x1", 1)]
    free = src.scan_csv(spark, str(p))
    assert dict(free.rows.dtypes) == {"id": "bigint", "age": "string", "name": "string"}


def test_loaders_keep_missing_words_and_rejects(spark, tmp_path):
    p = tmp_path / "compas.csv"
    head = ["sex", "age", "race", "priors_count", "c_charge_degree", "two_year_recid", "juv_fel_count", "juv_misd_count", "juv_other_count"]
    p.write_text(",".join(head) + "\nM,30,x,1,F,1,0,0,0\nF,NA,y,2,M,0,0,0,0\nF,41,y,2,N/A,0,0,0,0\nM,22,z,0,F,0,0,0,0\nM,1\n")
    rejects = []
    df, _ = registry.load(spark, "COMPAS", str(p), rejects)
    assert dict(df.dtypes)["age"] == "bigint" and sorted(r["age"] for r in df.collect()) == [22, 30]
    assert [r["value"] for d in rejects for r in d.collect()] == ["M,1"]


# --- A3-A8, Y1, Y2 ----------------------------------------------------------
def _run(spark, dataset, seed, acc):
    s = {"dpd_avg": 0.1, "dir_avg": 0.9, "eod_avg": 0.1, "bias_score": 0.1, "fail_count": 0}
    row = (dataset, seed, 80, 20, 2, ["g"], 0.5, 0.5, 0.5, 0.5, acc, s, s, ["a", "b"], [], None, 3.0, 0.5, "d", None, ["a", "b"],
           [{"feature": "a", "before": 0.2, "after": 0.1, "note": ""}], {"training": 2.0, "fairness": 1.0})
    return spark.createDataFrame([row], report.RUNS_SCHEMA)


def test_run_store_replaces_retried_runs(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "runs"))
    assert store.runs().count() == 0 and store.done({"m": 1}) == set()
    for acc in (0.6, 0.7):
        store.save(_run(spark, "007", 1, acc), {"m": 1})
    store.save(_run(spark, "007", 2, 0.8), {"m": 1})
    store.save(_run(spark, "007", 1, 0.9), {"m": 2})
    store.save(_run(spark, "b", 1, 0.5), {"m": 1})
    got = {(r["dataset"], r["seed"]): r["accuracy_full"] for r in store.runs({"m": 1}).collect()}
    assert got == {("007", 1): 0.7, ("007", 2): 0.8, ("b", 1): 0.5} and store.done({"m": 2}) == {("007", 1)}
    assert store.runs().count() == 4
    assert store.refresh_summary().count() == 4
    store.save(_run(spark, "b", 1, 0.55), {"m": 1})
    assert {r["dataset"]: r["accuracy_full"] for r in store.refresh_summary(["b"]).where("dataset = 'b'").collect()} == {"b": 55.0}
    assert store.refresh_summary(["b"]).count() == 4
    store.export(str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out/raw_measurements.csv")).count() == 4
    assert spark.read.json(str(tmp_path / "out/audit_summary.json")).count() == 4
    assert spark.read.text(str(tmp_path / "out/summary.md")).count() == 6


def test_runtime_and_stability_from_runs(spark):
    runs = _run(spark, "x", 1, 0.6).unionByName(_run(spark, "x", 2, 0.7))
    t = {r["Component"]: r for r in report.tab_runtime(report.runtime_breakdown(runs)).collect()}
    assert t["training"]["Percent"] == pytest.approx(200 / 3) and t["Total"]["Percent"] == 100.0
    s = report.topk_stability(runs, "shap_topk", 2).first()
    assert (s["score"], s["var"]) == (1.0, 0.0)


def test_observed_writes(spark):
    from equilens.session import cut_observed
    df, seen = cut_observed(spark.range(10), "seen", n=F.count(F.lit(1)), s=F.sum("id"))
    assert seen == {"n": 10, "s": 45} and df.count() == 10


@pytest.mark.parametrize("kind", ["wide", "clusters", "copies"])
def test_knn_by_groups_of_cells_equals_brute_force(spark, monkeypatch, kind):
    rng = np.random.default_rng(5)
    n = 400
    if kind == "wide":                                    # no box can be left out
        pts = rng.normal(size=(n, 24))
    elif kind == "clusters":
        pts = rng.normal(size=(n, 2)) * 0.01 + rng.integers(0, 6, size=(n, 1)) * 10.0
    else:
        pts = rng.integers(0, 12, size=(n, 2)).astype(float)
    pts[0] = 1000.0                                       # far from all others
    names = [f"f{i}" for i in range(pts.shape[1])]
    ids = list(range(100, 100 + n))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in zip(ids, pts)], "row_id long, " + ", ".join(f"{c} double" for c in names))
    monkeypatch.setattr(knn, "GROUPS", 4, raising=False)
    monkeypatch.setattr(knn, "TASK_ROWS", 100)
    monkeypatch.setattr(knn, "FIRST_WAVE", 1)
    stats = {}
    got = rows_of(knn.knn(df, names, 5, block_rows=8, stats=stats))
    want = brute_knn(pts, ids, 5)
    for i in ids:
        assert [x for x, _ in got[i]] == [x for x, _ in want[i]] and np.allclose([x for _, x in got[i]], [x for _, x in want[i]])
    if kind == "wide":
        assert stats["cells"] > 30 and stats["visited"] <= 8 * stats["cells"]


def test_knn_broadcasts_nothing_that_executors_must_import(spark, monkeypatch):
    import pickle

    from pyspark import SparkContext
    sent, real = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: sent.append(pickle.dumps(value)) or real(self, value))
    df = spark.createDataFrame([(i, float(i % 17), float(i % 5)) for i in range(300)], "row_id long, a double, b double")
    assert knn.knn(df, ["a", "b"], 3, block_rows=32).count() == 900
    assert len(sent) >= 2 and not any(b"equilens" in x for x in sent)


def test_drawn_blocks_equal_the_column_draws(spark):
    from equilens.functions import draws, mathx
    ids = [0, 7, -12, 123456, 10 ** 12]
    df = spark.createDataFrame([(i, s) for i in ids for s in (1, 9, 10, 123)], "i long, s int")
    got = df.select("i", "s", mathx.hash_open_uniform(3, "lime0", "i", "s").alias("u"), mathx.hash_normal(3, "lime0", "i", "s").alias("z")).collect()
    with np.errstate(over="ignore"):
        u = draws.open_uniforms([f"3:lime0:{i}:".encode() for i in ids], [b"1", b"9", b"10", b"123"])
        long = draws.open_uniforms([b"x" * 70], [b"1"])
    z = draws.norm_ppf(u)
    assert [r["u"] for r in got] == u.ravel().tolist()
    assert np.allclose([r["z"] for r in got], z.ravel(), rtol=1e-13)
    assert 0 < long[0, 0] < 1
    tails = np.array([1e-14, 1e-9, 0.01, 0.5, 1 - 1e-9])
    want = spark.createDataFrame([(float(p),) for p in tails], "p double").select(mathx.norm_ppf(F.col("p"))).collect()
    assert np.allclose([r[0] for r in want], draws.norm_ppf(tails), rtol=1e-12)


def test_local_surrogate_of_repeated_and_missing_rows(spark):
    """Rows of one id share a fit, rows with a missing value count for nothing; the model is valued in columns, its
    sums are one per feature."""
    train = spark.createDataFrame([(float(i % 7), float(i % 3)) for i in range(50)], "a double, b double")
    rows = [(1, 2.0, 1.0), (1, 5.0, 0.0), (2, 3.0, 2.0), (3, None, 1.0), (4, 1.0, 1.0), (4, None, 0.0), (None, 4.0, 2.0)]
    out = surrogate.local_surrogate(lambda x: x["a"] * x["b"] / 10, spark.createDataFrame(rows, "row_id long, a double, b double"),
                                    train, ["a", "b"], 30, 5)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "md5" not in plan
    got = {(r["row_id"], r["feature"]): r["weight"] for r in out.collect()}
    t = np.array([(i % 7, i % 3) for i in range(50)], float)
    mean, sd = t.mean(0), t.std(0)
    from equilens.functions import draws
    for key in (1, 2, 3, 4, None):
        own = [np.array(r[1:], float) for r in rows if r[0] == key and None not in r[1:]]
        if not own:
            assert got[key, "a"] is None and got[key, "b"] is None
            continue
        salt = "" if key is None else f"{key}:"
        with np.errstate(over="ignore"):
            z = np.column_stack([draws.norm_ppf(draws.open_uniforms([f"5:lime{j}:{salt}".encode()], [str(s).encode() for s in range(1, 30)]))[0] for j in (0, 1)])
        zs, ws = [], []
        for o in own:
            o = (o - mean) / sd
            zs += [o, *z]
            ws += [1.0, *np.exp(-((z - o) ** 2).sum(1) / (0.75 ** 2 * 2)) ** 0.5]
        zs, ws = np.array(zs), np.array(ws)
        x = zs * sd + mean
        y = x[:, 0] * x[:, 1] / 10
        zc, yc = zs - np.average(zs, axis=0, weights=ws), y - np.average(y, weights=ws)
        want = np.linalg.solve((zc * ws[:, None]).T @ zc + np.eye(2), (zc * ws[:, None]).T @ yc)
        assert np.allclose([got[key, "a"], got[key, "b"]], want, atol=1e-9), key


def test_logistic_regression_as_rule(spark):
    df = spark.createDataFrame([(i, int(i % 5 > 1), float(i % 5), float(i % 3)) for i in range(60)], "row_id long, y int, a double, b double")
    from equilens.operators import model
    m = model.fit_model(df, ["a", "b"], "lr")
    want = {r["row_id"]: r["proba"] for r in model.score(m, df, ["a", "b"], ["row_id"]).collect()}
    got = {r["row_id"]: r["proba"] for r in model.score(model.as_rule(m, ["a", "b"]), df, ["a", "b"], ["row_id"]).collect()}
    assert all(abs(got[i] - want[i]) < 1e-14 for i in want)
