import itertools
import math

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from equilens.operators import explain as xx
from equilens.operators import model as mx


def _cond_value(t, x, S, node=0):
    """E[f(x) | x_S] along the tree, averaging unknown features by cover."""
    if t["left"][node] < 0:
        return t["value"][node]
    f, a, b = t["feat"][node], t["left"][node], t["right"][node]
    if f in S:
        return _cond_value(t, x, S, a if x[f] <= t["thr"][node] else b)
    return (t["cover"][a] * _cond_value(t, x, S, a) + t["cover"][b] * _cond_value(t, x, S, b)) / t["cover"][node]


def _brute_phi(t, x, d):
    phi = np.zeros(d)
    for j in range(d):
        others = [k for k in range(d) if k != j]
        for r in range(d):
            for S in itertools.combinations(others, r):
                wgt = math.factorial(len(S)) * math.factorial(d - len(S) - 1) / math.factorial(d)
                phi[j] += wgt * (_cond_value(t, x, set(S) | {j}) - _cond_value(t, x, set(S)))
    return phi


def test_tree_shap_exact_and_additive(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(800):
        a, b, g = rng.normal(), rng.normal(), float(rng.integers(0, 3))
        rows.append((i, int(a + 0.5 * b * g + rng.normal(scale=0.5) > 0), a, b, g))
    df = spark.createDataFrame(rows, "row_id long, y int, a double, b double, g double")
    feats = ["a", "b", "g"]
    data = mx.assemble(df, feats).select(F.col("y").cast("double").alias("label"), "features")
    model = RandomForestClassifier(numTrees=3, maxDepth=4, seed=1).fit(data)
    trees = xx.forest_arrays(model)
    ex = df.limit(25)
    phi = xx.tree_shap(model, ex, feats).toPandas()
    X = {r["row_id"]: np.array([r["a"], r["b"], r["g"]]) for r in ex.collect()}
    for rid, x in X.items():
        brute = sum(_brute_phi(t, x, 3) for t in trees) / len(trees)
        got = phi[phi.row_id == rid].set_index("feature").loc[feats, "phi"].to_numpy()
        assert np.allclose(got, brute, atol=1e-12)
    base = xx.tree_base_value(trees)
    pr = {r["row_id"]: r["proba"] for r in mx.score(model, ex, feats, ["row_id"]).collect()}
    sums = phi.groupby("row_id")["phi"].sum()
    assert max(abs(sums[i] + base - pr[i]) for i in pr) < 1e-12
