"""Stage 5: feature attributions and their group disparity, as DataFrame jobs.

Attributions are long tables ``(row_id, feature, phi)`` carrying the group
column(s) of the explained row, so disparity is a plain grouped aggregate
(no join back). Model-agnostic explainers build all perturbed rows with
generators (``sequence`` + ``inline``), score them in one ``model.transform``
and reduce with grouped aggregates; only the per-row ridge fits of LIME run
in pandas (``applyInPandas``, one explained row per group, bounded size).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mathx import hash_open_uniform, hash_uniform, with_norm_ppf
from ..session import spread
from ..spec import DISPARITY_FLOOR, DISPARITY_LIMIT, LIME_SAMPLES
from .dist import sample_n
from .model import score


# ---------------------------------------------------------------------------
# X1-X2 samples and linear attributions
# ---------------------------------------------------------------------------
def background_means(bg: DataFrame, features: Sequence[str]) -> dict[str, float]:
    row = bg.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in features]).first()
    return {c: float(row[c] or 0.0) for c in features}


def linear_shap(df: DataFrame, coef: dict[str, float], means: dict[str, float],
                keep: Sequence[str] = (), id_col: str = "row_id") -> DataFrame:
    """phi_j = beta_j * (x_j - mean_bg_j) (log-odds units), long form."""
    feats = list(coef)
    return df.select(F.col(id_col).alias("row_id"), *keep, F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"),
                 (F.lit(float(coef[c])) * (F.col(c).cast("double") - F.lit(means[c]))).alias("phi"))
        for c in feats])))


def lr_coefficients(model: Model, features: Sequence[str]) -> dict[str, float]:
    return {c: float(v) for c, v in zip(features, model.coefficients.toArray())}


# ---------------------------------------------------------------------------
# X5-X7, X9-X10 reductions
# ---------------------------------------------------------------------------
def mean_abs(phi: str = "phi") -> F.Column:
    """mean |phi|, added up in whole steps of 2^-40, so that it does not depend on the order of rows."""
    steps = F.round(F.abs(F.col(phi)) * float(1 << 40)).cast("decimal(20,0)")
    return (F.sum(steps).cast("double") / F.count(phi) / float(1 << 40)).alias("mean_abs")


def importance(attr: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """mean |phi| per feature (optionally per run / dataset)."""
    return attr.groupBy(*by, "feature").agg(mean_abs())


def attribution_disparity(attr: DataFrame, group_col: str, by: Sequence[str] = ()) -> DataFrame:
    """mean |phi| per (feature, group) of one sensitive column."""
    return attr.groupBy(*by, "feature", F.col(group_col).cast("string").alias("grp")).agg(mean_abs())


def flag_features(attr: DataFrame, group_col: str, by: Sequence[str] = (),
                  limit: float = DISPARITY_LIMIT, floor: float = DISPARITY_FLOOR) -> DataFrame:
    """(feature, spread, ratio, flagged): spread = max - min of the group means,
    ratio = spread / max(floor, overall mean |phi|), flagged when ratio > limit."""
    disp = attribution_disparity(attr, group_col, by).groupBy(*by, "feature").agg(
        (F.max("mean_abs") - F.min("mean_abs")).alias("spread"))
    imp = importance(attr, by)
    j = disp.join(imp, [*by, "feature"])
    ratio = F.col("spread") / F.greatest(F.lit(floor), F.col("mean_abs"))
    return j.select(*by, "feature", "spread", ratio.alias("ratio"), (ratio > limit).alias("flagged"))


def top_features(imp: DataFrame, features: Sequence[str], k: int = 10,
                 by: Sequence[str] = ()) -> DataFrame:
    """Top-k features by mean |phi|; ties keep the feature order. (feature, rank)."""
    pos = F.array_position(F.array(*[F.lit(c) for c in features]), F.col("feature"))
    w = Window.partitionBy(*by).orderBy(F.col("mean_abs").desc(), pos) if by else \
        Window.orderBy(F.col("mean_abs").desc(), pos)
    return (imp.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
               .select(*by, "feature", F.col("rank").cast("int").alias("rank")))


def topk_consistency(imp_runs: DataFrame, features: Sequence[str], k: int = 10,
                     run_col: str = "run_id", by: Sequence[str] = ()) -> DataFrame:
    """|intersection| / |union| of the top-k sets across runs (1.0 with < 2 runs)."""
    keys = list(by) or ["__all"]
    if not by:
        imp_runs = imp_runs.withColumn("__all", F.lit(0))
    top = top_features(imp_runs, features, k, [*keys, run_col])
    runs = imp_runs.groupBy(*keys).agg(F.countDistinct(run_col).alias("n_runs"))
    per = top.groupBy(*keys, "feature").agg(F.countDistinct(run_col).alias("c"))
    j = per.join(runs, keys)
    out = j.groupBy(*keys).agg(F.first("n_runs").cast("long").alias("n_runs"),
                               F.count(F.when(F.col("c") == F.col("n_runs"), 1)).cast("long").alias("inter"),
                               F.count(F.lit(1)).cast("long").alias("uni"))
    out = out.drop("__all")
    return out.withColumn("consistency", F.when(F.col("n_runs") < 2, F.lit(1.0)).otherwise(
        F.col("inter") / F.greatest(F.col("uni"), F.lit(1))))


# ---------------------------------------------------------------------------
# X4 permutation-sampling Shapley values (model agnostic)
# ---------------------------------------------------------------------------
def sampling_shap(model: Model, rows: DataFrame, features: Sequence[str], means: dict[str, float],
                  n_perm: int = 10, seed: int = 42, keep: Sequence[str] = ()) -> DataFrame:
    """Shapley values against the background mean by permutation sampling.

    Rows x permutation m x step p (0..d): features whose position in permutation
    m is < p take the row's value, the rest the background mean. One
    ``model.transform`` scores all of them; a lag over p inside (row, m)
    gives the marginal of the feature added at p. Additive by construction:
    sum(phi) = f(x) - f(background mean)."""
    feats = list(features)
    d = len(feats)
    base = rows.select(F.col("row_id"), *keep, *feats)
    x = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))).alias("m"))
    keys = [F.struct(hash_uniform(seed, f"perm{j}", "row_id", "m").alias("h"), F.lit(j).alias("j"))
            for j in range(d)]
    x = x.withColumn("__perm", F.transform(F.array_sort(F.array(*keys)), lambda s: s["j"]))
    x = x.select("*", F.explode(F.sequence(F.lit(0), F.lit(d))).alias("p"))
    # position of feature j in the permutation, and the feature added at step p
    cols = []
    for j, c in enumerate(feats):
        pos = F.array_position(F.col("__perm"), F.lit(j)) - 1
        cols.append(F.when(pos < F.col("p"), F.col(c)).otherwise(F.lit(means[c])).alias(c))
    added = F.when(F.col("p") > 0, F.element_at(F.col("__perm"), F.col("p")))
    x = x.select("row_id", *keep, "m", "p", added.alias("__j"), *cols)
    s = score(model, x, feats, ["row_id", *keep, "m", "p", "__j"])
    w = Window.partitionBy("row_id", "m").orderBy("p")
    s = s.withColumn("__marg", F.col("proba") - F.lag("proba").over(w)).where(F.col("p") > 0)
    names = F.array(*[F.lit(c) for c in feats])
    return (s.groupBy("row_id", *keep, "__j").agg(F.avg("__marg").alias("phi"))
             .select("row_id", *keep, F.element_at(names, F.col("__j") + 1).alias("feature"), "phi"))


# ---------------------------------------------------------------------------
# X8 LIME
# ---------------------------------------------------------------------------
def _ridge_per_row(features: Sequence[str], top: int, alpha: float = 1.0):
    feats = list(features)

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        z = pdf[[f"__z_{c}" for c in feats]].to_numpy(dtype=np.float64)
        y = pdf["proba"].to_numpy(dtype=np.float64)
        w = pdf["__w"].to_numpy(dtype=np.float64)
        sw = np.sqrt(w)
        zm = np.average(z, axis=0, weights=w)
        ym = np.average(y, weights=w)
        a = (z - zm) * sw[:, None]
        b = (y - ym) * sw
        coef = np.linalg.solve(a.T @ a + alpha * np.eye(len(feats)), a.T @ b)
        order = np.argsort(-np.abs(coef), kind="stable")[:top]
        return pd.DataFrame({"row_id": np.full(len(order), pdf["row_id"].iloc[0], dtype=np.int64),
                             "feature": [feats[i] for i in order],
                             "weight": coef[order]})
    return fn


def lime(model: Model, rows: DataFrame, train: DataFrame, features: Sequence[str],
         n_samples: int = LIME_SAMPLES, seed: int = 42, top: int = 10) -> DataFrame:
    """Local surrogate per explained row: Gaussian samples around the training
    mean (scaled by training std), kernel width 0.75 * sqrt(d), weighted ridge
    (alpha 1) on the standardised samples; top weights per row.
    Returns (row_id, feature, weight)."""
    feats = list(features)
    d = len(feats)
    st = train.agg(*[F.avg(c).alias(f"m_{c}") for c in feats],
                   *[F.stddev_pop(c).alias(f"s_{c}") for c in feats]).first()
    mean = {c: float(st[f"m_{c}"] or 0.0) for c in feats}
    sd = {c: float(st[f"s_{c}"] or 0.0) or 1.0 for c in feats}
    x = rows.select("row_id", *feats).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))).alias("__s"))
    x = x.select("*", *[hash_open_uniform(seed, f"lime{j}", "row_id", "__s").alias(f"__u{j}")
                        for j in range(d)])
    x = with_norm_ppf(x, {f"__g{j}": f"__u{j}" for j in range(d)})
    # sample 0 is the instance itself
    zc = [F.when(F.col("__s") == 0, (F.col(c) - mean[c]) / sd[c]).otherwise(F.col(f"__g{j}"))
          .alias(f"__z_{c}") for j, c in enumerate(feats)]
    z0 = [((F.col(c) - mean[c]) / sd[c]).alias(f"__z0_{c}") for c in feats]
    x = x.select("row_id", "__s", *zc, *z0)
    xin = x.select("*", *[(F.col(f"__z_{c}") * sd[c] + mean[c]).alias(c) for c in feats])
    dist2 = sum(((F.col(f"__z_{c}") - F.col(f"__z0_{c}")) ** 2 for c in feats), F.lit(0.0))
    width = 0.75 * np.sqrt(d)
    xin = xin.withColumn("__w", F.sqrt(F.exp(-dist2 / (width * width))))
    sc = score(model, xin, feats, ["row_id", "__w", *[f"__z_{c}" for c in feats]])
    return sc.groupBy("row_id").applyInPandas(_ridge_per_row(feats, top),
                                             "row_id long, feature string, weight double")


def lime_importance(weights: DataFrame, n_explained: int) -> DataFrame:
    """sum |weight| per feature divided by the number of explained rows."""
    return weights.groupBy("feature").agg(
        (F.sum(F.abs("weight")) / F.lit(max(1, n_explained))).alias("mean_abs"))


def explain_sample(df: DataFrame, n: int | None, seed: int, salt: str) -> DataFrame:
    """The rows to explain / the background (X1): all of them, or n rows by hash order."""
    return df if n is None else sample_n(df, n, seed, "row_id", salt)


# ---------------------------------------------------------------------------
# X3 TreeSHAP for Spark tree ensembles (path-dependent, Lundberg et al. 2018)
# ---------------------------------------------------------------------------
def forest_arrays(model: Model) -> list[dict]:
    """Node arrays per tree (left, right, feature, threshold, value = class-1
    fraction, cover = weighted count), read from the saved model. The size is
    bounded by the model (trees x nodes), not by the data."""
    import uuid

    from ..session import ensure_checkpoint_dir
    spark = model.sparkSession if hasattr(model, "sparkSession") else None
    from pyspark.sql import SparkSession
    spark = spark or SparkSession.getActiveSession()
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/models/forest-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    if "treeID" not in nodes.columns:           # a single decision tree
        nodes = nodes.withColumn("treeID", F.lit(0))
    rows = nodes.select("treeID", "nodeData.id", "nodeData.impurityStats", "nodeData.leftChild",
                        "nodeData.rightChild", "nodeData.split.featureIndex",
                        "nodeData.split.leftCategoriesOrThreshold").collect()
    trees: dict[int, list] = {}
    for r in rows:
        trees.setdefault(r["treeID"], []).append(r)
    out = []
    for tid in sorted(trees):
        rs = sorted(trees[tid], key=lambda r: r["id"])
        n = len(rs)
        t = {"left": np.full(n, -1), "right": np.full(n, -1), "feat": np.zeros(n, dtype=int),
             "thr": np.zeros(n), "value": np.zeros(n), "cover": np.zeros(n)}
        for r in rs:
            i = r["id"]
            stats = np.asarray(r["impurityStats"], dtype=float)
            t["cover"][i] = stats.sum()
            t["value"][i] = stats[1] / stats.sum() if stats.sum() > 0 and len(stats) > 1 else 0.0
            t["left"][i], t["right"][i] = r["leftChild"], r["rightChild"]
            if r["leftChild"] >= 0:
                t["feat"][i] = r["featureIndex"]
                t["thr"][i] = r["leftCategoriesOrThreshold"][0]
        out.append(t)
    return out


def tree_paths(t: dict) -> list[tuple]:
    """Leaves of a tree as (features, lower and upper limits, share of the training rows that pass each
    feature's tests, value); a row reaches the leaf if lower < x <= upper for all its features."""
    out = []
    todo = [(0, {})]
    while todo:
        node, path = todo.pop()
        if t["left"][node] < 0:
            feats = sorted(path)
            out.append((feats, *(np.array([path[f][i] for f in feats]) for i in range(3)), float(t["value"][node])))
            continue
        f, cut = int(t["feat"][node]), float(t["thr"][node])
        lo, hi, share = path.get(f, (-np.inf, np.inf, 1.0))
        for child, limits in ((t["left"][node], (lo, min(hi, cut))), (t["right"][node], (max(lo, cut), hi))):
            if t["cover"][child] > 0:
                todo.append((int(child), {**path, f: (*limits, share * t["cover"][child] / t["cover"][node])}))
    return out


def _pattern_phi(share: np.ndarray) -> np.ndarray:
    """Shapley values of leaves with the same number m of features, for every pattern of tests passed:
    (leaves, 2^m, m), for a leaf value of 1. A coalition's value is the product over features of, inside
    it, whether the row passes, and outside, the share that passes."""
    n, m = share.shape
    passes = ((np.arange(1 << m)[:, None] >> np.arange(m)) & 1).astype(float)
    weight = np.array([math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m) for s in range(m)])
    out = np.empty((n, 1 << m, m))
    for j in range(m):
        by_size = np.zeros((n, 1 << m, m))              # sums over coalitions of the other features, by size
        by_size[..., 0] = 1.0
        for k in range(m):
            if k != j:
                grown = by_size * share[:, None, k, None]
                grown[..., 1:] += by_size[..., :-1] * passes[None, :, k, None]
                by_size = grown
        out[..., j] = (by_size @ weight) * (passes[None, :, j] - share[:, None, j])
    return out


def _tree_phi(t: dict, X: np.ndarray) -> np.ndarray:
    """Exact path-dependent Shapley values of one tree for all rows of X: per leaf a row only matters by
    which features' tests it passes, so their values are looked up by that pattern."""
    phi = np.zeros(X.shape)
    by_size: dict[int, list[tuple]] = {}
    for leaf in t["paths"] if "paths" in t else tree_paths(t):
        if leaf[0]:
            by_size.setdefault(len(leaf[0]), []).append(leaf)
    for m, leaves in by_size.items():
        tables = _pattern_phi(np.array([x[3] for x in leaves]))
        for (feats, lo, hi, _, value), table in zip(leaves, tables):
            pattern = np.zeros(len(X), dtype=np.int64)
            for i, f in enumerate(feats):
                pattern += ((X[:, f] > lo[i]) & (X[:, f] <= hi[i])).astype(np.int64) << i
            phi[:, feats] += (table * value)[pattern]
    return phi


def tree_base_value(trees: list[dict]) -> float:
    """Expected forest output: mean over trees of the cover-weighted leaf values."""
    vals = []
    for t in trees:
        leaves = t["left"] < 0
        vals.append(float((t["cover"][leaves] * t["value"][leaves]).sum() / t["cover"][0]))
    return float(np.mean(vals))


def tree_shap(model: Model, rows: DataFrame, features: Sequence[str], keep: Sequence[str] = ()
              ) -> DataFrame:
    """(row_id, keep..., feature, phi) for the class-1 probability of a Spark
    random forest / decision tree; sum(phi) + base value = predicted probability.

    The leaves are broadcast (bounded by the model); every task looks all of them up for its own
    rows, vectorised over the Arrow batch, so rows are neither copied nor shuffled."""
    feats = list(features)
    trees = [{"paths": tree_paths(t)} for t in forest_arrays(model)]
    spark = rows.sparkSession
    bc = spark.sparkContext.broadcast(trees)
    keep = list(keep)

    def fn(it):
        ts = bc.value
        for pdf in it:
            if pdf.empty:
                continue
            X = pdf[feats].to_numpy(dtype=np.float64)
            phi = sum(_tree_phi(t, X) for t in ts) / len(ts)
            out = pdf[["row_id", *keep]].loc[np.repeat(pdf.index.to_numpy(), len(feats))].reset_index(drop=True)
            out["feature"] = np.tile(np.array(feats, dtype=object), len(pdf))
            out["phi"] = phi.ravel()
            yield out

    key_types = [f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep]
    schema = ", ".join(["row_id long", *key_types, "feature string", "phi double"])
    return spread(rows.select("row_id", *keep, *feats)).mapInPandas(fn, schema)
