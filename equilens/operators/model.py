"""Stage 3: scoring and model training with Spark ML; metrics in one aggregate.

Synthetic rows only ever enter training; scoring runs on the real held-out
rows (the leakage control). ``logistic_score`` is a deterministic weighted
risk score -> sigmoid, so every downstream operator can be checked exactly.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.mathx import safe_div
from ..session import ensure_checkpoint_dir, spread, together
from ..spec import THRESHOLD

LR_MAX_ITER = 200
LR_C = 1.0
RF_TREES = 100
RF_DEPTH = 8
RF_NODE_MEMORY_MB = 1024
FIT_ROWS = 100_000           # rows of a partition that a learner passes over, about


# ---------------------------------------------------------------------------
# M8 deterministic risk score
# ---------------------------------------------------------------------------
def logistic_score(terms: Sequence[Column], offset: float = 0.0) -> Column:
    """1 / (1 + exp(-(sum(terms) - offset)))."""
    s = F.lit(0.0)
    for t in terms:
        s = s + t.cast("double")
    return 1.0 / (1.0 + F.exp(-(s - F.lit(offset))))


def threshold(proba: Column, t: float = THRESHOLD) -> Column:
    """Prediction = proba >= t (inclusive)."""
    return (proba >= F.lit(t)).cast("int")


# ---------------------------------------------------------------------------
# M5 metrics
# ---------------------------------------------------------------------------
def classification_metrics(scored: DataFrame, y: str = "y", pred: str = "pred",
                           by: Sequence[str] = ()) -> DataFrame:
    """n, tp, fp, fn, tn, accuracy, f1, precision, recall (0 on a zero denominator);
    one pass, optionally per group ``by``."""
    yv, pv = F.col(y).cast("int"), F.col(pred).cast("int")
    g = scored.groupBy(*by) if by else scored.groupBy()
    m = g.agg(F.count(F.lit(1)).cast("long").alias("n"),
              F.count(F.when((yv == 1) & (pv == 1), 1)).cast("long").alias("tp"),
              F.count(F.when((yv == 0) & (pv == 1), 1)).cast("long").alias("fp"),
              F.count(F.when((yv == 1) & (pv == 0), 1)).cast("long").alias("fn"),
              F.count(F.when((yv == 0) & (pv == 0), 1)).cast("long").alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return m.select(*by, "n", "tp", "fp", "fn", "tn",
                    safe_div(tp + tn, F.col("n")).alias("accuracy"),
                    safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"),
                    safe_div(tp, tp + fp).alias("precision"),
                    safe_div(tp, tp + fn).alias("recall"))


# ---------------------------------------------------------------------------
# M1-M3 Spark ML models
# ---------------------------------------------------------------------------
def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out,
                           handleInvalid="keep").transform(df)


def fit_model(train: DataFrame, features: Sequence[str], kind: str = "rf", seed: int = 42,
              label: str = "y") -> Model:
    """lr: L2 logistic regression, C = 1 on a summed loss -> regParam = 1 / n,
    no standardisation, 200 iterations. rf: 100 trees, depth 8, sqrt features."""
    data = assemble(train, features).select(F.col(label).cast("double").alias("label"), "features")
    # iterative learners make many passes and a forest keeps its draws for every tree with each row: spread
    # the input over every core once, up front, and no partition of a forest's rows holds more than FIT_ROWS
    n = train.count()
    par = train.sparkSession.sparkContext.defaultParallelism
    if kind == "rf":
        par = max(par, -(-n // FIT_ROWS))
    if data.rdd.getNumPartitions() < par:
        data = data.repartition(par)
    if kind == "lr":
        est = LogisticRegression(maxIter=LR_MAX_ITER, regParam=1.0 / (LR_C * max(1, n)),
                                 elasticNetParam=0.0, standardization=False, fitIntercept=True)
    elif kind == "rf":
        # larger node-statistics budget: fewer passes per tree level for 100 trees
        est = RandomForestClassifier(numTrees=RF_TREES, maxDepth=RF_DEPTH,
                                     featureSubsetStrategy="sqrt", seed=seed,
                                     maxMemoryInMB=RF_NODE_MEMORY_MB, cacheNodeIds=True)
    else:
        raise ValueError(f"unknown model kind {kind}")
    return _without_summary(est.fit(data), train.sparkSession)


def _without_summary(model: Model, spark: SparkSession) -> Model:
    """The model without its training summary: saved and loaded again if it has one. A summary holds the
    session, which does not go to the tasks that score once a query of the session was observed."""
    if not getattr(model, "hasSummary", False):
        return model
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/models/fitted-{uuid.uuid4().hex}"
    model.save(path)
    return type(model).load(path)


def as_rule(model: Model | Callable, features: Sequence[str]) -> Model | Callable:
    """A two-class logistic regression as the rule that gives its probability, in plain column arithmetic;
    other models as they are."""
    if not isinstance(model, LogisticRegressionModel) or model.numClasses != 2:
        return model
    weights, offset = [float(b) for b in model.coefficients.toArray()], -float(model.intercept)
    return lambda x: logistic_score([F.lit(b) * x[c] for b, c in zip(weights, features)], offset)


def score(model: Model | Callable[[dict[str, Column]], Column], df: DataFrame, features: Sequence[str],
          keep: Sequence[str] = (), t: float = THRESHOLD) -> DataFrame:
    """(keep..., proba, pred): positive-class probability and the thresholded prediction. A model is a
    Spark ML model or a rule: a function of {feature: column} that gives the probability."""
    if not isinstance(model, Model):
        out = df.select(*keep, model({c: F.col(c) for c in features}).cast("double").alias("proba"))
        return out.withColumn("pred", threshold(F.col("proba"), t))
    out = _without_summary(model, df.sparkSession).transform(assemble(df, features))
    proba = vector_to_array("probability")[1]
    return out.select(*keep, proba.alias("proba")).withColumn("pred", threshold(F.col("proba"), t))


def score_all(models: dict, df: DataFrame, features: Sequence[str], keep: Sequence[str] = (),
              t: float = THRESHOLD) -> DataFrame:
    """(keep..., pred_<name> per model): the predictions of several models side by side, in one pass over
    ``df``; the feature vector is made once. Fitted models are much work a row (a hundred trees each), so
    rows are dealt over all cores first."""
    if any(isinstance(m, Model) for m in models.values()):
        df = spread(df)
    out = assemble(df, features, "__x")
    cols = []
    for k, m in models.items():
        if isinstance(m, Model):
            m = _without_summary(m, df.sparkSession)
            own = m.copy({m.featuresCol: "__x", m.probabilityCol: f"__p_{k}", m.rawPredictionCol: f"__r_{k}",
                          m.predictionCol: f"__c_{k}"})
            out = own.transform(out)
            p = vector_to_array(f"__p_{k}")[1]
        else:
            p = m({c: F.col(c) for c in features}).cast("double")
        cols.append(threshold(p, t).alias(f"pred_{k}"))
    return out.select(*keep, *cols)


def minmax_scores(df: DataFrame, raw: str, out: str = "proba") -> DataFrame:
    """Unbounded decision scores -> [0, 1]: (s - min) / (max - min + 1e-9); one
    aggregate for min/max, then a projection."""
    mm = df.agg(F.min(raw).alias("lo"), F.max(raw).alias("hi")).first()
    lo, hi = float(mm["lo"] or 0.0), float(mm["hi"] or 0.0)
    return df.withColumn(out, (F.col(raw) - F.lit(lo)) / F.lit(hi - lo + 1e-9))


@dataclass
class TrainResult:
    kind: str
    augmentation: str
    model: Model
    scored: DataFrame
    metrics: DataFrame


def train_eval(train: DataFrame, test: DataFrame, features: Sequence[str], kind: str = "rf",
               augmentation: str = "baseline", seed: int = 42,
               s_cols: Sequence[str] = ()) -> TrainResult:
    """Fit on ``train`` (may hold synthetic rows), score the real ``test`` rows."""
    model = fit_model(train, features, kind, seed)
    scored = score(model, test, features, ["row_id", "y", *s_cols])
    return TrainResult(kind, augmentation, model, scored, classification_metrics(scored))


def augment_at_once(kind: str) -> int:
    """Augmentations that run side by side: a forest's draws follow the order and the files of its rows, which
    they may change."""
    return 1 if kind == "rf" else 3


def ablate(train: DataFrame, test: DataFrame, features: Sequence[str], sensitive: Sequence[str],
           kinds: Sequence[str] = ("baseline", "smote", "cf", "copula", "smote_copula", "full"),
           model_kind: str = "rf", seed: int = 42) -> DataFrame:
    """Accuracy / F1 / precision / recall per augmentation, one row each. Every model is fitted on its whole
    table: counterfactual copies are those of all training rows."""
    from .augment import augment_batches
    s_cols = [f"s_{c}" for c in sensitive]
    rows = None
    batches = augment_batches(train, features, sensitive, seed, kinds, at_once=augment_at_once(model_kind))
    results = together(train.sparkSession, {k: partial(train_eval, b, test, features, model_kind, k, seed, s_cols)
                                            for k, b in batches.items()})
    for k in kinds:
        m = results[k].metrics.select(F.lit(k).alias("augmentation"), "*")
        rows = m if rows is None else rows.unionByName(m)
    return rows


def leakage_test(model: Model, features: Sequence[str], test_real: DataFrame,
                 test_synth: DataFrame) -> DataFrame:
    """Accuracy (percent) on real held-out rows vs on real + synthetic held-out
    rows, and the difference real - mixed (inflation shows as a negative diff)."""
    real = score(model, test_real, features, ["y"]).withColumn("__syn", F.lit(0))
    syn = score(model, test_synth, features, ["y"]).withColumn("__syn", F.lit(1))
    both = real.unionByName(syn)
    hit = (F.col("y") == F.col("pred")).cast("double")
    return both.agg((F.avg(F.when(F.col("__syn") == 0, hit)) * 100).alias("real_only"),
                    (F.avg(hit) * 100).alias("real_plus_synth")).withColumn(
        "delta", F.col("real_only") - F.col("real_plus_synth"))
