"""End-to-end audit: prepare -> augment -> train/score -> fairness -> attributions -> run row.

Each stage returns lazy DataFrames; actions are the model fits, small
aggregates (metrics, class counts, the d x d correlation) and the run row.
Reused intermediates (prepared table, SMOTE rows, copula rows,
counterfactual rows) are written once to the shared checkpoint folder.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import partial

from pyspark.ml.classification import LogisticRegressionModel, RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import augment as ax
from ..operators import explain as xx
from ..operators import fairness as fx
from ..operators import fidelity as fid
from ..operators import model as mx
from ..operators import prep as px
from ..operators import report as rp
from ..operators import surrogate as sg
from ..operators.dist import sample_n
from ..session import cut_lineage, cut_observed, together
from ..spec import COUNTERFACTUAL_N, AuditSpec
from .history import RunStore

VARIANTS = {"baseline": "baseline", "smote": "smote", "cf": "cf", "gan": "copula", "smote_gan": "smote_copula", "full": "full"}
LIME_ROWS = 25               # rows that get a local surrogate (a report on a sample, as the operator is meant)
TOP_FEATURES = 5


@dataclass
class AuditResult:
    run: DataFrame                      # one row, RUNS_SCHEMA
    fairness_before: DataFrame
    fairness_after: DataFrame
    record: DataFrame
    attributions: DataFrame | None
    stage_seconds: dict[str, float] = field(default_factory=dict)


def _summary_struct(fair: DataFrame) -> dict:
    row = fx.fairness_summary(fair).first()
    return {"dpd_avg": row["dpd_avg"], "dir_avg": row["dir_avg"], "eod_avg": row["eod_avg"],
            "bias_score": row["bias_score"], "fail_count": int(row["fail_count"])}


def _attributions(model, rows: DataFrame, feats: list[str], means: dict[str, float], keep: list[str],  # noqa: ANN001
                  n_perm: int, seed: int) -> DataFrame:
    """Attributions by the method that fits the model: exact for linear models, forests, and any model of
    up to 12 features; else by sampled permutations."""
    if isinstance(model, LogisticRegressionModel):
        return xx.linear_shap(rows, xx.lr_coefficients(model, feats), means, keep)
    if isinstance(model, RandomForestClassificationModel):
        return xx.tree_shap(model, rows, feats, keep)
    if len(feats) <= sg.LATTICE_FEATURES:
        return sg.lattice_shap(model, rows, feats, means, keep)
    return xx.sampling_shap(model, rows, feats, means, n_perm, seed, keep)


def _lime_top(model, rows: DataFrame, train: DataFrame, feats: list[str], n: int, seed: int) -> list[str]:  # noqa: ANN001
    some = sample_n(rows, n, seed, "row_id", "lime_rows")
    fit = sg.local_surrogate if len(feats) <= sg.SOLVE_FEATURES else xx.lime
    imp = xx.lime_importance(fit(model, some, train, feats, seed=seed), n)
    return [r["feature"] for r in xx.top_features(imp, feats, TOP_FEATURES).orderBy("rank").collect()]


def audit_one(df: DataFrame, spec: AuditSpec, model_kind: str = "rf", seed: int = 42,
              run_xai: bool = True, n_explain: int | None = None,
              n_background: int | None = None, n_perm: int = 10, n_lime: int = LIME_ROWS,
              rules: dict | None = None, leakage: bool = False, domain: str | None = None) -> AuditResult:
    """Full audit of one table (the reference's per-dataset run). ``rules`` ({variant: rule}) stands in
    for the fitted models; nothing is augmented or fitted then. ``leakage`` adds the test with synthetic
    rows among the held-out ones. Attributions cover all test rows unless ``n_explain`` is given; the
    local surrogates are a report on ``n_lime`` rows."""
    spark = df.sparkSession
    t0 = time.perf_counter()
    times: dict[str, float] = {}
    lap = [t0]

    def mark(stage: str) -> None:
        now = time.perf_counter()
        times[stage] = times.get(stage, 0.0) + now - lap[0]
        lap[0] = now

    prepared, state = px.prepare(df, spec, seed)
    feats = state.features
    s_cols = [f"s_{c}" for c in spec.sensitive]
    train = prepared.where(F.col("split") == "train").drop("split")
    test = prepared.where(F.col("split") == "test").drop("split")
    n_train, n_test = state.rows["n_train"], state.rows["n_test"]
    mark("preprocess")

    # stages 2 and 3: every synthetic batch once, one fit each; all models score the real test rows
    # in one pass, written once
    fidelity = None
    if rules is None:
        b = ax.augment_batches(train, feats, spec.sensitive, seed, tuple(VARIANTS.values()), cf_n=COUNTERFACTUAL_N, n_train=n_train,
                               at_once=mx.augment_at_once(model_kind))
        mark("augment")
        steps = {k: partial(mx.fit_model, b[v], feats, model_kind, seed) for k, v in reversed(VARIANTS.items())}
        steps["fidelity"] = lambda: fid.fidelity(b["copula"], state.numeric, state.categorical).first()
        models = together(spark, steps)
        row = models.pop("fidelity")
        fidelity = {"ks_mean": row["ks_mean"], "chi_mean": row["chi_mean"], "n_synth": int(row["n_synth"])}
        models = {k: models[k] for k in VARIANTS}
    else:
        models = dict(rules)
    hits = {f"acc_{k}": F.avg((F.col("y") == F.col(f"pred_{k}")).cast("double")) for k in models}
    scored, acc = cut_observed(mx.score_all(models, test, feats, ["row_id", "y", *s_cols]), "scored", **hits)
    acc = {k: float(acc[f"acc_{k}"]) for k in models}
    mark("training")

    # stage 4: fairness before (baseline) / after (full)
    name = spec.name
    fair = {}
    for k in ("baseline", "full"):
        f = fx.fairness(scored, s_cols, name, "y", f"pred_{k}", spec.thresholds)
        fair[k] = cut_lineage(f.withColumn("sensitive", F.expr("substring(sensitive, 3)")), "fairness")
    sb, sa = _summary_struct(fair["baseline"]), _summary_struct(fair["full"])
    leak = None
    if leakage:
        mixed = ax.smote(test, feats, [], seed=seed)
        r = mx.leakage_test(models["full"], feats, test, mixed).first()
        leak = {k: r[k] for k in ("real_plus_synth", "real_only", "delta")}
    mark("fairness")

    # stage 5: attributions of the full model (and of the baseline, to compare) on real test rows
    top5: list[str] = []
    lime: list[str] = []
    flagged: list[str] = []
    shifts: list[dict] = []
    attr = None
    if run_xai:
        bg = xx.explain_sample(train, n_background, seed, "background")
        ex = xx.explain_sample(test, n_explain, seed, "explain")
        means = xx.background_means(bg, feats)
        of = lambda k: _attributions(models[k], ex, feats, means, s_cols[:1], n_perm, seed)
        mean_of = lambda x: {r["feature"]: r["mean_abs"] for r in xx.importance(x).collect()}
        got = together(spark, {"full": lambda: cut_lineage(of("full"), "attr"), "baseline": lambda: mean_of(of("baseline")),
                               "lime": lambda: _lime_top(models["full"], test, train, feats, n_lime, seed)})
        attr, before, lime = got["full"], got["baseline"], got["lime"]
        after = mean_of(attr)
        pos = {c: i for i, c in enumerate(feats)}
        top5 = sorted(after, key=lambda c: (-after[c], pos[c]))[:TOP_FEATURES]
        flagged = sorted([r["feature"] for r in xx.flag_features(attr, s_cols[0]).where("flagged").collect()], key=pos.get)
        shifts = [{"feature": c, "before": before.get(c), "after": after[c],
                   "note": "flagged" if c in flagged else ""} for c in top5]
        mark("attribution")

    acc_df = spark.createDataFrame([(name, acc["full"])], "dataset string, accuracy double")
    fl_df = spark.createDataFrame([(name, i, f) for i, f in enumerate(flagged)],
                                  "dataset string, rank int, feature string")
    record = rp.audit_record(fair["full"], acc_df, fl_df, spec.sensitive)
    elapsed = time.perf_counter() - t0
    row = (name, seed, n_train, n_test, len(feats), list(spec.sensitive),
           *[acc.get(k) for k in ("baseline", "smote", "cf", "gan", "full")],
           sb, sa, top5, flagged, fidelity, float(elapsed), acc.get("smote_gan"), domain, leak, lime, shifts, times)
    run = spark.createDataFrame([row], rp.RUNS_SCHEMA)
    return AuditResult(run, fair["baseline"], fair["full"], record, attr, times)


Loader = Callable[[SparkSession], tuple[DataFrame, AuditSpec]]


def audit_all(spark: SparkSession, loaders: dict[str, Loader], names: Sequence[str] | None = None,
              model_kind: str = "rf", seed: int = 42, run_xai: bool = True, store: RunStore | None = None,
              **options) -> tuple[DataFrame | None, DataFrame]:  # noqa: ANN003
    """Run the audit over registered tables. Unknown names and load/audit
    failures are returned as rows of the second table, not swallowed. With a ``store`` each run is saved
    as soon as it is there; ``options`` go to ``audit_one`` and are part of the run's configuration."""
    runs = None
    problems = []
    for name in names or list(loaders):
        if name not in loaders:
            problems.append((name, "unknown dataset"))
            continue
        try:
            df, spec = loaders[name](spark)
            r = audit_one(df, spec, model_kind, seed, run_xai, **options).run
            if store is not None:
                store.save(r, config_of(model_kind, run_xai, options))
            runs = r if runs is None else runs.unionByName(r)
        except Exception as e:  # noqa: BLE001 -- recorded, not hidden
            problems.append((name, f"{type(e).__name__}: {e}"[:500]))
    errs = spark.createDataFrame(problems, "dataset string, error string")
    return runs, errs


def config_of(model_kind: str, run_xai: bool, options: dict) -> dict:
    """What distinguishes runs of one dataset and seed; rules by their names."""
    return {"model": model_kind, "xai": run_xai,
            **{k: sorted(v) if isinstance(v, dict) else v for k, v in options.items()}}


def sweep(spark: SparkSession, loaders: dict[str, Loader], seeds: Sequence[int],
          names: Sequence[str] | None = None, model_kind: str = "rf", run_xai: bool = False,
          store: RunStore | None = None, **options) -> tuple[DataFrame | None, DataFrame]:  # noqa: ANN003
    """Multi-seed sweep: one run row per (dataset, seed), and the failures (seed, dataset, error). With a
    ``store``, runs that it already holds for this configuration are not made again."""
    out = failed = None
    config = config_of(model_kind, run_xai, options)
    chosen = list(names or loaders)

    def of_seed(s: int) -> tuple[DataFrame | None, DataFrame | None]:
        todo = chosen if store is None else [n for n in chosen if (n, s) not in store.done(config)]
        return audit_all(spark, loaders, todo, model_kind, s, run_xai, store, **options) if todo else (None, None)
    # runs of regressions that nothing stores go two at a time
    results = together(spark, {str(i): partial(of_seed, s) for i, s in enumerate(seeds)}, at_once=2 if store is None and model_kind == "lr" else 1)
    for s, (runs, errs) in zip(seeds, results.values()):
        if errs is not None:
            errs = errs.select(F.lit(s).alias("seed"), "dataset", "error")
            failed = errs if failed is None else failed.unionByName(errs)
        if runs is not None:
            out = runs if out is None else out.unionByName(runs)
    if failed is None:
        failed = spark.createDataFrame([], "seed int, dataset string, error string")
    return (out if store is None else store.runs(config)), failed


def summary_from_runs(runs: DataFrame, k: int = TOP_FEATURES) -> DataFrame:
    """Per-dataset summary in the shape the report tables read (stability over seeds, fairness before/after
    means, leakage, attributions, agreement of the runs' first ``k`` features). The table that all
    synthetic rows make is at once the full one and the one of SMOTE and copula rows with copies."""
    pct = lambda c: F.avg(F.col(c) * 100)
    g = runs.groupBy("dataset").agg(
        F.first("sensitive").alias("sens"), F.max(F.col("n_train") + F.col("n_test")).alias("size"), F.first("domain").alias("domain"),
        *[pct(f"accuracy_{v}").alias(v) for v in ("baseline", "smote", "cf", "gan", "smote_gan", "full")],
        F.min(F.col("accuracy_full") * 100).alias("low"), F.max(F.col("accuracy_full") * 100).alias("high"),
        *[F.avg(f"fairness_{t}.{m}").alias(f"{m}_{t}") for m in ("dpd_avg", "dir_avg", "eod_avg", "bias_score") for t in ("before", "after")],
        *[F.avg(f"leakage.{m}").alias(m) for m in ("real_plus_synth", "real_only", "delta")])
    for method in ("shap", "lime"):
        s = rp.topk_stability(runs, f"{method}_topk", k)
        g = g.join(s.select("dataset", F.col("score").alias(method), F.col("var").alias(f"{method}_var")), "dataset")
    shift = runs.select("dataset", F.inline("shap_features")).groupBy("dataset", "feature").agg(
        F.avg("before").alias("before"), F.avg("after").alias("after"), F.max("note").alias("note"))
    shift = shift.groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct("feature", "before", "after", "note"))).alias("shap_features"))
    g = g.join(shift, "dataset", "left")
    c = F.col
    return g.select(
        F.lit(None).cast("int").alias("pos"), "dataset", "domain",
        F.array_join("sens", ", ").alias("sensitive"), c("size").cast("long").alias("size"),
        F.struct(c("baseline"), c("smote_gan").alias("smote_gan_only"), c("cf").alias("counterfactual_only"),
                 c("full").alias("smote_gan_then_cf"), c("full").alias("full_framework")).alias("accuracy"),
        F.struct("real_plus_synth", "real_only", "delta").alias("leakage"),
        F.struct(c("baseline"), c("full").alias("mean"), c("low"), c("high")).alias("stability_10runs"),
        F.struct(*[c(f"{m}_avg_{t}").alias(f"{m}_{t}") for m in ("dpd", "dir", "eod") for t in ("before", "after")],
                 rp.bias_reduction(c("bias_score_before"), c("bias_score_after")).alias("bias_reduction_pct")).alias("fairness"),
        F.struct("shap", "shap_var", "lime", "lime_var").alias("xai_consistency"), "shap_features")
