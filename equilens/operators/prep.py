"""Stage 1: cleaning, label coercion, imputation, stratified split, encoding, scaling.

Fitted state is kept as small DataFrames -- ``encoder(feature, value, code)``
and ``stats(feature, kind, fill_num, fill_cat, mean, std)`` -- and applied with
size-checked broadcast joins and literal projections. Each fit is one pass
(or a few passes for exact medians); nothing row-level reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, FloatType, NumericType, StringType

from ..functions.mathx import hash_uniform
from ..session import cut_lineage, cut_observed, together
from ..spec import MISSING_CATEGORY, TEST_SIZE, AuditSpec
from .dist import exact_median, exact_medians, k_smallest_flag, numbered

ENCODER_BROADCAST_ROWS = 500_000     # values of a dictionary that is broadcast whole
HOT_SHARE = 1000                     # of a larger one, values with a thousandth of the rows are


# ---------------------------------------------------------------------------
# Projection, names, tokens, missing rows, labels
# ---------------------------------------------------------------------------
def keep_columns(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Project to ``keep``, silently skipping names that do not exist."""
    return df.select(*[c for c in keep if c in df.columns])


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*[c for c in cols if c in df.columns])


def normalise_names(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Trim + lower-case column names; ``aliases`` {old: new} apply when ``new`` is absent."""
    names = [c.strip().lower() for c in df.columns]
    out = df.toDF(*names)
    for old, new in (aliases or {}).items():
        if old in out.columns and new not in out.columns:
            out = out.withColumnRenamed(old, new)
    return out


def null_tokens(df: DataFrame, tokens: Sequence[str], cols: Sequence[str] | None = None) -> DataFrame:
    """String tokens (e.g. '?', 'None') -> NULL in string columns; NaN -> NULL in
    floating columns. Tokens compare after trimming whitespace."""
    toks = list(tokens)
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if (cols is None or f.name in cols) and isinstance(f.dataType, StringType) and toks:
            out.append(F.when(F.trim(c).isin(toks), F.lit(None).cast("string"))
                        .otherwise(c).alias(f.name))
        elif (cols is None or f.name in cols) and isinstance(f.dataType, (DoubleType, FloatType)):
            out.append(F.when(F.isnan(c), F.lit(None).cast(f.dataType)).otherwise(c).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def drop_missing(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a NULL in any (or any of ``subset``) column."""
    return df.na.drop(how="any", subset=list(subset) if subset else None)


_OPS = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "ge": lambda a, b: a >= b,
        "gt": lambda a, b: a > b, "le": lambda a, b: a <= b, "lt": lambda a, b: a < b}


def label_from(col: str, op: str, value, strip_chars: str = "", trim: bool = True) -> Column:
    """0/1 label from a predicate: string (in)equality after trimming and
    removing ``strip_chars`` (e.g. '>50K.' -> '>50K'), or a numeric threshold."""
    c = F.col(col)
    if isinstance(value, str):
        if strip_chars:
            c = F.translate(c.cast("string"), strip_chars, "")
        if trim:
            c = F.trim(c.cast("string"))
    return F.when(c.isNull(), F.lit(None)).otherwise(_OPS[op](c, F.lit(value)).cast("int"))


def to_binary(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Coerce ``col`` to {0,1}: values already in {0,1} kept; floating columns ->
    ``>= median``; anything else -> 1 for the largest sorted value, else 0.
    One small aggregate decides the rule (and a distributed exact median if needed)."""
    out = out or col
    dt = df.schema[col].dataType
    c = F.col(col)
    if isinstance(dt, (NumericType, BooleanType)):
        num = c.cast("double")
        row = df.agg(F.count(F.when(c.isNotNull() & ~num.isin(0.0, 1.0), 1)).alias("bad"),
                     F.max(num).alias("mx")).first()
        if row["bad"] == 0:
            expr = num.cast("int")
        elif isinstance(dt, (DoubleType, FloatType)) or type(dt).__name__ == "DecimalType":
            med = exact_median(df, col)
            expr = (num >= F.lit(med)).cast("int")
        else:
            expr = (num == F.lit(row["mx"])).cast("int")
    else:
        mx = df.agg(F.max(c.cast("string"))).first()[0]
        expr = (c.cast("string") == F.lit(mx)).cast("int")
    return df.withColumn(out, F.when(c.isNull(), F.lit(None).cast("int")).otherwise(expr))


def split_kinds(df: DataFrame, features: Sequence[str],
                categorical: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """(numeric, categorical) from the schema: numeric/boolean types are numeric
    unless listed in ``categorical``; everything else is categorical. No scan."""
    num, cat = [], []
    for c in features:
        dt = df.schema[c].dataType
        if c not in categorical and isinstance(dt, (NumericType, BooleanType)):
            num.append(c)
        else:
            cat.append(c)
    return num, cat


# ---------------------------------------------------------------------------
# imputation
# ---------------------------------------------------------------------------
def fit_modes(df: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """(feature, fill_cat): most frequent non-null value, ties -> smallest value,
    'missing' when a column is all NULL. One pass: unpivot + grouped counts
    (map-side combine) + a min(struct) per feature."""
    if not categorical:
        return df.sparkSession.createDataFrame([], "feature string, fill_cat string")
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value"))
        for c in categorical])))
    counts = long.where(F.col("value").isNotNull()).groupBy("feature", "value").count()
    best = counts.groupBy("feature").agg(
        F.min(F.struct((F.lit(0) - F.col("count")).alias("k"), F.col("value").alias("v"))).alias("b"))
    feats = df.sparkSession.createDataFrame([(c,) for c in categorical], "feature string")
    return feats.join(best, "feature", "left").select(
        "feature", F.coalesce(F.col("b.v"), F.lit(MISSING_CATEGORY)).alias("fill_cat"))


def fit_medians(df: DataFrame, numeric: Sequence[str]) -> dict[str, float]:
    """Exact median per numeric column (0.0 when all NULL); distributed selection."""
    x = df.select(*[F.col(c).try_cast("double").alias(c) for c in numeric])
    meds = exact_medians(x, numeric)
    return {c: 0.0 if m is None or math.isnan(m) else m for c, m in meds.items()}


def impute(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]
           ) -> tuple[DataFrame, DataFrame]:
    """Median-fill numerics (non-numeric text -> NULL first), mode-fill categoricals.
    Returns (filled df, stats(feature, kind, fill_num, fill_cat))."""
    fits = together(df.sparkSession, {"medians": lambda: fit_medians(df, numeric), "modes": lambda: fit_modes(df, categorical).collect()})
    meds, modes = fits["medians"], {r["feature"]: r["fill_cat"] for r in fits["modes"]}
    cols = []
    for f in df.columns:
        if f in meds:
            cols.append(F.coalesce(F.col(f).try_cast("double"), F.lit(meds[f])).alias(f))
        elif f in modes:
            cols.append(F.coalesce(F.col(f).cast("string"), F.lit(modes[f])).alias(f))
        else:
            cols.append(F.col(f))
    rows = [(k, "numeric", float(v), None) for k, v in meds.items()]
    rows += [(k, "categorical", None, v) for k, v in modes.items()]
    stats = df.sparkSession.createDataFrame(
        rows, "feature string, kind string, fill_num double, fill_cat string")
    return df.select(*cols), stats


# ---------------------------------------------------------------------------
# Stratified split
# ---------------------------------------------------------------------------
def split_quotas(counts: dict[int, int], test_size: float = TEST_SIZE) -> dict[int, tuple[int, int]]:
    """{class: (n_train, n_test)}: n_test = ceil(test_size * n); train share per
    class = floor(n_train * n_c / n), the remainder to the largest fractional
    parts (ties -> smaller class, then smaller label)."""
    n = sum(counts.values())
    n_test = int(math.ceil(test_size * n))
    n_train = n - n_test
    base = {c: (n_train * k) // n for c, k in counts.items()}
    frac = {c: (n_train * k) % n for c, k in counts.items()}
    rem = n_train - sum(base.values())
    order = sorted(counts, key=lambda c: (-frac[c], counts[c], c))
    for c in order[:rem]:
        base[c] += 1
    return {c: (base[c], counts[c] - base[c]) for c in counts}


def stratified_split(df: DataFrame, label: str = "y", test_size: float = TEST_SIZE,
                     seed: int = 42, id_col: str = "row_id") -> DataFrame:
    """Adds ``split`` ('train'/'test'): per class, the test quota of rows with the
    smallest hash draw (u, id) goes to test. Exact quotas, deterministic under
    any partitioning, no single-task window over a class."""
    counts = {int(r[0]): int(r[1]) for r in df.groupBy(label).count().collect()}
    quotas = split_quotas(counts, test_size)
    qdf = df.sparkSession.createDataFrame([(c, q[1]) for c, q in quotas.items()],
                                          f"{label} int, quota long")
    u = df.withColumn("__u", hash_uniform(seed, "split", id_col))
    flagged = k_smallest_flag(u, [label], qdf, "__u", id_col, flag="__test")
    return flagged.withColumn("split", F.when(F.col("__test"), "test").otherwise("train")).drop(
        "__u", "__test")


# ---------------------------------------------------------------------------
# Encoding and scaling
# ---------------------------------------------------------------------------
def fit_encoder(train: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """encoder(feature, value, code): code = rank of the value in ascending
    lexical order of the train values, from 0, by range partitions and offsets."""
    if not categorical:
        return train.sparkSession.createDataFrame([], "feature string, value string, code int")
    long = train.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value"))
        for c in categorical])))
    distinct = long.where(F.col("value").isNotNull()).distinct()
    return numbered(distinct, ["value"], "code", ["feature"]).withColumn("code", F.col("code").cast("int"))


def encode(df: DataFrame, encoder: DataFrame, categorical: Sequence[str],
           suffix: str = "", broadcast_rows: int = ENCODER_BROADCAST_ROWS) -> DataFrame:
    """Replace each categorical column by its code (double); unseen or NULL -> 0, the code of the
    smallest train value. A dictionary of at most ``broadcast_rows`` values is broadcast (one count
    for all columns); of a larger one only the frequent values are, the others are joined by shuffle."""
    out = df
    if not categorical:
        return out
    sizes = {r["feature"]: r["count"] for r in encoder.groupBy("feature").count().collect()}
    for c in categorical:
        m = encoder.where(F.col("feature") == c).select(F.col("value").alias("__v"), F.col("code").alias("__code"))
        if sizes.get(c, 0) <= broadcast_rows:
            out = out.join(F.broadcast(m), F.col(c).cast("string") == F.col("__v"), "left")
        else:
            out = _join_large(out, c, m)
        out = out.withColumn(c + suffix, F.coalesce(F.col("__code"), F.lit(0)).cast("double")).drop("__v", "__code")
    return out


def _join_large(df: DataFrame, col: str, m: DataFrame) -> DataFrame:
    """Left join of ``col`` with the dictionary (__v, __code). Values that hold at least one of
    ``HOT_SHARE`` rows, of which there are at most as many, meet a broadcast part; NULL needs no join."""
    value = F.col(col).cast("string")
    counts = df.where(F.col(col).isNotNull()).groupBy(value.alias("__v")).count()
    n = df.count()
    hot = cut_lineage(m.join(counts.where(F.col("count") * HOT_SHARE >= n).select("__v"), "__v"), "hot_values")
    known = df.where(F.col(col).isNotNull())
    missing = df.where(F.col(col).isNull()).select("*", F.lit(None).cast("string").alias("__v"), F.lit(None).cast("int").alias("__code"))
    return (known.join(F.broadcast(hot), value == F.col("__v"))
            .unionByName(known.join(F.broadcast(hot.select("__v")), value == F.col("__v"), "left_anti")
                              .join(m, value == F.col("__v"), "left"))
            .unionByName(missing))


def fit_scaler(train: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """(feature, mean, std): population std, one aggregate pass."""
    if not numeric:
        return train.sparkSession.createDataFrame([], "feature string, mean double, std double")
    row = train.agg(*[F.avg(F.col(c).cast("double")).alias(f"m_{i}") for i, c in enumerate(numeric)],
                    *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{i}")
                      for i, c in enumerate(numeric)]).first()
    rows = [(c, float(row[f"m_{i}"] or 0.0), float(row[f"s_{i}"] or 0.0))
            for i, c in enumerate(numeric)]
    return train.sparkSession.createDataFrame(rows, "feature string, mean double, std double")


def scale(df: DataFrame, scaler: DataFrame) -> DataFrame:
    """z-score with the fitted (mean, std); std 0 divides by 1; NULL -> 0.0 afterwards."""
    params = {r["feature"]: (r["mean"], r["std"]) for r in scaler.collect()}
    cols = []
    for f in df.columns:
        if f in params:
            m, s = params[f]
            z = (F.col(f).cast("double") - F.lit(m)) / F.lit(s if s != 0 else 1.0)
            cols.append(F.coalesce(z, F.lit(0.0)).alias(f))
        else:
            cols.append(F.col(f))
    return df.select(*cols)


# ---------------------------------------------------------------------------
# Whole stage
# ---------------------------------------------------------------------------
@dataclass
class PrepState:
    spec: AuditSpec
    numeric: list[str]
    categorical: list[str]
    features: list[str]
    encoder: DataFrame
    fills: DataFrame
    scaler: DataFrame
    rows: dict = field(default_factory=dict)     # n_train, n_test, n_positive, seen while writing


def feature_list(df: DataFrame, spec: AuditSpec) -> list[str]:
    if spec.features:
        return list(spec.features)
    return [c for c in df.columns if c not in (spec.label, spec.id_col)]


def prepare(df: DataFrame, spec: AuditSpec, seed: int = 42,
            test_size: float = TEST_SIZE) -> tuple[DataFrame, PrepState]:
    """raw -> (row_id, split, y, s_<c> (encoded, unscaled), <feature> double...).

    Order of the reference: drop NULL labels, coerce label, impute on all rows,
    split, fit encoders and scaler on train only, capture sensitive columns
    after encoding and before scaling, residual NULL -> 0.
    """
    feats = feature_list(df, spec)
    numeric, categorical = split_kinds(df, feats, spec.categorical)
    base = df.select(F.col(spec.id_col).alias("row_id"), F.col(spec.label).alias("y"), *feats)
    if spec.null_tokens:
        base = null_tokens(base, spec.null_tokens, categorical)
    # the label rule, imputation fits, split, encoder and scaler each run a few
    # small jobs over this table: materialise it once instead of re-running the source
    base = cut_lineage(base.where(F.col("y").isNotNull()), "raw")
    # draws, splits and joins go by row id: repeated ids would multiply or merge rows
    def unique() -> None:
        twice = base.groupBy("row_id").count().where(F.col("count") > 1).limit(1).collect()
        if twice:
            raise ValueError(f"row id {twice[0][0]} occurs {twice[0][1]} times; ids must be unique")
    filled, fills = together(df.sparkSession, {"ids": unique, "filled": lambda: impute(to_binary(base, "y"), numeric, categorical)})["filled"]
    split = cut_lineage(stratified_split(filled, "y", test_size, seed, "row_id"), "split")
    train = split.where(F.col("split") == "train")
    encoder = fit_encoder(train, categorical)
    enc = encode(split, encoder, categorical)
    scaler = fit_scaler(enc.where(F.col("split") == "train"), numeric)
    sens = [F.col(c).cast("double").alias(f"s_{c}") for c in spec.sensitive]
    out = enc.select("row_id", "split", F.col("y").cast("int").alias("y"), *sens, *feats)
    out = scale(out, scaler)
    out = out.select("row_id", "split", "y", *[f"s_{c}" for c in spec.sensitive],
                     *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in feats])
    is_test = (F.col("split") == "test").cast("long")
    out, seen = cut_observed(out, "prepared", n=F.count(F.lit(1)), n_test=F.sum(is_test), n_positive=F.sum("y"))
    rows = {"n_train": int(seen["n"] or 0) - int(seen["n_test"] or 0), "n_test": int(seen["n_test"] or 0),
            "n_positive": int(seen["n_positive"] or 0)}
    state = PrepState(spec, numeric, categorical, feats, encoder, fills, scaler, rows)
    return out, state


def apply_prep(df: DataFrame, state: PrepState) -> DataFrame:
    """Apply a fitted state to new rows: unseen categories -> code 0, non-numeric
    text -> 0 *before* scaling (not the median), then z-score."""
    spec = state.spec
    base = df.select(F.col(spec.id_col).alias("row_id"), *state.features)
    enc = encode(base, state.encoder, state.categorical)
    enc = enc.select("row_id", *[
        F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c) if c in state.numeric
        else F.col(c) for c in state.features])
    return scale(enc, state.scaler)


def profile(prepared: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per split: rows, feature count, positive rate, NULL cells (one pass)."""
    nulls = sum((F.col(c).isNull().cast("long") for c in features), F.lit(0).cast("long"))
    return prepared.groupBy("split").agg(
        F.count(F.lit(1)).cast("long").alias("n"),
        F.lit(len(features)).cast("int").alias("n_features"),
        F.avg(F.col("y").cast("double")).alias("pos_rate"),
        F.sum(nulls).cast("long").alias("n_null"))
