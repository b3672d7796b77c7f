"""Scalar Column functions: normal CDF / quantile, deterministic draws, guards.

Everything here builds JVM-side Column expressions (whole-stage codegen, no
Python in the hot path). The same constants also render as SQL text so the
DuckDB oracle evaluates the identical formula.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (published approximations; must stay exactly as written)
# ---------------------------------------------------------------------------
# Normal CDF, West (2005) after Hart (1968); numerator / denominator
# coefficients, highest power first.
HART_N = (0.0352624965998911, 0.700383064443688, 6.37396220353165,
          33.912866078383, 112.079291497871, 221.213596169931,
          220.206867912376)
HART_D = (0.0883883476483184, 1.75566716318264, 16.064177579207,
          86.7807322029461, 296.564248779674, 637.333633378831,
          793.826512519948, 440.413735824752)
HART_SPLIT = 7.07106781186547
HART_CUTOFF = 37.0
SQRT_2PI = 2.506628274631

# Normal quantile, Wichura (1988) AS241 PPND16, highest power first.
AS241_A = (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853,
           45921.953931549871457, 13731.693765509461125, 1971.5909503065514427,
           133.14166789178437745, 3.387132872796366608)
AS241_B = (5226.495278852854561, 28729.085735721942674, 39307.89580009271061,
           21213.794301586595867, 5394.1960214247511077, 687.1870074920579083,
           42.313330701600911252, 1.0)
AS241_C = (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177,
           1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055,
           4.6303378461565452959, 1.42343711074968357734)
AS241_D = (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966,
           0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494,
           2.05319162663775882187, 1.0)
AS241_E = (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386,
           0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358,
           5.4637849111641143699, 6.6579046435011037772)
AS241_F = (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5,
           7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531,
           0.59983220655588793769, 1.0)

TWO_POW_48 = 281474976710656.0


def _horner(x: Column, coeffs: Sequence[float]) -> Column:
    acc = F.lit(coeffs[0])
    for c in coeffs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def _horner_sql(x: str, coeffs: Sequence[float]) -> str:
    acc = repr(coeffs[0])
    for c in coeffs[1:]:
        acc = f"(({acc}) * {x} + {c!r})"
    return acc


# ---------------------------------------------------------------------------
# Normal CDF
# ---------------------------------------------------------------------------
def norm_lower_tail(a: Column) -> Column:
    """Phi(-a) for a >= 0 (the upper tail mass of |x|)."""
    e = F.exp(-(a * a) / 2.0)
    b = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        b = a + F.lit(k) / b
    return (F.when(a > HART_CUTOFF, F.lit(0.0))
             .when(a < HART_SPLIT, e * _horner(a, HART_N) / _horner(a, HART_D))
             .otherwise(e / b / SQRT_2PI))


def norm_cdf(x: Column) -> Column:
    """Standard normal CDF as a Column expression (max abs error ~1e-16)."""
    x = x.cast("double")
    c = norm_lower_tail(F.abs(x))
    return F.when(x > 0, 1.0 - c).otherwise(c)


def two_sided_p(z: Column) -> Column:
    """2 * Phi(-|z|): keeps precision in the tail."""
    return 2.0 * norm_lower_tail(F.abs(z.cast("double")))


def norm_lower_tail_sql(a: str) -> str:
    e = f"exp(-({a}) * ({a}) / 2.0)"
    b = f"({a} + 0.65)"
    for k in (4.0, 3.0, 2.0, 1.0):
        b = f"({a} + {k!r} / {b})"
    return (f"(CASE WHEN {a} > {HART_CUTOFF!r} THEN 0.0 "
            f"WHEN {a} < {HART_SPLIT!r} THEN {e} * {_horner_sql(a, HART_N)} / {_horner_sql(a, HART_D)} "
            f"ELSE {e} / {b} / {SQRT_2PI!r} END)")


def norm_cdf_sql(x: str) -> str:
    c = norm_lower_tail_sql(f"abs({x})")
    return f"(CASE WHEN ({x}) > 0 THEN 1.0 - {c} ELSE {c} END)"


def two_sided_p_sql(z: str) -> str:
    return f"(2.0 * {norm_lower_tail_sql(f'abs({z})')})"


# ---------------------------------------------------------------------------
# Normal quantile (AS241)
# ---------------------------------------------------------------------------
def _ppf_from(q: Column, r: Column) -> Column:
    central = q * _horner(0.180625 - q * q, AS241_A) / _horner(0.180625 - q * q, AS241_B)
    near = _horner(r - 1.6, AS241_C) / _horner(r - 1.6, AS241_D)
    far = _horner(r - 5.0, AS241_E) / _horner(r - 5.0, AS241_F)
    tail = F.when(r <= 5.0, near).otherwise(far)
    return F.when(F.abs(q) <= 0.425, central).otherwise(F.signum(q) * tail)


def _ppf_r(p: Column, q: Column) -> Column:
    return F.sqrt(-F.log(F.when(q <= 0, p).otherwise(1.0 - p)))


def norm_ppf(p: Column) -> Column:
    """Inverse standard normal CDF for p in (0, 1) as a Column expression."""
    p = p.cast("double")
    q = p - 0.5
    return _ppf_from(q, _ppf_r(p, q))


def with_norm_ppf(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Add ``out = Phi^-1(src)`` for each {out: src}, in two projections so the
    polynomials read plain columns (keeps generated code small for many columns)."""
    keep = [c for c in df.columns]
    st = df.select(*keep, *[(F.col(src).cast("double") - 0.5).alias(f"__q_{o}") for o, src in cols.items()])
    st = st.select(*keep, *[F.col(f"__q_{o}") for o in cols],
                   *[_ppf_r(F.col(src).cast("double"), F.col(f"__q_{o}")).alias(f"__r_{o}")
                     for o, src in cols.items()])
    return st.select(*keep, *[_ppf_from(F.col(f"__q_{o}"), F.col(f"__r_{o}")).alias(o) for o in cols])


def with_norm_cdf(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Add ``out = Phi(src)`` for each {out: src}; |x| is its own column first."""
    keep = [c for c in df.columns]
    st = df.select(*keep, *[F.abs(F.col(src).cast("double")).alias(f"__a_{o}") for o, src in cols.items()])
    out = []
    for o, src in cols.items():
        c = norm_lower_tail(F.col(f"__a_{o}"))
        out.append(F.when(F.col(src) > 0, 1.0 - c).otherwise(c).alias(o))
    return st.select(*keep, *out)


def norm_ppf_sql(p: str) -> str:
    q = f"(({p}) - 0.5)"
    rc = f"(0.180625 - {q} * {q})"
    central = f"({q} * {_horner_sql(rc, AS241_A)} / {_horner_sql(rc, AS241_B)})"
    r = f"sqrt(-ln(CASE WHEN {q} <= 0 THEN ({p}) ELSE 1.0 - ({p}) END))"
    near = f"({_horner_sql(f'({r} - 1.6)', AS241_C)} / {_horner_sql(f'({r} - 1.6)', AS241_D)})"
    far = f"({_horner_sql(f'({r} - 5.0)', AS241_E)} / {_horner_sql(f'({r} - 5.0)', AS241_F)})"
    tail = f"(CASE WHEN {r} <= 5.0 THEN {near} ELSE {far} END)"
    return (f"(CASE WHEN abs({q}) <= 0.425 THEN {central} "
            f"WHEN {q} < 0 THEN -{tail} ELSE {tail} END)")


# ---------------------------------------------------------------------------
# Deterministic draws: same value for the same key under any partitioning,
# and bit-identical in DuckDB.
# ---------------------------------------------------------------------------
def hash_uniform(seed: int, salt: str, *keys: Column | str) -> Column:
    """Uniform in [0, 1) from md5 of 'seed:salt:key...' (48 bits)."""
    parts = [F.lit(str(int(seed))), F.lit(str(salt))]
    parts += [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    h = F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12)
    return F.conv(h, 16, 10).cast("long").cast("double") / TWO_POW_48


def hash_uniform_sql(seed: int, salt: str, *keys: str) -> str:
    ks = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return (f"(('0x' || substr(md5(concat_ws(':', '{int(seed)}', '{salt}', {ks})), 1, 12))"
            f"::BIGINT / {TWO_POW_48!r})")


def hash_open_uniform(seed: int, salt: str, *keys: Column | str) -> Column:
    """Hash uniform moved to the open interval (0, 1): (k + 0.5) / 2^48."""
    return (hash_uniform(seed, salt, *keys) * TWO_POW_48 + 0.5) / TWO_POW_48


def hash_normal(seed: int, salt: str, *keys: Column | str) -> Column:
    """Standard normal draw: AS241 quantile of an open-interval hash uniform.
    (For many draws in one projection, select ``hash_open_uniform`` first and
    apply ``norm_ppf`` to the resulting column.)"""
    return norm_ppf(hash_open_uniform(seed, salt, *keys))


def hash_normal_sql(seed: int, salt: str, *keys: str) -> str:
    u = f"(({hash_uniform_sql(seed, salt, *keys)} * {TWO_POW_48!r} + 0.5) / {TWO_POW_48!r})"
    return norm_ppf_sql(u)


# ---------------------------------------------------------------------------
# Guards
# ---------------------------------------------------------------------------
def safe_div(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.when(b == 0, F.lit(default)).otherwise(a.cast("double") / b)


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def r6(x: Column, places: int = 6) -> Column:
    """Round for reports/oracle compare; + 0.0 folds -0.0 into 0.0."""
    return F.round(x.cast("double"), places) + F.lit(0.0)


def py_norm_cdf(x: float) -> float:
    """Plain-Python twin of ``norm_cdf`` (driver-side scalars, tests)."""
    a = abs(x)
    if a > HART_CUTOFF:
        c = 0.0
    elif a < HART_SPLIT:
        num = HART_N[0]
        for k in HART_N[1:]:
            num = num * a + k
        den = HART_D[0]
        for k in HART_D[1:]:
            den = den * a + k
        c = math.exp(-a * a / 2) * num / den
    else:
        b = a + 0.65
        for k in (4.0, 3.0, 2.0, 1.0):
            b = a + k / b
        c = math.exp(-a * a / 2) / b / SQRT_2PI
    return 1.0 - c if x > 0 else c
