"""Exact order statistics of many columns at once.

All wanted ranks of all columns share their scans. A scan counts, for every rank, the rows below, at and
between the limits that still enclose it, and draws a mergeable quantile sketch of the rows between;
two neighbouring points of the sketch are the next limits. A scan leaves about ``3 / grid`` of the rows
between, so ranks of any table are enclosed by a few thousand rows after two or three scans, and one
last scan gathers those.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRID = 1024                  # points of a sketch
GATHERED = 100_000           # values that all ranks together may still enclose when they are gathered


class _Open:
    """A rank that is not found yet: the value lies in the open interval (lo, hi), ``before`` rows are
    not above lo, ``n`` lie between. ``cuts`` are the limits to try next."""

    def __init__(self, col: str, k: int):
        self.col, self.k = col, k
        self.lo, self.hi = -math.inf, math.inf
        self.before = self.n = 0
        self.cuts: list[float] = []


def exact_ranks(df: DataFrame, ranks: dict[str, Sequence[float]], grid: int = GRID, gathered: int = GATHERED
                ) -> dict[str, list[float] | None]:
    """Per column the values of the given ranks: 0-based ones (ints), or shares of n - 1 (floats), each as
    its two neighbours' mean. Nulls and NaN do not count; a column without values gives None."""
    cols = list(ranks)
    if not cols:
        return {}
    x = df.select(*[F.when(~F.isnan(v), v).alias(f"c{i}") for i, v in enumerate(F.col(c).cast("double") for c in cols)])
    probs = [i / grid for i in range(1, grid)]

    def sketch(at: F.Column, name: str) -> F.Column:
        return F.percentile_approx(at, probs, 10 * grid).alias(name)
    first = x.agg(*[F.count(f"c{i}").alias(f"n{i}") for i in range(len(cols))],
                  *[F.count(F.when(F.col(f"c{i}") == e, 1)).alias(f"{k}{i}") for i in range(len(cols)) for k, e in (("m", -math.inf), ("p", math.inf))],
                  *[sketch(F.when(F.abs(f"c{i}") < math.inf, F.col(f"c{i}")), f"q{i}") for i in range(len(cols))]).first()
    found: dict[tuple[str, int], float] = {}
    open_: list[_Open] = []
    wanted: dict[str, list[tuple[int, int]] | None] = {}
    for i, c in enumerate(cols):
        n = first[f"n{i}"]
        if not n:
            wanted[c] = None
            continue
        wanted[c] = []
        for r in ranks[c]:
            at = (r, r) if isinstance(r, int) else (math.floor(r * (n - 1)), math.ceil(r * (n - 1)))
            if not 0 <= at[0] <= at[1] < n:
                raise ValueError(f"rank {r} out of range")
            wanted[c].append(at)
        low, high = first[f"m{i}"], first[f"p{i}"]            # infinite values
        for k in sorted({k for at in wanted[c] for k in at}):
            if k < low or k >= n - high:
                found[c, k] = -math.inf if k < low else math.inf
                continue
            o = _Open(c, k)
            o.before, o.n = low, n - low - high
            _limits(o, first[f"q{i}"])
            open_.append(o)
    number = {c: i for i, c in enumerate(cols)}
    while True:
        if sum(o.n for o in open_) <= gathered:
            break
        aggs = []
        for j, o in enumerate(open_):
            v = F.col(f"c{number[o.col]}")
            for m, cut in enumerate(o.cuts):
                aggs += [F.count(F.when(v < cut, 1)).alias(f"b{j}_{m}"), F.count(F.when(v <= cut, 1)).alias(f"u{j}_{m}")]
            limits = [o.lo, *o.cuts, o.hi]
            for m in range(len(limits) - 1):
                aggs.append(sketch(F.when((v > limits[m]) & (v < limits[m + 1]), v), f"q{j}_{m}"))
        row = x.agg(*aggs).first()
        left = []
        for j, o in enumerate(open_):
            below = [row[f"b{j}_{m}"] for m in range(len(o.cuts))]
            upto = [row[f"u{j}_{m}"] for m in range(len(o.cuts))]
            hit = next((c for c, b, u in zip(o.cuts, below, upto) if b <= o.k < u), None)
            if hit is not None:
                found[o.col, o.k] = hit
                continue
            part = sum(o.k >= u for u in upto)            # cuts that lie below
            end = below[part] if part < len(o.cuts) else o.before + o.n
            if part:
                o.lo, o.before = o.cuts[part - 1], upto[part - 1]
            if part < len(o.cuts):
                o.hi = o.cuts[part]
            o.n = end - o.before
            _limits(o, row[f"q{j}_{part}"])
            left.append(o)
        open_ = left
    if open_:
        items = [F.struct(F.lit(j).alias("j"), F.when((v > o.lo) & (v < o.hi), v).alias("v"))
                 for j, (o, v) in enumerate((o, F.col(f"c{number[o.col]}")) for o in open_)]
        seen = x.select(F.inline(F.array(*items))).where(F.col("v").isNotNull()).groupBy("j", "v").count().collect()
        for j, o in enumerate(open_):
            total = o.before
            for v, n in sorted((r["v"], r["count"]) for r in seen if r["j"] == j):
                total += n
                if o.k < total:
                    found[o.col, o.k] = v
                    break
    out: dict[str, list[float] | None] = {}
    for c, ats in wanted.items():
        out[c] = None if ats is None else [found[c, a] if a == b else (found[c, a] + found[c, b]) / 2.0 for a, b in ats]
    return out


def _limits(o: _Open, points: Sequence[float]) -> None:
    """The next cuts: the points of the sketch around the rank, one further on either side for its error.
    Points are values of rows between the limits, so every scan finds the rank or leaves fewer rows."""
    place = (o.k - o.before) / max(1, o.n) * len(points)
    near = [points[min(max(math.floor(place) + d, 0), len(points) - 1)] for d in (-2, 1)]
    o.cuts = sorted(set(near))


def exact_kth(df: DataFrame, col: str, ks: Sequence[int], local_max: int = GATHERED, splits: int = GRID) -> list[float]:
    """Exact k-th smallest non-null values (0-based ranks ``ks``) of ``col``."""
    got = exact_ranks(df, {col: [int(k) for k in ks]}, splits, local_max)[col]
    if got is None:
        raise ValueError("no values")
    return got


def exact_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """Exact medians (mean of the two middle values for even counts) of several columns."""
    return {c: None if v is None else v[0] for c, v in exact_ranks(df, {c: [0.5] for c in cols}).items()}


def exact_median(df: DataFrame, col: str, empty: float | None = None) -> float | None:
    m = exact_medians(df, [col])[col]
    return empty if m is None else m
