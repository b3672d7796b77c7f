"""Bootstrap of group means as a mergeable partial aggregate.

Every row gets, for each replicate, a Poisson(1) weight from a hash of its id. A task adds up weights
and weighted values of all replicates for the rows it reads and hands on one pair of arrays a group;
the arrays are then added. Work is rows times replicates, what is shuffled is tasks times groups times
replicates, and the result does not depend on how rows are dealt.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Modulus (a Mersenne prime; squares of residues fit 64 bits) and multipliers of the draws
PRIME = 2147483647
MULTIPLIERS = (48271, 69621)
HELD_GROUPS = 256            # groups a task holds sums of before it hands them on


def poisson_cuts(most: int = 12) -> list[float]:
    """Distribution function of a Poisson(1) weight at 0, 1, ...; beyond ``most`` lies under 1e-9."""
    out, p, total = [], math.exp(-1.0), 0.0
    for k in range(most):
        total += p
        out.append(total)
        p /= k + 1
    return out


def row_key(id_col: str, seed: int) -> F.Column:
    """A residue per id and seed, from its md5."""
    h = F.md5(F.concat(F.lit(f"{seed}:boot:"), F.col(id_col).cast("string")))
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("long") % F.lit(PRIME)


def draws(key: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Residues of rows (first axis) and replicates: two rounds of squaring between linear steps."""
    t = (key[:, None] + b[None, :] * MULTIPLIERS[0]) % PRIME
    t = (t * t + b[None, :]) % PRIME
    t = (t * MULTIPLIERS[1] + key[:, None]) % PRIME
    return (t * t + t) % PRIME


def draws_sql(key: str, b: str) -> str:
    """The same residues as SQL text."""
    first = f"(({key} + {b} * {MULTIPLIERS[0]}) % {PRIME})"
    second = f"(({first} * {first} + {b}) % {PRIME})"
    third = f"(({second} * {MULTIPLIERS[1]} + {key}) % {PRIME})"
    return f"(({third} * {third} + {third}) % {PRIME})"


def _partial_sums(n_boot: int, n_by: int):
    cuts = np.floor(np.array(poisson_cuts()) * PRIME).astype(np.int64)
    b = np.arange(1, n_boot + 1, dtype=np.int64)
    names = [f"g{i}" for i in range(n_by)]

    def rows(held):  # noqa: ANN001
        keys = list(held)
        cols = [pa.array([k[i] for k in keys], pa.string()) for i in range(n_by)]
        cols += [pa.array([held[k][i].tolist() for k in keys], pa.list_(pa.float64())) for i in range(2)]
        return pa.RecordBatch.from_arrays(cols, [*names, "w", "wv"])

    def run(batches):
        held: dict[tuple, list[np.ndarray]] = {}
        for batch in batches:
            key, value = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            groups = list(zip(*(batch.column(2 + i).to_pylist() for i in range(n_by)))) if n_by else [()] * len(key)
            of: dict[tuple, list[int]] = {}
            for i, g in enumerate(groups):
                of.setdefault(g, []).append(i)
            step = max(1, 2_000_000 // n_boot)
            for g, at in of.items():
                for lo in range(0, len(at), step):
                    some = at[lo:lo + step]
                    weight = np.searchsorted(cuts, draws(key[some], b), side="right").astype(np.float64)
                    if g not in held:
                        if len(held) >= HELD_GROUPS:
                            yield rows(held)
                            held = {}
                        held[g] = [np.zeros(n_boot), np.zeros(n_boot)]
                    held[g][0] += weight.sum(axis=0)
                    held[g][1] += value[some] @ weight
        if held:
            yield rows(held)
    return run


def bootstrap_means(df: DataFrame, value: str, id_col: str, *, n_boot: int = 5000, seed: int = 42, level: float = 0.95,
                    by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, mean, ci_low, ci_high): mean of ``value`` per group (as text) and the percentile interval
    of its bootstrap means. Rows without a value are left out; rows that share an id draw alike."""
    keys = [F.col(c).cast("string") for c in by] or [F.lit("")]
    x = df.where(F.col(value).isNotNull()).select(
        row_key(id_col, seed).alias("key"), F.col(value).cast("double").alias("value"), *[k.alias(f"g{i}") for i, k in enumerate(keys)])
    names = [f"g{i}" for i in range(len(keys))]
    kinds = "".join(f"{g} string, " for g in names)
    sums = x.mapInArrow(_partial_sums(n_boot, len(keys)), f"{kinds}w array<double>, wv array<double>")
    each = sums.select(*names, F.posexplode(F.arrays_zip("w", "wv")).alias("b", "s")).groupBy(*names, "b").agg(
        F.sum("s.w").alias("w"), F.sum("s.wv").alias("wv"))
    low = (1 - level) / 2
    ends = each.where(F.col("w") > 0).groupBy(*names).agg(
        F.percentile(F.col("wv") / F.col("w"), F.array(F.lit(low), F.lit(1 - low))).alias("q"))
    plain = x.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    both = plain.alias("p").join(
        ends.alias("e"), [F.col(f"p.{g}").eqNullSafe(F.col(f"e.{g}")) for g in names]).select("p.*", "q")
    return both.select(*[F.col(g).alias(c) for g, c in zip(names, by)], "n", "mean", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))
