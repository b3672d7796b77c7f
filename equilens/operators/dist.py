"""Distributed order statistics and selections (no single-task global sort).

* ``exact_kth`` / ``exact_median``: see ``quantiles.py``.
* ``k_smallest``: per-stratum "first q rows by (u, id)" with a quota table;
  rows below the boundary bin are taken whole, the window runs only inside
  one boundary bin per stratum (bins sized from the largest stratum).
* ``bucketed_long`` / ``bucket_prefix``: exact running sums along a value order,
  cut into value buckets (one ``approxQuantile`` pass + a multi-column
  Bucketizer) so the window runs per bucket, not per column.
* ``asof_lookup``: position -> entry of a cumulative histogram, sort-based; ``small_lookup``: the same for
  a table of few entries, by binary search and a broadcast, so that no row is shuffled.
* ``sample_n``: n rows without replacement by hash order.
* ``numbered``: consecutive numbers along an order, from range partitions and their offsets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mathx import hash_uniform
from .quantiles import exact_kth, exact_median, exact_medians, exact_ranks  # noqa: F401

BOUNDARY_BIN_ROWS = 1_000_000


def k_smallest_flag(df: DataFrame, strata: Sequence[str], quotas: DataFrame, u: str = "u",
                    order_id: str = "row_id", quota_col: str = "quota",
                    flag: str = "selected") -> DataFrame:
    """All rows of ``df`` plus boolean ``flag``: rank by (u, order_id) inside the
    stratum is <= quota. Same answer as
    ``row_number() over (partition by strata order by u, id) <= quota``.

    Plan: a histogram of (stratum, u-bin) -- at most strata x bins rows -- gives
    the boundary bin per stratum; rows in lower bins are selected, higher bins
    not, and only the boundary bin (~BOUNDARY_BIN_ROWS rows per stratum; the bin
    width shrinks with the largest stratum) runs a row_number window. The
    quota table has one row per stratum and is broadcast.
    """
    strata = list(strata)
    sizes = df.groupBy(*strata).count()
    max_n = sizes.agg(F.max("count")).first()[0] or 0
    bins = 1024
    while max_n / bins > BOUNDARY_BIN_ROWS and bins < (1 << 40):
        bins *= 2
    binned = df.withColumn("__bin", F.floor(F.col(u) * bins).cast("long"))
    hist = binned.groupBy(*strata, "__bin").agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(*strata).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    cum = hist.withColumn("__before", F.coalesce(F.sum("__c").over(w), F.lit(0)))
    q = F.broadcast(quotas.select(*strata, F.col(quota_col).cast("long").alias("__q")))
    bound = (cum.join(q, strata)
                .where((F.col("__before") < F.col("__q"))
                       & (F.col("__before") + F.col("__c") >= F.col("__q")))
                .select(*strata, F.col("__bin").alias("__bbin"),
                        (F.col("__q") - F.col("__before")).alias("__need")))
    # strata whose quota exceeds their size: every row selected
    full = (sizes.join(q, strata).where(F.col("count") < F.col("__q"))
            .select(*strata, F.lit(1 << 62).cast("long").alias("__bbin"),
                    F.lit(0).cast("long").alias("__need")))
    bounds = F.broadcast(bound.unionByName(full))
    j = binned.join(bounds, strata, "left").withColumn(
        "__bbin", F.coalesce(F.col("__bbin"), F.lit(-1).cast("long")))
    keep = list(df.columns)
    off = j.where(F.col("__bin") != F.col("__bbin")).select(
        *keep, (F.col("__bin") < F.col("__bbin")).alias(flag))
    wr = Window.partitionBy(*strata).orderBy(F.col(u), F.col(order_id))
    edge = (j.where(F.col("__bin") == F.col("__bbin"))
             .withColumn("__rn", F.row_number().over(wr))
             .select(*keep, (F.col("__rn") <= F.col("__need")).alias(flag)))
    return off.unionByName(edge)


def k_smallest(df: DataFrame, strata: Sequence[str], quotas: DataFrame, u: str = "u",
               order_id: str = "row_id", quota_col: str = "quota") -> DataFrame:
    """Rows whose rank by (u, order_id) inside their stratum is <= quota."""
    f = k_smallest_flag(df, strata, quotas, u, order_id, quota_col, "__sel")
    return f.where(F.col("__sel")).drop("__sel")


def sample_n(df: DataFrame, n: int, seed: int, id_col: str = "row_id",
             salt: str = "sample") -> DataFrame:
    """n rows without replacement: the n smallest hash draws (ties by id).

    Small n plans as TakeOrderedAndProject (per-task top-n, no full sort);
    large n goes through ``k_smallest`` (binned, no single-task window).
    """
    u = df.withColumn("__u", hash_uniform(seed, salt, id_col))
    if n <= 100_000:
        return u.orderBy("__u", id_col).limit(n).drop("__u")
    quotas = df.sparkSession.range(1).select(F.lit(1).alias("__s"), F.lit(n).cast("long").alias("quota"))
    return k_smallest(u.withColumn("__s", F.lit(1)), ["__s"], quotas, "__u", id_col).drop("__u", "__s")


PREFIX_SPLITS = 256            # buckets of a small table
PREFIX_BUCKET_ROWS = 500_000   # rows aimed at per bucket in a larger one
ASOF_BUCKET_ROWS = 200_000
ASOF_FILL_CORES = True
ASOF_SMALL_ROWS = 100_000      # entries of a table that is looked up without a shuffle, at most


def column_splits(df: DataFrame, cols: Sequence[str], splits: int = PREFIX_SPLITS
                  ) -> dict[str, list[float]]:
    """Split points per column from ONE ``approxQuantile`` pass over the wide
    table (at most len(cols) x splits numbers reach the driver)."""
    probs = [i / splits for i in range(1, splits)]
    cast = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    qs = cast.approxQuantile(list(cols), probs, 1.0 / (10 * splits))
    return {c: sorted(set(float(v) for v in q if v == v)) for c, q in zip(cols, qs)}


def n_splits(rows: int) -> int:
    """Value buckets for a table: at least PREFIX_SPLITS, growing with its rows."""
    return max(PREFIX_SPLITS, -(-rows // PREFIX_BUCKET_ROWS))


def bucketed_long(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (),
                  splits: int | None = None) -> DataFrame:
    """Unpivot numeric columns to (keep..., feature, __b, value): ``__b`` is the
    value bucket from a multi-column Bucketizer (binary search in the JVM),
    ``value`` has -0.0 folded into 0.0."""
    cols = list(cols)
    sp = column_splits(df, cols, n_splits(df.count()) if splits is None else splits)
    x = df.select(*keep, *[F.col(c).cast("double").alias(f"__v{i}") for i, c in enumerate(cols)])
    bz = Bucketizer(splitsArray=[[-math.inf] + sp[c] + [math.inf] for c in cols],
                    inputCols=[f"__v{i}" for i in range(len(cols))],
                    outputCols=[f"__b{i}" for i in range(len(cols))], handleInvalid="keep")
    x = bz.transform(x)
    return x.select(*keep, F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"__b{i}").cast("int").alias("__b"),
                 (F.col(f"__v{i}") + F.lit(0.0)).alias("value"))
        for i, c in enumerate(cols)])))


def bucket_prefix(hist: DataFrame, part: Sequence[str], order: str, counts: Sequence[str],
                  bucket: str = "__b") -> DataFrame:
    """Exclusive running sums ``<c>_before`` when ``hist`` already carries a value
    bucket: bucket totals (small) get a running sum, are broadcast back, and
    the window runs per (part, bucket)."""
    part = list(part)
    tot = hist.groupBy(*part, bucket).agg(*[F.sum(c).alias(f"__t_{c}") for c in counts])
    wt = Window.partitionBy(*part).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(*part, bucket, *[F.coalesce(F.sum(f"__t_{c}").over(wt), F.lit(0)).alias(f"__o_{c}")
                                      for c in counts])
    j = hist.join(F.broadcast(tot), [*part, bucket])
    w = Window.partitionBy(*part, bucket).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return j.select(*hist.columns, *[
        (F.col(f"__o_{c}") + F.coalesce(F.sum(c).over(w), F.lit(0))).alias(f"{c}_before")
        for c in counts])


def asof_lookup(probes: DataFrame, table: DataFrame, part: Sequence[str], pos: str,
                start: str, length: str, payload: Sequence[str], totals: DataFrame,
                total: str = "total", n_rows: int | None = None) -> DataFrame:
    """For each probe (part, pos) return ``payload`` of the table entry with
    start <= pos < start + length (entries tile [0, total) per part).

    A sort-based as-of join, not a range join: positions are cut into equal-width
    buckets per part; every entry is placed in the bucket of its start plus one
    carry row per further bucket it spans; probes and entries are merged per
    (part, bucket) with ``last(..., ignorenulls)``. Bucket count grows with the
    data so a bucket holds about ASOF_BUCKET_ROWS rows, and a hot entry (one
    value with a third of the mass) spreads over many buckets instead of
    landing in one task.
    """
    part = list(part)
    if n_rows is None:          # callers usually know the sizes; counting re-runs both inputs
        n_rows = probes.count() + table.count()
    # enough buckets for the data size, and (optionally) at least one task per core overall
    nb = max(1, -(-n_rows // ASOF_BUCKET_ROWS))
    if ASOF_FILL_CORES:
        n_parts = max(1, totals.count())
        nb = max(nb, -(-probes.sparkSession.sparkContext.defaultParallelism // n_parts))
    tt = F.broadcast(totals.select(*part, F.col(total).cast("long").alias("__tot")))
    width = F.greatest(F.ceil(F.col("__tot") / F.lit(nb)), F.lit(1)).cast("long")
    t = table.join(tt, part).withColumn("__w", width)
    first = F.floor(F.col(start) / F.col("__w")).cast("long")
    last = F.floor((F.col(start) + F.col(length) - 1) / F.col("__w")).cast("long")
    t = t.withColumn("__bk", F.explode(F.sequence(first, F.greatest(first, last))))
    pay = F.struct(*[F.col(c) for c in payload])
    probe_t = F.struct(*[F.col(c) for c in probes.columns])
    pq = probes.join(tt, part).withColumn("__w", width)
    pside = pq.select(*part, F.floor(F.col(pos) / F.col("__w")).cast("long").alias("__bk"),
                      F.col(pos).cast("long").alias("__pos"), F.lit(1).alias("__kind"),
                      probe_t.alias("__probe"))
    entries = t.select(*part, "__bk",
                       F.greatest(F.col(start), F.col("__bk") * F.col("__w")).alias("__pos"),
                       F.lit(0).alias("__kind"), pay.alias("__pay"))
    u = (entries.withColumn("__probe", F.lit(None).cast(pside.schema["__probe"].dataType))
         .unionByName(pside.withColumn("__pay", F.lit(None).cast(entries.schema["__pay"].dataType))))
    w = Window.partitionBy(*part, "__bk").orderBy("__pos", "__kind").rowsBetween(
        Window.unboundedPreceding, 0)
    m = u.withColumn("__hit", F.last("__pay", ignorenulls=True).over(w)).where(F.col("__kind") == 1)
    return m.select(*[F.col(f"__probe.{c}").alias(c) for c in probes.columns],
                    *[F.col(f"__hit.{c}").alias(c) for c in payload])


def small_lookup(probes: DataFrame, table: DataFrame, pos: str, start: str, payload: Sequence[str]) -> DataFrame:
    """``probes`` with ``payload`` of the last table entry whose start is <= ``pos``. The table holds at most
    ``ASOF_SMALL_ROWS`` entries (the caller has counted them), the first one starting at 0; payload columns
    have other names than those of the probes."""
    rows = table.select(start, *payload).orderBy(start).collect()
    names = [f"__l{i}" for i in range(len(payload))]
    types = ", ".join(f"{x} {table.schema[c].dataType.simpleString()}" for x, c in zip(names, payload))
    entries = probes.sparkSession.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], f"__entry int, {types}")
    # one split below the first entry: a Bucketizer needs three
    splits = [-math.inf, *[float(r[0]) for r in rows], math.inf]
    x = Bucketizer(splits=splits, inputCol="__at", outputCol="__bin").transform(probes.withColumn("__at", F.col(pos).cast("double")))
    # every row has its entry; an inner join would add a filter that repeats the expressions of ``pos``
    x = x.withColumn("__entry", (F.col("__bin") - 1).cast("int")).join(F.broadcast(entries), "__entry", "left")
    return x.select(*probes.columns, *[F.col(n).alias(c) for n, c in zip(names, payload)])


def numbered(df: DataFrame, order: Sequence[str], out: str, part: Sequence[str] = ()) -> DataFrame:
    """``df`` with its 0-based place along ``order`` inside each ``part`` (rows distinct in both). Rows are
    dealt by range and written; a place is the sum of the ranges before and the place in its own range."""
    from ..session import cut_lineage
    part = list(part)
    dealt = cut_lineage(df.repartitionByRange(*part, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(*part, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*part).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    first = F.broadcast(sizes.select(*part, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first")))
    own = Window.partitionBy(*part, "__range").orderBy(*order)
    return dealt.join(first, [*part, "__range"]).withColumn(
        out, (F.col("__first") + F.row_number().over(own) - 1).cast("long")).select(*df.columns, out)
