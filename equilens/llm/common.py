"""Shared helpers of the training-data operators: tables, batches, hashing, components."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, cut_observed

BROADCAST_ROWS = 500_000     # a side is broadcast only after counting at most this many rows
BATCH_ROWS = 128             # rows per Arrow batch handed to Python
CHUNK_BYTES = 1_000_000      # text handled at once by the vectorised kernels (or one document)
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches of whole texts small enough for a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if ``df`` holds at most ``rows`` rows, checked at each use; else
    leave the join to the planner. ``df`` should be a written table: the check reads it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def crc_mod(col: str, m: int) -> F.Column:
    """crc32 of the id as text, modulo ``m`` (null id: null)."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(m)


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker process, shared by its tasks."""
    mod = sys.modules.setdefault("_equilens_worker", types.ModuleType("_equilens_worker"))
    return mod.__dict__.setdefault(name, {})


def chunks(sizes: Iterable[int], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """(from, to) ranges of consecutive rows whose sizes add up to at most ``most`` (or one row)."""
    start = total = n = 0
    for n, s in enumerate(sizes, 1):
        if total and total + s > most:
            yield start, n - 1
            start, total = n - 1, 0
        total += s
    if n > start:
        yield start, n


# ---------------------------------------------------------------------------
# word and shingle hashes (64 bit, vectorised over many documents)
# ---------------------------------------------------------------------------
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_K = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
      0xE7037ED1A0B428DB)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(_K[0])
    x ^= x >> np.uint64(27)
    x *= np.uint64(_K[1])
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of an odd base modulo 2^64, and of its inverse."""
    cache = worker_cache("powers")
    have = cache.get(which)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        base = _BASES[which]
        p = np.full(size, base, dtype=np.uint64)
        q = np.full(size, pow(base, -1, 1 << 64), dtype=np.uint64)
        p[0] = q[0] = 1
        cache[which] = have = (np.multiply.accumulate(p), np.multiply.accumulate(q))
    return have


WINDOW = 1 << 17             # bytes whose prefix sums are held at once


def span_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every span b[start:end] (in order, not overlapping), whatever its place; prefix sums and
    powers are held for a window of spans at a time, so long texts need no longer tables."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + WINDOW, side="right")))
        part = b[lo:int(ends[j - 1])]
        p, q = powers(len(part) + 1)
        h = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * p[: len(part)], out=h[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((h[e] - h[s]) * q[s] + (e - s).astype(np.uint64))
        i = j
    return out


def words_of(texts: list[bytes], spaces: np.ndarray = SPACES):
    """Word hashes of all texts: (hash, document index, first word index per document + total,
    byte start, byte end); starts and ends count inside the joined text, with one separating
    space between documents. ``spaces`` marks the separating bytes."""
    joined = b" ".join(texts)
    b = np.frombuffer(joined, dtype=np.uint8)
    n = len(texts)
    at = np.zeros(n + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    if not len(b):
        z = np.zeros(0, dtype=np.int64)
        return z.astype(np.uint64), z, np.zeros(n + 1, dtype=np.int64), z, z, at
    sp = spaces[b]
    starts = np.flatnonzero(~sp & np.concatenate(([True], sp[:-1])))
    ends = np.flatnonzero(~sp & np.concatenate((sp[1:], [True]))) + 1
    word = span_hashes(b, starts, ends)
    first = np.searchsorted(starts, at)
    doc = np.repeat(np.arange(n), np.diff(first))
    return word, doc, first, starts, ends, at


def shingles_of(word: np.ndarray, first: np.ndarray, k: int):
    """Hashes of all runs of ``k`` words inside a document and their first index per document
    (+ total). A document of 1 to k-1 words has its whole sequence as one shingle."""
    n_words = np.diff(first)
    n = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(np.int64))
    out_first = np.concatenate(([0], np.cumsum(n)))
    total = int(out_first[-1])
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(total) - out_first[doc] + first[doc]
    h = np.zeros(total, dtype=np.uint64)
    left = n_words[doc]
    for i in range(k):
        there = left > i
        w = np.where(there, word[np.minimum(at + i, len(word) - 1)] if len(word) else 0, np.uint64(0))
        h = (h ^ w) * np.uint64(_K[i % len(_K)]) + np.uint64(2 * i + 1)
        h ^= h >> np.uint64(29)
    return mix(h), out_first


def utf8(col: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as bytes, null as empty."""
    return [b"" if x is None else x for x in col.cast(pa.binary()).to_pylist()]


def lists_of(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and first index per row (+ total)."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, type=kind))


# ---------------------------------------------------------------------------
# connected components
# ---------------------------------------------------------------------------
FEW_EDGES = 50_000           # edges that one task joins up


def _joined_up(batches):
    """(node, component) of the edges (u, v): each node's smallest reachable node."""
    least: dict[int, int] = {}

    def root(x: int) -> int:
        while least[x] != x:
            least[x] = least[least[x]]
            x = least[x]
        return x
    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            least.setdefault(u, u)
            least.setdefault(v, v)
            u, v = root(u), root(v)
            if u != v:
                least[max(u, v)] = min(u, v)
    nodes = list(least)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())],
                                     ["node", "component"])


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with an edge to another.

    Alternating large-star / small-star rounds; each is a few shuffles over the edge list and a written
    table in the shared folder, so a lost executor repeats one round at most. A hub's edges are
    pre-aggregated (min) and its join can be split by AQE; nothing is collected. A list of at most
    ``FEW_EDGES`` edges is joined up by one task.
    """
    def written(e: DataFrame) -> tuple[DataFrame, dict]:
        return cut_observed(e, "edges", n=F.count(F.lit(1)), sign=F.bit_xor(F.xxhash64("u", "v")))
    hi, lo = F.greatest(F.col(a), F.col(b)).cast("long"), F.least(F.col(a), F.col(b)).cast("long")
    e, seen = written(edges.where(F.col(a) != F.col(b)).select(hi.alias("u"), lo.alias("v")).distinct())
    while seen["n"] > FEW_EDGES:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where(F.col("v") > F.col("u")).join(least, "u")
                     .select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small_star = large.join(least, "u").where(F.col("v") != F.col("m")).select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        before = seen
        e, seen = written(small_star.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        if seen == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    return cut_lineage(e.select("u", "v").coalesce(1).mapInArrow(_joined_up, "node long, component long"), "components")


def joined(comp: DataFrame, edges: DataFrame, a: str, b: str) -> DataFrame:
    """``comp`` (node, component) with further edges taken in: only the components they tie together are
    joined up, over the edges between components."""
    of = lambda c: comp.select(F.col("node").alias(c), F.col("component").alias("c_" + c))
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    tied = ends.join(of("a"), "a", "left").join(of("b"), "b", "left").select(
        F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    over = components(tied, "a", "b")
    moved = comp.join(over.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select(
        "node", F.coalesce("to", "component").alias("component"))
    return cut_lineage(moved.unionByName(over).distinct(), "components")
