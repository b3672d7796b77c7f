"""Operator 4: near-duplicate vectors by E8 lattice hashing.

Vectors are normalised and turned by a random rotation; each run of eight rotated coordinates
is one table (a random projection to eight dimensions), scaled and decoded to its nearest E8
lattice point. A vector is filed under its home cell in every table and also looks into the
``probes`` neighbouring cells that lie nearest. The rotation is orthogonal, so the eight-
dimensional distances of two close vectors add up to their distance, and in the best of the
tables they are much closer than on average.

A slim pass over (cell, id) finds the cells that hold anything to compare; only their vectors
are shuffled. Large cells are split into blocks that meet block by block, cosines are taken in
double precision inside the tasks, and a pair is counted in the first table that finds it: no
pair ever becomes a row. Each task gives link counts per vector and a spanning set of links.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import bound_batches, components, small

SCALE = 8.0
PROBES = 4
ROUNDS = 1             # rotations; each gives ceil(dim / 8) tables
BLOCK_ROWS = 1024      # vectors of one cell that meet at once
SHARD_ROWS = 20_000    # aimed rows per task group


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i in range(8):
        for j in range(i + 1, 8):
            for a in (1, -1):
                for b in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for m in range(256):
        if bin(m).count("1") % 2 == 0:
            out.append(np.array([-0.5 if m >> i & 1 else 0.5 for i in range(8)]))
    return np.array(out)


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest point of D8 (integers of even sum) to each row."""
    r = np.rint(x)
    err = x - r
    odd = np.flatnonzero(r.sum(axis=1).astype(np.int64) % 2)
    at = np.abs(err[odd]).argmax(axis=1)
    r[odd, at] += np.where(err[odd, at] >= 0, 1.0, -1.0)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point to each row of ``x`` (n x 8)."""
    a = _d8(x)
    b = _d8(x - 0.5) + 0.5
    pick = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(pick[:, None], a, b)


def _code(points: np.ndarray, table: int) -> np.ndarray:
    """64-bit name of lattice points (n x 8) in a table."""
    h = np.full(len(points), 0x51_7C_C1_B7_27_22_0A_95 ^ (table + 1), dtype=np.uint64)
    twice = np.rint(points * 2).astype(np.int64).astype(np.uint64)
    for i in range(8):
        h = (h ^ twice[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def rotations(dim: int, rounds: int) -> list[np.ndarray]:
    rng = np.random.default_rng(8)
    wide = -(-dim // 8) * 8
    return [np.linalg.qr(rng.standard_normal((wide, wide)))[0] for _ in range(rounds)]


def codes(unit: np.ndarray, scale: float, probes: int, rounds: int) -> np.ndarray:
    """n x tables x (1 + probes) cell names: home first, then the nearest neighbours."""
    n, dim = unit.shape
    wide = -(-dim // 8) * 8
    x = np.zeros((n, wide))
    x[:, :dim] = unit
    near = roots()
    out = []
    for r, rot in enumerate(rotations(dim, rounds)):
        y = (x @ rot) * scale
        for t in range(wide // 8):
            z = y[:, 8 * t:8 * t + 8]
            v = decode(z)
            side = (z - v) @ near.T
            best = np.argpartition(-side, min(probes, 239), axis=1)[:, :probes] if probes else np.zeros((n, 0), int)
            table = r * (wide // 8) + t
            out.append(np.stack([_code(v, table)] + [_code(v + near[best[:, p]], table)
                                                     for p in range(probes)], axis=1))
    return np.stack(out, axis=1) if out else np.zeros((n, 0, 1 + probes), dtype=np.int64)


def _vectors(batches):
    """vec_id, key of (label, vector), label, vector; key and vector null where nothing can link."""
    for b in batches:
        ids, vecs, labels = b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()
        keys, out = [], []
        for v, label in zip(vecs, labels):
            a = None if v is None or label is None or not v or any(x is None for x in v) else np.array(v, dtype=np.float64)
            if a is None or not np.isfinite(a).all() or not a.any():
                keys.append(None), out.append(None)
                continue
            a = a + 0.0                                     # -0.0 and 0.0 are one value
            keys.append(hashlib.blake2b(f"{label}:".encode() + a.tobytes(), digest_size=16).digest())
            out.append(a)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(keys, pa.binary()), b.column(2), pa.array(out, pa.list_(pa.float64()))],
            ["vec_id", "key", "label", "v"])


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1)[:, None]                 # the squares neither overflow nor vanish
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _coder(scale: float, probes: int, rounds: int):
    def run(batches):
        for b in batches:
            vecs = b.column(1).to_pylist()
            out: list = [None] * len(vecs)
            for dim in {len(v) for v in vecs}:
                at = [i for i, v in enumerate(vecs) if len(v) == dim]
                c = codes(_unit(np.array([vecs[i] for i in at])), scale, probes, rounds) ^ np.int64(dim)
                for i, x in zip(at, c.reshape(len(at), -1)):
                    out[i] = x
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], ["key", "codes"])
    return run


def _meet(threshold: float, width: int):
    def links(x, home, a, b):  # noqa: ANN001
        """Index pairs (from a, from b) in one cell with a sufficient cosine."""
        s = x[a] @ x[b].T
        i, j = np.nonzero(s >= threshold - 1e-9)
        i, j = a[i], b[j]
        ok = (home[i] | home[j]) & (i != j)
        i, j = i[ok], j[ok]
        ok = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
        return i[ok], j[ok]

    def first_cell(code, i, j):  # noqa: ANN001
        """The cell of the first table in which two vectors find each other."""
        cell = np.zeros(len(i), dtype=np.int64)
        todo = np.ones(len(i), dtype=bool)
        for t in range(code.shape[1]):
            hi, hj = code[i, t, 0], code[j, t, 0]
            ij = (code[j, t] == hi[:, None]).any(axis=1)
            ji = (code[i, t] == hj[:, None]).any(axis=1)
            c = np.where(ij & ji, np.minimum(hi, hj), np.where(ij, hi, hj))
            now = todo & (ij | ji)
            cell[now] = c[now]
            todo &= ~now
        return cell

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["label", "code", "bi", "bj"], kind="stable")
        rep, copies = pdf["rep"].to_numpy(), pdf["copies"].to_numpy()
        home, blk = pdf["home"].to_numpy(), pdf["blk"].to_numpy()
        cells, bi, bj = pdf["code"].to_numpy(), pdf["bi"].to_numpy(), pdf["bj"].to_numpy()
        label = pdf["label"].to_numpy()
        codes_of = pdf["codes"].to_numpy()
        new = np.ones(len(pdf), dtype=bool)
        new[1:] = (label[1:] != label[:-1]) | (cells[1:] != cells[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])
        bounds = np.append(np.flatnonzero(new), len(pdf))
        vecs = pdf["v"].to_numpy()
        out_rep, out_n, out_to = [], [], []
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            x = _unit(np.stack(vecs[lo:hi]))
            at = np.arange(hi - lo)
            if bi[lo] == bj[lo]:
                i, j = links(x, home[lo:hi], at, at)
                keep = i < j
                i, j = i[keep], j[keep]
            else:
                i, j = links(x, home[lo:hi], at[blk[lo:hi] == bi[lo]], at[blk[lo:hi] == bj[lo]])
            if not len(i):
                continue
            code = np.stack(codes_of[lo:hi]).reshape(hi - lo, -1, width)
            counted = first_cell(code, i, j) == cells[lo]
            n = np.zeros(hi - lo, dtype=np.int64)
            np.add.at(n, i[counted], copies[lo:hi][j[counted]])
            np.add.at(n, j[counted], copies[lo:hi][i[counted]])
            least = rep[lo:hi].copy()                      # smallest id reachable inside the cell
            while True:
                was = least.copy()
                np.minimum.at(least, i, least[j])
                np.minimum.at(least, j, least[i])
                if (was == least).all():
                    break
            seen = np.union1d(i, j)
            out_rep.append(rep[lo:hi][seen])
            out_n.append(n[seen])
            out_to.append(least[seen])
        if not out_rep:
            return pd.DataFrame({"rep": [], "links": [], "to": []}).astype("int64")
        return pd.DataFrame({"rep": np.concatenate(out_rep), "links": np.concatenate(out_n),
                             "to": np.concatenate(out_to)})
    return run


def near_vectors(vectors: DataFrame, *, threshold: float = 0.98, id_col: str = "vec_id",
                 vec_col: str = "embedding", label_col: str = "label", scale: float = SCALE,
                 probes: int = PROBES, rounds: int = ROUNDS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors``.

    Rows with equal, non-null labels link if their cosine in double precision is at least
    ``threshold``. Vectors that are null, empty or zero or hold null or non-finite components link
    with nothing, nor do vectors of different lengths. Equal vectors are compared once and counted
    as often as they occur. Rows that share an id are counted apart and share a component. A null
    id gets a null component and is kept. Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    bound_batches(spark, 2048)
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"),
                         F.col(label_col).cast("string").alias("label"))
    rows = cut_lineage(src.mapInArrow(_vectors, "vec_id long, key binary, label string, v array<double>"), "vectors")
    reps = (rows.where(F.col("key").isNotNull()).groupBy("key")
                .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"),
                     F.first("label").alias("label"), F.first("v").alias("v")))
    reps = cut_lineage(reps.where(F.col("rep").isNotNull()), "distinct_vectors")
    coded = cut_lineage(reps.select("key", "v").mapInArrow(_coder(scale, probes, rounds),
                                                           "key binary, codes array<long>"), "codes")
    width = 1 + probes
    slim = (coded.join(reps.select("key", "label", "rep"), "key")
                 .select("key", "label", F.posexplode("codes").alias("pos", "code"))
                 .withColumn("home", F.col("pos") % width == 0).drop("pos"))
    slim = cut_lineage(slim, "cells_of")
    cells = (slim.groupBy("label", "code").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("any"))
                 .where(F.col("any") & (F.col("n") > 1)).select("label", "code", "n"))
    blocks = F.ceil(F.col("n") / F.lit(float(block_rows))).cast("int")
    at = cut_lineage(slim.join(cells, ["label", "code"]).withColumn("blocks", blocks)
                         .withColumn("blk", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")), "meeting")
    n_shards = max(1, math.ceil((at.agg(F.sum("blocks")).first()[0] or 0) / SHARD_ROWS))
    at = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    at = at.select("key", "code", "home", "blk", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"))
    full = (at.join(reps, "key").join(coded, "key")
              .withColumn("shard", F.pmod(F.xxhash64("label", "code", "bi", "bj"), F.lit(n_shards))))
    met = cut_lineage(full.select("shard", "rep", "copies", "label", "code", "home", "blk", "bi", "bj", "v", "codes")
                          .groupBy("shard").applyInPandas(_meet(threshold, width), "rep long, links long, to long"), "links")
    count = met.groupBy("rep").agg(F.sum("links").alias("links"))
    # rows that share an id but not the vector are one node: their keys carry the same id or link to it
    comp = components(met.select(F.col("rep").alias("a"), F.col("to").alias("b")).unionByName(
        rows.join(reps.select("key", "rep"), "key").where(F.col("vec_id") != F.col("rep"))
            .select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))), "a", "b")
    one = reps.select("key", "rep", "copies").join(count, "rep", "left")
    out = (rows.join(one, "key", "left").join(comp.withColumnRenamed("node", "vec_id"), "vec_id", "left")
               .select("vec_id", F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).alias("n_links"),
                       F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "rep", "vec_id")).alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
