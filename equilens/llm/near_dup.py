"""Operator 7: near-duplicate documents by MinHash with tensored banding.

Instead of one fresh set of minhashes per table, ``groups`` small collections of ``size``
minhashes are computed once and every *pair* of collections forms the key of one table:
groups * size minhash evaluations serve groups * (groups - 1) / 2 tables with keys of
2 * size minhashes. Two sets of similarity s meet in a table if at least two collections
agree, so a link is missed with probability (1-p)^g + g p (1-p)^(g-1), p = s^size; ``groups``
is derived from the threshold so that this stays below ``miss``.

Documents with equal shingle sets collapse to one node first. In every bucket the members
are compared with pivots instead of with each other; buckets whose members already share a
component are done, the others get further pivots until no cross-component pair is left
untested. All links are confirmed on the full shingle sets.

Before a pair's full sets are fetched, two necessary conditions are tested: the set sizes, and
the parity bitmaps. Bit b of a set's bitmap is the parity of its shingles that hash to b, so two
bitmaps differ in at most as many bits as the sets do in shingles: a pair with more differing bits
than the threshold allows differing shingles cannot link. This drops no link.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import (bound_batches, chunks, components, joined, lists_of, mix, shingles_of, small, utf8,
                     words_of)

SIZE = 2              # minhashes per collection
MISS = 1e-4           # largest probability of missing a link at the threshold
PARITY_BITS = 1024    # bits of a set's parity bitmap (a multiple of 64)
PAIR_BUCKET = 512     # up to this many members all of a bucket become pivots in one round
PIVOTS = 256          # pivots of the first such round in larger buckets, four times more in each next


def n_groups(num: int, den: int, size: int = SIZE, miss: float = MISS) -> int:
    """Smallest number of collections whose miss probability at num/den is at most ``miss``."""
    p = (num / den) ** size
    g = 2
    while (1 - p) ** g + g * p * (1 - p) ** (g - 1) > miss and g < 200:
        g += 1
    return g


def _sets(batch_texts: list[bytes], k: int):
    """Distinct shingle hashes per text: list of sorted uint64 arrays."""
    word, _, first, _, _, _ = words_of([t.lower() for t in batch_texts])
    h, at = shingles_of(word, first, k)
    return [np.unique(h[at[i]:at[i + 1]]) for i in range(len(batch_texts))]


def _parity(flat: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Parity bitmaps of consecutive sets of ``n`` shingles each: (sets, PARITY_BITS / 64) int64."""
    at = np.repeat(np.arange(len(n)) * PARITY_BITS, n) + (mix(flat) % np.uint64(PARITY_BITS)).astype(np.int64)
    odd = (np.bincount(at, minlength=len(n) * PARITY_BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(len(n), -1)


def _signer(k: int, groups: int, size: int):
    rng = np.random.default_rng(20240607)
    mul = rng.integers(1, 1 << 63, groups * size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    xor = rng.integers(0, 1 << 63, groups * size, dtype=np.uint64)

    def sign(batches):
        for b in batches:
            texts = utf8(b.column(1))
            for lo, hi in chunks(map(len, texts)):
                sets = _sets(texts[lo:hi], k)
                n = np.array([len(s) for s in sets], dtype=np.int64)
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                full = np.flatnonzero(n)
                keys = np.zeros((hi - lo, groups), dtype=np.int64)
                bits = np.zeros((hi - lo, PARITY_BITS // 64), dtype=np.int64)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    at = np.concatenate(([0], np.cumsum(n[full])[:-1]))
                    bits[full] = _parity(flat, n[full])
                    for g in range(groups):
                        acc = np.full(len(full), g + 1, dtype=np.uint64)
                        for j in range(g * size, g * size + size):
                            v = (flat ^ xor[j]) * mul[j]
                            v ^= v >> np.uint64(32)
                            acc = mix(acc ^ np.minimum.reduceat(v * mul[j], at))
                        keys[full, g] = acc.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(n), pa.array(digest, pa.binary()),
                     lists_of(keys.reshape(-1), np.arange(hi - lo + 1) * groups, pa.int64()),
                     lists_of(bits.reshape(-1), np.arange(hi - lo + 1) * bits.shape[1], pa.int64())],
                    ["doc_id", "n", "set_key", "groups", "bits"])
    return sign


def _setter(k: int):
    def run(batches):
        for b in batches:
            texts = utf8(b.column(1))
            for lo, hi in chunks(map(len, texts)):
                sets = _sets(texts[lo:hi], k)
                first = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), lists_of(flat, first, pa.int64())],
                    ["rep", "items"])
    return run


def near_duplicates(docs: DataFrame, *, k: int = 5, num: int = 80, den: int = 100,
                    id_col: str = "doc_id", text_col: str = "text", size: int = SIZE,
                    miss: float = MISS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; a document's set
    holds its distinct ``k``-word shingles (fewer words: the whole sequence as one). Documents
    link if den * |intersection| >= num * |union|. Null and wordless texts have an empty set and
    link with nothing. Rows that share an id are one document. A null id links with nothing,
    gets a null component and is kept. Other columns of ``docs`` are ignored; an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    groups = n_groups(num, den, size, miss)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = cut_lineage(src.mapInArrow(
        _signer(k, groups, size), "doc_id long, n long, set_key binary, groups array<long>, bits array<long>"), "minhash")
    reps = cut_lineage(
        signed.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy("set_key")
              .agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"),
                   F.first("groups").alias("groups"), F.first("bits").alias("bits")), "sets")
    keys = F.array(*[F.xxhash64(F.lit(i), F.lit(j), F.col("groups")[i], F.col("groups")[j])
                     for i, j in itertools.combinations(range(groups), 2)])
    keyed = reps.select("set_key", "rep", F.explode(keys).alias("key"))
    shared = (keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("rep").alias("pivot"))
                   .where(F.col("members") > 1))
    buckets = cut_lineage(keyed.join(shared, "key"), "buckets")

    check = _Check(src, reps, k, num, den)
    links = check.links(buckets.where(F.col("rep") != F.col("pivot"))
                               .select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct())
    n_pivots = PIVOTS
    comp = components(links, "a", "b")
    at = buckets.where(F.col("members") > 2)
    while True:
        open_ = cut_lineage(_with_sets(_open(at, comp), reps), "open")
        pivots = cut_lineage(_pivots(open_, n_pivots), "pivots")
        if pivots.isEmpty():
            break
        found = check.links(_next_pairs(open_, pivots, num, den))
        if not found.isEmpty():
            comp = joined(comp, found, "a", "b")
        # all pairs of the other buckets have been compared now
        at = open_.where(~_whole(n_pivots)).select(*at.columns)
        if at.isEmpty():
            break
        n_pivots *= 4
    member = signed.join(reps.select("set_key", "rep"), "set_key", "left")
    return _labelled(member, comp)


class _Check:
    """Confirms pairs on full sets; sets are made once per document that any pair names."""

    def __init__(self, src: DataFrame, reps: DataFrame, k: int, num: int, den: int):
        self.src, self.k, self.num, self.den = src, k, num, den
        # the bitmap of an id that several sets share is not known and passes every pair
        self.size = reps.groupBy("rep").agg(
            F.min("n").alias("lo"), F.max("n").alias("hi"),
            F.when(F.count(F.lit(1)) == 1, F.first("bits")).alias("bits"))
        self.sets: DataFrame | None = None

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets fulfil den * |a & b| >= num * |a | b|."""
        num, den = self.num, self.den
        of = lambda c: self.size.select(F.col("rep").alias(c), *[F.col(x).alias(c + x) for x in ("lo", "hi", "bits")])
        cand = (pairs.join(of("a"), "a").join(of("b"), "b")
                     .where((F.col("ahi") * den >= F.col("blo") * num) & (F.col("bhi") * den >= F.col("alo") * num)
                            & _may_link("abits", "bbits", F.col("ahi") + F.col("bhi"), num, den))
                     .select("a", "b"))
        cand = cut_lineage(cand, "candidates")
        if cand.isEmpty():
            return cand
        ids = cand.select(F.col("a").alias("doc_id")).unionByName(cand.select(F.col("b").alias("doc_id"))).distinct()
        if self.sets is not None:
            ids = ids.join(self.sets.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_anti")
        ids = cut_lineage(ids, "needed")
        if self.sets is None or not ids.isEmpty():
            more = cut_lineage(self.src.join(small(ids), "doc_id", "left_semi").mapInArrow(
                _setter(self.k), "rep long, items array<long>"), "full_sets")
            self.sets = more if self.sets is None else self.sets.unionByName(more)
        both = (cand.join(self.sets.select(F.col("rep").alias("a"), F.col("items").alias("x")), "a")
                    .join(self.sets.select(F.col("rep").alias("b"), F.col("items").alias("y")), "b"))
        inter = F.size(F.array_intersect("x", "y"))
        both = both.select("a", "b", inter.cast("long").alias("i"), (F.size("x") + F.size("y")).cast("long").alias("s"))
        linked = (F.col("i") > 0) & (F.col("i") * den >= (F.col("s") - F.col("i")) * num)
        return cut_lineage(both.where(linked).select("a", "b").distinct(), "linked")


def _may_link(bits: str, others: str, total: F.Column, num: int, den: int) -> F.Column:
    """Whether two sets of ``total`` shingles together can still link by their parity bitmaps:
    they differ in at least as many shingles as the bitmaps do in bits."""
    differ = [F.bit_count(F.col(bits)[i].bitwiseXOR(F.col(others)[i])) for i in range(PARITY_BITS // 64)]
    return F.coalesce(sum(differ[1:], differ[0]).cast("long") * (den + num) <= total * (den - num), F.lit(True))


def _open(buckets: DataFrame, comp: DataFrame) -> DataFrame:
    """Members of buckets that still hold more than one component, with the largest (``main``) and
    the number of members outside it (``others``)."""
    at = (buckets.join(comp.withColumnRenamed("node", "rep"), "rep", "left")
                 .select(*buckets.columns, F.coalesce("component", "rep").alias("comp")))
    sizes = at.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    mixed = (sizes.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("n", "comp")).alias("m"))
                  .where(F.col("k") > 1).select("key", F.col("m.comp").alias("main"), F.col("m.n").alias("in_main")))
    return at.join(mixed, "key").withColumn("others", F.col("members") - F.col("in_main")).drop("in_main")


def _with_sets(open_: DataFrame, reps: DataFrame) -> DataFrame:
    """Adds size and bitmap to the open members: a set's memberships, one per table at most, are
    gathered first, so that its bitmap is joined once and not once per table."""
    cols = [c for c in open_.columns if c != "set_key"]
    of = open_.groupBy("set_key").agg(F.collect_list(F.struct(*cols)).alias("in"))
    return (of.join(reps.select("set_key", "n", "bits"), "set_key")
              .select("set_key", "n", "bits", F.inline("in")))


def _whole(n_pivots: int) -> F.Column:
    """Whether all members of an open bucket outside its main component become pivots in this round;
    every pair of two components is compared then, and the bucket is done."""
    return (F.col("members") <= PAIR_BUCKET) | (F.col("others") <= n_pivots)


def _pivots(open_: DataFrame, n_pivots: int) -> DataFrame:
    """Members of open buckets to compare the others with next. Of any two components one is not
    the main one, so pivots outside it meet every open pair. A bucket's first pivot has met all."""
    fresh = open_.where((F.col("comp") != F.col("main")) & (F.col("rep") != F.col("pivot")))
    cols = ["rep", "set_key", "comp", "n", "bits"]
    few = fresh.where(_whole(n_pivots)).select("key", *cols)
    many = (fresh.where(~_whole(n_pivots))
                 .groupBy("key", F.pmod(F.xxhash64("rep"), F.lit(n_pivots)).alias("slot"))
                 .agg(F.min(F.struct(*cols)).alias("p")).select("key", "p.*"))
    return few.unionByName(many)


def _next_pairs(open_: DataFrame, pivots: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of a pivot and a member of another component in the same bucket. Pairs that cannot
    link are left out: by the sizes of their sets and by their parity bitmaps. The join is on
    bucket and size class; sizes that allow a link lie in the same or in adjacent classes, so a
    large bucket meets class by class."""
    size_class = F.floor(F.log("n") / (math.log(den / num) + 1e-6)) if num < den else F.col("n")
    p = (pivots.withColumn("class", F.explode(F.array(size_class - 1, size_class, size_class + 1)))
               .select("key", "class", *[F.col(c).alias("p_" + c) for c in ("rep", "comp", "n", "bits")]))
    both = open_.withColumn("class", size_class).join(p, ["key", "class"]).where(
        (F.col("comp") != F.col("p_comp")) & ((F.col("comp") == F.col("main")) | (F.col("members") > PAIR_BUCKET) | (F.col("rep") > F.col("p_rep")))
        & (F.col("n") * den >= F.col("p_n") * num) & (F.col("p_n") * den >= F.col("n") * num)
        & _may_link("bits", "p_bits", F.col("n") + F.col("p_n"), num, den))
    return both.select(F.greatest("rep", "p_rep").alias("a"), F.least("rep", "p_rep").alias("b")).distinct()


def _labelled(member: DataFrame, comp: DataFrame) -> DataFrame:
    """Component per row; rows that share an id are joined into one component."""
    split = cut_lineage(member.where(F.col("rep").isNotNull()).groupBy("doc_id")
                        .agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"))
                        .where(F.col("lo") != F.col("hi")), "shared_ids")
    if not split.isEmpty():
        own = (member.join(split, "doc_id", "left_semi").where(F.col("rep").isNotNull())
                     .select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
        comp = joined(comp, own, "a", "b")
    of = member.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))
    return of.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
