"""Operator 2: benchmark decontamination by SimHash over item-sized windows.

Every text is hashed into word shingles. An item whose weighted shingles can still reach the
similarity (enough of their weight occurs in the text at all, a necessary condition) gets
windows of its own size slid over the places of its shingles; each window's 64-bit SimHash is
looked up in a multi-index: the fingerprint is cut into blocks, every item is filed under all
block values within ``radius // blocks`` bits of its own, so each item within ``radius`` bits is
found in at least one block. Windows found are verified by exact weighted Jaccard similarity.

The benchmark is a stated query set: it is read in parts of bounded size, and all texts are run
against each part. Shingle weights are counted once over the whole benchmark: of its shingles
those that several items share are broadcast, any other has the weight of a shingle seen once.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import bound_batches, chunks, shingles_of, utf8, words_of

WORDS = 5
SIMILARITY = 0.8
RADIUS = 19            # bits; a pair at the similarity differs in about 10 (3 standard deviations less)
BLOCKS = 4
PART_ITEMS = 1000      # items, and
PART_CHARS = 4_000_000  # characters of the benchmark handled at once
_BITS = np.arange(64, dtype=np.uint64)
# words are runs of ASCII letters and digits and of bytes beyond ASCII; punctuation separates
_SEPARATES = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def item_sets(texts: list[bytes], k: int) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Distinct shingles of every item that has words, and all items' numbers of words. An item
    shorter than a shingle is one shingle of its own length."""
    word, _, first, _, _, _ = words_of([t.lower() for t in texts], _SEPARATES)
    n = np.diff(first).astype(np.int64)
    return {i: np.unique(shingles_of(word[first[i]:first[i + 1]], np.array([0, n[i]]), int(min(k, n[i])))[0])
            for i in range(len(texts)) if n[i]}, n


def _item_shingles(k: int):
    def run(batches):
        for b in batches:
            sets, _ = item_sets(utf8(b.column(0)), k)
            h = np.concatenate([np.zeros(0, np.uint64), *sets.values()])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])
    return run


class Index:
    """Shingles, weights, fingerprints and the multi-index of one part of the benchmark."""

    def __init__(self, ids: list[int], texts: list[bytes], k: int, radius: int, shared=None):  # noqa: ANN001
        """``shared``: items, shared shingles (sorted) and their items in the whole benchmark; if
        None, the part is all of it."""
        self.k, self.radius, self.ids = k, radius, ids
        self.sets, n_words = item_sets(texts, k)
        items = list(self.sets)
        self.gram = np.minimum(k, n_words)
        self.length = {i: int(n_words[i]) for i in items}
        every = np.concatenate([self.sets[i] for i in items]) if items else np.zeros(0, np.uint64)
        self.vocab, df = np.unique(every, return_counts=True)
        n, self.shared, df = shared or (len(ids), self.vocab, df)
        self.shared_weight = np.log(1.0 + n / df)
        self.rare = math.log(1.0 + n)                         # weight of a shingle of one item or of none
        self.weight = self.weights(self.vocab)
        post: dict[int, list[int]] = {}
        for i in items:
            for p in np.searchsorted(self.vocab, self.sets[i]).tolist():
                post.setdefault(p, []).append(i)
        self.post = post
        self.total = {i: float(self.weights(self.sets[i]).sum()) for i in items}
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(self.vocab >> np.uint64(44)).astype(np.int64)] = True
        self.by_gram = sorted({int(self.gram[i]) for i in items})
        self.prints = {i: fingerprints(self.sets[i], self.weights(self.sets[i]), np.array([0]),
                                       len(self.sets[i]))[0] for i in items}
        near = [m for d in range(radius // BLOCKS + 1) for m in
                (sum(1 << b for b in c) for c in itertools.combinations(range(16), d))]
        self.near = np.array(near, dtype=np.int64)
        self.blocks: dict[int, list[np.ndarray]] = {}          # window length -> per block, value -> found
        self.of_length: dict[int, np.ndarray] = {}
        for length in sorted(set(self.length.values())):
            who = np.array([i for i in items if self.length[i] == length])
            self.of_length[length] = who
            tables = []
            for b in range(BLOCKS):
                t = np.zeros((1 << 16, -(-len(who) // 8)), dtype=np.uint8)
                for j, i in enumerate(who):
                    value = int(self.prints[i] >> np.uint64(16 * b)) & 0xFFFF
                    t[value ^ self.near, j // 8] |= np.uint8(128 >> j % 8)
                tables.append(t)
            self.blocks[length] = tables

    def weights(self, h: np.ndarray) -> np.ndarray:
        if not len(self.shared):
            return np.full(len(h), self.rare)
        at = np.minimum(np.searchsorted(self.shared, h), len(self.shared) - 1)
        return np.where(self.shared[at] == h, self.shared_weight[at], self.rare)

    def lookup(self, length: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) for all fingerprints within the radius of an item of that length."""
        bits = np.zeros((len(prints), self.blocks[length][0].shape[1]), dtype=np.uint8)
        for b, t in enumerate(self.blocks[length]):
            bits |= t[((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)]
        who = self.of_length[length]
        w, j = np.nonzero(np.unpackbits(bits, axis=1)[:, :len(who)])
        item_prints = np.array([self.prints[i] for i in who], dtype=np.uint64)
        ok = np.bitwise_count(prints[w] ^ item_prints[j]) <= self.radius
        return w[ok], who[j[ok]]


def fingerprints(h: np.ndarray, weight: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    """SimHash of the distinct shingles among starts..starts+m of each window: a shingle that the window
    holds several times counts once, as in the set of an item."""
    weight = np.round(weight * (1 << 24))        # whole numbers: sums do not depend on where they begin
    sign = np.where((h[:, None] >> _BITS) & np.uint64(1), weight[:, None], -weight[:, None])
    acc = np.concatenate((np.zeros((1, 64)), np.cumsum(sign, axis=0)))
    total = acc[np.minimum(starts + m, len(h))] - acc[starts]
    order = np.argsort(h, kind="stable")
    again = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    here, before = order[again + 1], order[again]
    near = here - before < m
    if near.any():
        # the later place does not count in the windows that hold the earlier one as well
        here, before = here[near], before[near]
        less = np.zeros((len(h) + 2, 64))
        np.add.at(less, np.maximum(here - m + 1, 0), sign[here])
        np.subtract.at(less, before + 1, sign[here])
        total -= np.cumsum(less, axis=0)[starts]
    return (np.where(total > 0, np.uint64(1) << _BITS, np.uint64(0))).sum(axis=1, dtype=np.uint64)


def _scan_text(ix: Index, h: np.ndarray, gram: int, at: np.ndarray, similarity: float):
    """Best window per item in one text: (item, first shingle, shingles, similarity, bits apart)."""
    pos = np.searchsorted(ix.vocab, h[at])
    inside = pos < len(ix.vocab)
    at, pos = at[inside], pos[inside]
    at, pos = at[ix.vocab[pos] == h[at]], pos[ix.vocab[pos] == h[at]]
    have: dict[int, float] = {}
    for p in np.unique(pos).tolist():
        for i in ix.post[p]:
            if ix.gram[i] == gram:
                have[i] = have.get(i, 0.0) + float(ix.weight[p])
    for length in sorted({ix.length[i] for i, w in have.items() if w >= similarity * ix.total[i] - 1e-9}):
        who = [i for i, w in have.items() if ix.length[i] == length and w >= similarity * ix.total[i] - 1e-9]
        m = min(length - gram + 1, len(h))
        mine = at[np.isin(ix.vocab[pos], np.concatenate([ix.sets[i] for i in who]))]
        starts = np.unique(np.clip(np.unique(mine)[:, None] - np.arange(m)[None, :], 0, len(h) - m))
        for lo, hi in chunks(np.diff(starts, append=starts[-1] + 1), 4096):
            some = starts[lo:hi]
            base = h[some[0]:some[-1] + m]
            prints = fingerprints(base, ix.weights(base), some - some[0], m)
            best: dict[int, tuple] = {}
            w, items = ix.lookup(length, prints)
            for j, i in zip(w.tolist(), items.tolist()):
                if i not in who:
                    continue
                win = np.unique(h[some[j]:some[j] + m])
                both = float(ix.weights(np.intersect1d(win, ix.sets[i], assume_unique=True)).sum())
                sim = both / (float(ix.weights(win).sum()) + ix.total[i] - both)
                if sim >= similarity - 1e-12 and (i not in best or sim > best[i][0]):
                    best[i] = (sim, int(some[j]), int(np.bitwise_count(prints[j] ^ ix.prints[i])))
            for i, (sim, s, d) in best.items():
                yield i, s, m, sim, d


def _scanner(part, shared, similarity: float):  # noqa: ANN001
    def run(batches):
        ix: Index = Index(*part.value, shared.value)
        for b in batches:
            doc, texts = b.column(0).to_pylist(), utf8(b.column(1))
            for lo, hi in chunks(map(len, texts)):
                word, _, first, starts, ends, at = words_of([t.lower() for t in texts[lo:hi]], _SEPARATES)
                rows = []
                for gram in ix.by_gram:
                    h, sh = shingles_of(word, first, gram)
                    hit = np.flatnonzero(ix.maybe[(h >> np.uint64(44)).astype(np.int64)])
                    of = np.searchsorted(sh, hit, side="right") - 1
                    for d in np.unique(of).tolist():
                        if first[d + 1] - first[d] < gram:
                            continue
                        own = h[sh[d]:sh[d + 1]]
                        for i, s, m, sim, bits in _scan_text(ix, own, gram, hit[of == d] - sh[d], similarity):
                            a, e = starts[first[d] + s], ends[first[d] + s + m + gram - 2]
                            t = texts[lo + d]
                            a, e = int(a - at[d]), int(e - at[d])
                            rows.append((doc[lo + d], ix.ids[i], len(t[:a].decode("utf-8", "replace")),
                                         len(t[:e].decode("utf-8", "replace")), sim, bits))
                cols = list(zip(*rows)) if rows else [[]] * 6
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                                 ["doc_id", "item_id", "start", "end", "similarity", "bits"])
    return run


def contaminations(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text", k: int = WORDS,
                   similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, start, end, similarity, bits): per document and benchmark item the best
    window (most similar, then first), with its character offsets in the text.

    Words are lower-cased (A-Z) runs of letters and digits; a window and an item match if the
    weighted Jaccard similarity of their ``k``-word shingles is at least ``similarity`` (an item
    of fewer words is one shingle and must occur whole). A text shorter than an item is one
    window. Null, empty and wordless texts and items match nothing; repeated rows and items that
    share an id give one row; a null id is reported as null. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where(
        F.length("text") > 0).distinct()
    n, chars = items.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    parts = max(1, math.ceil((n or 0) / PART_ITEMS), math.ceil((chars or 0) / PART_CHARS))
    df = (items.select("text").mapInArrow(_item_shingles(k), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
               .where(F.col("n") > 1).toArrow())              # 16 bytes for a shingle that items share
    h = df.column("h").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(h)
    shared = spark.sparkContext.broadcast((n, h[order], df.column("n").to_numpy().astype(np.int64)[order]))
    out = None
    for p in range(parts):
        rows = sorted(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).collect(),
                      key=lambda r: (r[0] is None, r[0], r[1]))
        part = spark.sparkContext.broadcast(([r[0] for r in rows], [r[1].encode("utf-8", "surrogatepass") for r in rows],
                                             k, radius))
        found = src.mapInArrow(_scanner(part, shared, similarity), "doc_id long, item_id long, start long, end long, "
                                                                   "similarity double, bits long")
        out = found if out is None else out.unionByName(found)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"), "end", "bits")).alias("b")
    return cut_lineage(out.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("b.s")).alias("start"), F.col("b.end").alias("end"),
        F.col("b.similarity").alias("similarity"), F.col("b.bits").alias("bits")), "contaminations")
