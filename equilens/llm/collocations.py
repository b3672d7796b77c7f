"""Operator 13: phrase collocations from vertically partitioned, depth-truncated suffix trees.

The suffixes are the runs of up to four words that begin at each word of a piece. The tree of all of
them is cut vertically: word prefixes are grouped so that the suffixes of a group fit a memory
budget, a prefix with more suffixes than that is prolonged by one more word until its parts fit, and
the subtree of every group is built by itself, from its sorted suffixes. A node's count is the sum of
the leaf totals below it. Counts of prolonged prefixes, the trunk above the subtrees, are known from
the partitioning.

Passes: words are counted per language (text); texts are written as word codes (text); prefixes that
exceed the budget are counted a word deeper (codes, only while there are any); suffixes go to their
groups in packed blocks (codes); subtrees give counts; the rest is joins over frequent phrases only.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import bound_batches, mix, small, utf8, words_of

DEPTH = 4                    # words of the longest phrase
LEAST = 30                   # occurrences a phrase needs
TOP = 2000                   # phrases reported per language
BUDGET = 1_500_000           # suffixes of a group held in memory at once
GROUPS = 20_000              # groups at most; beyond that a group is built in several parts, added up
HEAVY = 32                   # a prefix over 1/32 of the budget is given its group by name
KNOWN = 400_000              # words that have a short code: the most frequent ones, broadcast
BLOCK_BYTES = 2_000_000      # text handled at once
BLOCK_CODES = 500_000        # words whose suffixes are packed at once
_LONG = np.uint64(1 << 62)   # codes from here on are word hashes, below are ranks
_BREAKS = np.isin(np.arange(256), [ord(c) for c in ".,;:!?\n\x0b\x0c\r"])
_SEPARATES = _BREAKS | np.isin(np.arange(256), [9, 32])
_CUT = re.compile(rb"[\t-\r .,;:!?]")
WORDS = [f"w{i + 1}" for i in range(DEPTH)]


# ---------------------------------------------------------------------------
# texts to words
# ---------------------------------------------------------------------------
def _windows(text: bytes, most: int):
    """(first, last, part): a text in parts that end before a separating byte."""
    lo = 0
    while True:
        m = _CUT.search(text, lo + most) if lo + most < len(text) else None
        hi = m.start() if m else len(text)
        yield lo == 0, m is None, text[lo:hi] if lo or m else text
        if not m:
            return
        lo = hi


def _blocks(batches, most: int):
    """(language, [(begins a text, ends it, bytes)]) with about ``most`` bytes each."""
    held: dict[str, list] = {}
    size: dict[str, int] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), utf8(b.column(1))):
            for part in _windows(text.lower(), most):
                held.setdefault(lang, []).append(part)
                size[lang] = size.get(lang, 0) + len(part[2])
                if size[lang] >= most:
                    yield lang, held.pop(lang)
                    del size[lang]
    yield from held.items()


def _words(parts: list[tuple[bool, bool, bytes]]):
    """Word hashes of all parts, whether a word begins a piece, and (start, end) in the joined bytes."""
    joined = b" ".join(p for *_, p in parts)
    word, doc, first, starts, ends, at = words_of([p for *_, p in parts], _SEPARATES)
    pieces = np.cumsum(_BREAKS[np.frombuffer(joined, dtype=np.uint8)], dtype=np.int32)
    piece = pieces[starts] if len(starts) else np.zeros(0, np.int32)
    new = np.ones(len(word), dtype=bool)
    new[1:] = (piece[1:] != piece[:-1]) | (doc[1:] != doc[:-1])
    # the first word of a part that goes on with a text begins a piece only behind a break
    for i, (begins, *_) in enumerate(parts):
        if not begins and first[i] < first[i + 1]:
            w = first[i]
            new[w] = bool(_BREAKS[np.frombuffer(joined, np.uint8, int(starts[w] - at[i]), int(at[i]))].any())
    return (word >> np.uint64(2)) | _LONG, new, starts, ends, joined


def _count_words(batches):
    for lang, parts in _blocks(batches, BLOCK_BYTES):
        word, _, starts, ends, joined = _words(parts)
        code, at, n = np.unique(word, return_index=True, return_counts=True)
        texts = [joined[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())]
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * (len(code) + 1), pa.string()), pa.array([0, *code.view(np.int64).tolist()], pa.int64()),
             pa.array([b"", *texts], pa.binary()).cast(pa.string()), pa.array([len(word), *n.tolist()], pa.int64())],
            ["lang", "code", "word", "f"])


class _Codes:
    """Short codes of the most frequent words, per language; ``complete``: of all that are frequent."""

    def __init__(self, known: pa.Table, complete: bool):
        self.complete = complete
        langs = known.column("lang").combine_chunks().dictionary_encode()
        lang = langs.indices.to_numpy(zero_copy_only=False)
        code = known.column("code").to_numpy().view(np.uint64)
        self.of = {}
        for i, name in enumerate(langs.dictionary.to_pylist()):
            c = code[lang == i]                           # most frequent first
            order = np.argsort(c)
            self.of[name] = c, c[order], (order + 1).astype(np.uint64)

    def short(self, lang: str, word: np.ndarray) -> np.ndarray:
        """Ranks from 1 for known words; else 0 if the word is surely rare, or its hash."""
        _, code, rank = self.of.get(lang, (None, np.zeros(0, np.uint64), None))
        rest = np.zeros_like(word) if self.complete else word
        if not len(code):
            return rest
        at = np.minimum(np.searchsorted(code, word), len(code) - 1)
        return np.where(code[at] == word, rank[at], rest)

    def full(self, lang: str, codes: np.ndarray) -> np.ndarray:
        """Word hashes of short codes; 0 stays."""
        by_rank = np.concatenate((np.zeros(1, np.uint64), self.of.get(lang, (np.zeros(0, np.uint64),))[0]))
        known = codes < _LONG
        return np.where(known, by_rank[np.where(known, codes, 0).astype(np.int64)], codes)


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of equally many whole numbers, byte planes side by side, compressed."""
    import zstandard
    planes = np.stack([c.astype(np.uint64) for c in columns]).view(np.uint8).reshape(len(columns), -1, 8)
    raw = np.ascontiguousarray(planes.transpose(0, 2, 1)).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(data: bytes, n: int) -> np.ndarray:
    """The ``n`` columns of a packed block, one per row."""
    import zstandard
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(n, 8, -1)
    return np.ascontiguousarray(raw.transpose(0, 2, 1)).view(np.uint64).reshape(n, -1)


def _encode(codes):  # noqa: ANN001
    """Texts as word codes; a 0 stands before each piece and for words that are rare. Suffixes begin
    at the first ``n`` codes; a text that goes on in the next row has its last ones repeated there."""
    def run(batches):
        left: dict[str, np.ndarray] = {}
        for lang, parts in _blocks(batches, BLOCK_BYTES):
            word, new, *_ = _words(parts)
            out = np.insert(codes.value.short(lang, word), np.flatnonzero(new), np.uint64(0))
            out = np.concatenate((left.pop(lang, np.zeros(0, np.uint64)), out))
            n = len(out)
            if not parts[-1][1]:
                n = max(0, n - DEPTH + 1)
                left[lang] = out[n:]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang], pa.string()), pa.array([n], pa.int64()), pa.array([pack([out])], pa.binary())],
                ["lang", "n", "codes"])
    return run


# ---------------------------------------------------------------------------
# vertical partitioning
# ---------------------------------------------------------------------------
class _Plan:
    """Where suffixes go: prefixes by name to a group, or prolonged (group -1); all others, which
    are light, to a group by hash."""

    def __init__(self) -> None:
        self.key = np.zeros(0, np.uint64)
        self.group = np.zeros(0, np.int64)
        self.light: dict[str, tuple[int, int]] = {}       # language: first light group, groups
        self.parts = 1

    def name(self, keys: np.ndarray, groups: np.ndarray) -> None:
        key, group = np.concatenate((self.key, keys)), np.concatenate((self.group, groups))
        order = np.argsort(key)
        self.key, self.group = key[order], group[order]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Group of each prefix hash by name, -1: prolonged, -2: light."""
        if not len(self.key):
            return np.full(len(h), -2)
        at = np.minimum(np.searchsorted(self.key, h), len(self.key) - 1)
        return np.where(self.key[at] == h, self.group[at], -2)


def _lang_key(lang: str) -> np.uint64:
    import zlib
    return np.uint64(zlib.crc32(lang.encode()) + 1)


def prefix_hash(lang: str, words: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(words[0]), _lang_key(lang), dtype=np.uint64)
    for w in words:
        h = mix(h ^ w) + np.uint64(0x9E3779B97F4A7C15)
    return h


def _suffixes(codes: np.ndarray) -> list[np.ndarray]:
    """The words of all suffixes of two words and more, 0 behind a suffix's end."""
    c = np.concatenate((codes, np.zeros(DEPTH, np.uint64)))
    at = np.flatnonzero((c[:-1] != 0) & (c[1:] != 0))
    out = [c[at], c[at + 1]]
    for i in range(2, DEPTH):
        out.append(np.where(out[-1] != 0, c[np.minimum(at + i, len(c) - 1)], 0))
    return out


def _runs(batches):
    """(language, codes, n): word codes in runs of bounded size; suffixes begin at the first n."""
    for b in batches:
        for lang, n, data in zip(*(c.to_pylist() for c in b.columns)):
            codes = unpack(data, 1)[0]
            for lo in range(0, n, BLOCK_CODES):
                yield lang, codes[lo:lo + BLOCK_CODES + DEPTH - 1], min(BLOCK_CODES, n - lo)


def _starting(codes: np.ndarray, n: int) -> list[np.ndarray]:
    """Suffixes that begin within the first ``n`` codes."""
    own = int(np.count_nonzero((codes[:n] != 0) & (np.append(codes, np.uint64(0))[1:n + 1] != 0)))
    return [w[:own] for w in _suffixes(codes)]


def _count_deeper(plan, depth: int):  # noqa: ANN001
    """Counts of the prefixes of ``depth`` words whose first words are a prolonged prefix."""
    def run(batches):
        for lang, codes, n in _runs(batches):
            words = _starting(codes, n)
            keep = np.ones(len(words[0]), dtype=bool)
            for d in range(1, depth):
                keep[keep] = plan.value.find(prefix_hash(lang, [w[keep] for w in words[:d]])) == -1
            words = [w[keep] for w in words[:depth]]
            there = words[-1] != 0
            words = [w[there] for w in words]
            first, total = _equal(words)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(first), pa.string()),
                 *[pa.array(w[first].view(np.int64)) for w in words], pa.array(total)],
                ["lang", *WORDS[:depth], "f"])
    return run


def _equal(words: list[np.ndarray], weight: np.ndarray | None = None):
    """(index of the first, total weight) of every distinct row of the columns, in their order."""
    if not len(words[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort(words[::-1])
    new = np.zeros(len(order), dtype=bool)
    new[0] = True
    for w in words:
        s = w[order]
        new[1:] |= s[1:] != s[:-1]
    at = np.flatnonzero(new)
    total = np.add.reduceat(np.ones(len(order), np.int64) if weight is None else weight[order].astype(np.int64), at)
    return order[at], total


def _place(plan, budget: int, depth: int, counted: pa.Table, group: int) -> int:
    """Names the heavy prefixes of ``depth`` words: prolonged if they exceed the budget, else put
    into groups, largest first, as long as the budget lasts. Returns the next free group."""
    f = counted.column("f").to_numpy()
    order = np.argsort(-f, kind="stable")
    lang = np.array(counted.column("lang").to_pylist(), dtype=object)
    keys = np.zeros(len(f), dtype=np.uint64)
    words = [counted.column(w).to_numpy().view(np.uint64) for w in WORDS[:depth]]
    for name in set(lang.tolist()):
        mine = lang == name
        keys[mine] = prefix_hash(name, [w[mine] for w in words])
    groups = np.full(len(f), -1, dtype=np.int64)
    load = 0
    for i in order.tolist():
        if f[i] > budget and depth < DEPTH:
            continue
        if load and load + f[i] > budget:
            group, load = group + 1, 0
        groups[i] = group
        load += int(f[i])
    plan.name(keys, groups)
    return group + 1 if load else group


# ---------------------------------------------------------------------------
# suffixes to groups, subtrees
# ---------------------------------------------------------------------------
def _route(plan, parts: int):  # noqa: ANN001
    def run(batches):
        p = plan.value
        for k, (lang, codes, n) in enumerate(_runs(batches)):
            words = _starting(codes, n)
            first, total = _equal(words)                   # copies are added up before they travel
            words = [w[first] for w in words]
            start, light = p.light.get(lang, (0, 1))
            group = np.zeros(len(first), np.int64)
            depth = np.full(len(first), DEPTH, np.int64)    # words of the prefix a suffix went by
            todo = np.arange(len(first))
            for d in range(1, DEPTH + 1):
                h = prefix_hash(lang, [w[todo] for w in words[:d]])
                to = p.find(h)
                group[todo] = np.where(to >= 0, to, start + (h % np.uint64(light)).astype(np.int64))
                depth[todo] = d
                todo = todo[to == -1]
                if not len(todo):
                    break
            order = np.argsort(group, kind="stable")
            cuts = np.flatnonzero(np.diff(group[order], prepend=-1))
            rows = [(lang, int(group[order[a]]), k % parts, pack([*(w[order[a:e]] for w in words),
                                                                  total[order[a:e]], depth[order[a:e]]]))
                    for a, e in zip(cuts, [*cuts[1:], len(order)])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.binary()))],
                ["lang", "group", "part", "block"])
    return run


def subtree(words: list[np.ndarray], weight: np.ndarray, depth: np.ndarray):
    """Nodes of the suffix tree of the given suffixes: per depth from 2 on (index of a suffix below
    the node, total weight of the leaves below). Nodes above a suffix's own prefix are left out."""
    order = np.lexsort(words[::-1])
    words, weight, depth = [w[order] for w in words], weight[order], depth[order]
    upto = np.concatenate(([0], np.cumsum(weight.astype(np.int64))))
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for d, w in enumerate(words, 1):
        new[1:] |= w[1:] != w[:-1]
        if d < 2:
            continue
        at = np.flatnonzero(new)
        total = upto[np.append(at[1:], len(order))] - upto[at]
        keep = (w[at] != 0) & (depth[at] <= d)
        yield d, order[at[keep]], total[keep]


def _grow(codes, least: int):  # noqa: ANN001
    """The subtree of one group (or of a part of it): its nodes with at least ``least`` leaves."""
    def run(key, blocks):  # noqa: ANN001
        lang = key[0].as_py()
        *words, weight, depth = np.concatenate(
            [unpack(x.as_py(), DEPTH + 2) for c in blocks.column("block").chunks for x in c], axis=1)
        cols: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(DEPTH + 1)]
        for d, at, total in subtree(words, weight, depth):
            at, total = at[total >= least], total[total >= least]
            for i in range(DEPTH):
                w = codes.value.full(lang, words[i][at]) if i < d else np.zeros(len(at), np.uint64)
                cols[i].append(w.view(np.int64))
            cols[DEPTH].append(total)
        out = [np.concatenate(c) for c in cols]
        return pa.table([pa.array([lang] * len(out[0]), pa.string()), *map(pa.array, out)], names=["lang", *WORDS, "f"])
    return run


def phrase_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = LEAST,
                  budget: int = BUDGET, known: int = KNOWN) -> tuple[DataFrame, DataFrame]:
    """(phrases, words): all phrases of one to four words that occur at least ``least`` times in a
    language as (lang, w1..w4 word codes, 0 behind the end, f), and (lang, code, word, f) of the words;
    the word with code 0 has the number of all words. Words are told apart by 62 bits of hash."""
    spark: SparkSession = docs.sparkSession
    bound_batches(spark)
    src = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                      F.col(text_col).cast("string").alias("text")).where(F.length("text") > 0)
    words = cut_lineage(
        src.mapInArrow(_count_words, "lang string, code long, word string, f long").groupBy("lang", "code")
           .agg(F.min("word").alias("word"), F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("code") == 0)), "words")
    frequent = words.where(F.col("code") != 0)
    top = frequent.select("lang", "code", "f").orderBy(F.desc("f"), "lang", "code").limit(known).toArrow()
    complete = top.num_rows < known
    codes = spark.sparkContext.broadcast(_Codes(top, complete))
    encoded = cut_lineage(src.mapInArrow(_encode(codes), "lang string, n long, codes binary"), "codes")

    # words that have no short code are light: there are at most KNOWN * f of them more frequent
    total = {r[0]: int(r[1]) for r in words.groupBy("lang").agg(
        F.sum(F.when(F.col("code") != 0, F.col("f")) if complete else F.when(F.col("code") == 0, F.col("f")))).collect()
        if r[1]}
    every = sum(total.values())
    limit = max(budget, -(-every // GROUPS))
    parts = -(-limit // budget)
    plan, free, trunk = _Plan(), 0, []
    rank = {}
    short = np.zeros(top.num_rows, np.int64)
    for i, lang in enumerate(top.column("lang").to_pylist()):
        rank[lang] = short[i] = rank.get(lang, 0) + 1
    counted = pa.table({"lang": top.column("lang"), "w1": pa.array(short), "f": top.column("f")})
    for depth in range(1, DEPTH + 1):
        f = counted.column("f").to_numpy()
        free = _place(plan, limit, depth, counted.filter(pa.array(f > limit // HEAVY)), free)
        if depth == DEPTH or not (f > limit).any():
            break
        shipped = spark.sparkContext.broadcast(plan)
        kinds = ", ".join(f"{w} long" for w in WORDS[:depth + 1])
        deeper = encoded.mapInArrow(_count_deeper(shipped, depth + 1), f"lang string, {kinds}, f long").groupBy(
            "lang", *WORDS[:depth + 1]).agg(F.sum("f").alias("f"))
        counted = cut_lineage(deeper.where(F.col("f") > limit // HEAVY), "prefixes").toArrow()
        if depth + 1 < DEPTH:
            trunk.append((depth + 1, counted.filter(pa.array(counted.column("f").to_numpy() > limit))))
    for lang, n in sorted(total.items()):
        groups = max(1, -(-2 * n // limit))
        plan.light[lang] = free, groups
        free += groups
    shipped = spark.sparkContext.broadcast(plan)
    blocks = encoded.mapInArrow(_route(shipped, parts), "lang string, group long, part long, block binary")
    kinds = ", ".join(f"{w} long" for w in WORDS)
    nodes = blocks.groupBy("lang", "group", "part").applyInArrow(
        _grow(codes, least if parts == 1 else 1), f"lang string, {kinds}, f long")
    if parts > 1:
        nodes = nodes.groupBy("lang", *WORDS).agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    zero = F.lit(0).cast("long")
    out = nodes.unionByName(frequent.select("lang", F.col("code").alias("w1"), *[zero.alias(w) for w in WORDS[1:]], "f"))
    for depth, table in trunk:
        if table.num_rows:
            rows = []
            for lang in set(table.column("lang").to_pylist()):
                t = table.filter(pa.compute.equal(table.column("lang"), lang))
                cols = [codes.value.full(lang, t.column(w).to_numpy().view(np.uint64)).view(np.int64).tolist()
                        for w in WORDS[:depth]]
                rows += [(lang, *w, *[0] * (DEPTH - depth), n) for *w, n in zip(*cols, t.column("f").to_pylist())]
            out = out.unionByName(spark.createDataFrame(rows, f"lang string, {kinds}, f long"))
    return cut_lineage(out, "phrases"), words


def _key(words: list[F.Column]) -> F.Column:
    pad = [F.lit(0).cast("long")] * (DEPTH - len(words))
    return F.struct(*[w.alias(n) for w, n in zip([*words, *pad], WORDS)])


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = LEAST,
                 top: int = TOP, budget: int = BUDGET, known: int = KNOWN) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of two to four
    words by score, then count ``a`` (both descending), then phrase (UTF-8 byte order).

    Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends, these into words at
    blanks and tabs. A phrase needs ``least`` occurrences within pieces, overlapping ones counted.
    Of its cuts into two parts with counts l and r the one with the lowest floor(2000000 a / (l + r))
    counts, on a tie the first. Phrases inside a longer one with at least 80 % of their count are
    dropped. ``n``: words of the language. A null language is ``und``; null and empty texts hold
    nothing; repeated rows count each; other columns are not looked at; an empty table gives an
    empty result.
    """
    phrases, words = phrase_counts(docs, text_col=text_col, lang_col=lang_col, least=least, budget=budget, known=known)
    w = [F.col(x) for x in WORDS]
    counts = phrases.select("lang", F.struct(*WORDS).alias("key"), "f")
    cand = phrases.where(F.col("w2") != 0).select(
        "lang", F.struct(*WORDS).alias("phrase"), F.col("f").alias("a"),
        F.when(F.col("w3") == 0, 2).when(F.col("w4") == 0, 3).otherwise(4).alias("d"), *WORDS)
    cut = [F.when(F.col("d") == d, F.array(*[F.struct(F.lit(k).alias("k"), _key(w[:k]).alias("left"), _key(w[k:d]).alias("right"))
                                            for k in range(1, d)])) for d in range(2, DEPTH + 1)]
    cuts = cand.select("lang", "phrase", "a", F.inline(F.coalesce(*cut)))
    of = lambda c, f: counts.select("lang", F.col("key").alias(c), F.col("f").alias(f))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    score = F.expr("(cast(a as decimal(28,0)) * 2000000BD) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("m")).select("lang", "phrase", "a", "m.l", "m.r", "m.score")
    part = [F.when(F.col("d") == d, F.array(*[_key(w[i:i + m]) for m in range(2, d) for i in range(d - m + 1)]))
            for d in range(3, DEPTH + 1)]
    inside = cand.where(F.col("d") > 2).select("lang", F.col("a").alias("longer"), F.explode(F.coalesce(*part)).alias("phrase")).groupBy(
        "lang", "phrase").agg(F.max("longer").alias("longer"))
    left = scored.join(inside, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | F.expr("100BD * cast(longer as decimal(20,0)) < 80BD * cast(a as decimal(20,0))"))
    left = left.select("lang", "a", "l", "r", "score", *[F.col(f"phrase.{x}").alias(x) for x in WORDS])
    named = small(words.where(F.col("code") != 0).select("lang", "code", "word"))
    for x in WORDS:
        left = left.join(named.select("lang", F.col("code").alias(x), F.col("word").alias(x + "s")), ["lang", x], "left")
    left = left.select("lang", F.concat_ws(" ", *[x + "s" for x in WORDS]).alias("phrase"), "a", "l", "r", "score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    n = F.broadcast(words.where(F.col("code") == 0).select("lang", F.col("f").alias("n")))
    return ranked.join(n, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
