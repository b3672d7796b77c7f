"""Operator 9: language-model scores from Brown classes.

Training counts every word over all training texts. The most frequent words (a number fixed by a
parameter and proven by counting) form the head that is broadcast; all other words meet their counts
in a shuffle join, so neither grows a task with the corpus. Texts are written once as word ranks; all
later counts read these. Classes are made in two steps: the ``UNITS`` most frequent words are clustered
by the exchange algorithm on their bigram counts over the whole corpus; then every other head word
moves into the class that raises the class-bigram likelihood most, by the counts of the classes it
stands between, which Spark gathers per word and weighs against the small class matrix. Words beyond
the head join a class by the same rule and by all their places, neighbours that are beyond it too
counting by one of ``SUFFIXES`` classes of last two bytes; their classes stay in a table that meets
pairs and texts in joins. Only words that no training text holds keep a class by their last two bytes;
the end of a text is a class of its own. P(text) is the product of add-one smoothed class transitions
and word emissions:
P(c_i | c_i-1) * (count(w) + 1) / (tokens of c + distinct words of c + 1).
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import bound_batches, chunks, utf8, worker_cache

HEAD = 200_000        # most frequent words broadcast, at most
UNITS = 768           # words the classes are made from by exchange
CLASSES = 32          # classes of the exchange
SUFFIXES = 16         # classes by the last two bytes: words of no training text, and neighbours beyond the head
ROUNDS = 8            # exchange passes at most
FLUSH = 300_000       # distinct words a counting task holds before it passes counts on


def _counter(batches):
    """(word, n) of the training texts; the null word counts texts (their end tokens)."""
    have: Counter = Counter()
    texts_seen = 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(have), pa.binary()), pa.array(list(have.values()), pa.int64())],
                                          ["word", "n"])
    for b in batches:
        texts = utf8(b.column(0))
        texts_seen += len(texts)
        for t in texts:
            have.update(t.lower().split())
            if len(have) > FLUSH:
                yield out()
                have = Counter()
    if have:
        yield out()
    if texts_seen:
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([texts_seen], pa.int64())], ["word", "n"])


def suffix_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % SUFFIXES


def _ranks(model: dict) -> dict[bytes, int]:
    """Head word -> rank, made once per worker and model."""
    cache = worker_cache("class_lm")
    if cache.get("id") != model["id"]:
        cache.update(id=model["id"], rank={w: i for i, w in enumerate(model["words"])})
    return cache["rank"]


def _codes_of(words: list[bytes], rank: dict[bytes, int]) -> np.ndarray:
    """Rank of each head word; for others the number of head words plus the suffix class."""
    n = len(rank)
    r = [rank.get(w, -1) for w in words]
    return np.array([x if x >= 0 else n + suffix_class(w) for x, w in zip(r, words)], dtype=np.int32)


def _encode(model):  # noqa: ANN001
    """Runs of whole texts as word codes, an end code before the first, between texts and behind the last;
    with them the words beyond the head as they come."""
    def run(batches):
        m = model.value
        rank = _ranks(m)
        end = np.array([len(rank) + SUFFIXES], dtype=np.int32)
        for b in batches:
            texts = utf8(b.column(0))
            for lo, hi in chunks(map(len, texts)):
                seq, rare = [end], []
                for t in texts[lo:hi]:
                    words = t.lower().split()
                    seq += [_codes_of(words, rank), end]
                    rare += [words[i] for i in np.flatnonzero(seq[-2] >= len(rank)).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(seq).tobytes()], pa.binary()),
                                                  pa.array([rare], pa.list_(pa.binary()))], ["codes", "rare"])
    return run


def _bigrams(of_code):  # noqa: ANN001
    """Counts of neighbouring pairs, codes being mapped to fewer kinds first."""
    def run(batches):
        kind = of_code.value
        size = int(kind.max()) + 1
        total = np.zeros(size * size, dtype=np.int64)
        for b in batches:
            for x in b.column(0):
                u = kind[np.frombuffer(x.as_buffer(), dtype=np.int32)].astype(np.int64)
                total += np.bincount(u[:-1] * size + u[1:], minlength=size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])
    return run


def _contexts(of_code):  # noqa: ANN001
    """(word, cell, n): how often a word without a class (-1) has a class before it (cell: the class) or behind
    it (cell: classes + the class); neighbours without one do not count."""
    def run(batches):
        kind = of_code.value
        size = int(kind.max()) + 1
        held: list[np.ndarray] = []
        n_held = 0

        def out():
            key, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key // (2 * size)), pa.array(key % (2 * size)), pa.array(n)], ["word", "cell", "n"])
        for b in batches:
            for x in b.column(0):
                c = np.frombuffer(x.as_buffer(), dtype=np.int32)
                k = kind[c].astype(np.int64)
                at = np.flatnonzero(k < 0)                          # ends stand on either side of every word
                for side, near in ((0, k[at - 1]), (size, k[at + 1])):
                    ok = near >= 0
                    held.append(c[at][ok].astype(np.int64) * (2 * size) + side + near[ok])
                    n_held += len(held[-1])
                if n_held > FLUSH * 10:
                    yield out()
                    held, n_held = [], 0
        if n_held:
            yield out()
    return run


def _rare_places(b, n_words: int):  # noqa: ANN001
    """Per run of a batch: its codes, the places of words beyond the head and these words."""
    for codes, rare in zip(b.column("codes"), b.column("rare")):
        c = np.frombuffer(codes.as_buffer(), dtype=np.int32)
        yield c, np.flatnonzero((c >= n_words) & (c < n_words + SUFFIXES)), rare.values


def _counted(columns: list, names: list[str]):
    """The distinct rows of a batch with their numbers."""
    t = pa.table(columns, names).group_by(names, use_threads=False).aggregate([([], "count_all")])
    return t.rename_columns([*names, "n"]).to_batches()


def _rare_contexts(of_code, n_words: int):  # noqa: ANN001
    """(word, sides, n) of the words beyond the head; sides: the class before it times classes + the class behind it."""
    def run(batches):
        kind = of_code.value
        size = int(kind.max()) + 1
        for b in batches:
            for c, at, rare in _rare_places(b, n_words):
                if len(at):
                    sides = kind[c[at - 1]].astype(np.int64) * size + kind[c[at + 1]]
                    yield from _counted([rare, pa.array(sides)], ["word", "sides"])
    return run


def _rare_pairs(n_words: int):
    """(w1, w2, n): neighbours that are both beyond the head."""
    def run(batches):
        for b in batches:
            for _, at, rare in _rare_places(b, n_words):
                first = pa.array(np.flatnonzero(np.diff(at) == 1))
                if len(first):
                    yield from _counted([rare.take(first), rare.slice(1).take(first)], ["w1", "w2"])
    return run


def _xlogx(x):  # noqa: ANN001
    return x * np.log(np.maximum(x, 1e-300)) * (x > 0)


def best_classes(before: np.ndarray, behind: np.ndarray, both: np.ndarray, classes: int) -> np.ndarray:
    """Per word (row) the class among the first ``classes`` whose class-bigram log-likelihood gains most if
    the word joins it; ``before`` and ``behind`` count the classes around the word, ``both`` the class
    pairs without these words. Ties go to the first class."""
    tail, head = both.sum(axis=1), both.sum(axis=0)
    out, into = behind.sum(axis=1), before.sum(axis=1)
    gain = np.empty((len(before), classes))
    for c in range(classes):
        gain[:, c] = ((_xlogx(both[c] + behind) - _xlogx(both[c])).sum(axis=1)
                      + (_xlogx(both[:, c] + before) - _xlogx(both[:, c])).sum(axis=1)
                      + _xlogx(both[c, c] + behind[:, c] + before[:, c]) - _xlogx(both[c, c] + behind[:, c])
                      - _xlogx(both[c, c] + before[:, c]) + _xlogx(both[c, c])
                      - _xlogx(tail[c] + before[:, c] + out) + _xlogx(tail[c] + before[:, c])
                      - _xlogx(head[c] + behind[:, c] + into) + _xlogx(head[c] + behind[:, c]))
    return gain.argmax(axis=1)


def best_of_few(row: np.ndarray, cell: np.ndarray, n: np.ndarray, rows: int, both: np.ndarray, classes: int) -> np.ndarray:
    """``best_classes`` of ``rows`` words with few neighbours: ``n`` times word ``row`` has ``cell`` around it (a
    class before it, or classes + the class behind it)."""
    size = len(both)
    seen = np.concatenate((both[:, :classes], both[:classes].T))           # the pair that a cell adds to, per class
    gain = np.zeros((rows, classes))
    old = _xlogx(seen)
    step = 1 << 16
    for lo in range(0, len(row), step):
        r, x, k = row[lo:lo + step], cell[lo:lo + step], n[lo:lo + step, None]
        add = _xlogx(seen[x] + k) - old[x]
        first = np.flatnonzero(np.diff(r, prepend=-1))                     # rows come in order
        gain[r[first]] += np.add.reduceat(add, first, axis=0)
    near = np.zeros((rows, 2, classes))
    inner = cell % size < classes
    near[row[inner], cell[inner] // size, cell[inner] % size] = n[inner]
    before, behind = near[:, 0], near[:, 1]
    into = np.bincount(row, n * (cell < size), rows)[:, None]
    out = np.bincount(row, n * (cell >= size), rows)[:, None]
    corner = np.diagonal(both)[:classes]
    tail, head = both.sum(axis=1)[:classes], both.sum(axis=0)[:classes]
    gain += (_xlogx(corner + behind + before) - _xlogx(corner + behind) - _xlogx(corner + before) + _xlogx(corner)
             - _xlogx(tail + before + out) + _xlogx(tail + before) - _xlogx(head + behind + into) + _xlogx(head + behind))
    return gain.argmax(axis=1)


def _placer(both: np.ndarray, classes: int):
    """Words beyond the head with their sides -> with their number, class and cells as in ``_contexts``."""
    size = len(both)

    def run(batches):
        for b in batches:
            around = b.column("around")
            rows = len(around)
            flat = around.flatten()
            sides, n = flat.field("sides").to_numpy(), flat.field("n").to_numpy()
            row = np.repeat(np.arange(rows), np.diff(around.offsets.to_numpy()))
            key, of = np.unique(np.concatenate((row * 2 * size + sides // size, row * 2 * size + size + sides % size)), return_inverse=True)
            times = np.bincount(of, np.concatenate((n, n)))
            number = np.bincount(row, n, rows).astype(np.int64)
            row, cell = key // (2 * size), key % (2 * size)
            best = best_of_few(row, cell, times, rows, both, classes)
            cells = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)), pa.StructArray.from_arrays(
                [pa.array(cell), pa.array(times.astype(np.int64))], ["cell", "n"]))
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(number), pa.array(best.astype(np.int32)), cells],
                                             ["word", "n", "class", "cells"])
    return run


def _place_rare(codes: DataFrame, of_code: np.ndarray, n_words: int, both: np.ndarray, classes: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Classes of all words beyond the head: (word, n, class, cells) as a written table, the class pairs
    with these words in their classes and the number of these words per class."""
    sent = codes.sparkSession.sparkContext.broadcast(of_code)
    sides = codes.mapInArrow(_rare_contexts(sent, n_words), "word binary, sides long, n long").repartition("word")
    around = sides.groupBy("word", "sides").agg(F.sum("n").alias("n")).groupBy("word").agg(
        F.collect_list(F.struct("sides", "n")).alias("around"))     # at most the square of the classes
    rare = cut_lineage(around.mapInArrow(_placer(both, classes), "word binary, n long, class int, cells array<struct<cell:bigint,n:bigint>>"),
                       "word_classes")
    size = len(both)
    by_suffix = set(of_code[n_words:n_words + SUFFIXES].tolist())
    pairs = both.copy()
    pairs[list(by_suffix), :] = 0
    pairs[:, list(by_suffix)] = 0
    near = rare.select("class", F.explode("cells").alias("x")).groupBy("class", "x.cell").agg(F.sum("x.n").alias("n"))
    for c, cell, n in near.collect():
        other = cell % size
        if other not in by_suffix:
            pairs[(other, c) if cell < size else (c, other)] += n
    twins = codes.mapInArrow(_rare_pairs(n_words), "w1 binary, w2 binary, n long")
    for k in "12":
        twins = twins.join(rare.select(F.col("word").alias(f"w{k}"), F.col("class").alias(f"c{k}")), f"w{k}").drop(f"w{k}")
    for a, b, n in twins.groupBy("c1", "c2").agg(F.sum("n")).collect():
        pairs[a, b] += n
    number = np.zeros(size)
    for c, n in rare.groupBy("class").count().collect():
        number[c] = n
    return rare, pairs, number


def _joiner(both: np.ndarray, classes: int):
    size = len(both)

    def run(batches):
        for pdf in batches:
            around = np.zeros((len(pdf), 2 * size))
            for i, cells in enumerate(pdf["cells"]):
                for x in cells:
                    around[i, x["cell"]] += x["n"]
            yield pd.DataFrame({"word": pdf["word"], "best": best_classes(around[:, :size], around[:, size:], both, classes)})
    return run


def exchange(n: np.ndarray, movable: int, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Class of every unit: the first ``movable`` units move between ``classes`` classes while the
    class-bigram log-likelihood grows; the other units keep a class each of their own."""
    size = len(n)
    n_classes = classes + size - movable
    group = np.concatenate((np.arange(movable) % classes, classes + np.arange(size - movable)))
    n = n.astype(np.float64)
    onto = np.zeros((size, n_classes))
    onto[np.arange(size), group] = 1.0
    to = n @ onto                      # unit -> class
    of = onto.T @ n                    # class -> unit
    both = onto.T @ to                 # class -> class

    f = _xlogx
    order = np.argsort(-(n.sum(axis=0)[:movable]), kind="stable")
    out_of, into = n.sum(axis=1), n.sum(axis=0)
    for _ in range(rounds):
        moved = 0
        for w in order:
            was = group[w]
            row, col, own = to[w].copy(), of[:, w].copy(), n[w, w]
            # counts without w
            row[was] -= own
            col[was] -= own
            rest = both.copy()
            rest[was, :] -= row
            rest[:, was] -= col
            rest[was, was] -= own
            tail, head = rest.sum(axis=1), rest.sum(axis=0)
            # gain of adding w to class c: its row and column change, and the corner once
            c = np.arange(classes)
            gain = (f(rest[c] + row) - f(rest[c])).sum(axis=1) + (f(rest[:, c].T + col) - f(rest[:, c].T)).sum(axis=1)
            corner = rest[c, c]
            gain += (f(corner + row[c] + col[c] + own) - f(corner + row[c]) - f(corner + col[c]) + f(corner))
            gain -= (f(tail[c] + out_of[w]) - f(tail[c])) + (f(head[c] + into[w]) - f(head[c]))
            best = int(np.argmax(gain))
            if best != was and gain[best] > gain[was] + 1e-9:
                group[w] = best
                to[:, was] -= n[:, w]
                to[:, best] += n[:, w]
                of[was] -= n[w]
                of[best] += n[w]
                both = rest
                both[best, :] += row
                both[:, best] += col
                both[best, best] += own
                moved += 1
        if not moved:
            break
    return group


def _scorer(model):  # noqa: ANN001
    def run(batches):
        m = model.value
        rank = _ranks(m)
        end = len(rank) + SUFFIXES
        group, trans, denom = m["group"], m["transition"], m["denominator"]
        counts = m["counts"]
        logc = np.append(np.log10(counts + 1.0), 0.0)         # last: words beyond the head, added later
        for b in batches:
            texts = utf8(b.column(2))
            n_tok, score, base_sum, known, tails, around, defaults = [], [], [], [], [], [], []
            for t in texts:
                words = t.lower().split()
                r = _codes_of(words, rank)
                c = group[np.concatenate(([end], r, [end]))]
                r = np.where(r < len(rank), r, -1)
                far = np.flatnonzero(r < 0)
                more = Counter(words[i] for i in far.tolist())
                place = {w: i for i, w in enumerate(more)}
                default = np.zeros(len(more), dtype=np.int32)
                x = c.astype(np.int32)                        # a class, or -1 - number of the word beyond the head
                x[far + 1] = [-1 - place[words[i]] for i in far.tolist()]
                default[-1 - x[far + 1]] = c[far + 1]
                open_ = (x[:-1] < 0) | (x[1:] < 0)
                a, z = c[:-1][~open_], c[1:]
                s = float(trans[a, z[~open_]].sum() - denom[z[x[1:] >= 0]].sum())
                own = float(logc[r].sum())
                n_tok.append(len(words) + 1)
                score.append(s + own + m["end"])
                base_sum.append(own + m["end"])
                known.append(int((r >= 0).sum()) + int(m["texts"] > 0))
                tails.append(list(more.items()))
                around.append(x[np.append(open_, False) | np.append(False, open_)].tobytes())
                defaults.append(default.tobytes())
            tail = pa.array([[{"w": w, "n": n} for w, n in x] for x in tails],
                            pa.list_(pa.struct([("w", pa.binary()), ("n", pa.int64())])))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n_tok, pa.int64()), pa.array(score, pa.float64()),
                 pa.array(base_sum, pa.float64()), pa.array(known, pa.int64()), tail,
                 pa.array(around, pa.binary()), pa.array(defaults, pa.binary())],
                ["doc_id", "held_out", "n_tokens", "score", "base_sum", "known", "tail", "around", "defaults"])
    return run


def _finish(model):  # noqa: ANN001
    """Scores with the class pairs that hold words beyond the head: found classes, or those by suffix."""
    def run(batches):
        trans, denom = model.value["transition"], model.value["denominator"]
        for b in batches:
            at = b.column("found").offsets.to_numpy()
            flat = b.column("found").values
            which, cls = flat.field("i").to_numpy(zero_copy_only=False), flat.field("c").to_numpy(zero_copy_only=False)
            s = b.column("score").to_numpy().copy()
            for i, (around, defaults) in enumerate(zip(b.column("around"), b.column("defaults"))):
                x = np.frombuffer(around.as_buffer(), dtype=np.int32)
                if x.size:
                    group = np.frombuffer(defaults.as_buffer(), dtype=np.int32).copy()
                    group[which[at[i]:at[i + 1]]] = cls[at[i]:at[i + 1]]
                    c = np.where(x < 0, group[np.where(x < 0, -1 - x, 0)], x)
                    open_ = (x[:-1] < 0) | (x[1:] < 0)           # the other pairs are counted, or were no neighbours
                    s[i] += trans[c[:-1], c[1:]][open_].sum() - denom[c[x < 0]].sum()
            names = [f.name for f in b.schema if f.name not in ("found", "around", "defaults", "score")]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in names), pa.array(s)], [*names, "score"])
    return run


def train(texts: DataFrame, *, text_col: str = "text", head: int | None = None, units: int = UNITS,
          classes: int = CLASSES, grow: bool = True, sent: int = HEAD) -> tuple[DataFrame, dict]:
    """(counts and classes of the words beyond the head, model). Null texts count as empty ones. All words get a
    learned class; the ``sent`` most frequent ones are broadcast. ``head`` gives learned classes to that many words
    only, the others have one by suffix; ``grow=False`` gives them to units only."""
    spark = texts.sparkSession
    every, head = head is None, sent if head is None else head
    bound_batches(spark)
    src = texts.select(F.col(text_col).alias("text"))
    counts = cut_lineage(src.mapInArrow(_counter, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")),
                         "word_counts")
    n_texts = (counts.where(F.col("word").isNull()).agg(F.sum("n")).first()[0]) or 0
    counts = counts.where(F.col("word").isNotNull())
    tokens, distinct = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    # the least count of the head: how many words have each count, most frequent first
    least, room = 1, head
    for n, how_many in ((r[0], r[1]) for r in counts.groupBy("n").count().orderBy(F.desc("n")).limit(head).collect()):
        room -= how_many
        if room < 0:
            least = n + 1
            break
    top = sorted(((-r["n"], r["word"]) for r in counts.where(F.col("n") >= least).collect()))
    words = [bytes(w) for _, w in top]
    number = np.array([-n for n, _ in top], dtype=np.float64)
    n_units = min(units, len(words))
    model = {"id": uuid.uuid4().hex, "words": words, "units": n_units,
             "counts": number, "texts": n_texts, "least": least,
             "N": int((tokens or 0) + n_texts), "V": int(distinct + (n_texts > 0))}
    codes = cut_lineage(src.mapInArrow(_encode(spark.sparkContext.broadcast(model)), "codes binary, rare array<binary>"), "word_codes")
    rest = len(words) - n_units
    suffix = np.array([suffix_class(w) for w in words[n_units:]], dtype=np.int64)
    # kinds of codes: every unit by itself, other words by suffix, the end
    kind = np.concatenate((np.arange(n_units), n_units + suffix, n_units + np.arange(SUFFIXES + 1)))
    n = _pair_counts(codes, kind)
    group = exchange(n, n_units, min(classes, max(1, n_units))) if n_units else np.arange(len(n))
    made = int(group[:n_units].max()) + 1 if n_units else 0
    # the other head words: from the suffix classes to the class they raise the likelihood in most
    of_code = np.concatenate((group[:n_units], np.full(rest, -1), group[n_units:]))
    while grow and made and (of_code < 0).any():
        size = int(of_code.max()) + 1
        own = np.append(np.arange(len(n))[:n_units], np.arange(n_units + SUFFIXES, len(n)))
        both = np.zeros((size, size))                              # pairs of units and ends only
        np.add.at(both, (group[own][:, None], group[own][None, :]), n[np.ix_(own, own)])
        around = codes.select("codes").mapInArrow(_contexts(spark.sparkContext.broadcast(of_code)), "word long, cell long, n long")
        cells = around.groupBy("word", "cell").agg(F.sum("n").alias("n")).groupBy("word").agg(
            F.collect_list(F.struct("cell", "n")).alias("cells"))   # at most twice the classes
        best = cells.mapInPandas(_joiner(both, made), "word long, best long").toArrow()
        if not best.num_rows:
            break
        of_code[best.column("word").to_numpy()] = best.column("best").to_numpy()
    alone = np.flatnonzero(of_code[n_units:len(words)] < 0)         # not grown
    of_code[n_units + alone] = group[n_units + suffix[alone]]
    k = int(of_code.max()) + 1
    trans = np.zeros((k, k))
    got = _pair_counts(codes, of_code)
    trans[:len(got), :len(got)] = got
    # distinct words per class, and the words beyond the head with theirs
    kinds = np.zeros(k)
    np.add.at(kinds, of_code[:len(words)], 1)
    if every and grow and made and distinct > len(words):
        counts, trans, more = _place_rare(codes, of_code, len(words), trans, made)
        kinds += more
    else:
        for x, v in _suffix_sizes(counts, model).items():
            kinds[of_code[len(words) + x]] += v
        counts = counts.where(F.col("n") < least).withColumn("class", F.lit(None).cast("int"))
    kinds[of_code[-1]] += 1
    in_class = trans.sum(axis=0)
    model |= {"group": of_code, "transition": np.log10((trans + 1.0) / (trans.sum(axis=1, keepdims=True) + k)),
              "denominator": np.log10(in_class + kinds + 1.0), "end": math.log10(n_texts + 1.0)}
    return counts, model


def _pair_counts(codes: DataFrame, kind: np.ndarray) -> np.ndarray:
    """Neighbouring pairs of kinds over all texts (a dense matrix of kinds, whatever the corpus)."""
    size = int(kind.max()) + 1
    sent = codes.sparkSession.sparkContext.broadcast(kind)
    n = np.zeros(size * size)
    for r in codes.select("codes").mapInArrow(_bigrams(sent), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        n[r["cell"]] = r["n"]
    return n.reshape(size, size)


def _suffix_sizes(counts: DataFrame, model: dict) -> dict[int, int]:
    """Distinct training words per suffix class, without those of the head."""
    two = F.expr("substring(word, greatest(length(word) - 1, 1), 2)")
    every = counts.groupBy((F.crc32(two) % SUFFIXES).cast("int").alias("s")).count().collect()
    out = {r[0]: r[1] for r in every}
    for w in model["words"]:
        out[suffix_class(w)] -= 1
    return out


def score(docs: DataFrame, counts: DataFrame, model: dict, held_out, *, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) per row.

    ``base_score``: add-one unigram log10 probability; ``score``: log10 probability under the class
    model; ``perplexity``: 10 ** (-score / n_tokens). Words are runs of bytes other than ASCII
    white space, A-Z lower-cased; each text ends in one end token. Null and empty texts consist of
    the end token. Without training texts every token is unknown. Repeated rows and null ids are
    scored like any other; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    local = src.mapInArrow(_scorer(sent), "doc_id long, held_out boolean, n_tokens long, score double, base_sum double, "
                                          "known long, tail array<struct<w:binary,n:bigint>>, around binary, defaults binary")
    local = cut_lineage(local.withColumn("rid", F.monotonically_increasing_id()), "local_scores")
    rare = counts.select(F.col("word").alias("w"), F.col("n").alias("c"), "class")
    found = F.collect_list(F.when(F.col("class").isNotNull(), F.struct("i", F.col("class").alias("c"))))
    tail = (local.select("rid", F.posexplode("tail").alias("i", "t")).select("rid", "i", F.col("t.w").alias("w"), F.col("t.n").alias("k"))
                 .join(rare, "w").groupBy("rid").agg(
                     F.sum(F.col("k") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("k").alias("more_known"), found.alias("found")))
    out = local.drop("tail").join(tail, "rid", "left").drop("rid").withColumn("found", F.coalesce("found", F.array().cast("array<struct<i:int,c:int>>")))
    left = [f"{f.name} {f.dataType.simpleString()}" for f in out.schema if f.name not in ("found", "around", "defaults", "score")]
    out = out.mapInArrow(_finish(sent), ", ".join([*left, "score double"]))
    more = F.coalesce("more", F.lit(0.0))
    total = F.col("score") + more
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model["N"]).cast("long").alias("train_tokens"),
        (F.col("base_sum") + more - F.col("n_tokens") * math.log10(model["N"] + model["V"] + 1.0)).alias("base_score"),
        total.alias("score"), F.pow(F.lit(10.0), -total / F.col("n_tokens")).alias("perplexity"))
