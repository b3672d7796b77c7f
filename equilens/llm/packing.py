"""Operator 5: packing token sequences shortest-pack-first over the length histogram.

Every document is tokenised once, in its task, and cut into whole sequences of ``size`` tokens
and one remainder, so a piece's tokens do not depend on the packing. Only the histogram of
piece lengths (at most ``size`` rows) reaches the driver: lengths are placed from the longest
to the shortest into the shortest pack that still has room (the most free space), and whole
counts of identical packs are updated at once. The resulting patterns are joined back to the
pieces by their rank among the pieces of equal length; ranks are counted per hash slot and
offset, so a length that many pieces share is spread over tasks.

Tokens of a text are the tokens of its stretches: a single space between two characters that
are not white space always starts a new pre-token, so stretches are looked up, vectorised, by
their 64-bit hash in a per-worker cache, bounded in stretches and in ids; only unseen ones go
through the tokenizer.
"""

from __future__ import annotations

import math
import os
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import bound_batches, chunks, span_hashes, utf8, worker_cache

SIZE = 1024
END_ID = 0
CACHE_BITS = 21               # slots of a worker's cache of stretches; it starts anew when half full
CACHE_IDS = 5 << 20           # ids of a worker's cache; it starts anew when they are full
TEXT_BYTES = 1 << 18          # text cut into tokens at once (or one document)
SLOT_ROWS = 1_000             # aimed pieces per rank slot
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
# lead and second bytes of the white space characters beyond ASCII
_LEAD = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
_SECOND = np.isin(np.arange(256), [0x80, 0x81, 0x85, 0x9A, 0xA0])


def tokenizer(path: str):
    """The tokenizer of a file, loaded once per worker, as it is: strings of its special tokens give these."""
    cache = worker_cache("tokenizers")
    if path not in cache:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        cache[path] = Tokenizer.from_file(path)
    return cache[path]


class Stretches:
    """Open-addressing table: hash of a stretch -> its ids, all operations over arrays."""

    def __init__(self, path: str, bits: int = CACHE_BITS, most_ids: int = CACHE_IDS):
        self.path, self.least, self.most_ids, self.bits = path, bits, most_ids, 0
        vocab = tokenizer(path).get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.spaced[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True
        self.ids = np.zeros(0, dtype=np.min_scalar_type(max(vocab.values())))
        self.clear()

    def clear(self, n: int = 0, n_ids: int = 0) -> None:
        """Starts anew in the same arrays; only for ``n`` stretches or ``n_ids`` ids that pass the bounds
        (of one long text) larger ones are made, until the next time."""
        bits = max(self.least, (2 * n - 1).bit_length())
        if bits != self.bits:
            self.bits = bits
            self.keys = self.entry = self.start = None        # the old ones go before the new ones come
            self.keys = np.zeros(1 << bits, dtype=np.uint64)
            self.entry = np.zeros(1 << bits, dtype=np.int32)
            self.start = np.zeros((1 << (bits - 1)) + 1, dtype=np.uint32)
        else:
            self.keys.fill(0)
        if len(self.ids) != max(self.most_ids, n_ids):
            self.ids = np.zeros(max(self.most_ids, n_ids), dtype=self.ids.dtype)
        self.n = self.used = 0

    def fits(self, ids: list[np.ndarray]) -> bool:
        """Whether further stretches with these ids leave the table half empty."""
        return self.n + len(ids) <= 1 << (self.bits - 1) and self.used + sum(map(len, ids)) <= len(self.ids)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entry number of each hash, or -1."""
        out = np.full(len(h), -1, dtype=np.int64)
        todo = np.arange(len(h))
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(todo):
            k = self.keys[at]
            hit = k == h[todo]
            out[todo[hit]] = self.entry[at[hit]]
            on = ~hit & (k != 0)
            todo, at = todo[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, h: np.ndarray, ids: list[np.ndarray]) -> None:
        """New, distinct hashes and the ids of their stretches, which fit."""
        lens = np.array([len(x) for x in ids], dtype=np.int64)
        total = int(lens.sum())
        self.ids[self.used:self.used + total] = np.concatenate(ids) if ids else 0
        self.start[self.n + 1:self.n + len(h) + 1] = self.used + np.cumsum(lens)
        number = np.arange(self.n, self.n + len(h))
        self.n += len(h)
        self.used += total
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(h):
            free = self.keys[at] == 0
            self.keys[at[free]] = h[free]
            mine = free & (self.keys[at] == h)
            self.entry[at[mine]] = number[mine]
            h, number, at = h[~mine], number[~mine], (at[~mine] + 1) & ((1 << self.bits) - 1)

    def encode(self, found: list[bytes]) -> list[np.ndarray]:
        """Ids of stretches: those with just a leading space are encoded side by side in one
        text, since only their first token begins with that space."""
        tok = tokenizer(self.path)
        out: list = [None] * len(found)
        plain = [i for i, x in enumerate(found) if x[0] == 32 and x.count(b" ") == 1 and not _BLANK[x[-1]]]
        for lo in range(0, len(plain), 1024):
            part = plain[lo:lo + 1024]
            text = b"".join([found[i] for i in part]).decode("utf-8", "replace")
            ids = np.array(tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
            at = np.flatnonzero(self.spaced[ids])
            if len(at) == len(part) and (not len(at) or at[0] == 0):
                for i, x in zip(part, np.split(ids, at[1:])):
                    out[i] = x
        rest = [i for i, x in enumerate(out) if x is None]
        for lo in range(0, len(rest), 1024):
            part = rest[lo:lo + 1024]
            for i, e in zip(part, tok.encode_batch_fast([found[i].decode("utf-8", "replace") for i in part],
                                                        add_special_tokens=False)):
                out[i] = np.array(e.ids, dtype=np.uint32)
        return out


def token_ids(texts: list[bytes], path: str) -> list[np.ndarray]:
    """Token ids of each UTF-8 text, as the tokenizer gives them for the whole text."""
    cache = worker_cache("stretches")
    if path not in cache:
        cache[path] = Stretches(path)
    table: Stretches = cache[path]
    joined = b"\n".join(texts)
    if not joined:
        return [np.zeros(0, np.uint32) for _ in texts]
    b = np.frombuffer(joined, dtype=np.uint8)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    first = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    blank = _BLANK[b]
    pad = np.zeros(2, dtype=bool)
    # b[i:i+2] or b[i-2:i] (two bytes before a third) may be a longer white space character
    wide = np.concatenate((_LEAD[b[:-1]] & _SECOND[b[1:]], pad[:1])) if len(b) > 1 else pad[:1]
    before = np.concatenate(([True], blank[:-1]))
    after = np.concatenate((blank[1:], [True]))
    near = (np.concatenate((wide[1:], pad[:1])) | np.concatenate((pad, wide[:-2]))[: len(b)]
            | np.concatenate((pad, pad[:1], wide[:-3]))[: len(b)])
    cut = (b == 32) & ~before & ~after & ~near
    cut[first[size > 0]] = True
    starts = np.flatnonzero(cut)
    doc = np.searchsorted(first, starts, side="right") - 1
    ends = np.minimum(np.concatenate((starts[1:], [len(b)])), first[doc] + size[doc])
    h = span_hashes(b, starts, ends) | np.uint64(1)
    entry = table.find(h)
    new, at = np.unique(h[entry < 0], return_index=True)
    if len(new):
        at = np.flatnonzero(entry < 0)[at]
        encode = lambda at: table.encode([joined[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())])
        ids = encode(at)
        if not table.fits(ids):
            new, at = np.unique(h, return_index=True)
            ids = encode(at)
            table.clear(len(new), sum(map(len, ids)))
        table.add(new, ids)
        entry = table.find(h)
    begin = table.start[entry].astype(np.int64)
    lens = table.start[entry + 1] - begin
    upto = np.concatenate(([0], np.cumsum(lens)))
    ids = table.ids[np.repeat(begin - upto[:-1], lens) + np.arange(upto[-1])].astype(np.uint32)
    of = upto[np.searchsorted(doc, np.arange(len(texts) + 1))]
    return [ids[of[i]:of[i + 1]] for i in range(len(texts))]


def _cutter(path: str, size: int, with_ids: bool):
    end = np.array([END_ID], dtype="<u4")

    def run(batches):
        for b in batches:
            ids_col, texts = b.column(0).to_pylist(), utf8(b.column(1))
            for lo, hi in chunks(map(len, texts), TEXT_BYTES):
                rows: list[tuple] = []
                for doc, t in zip(ids_col[lo:hi], token_ids(texts[lo:hi], path)):
                    t = np.concatenate((t, end)).astype("<u4").tobytes()
                    for s in range(0, len(t), 4 * size):
                        x = t[s:s + 4 * size]
                        rows.append((doc, s // 4, len(x) // 4, zlib.crc32(x), len(t) // 4,
                                     x if with_ids else None))
                kinds = (pa.int64(),) * 5 + (pa.binary(),)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])
    return run


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """[(count, lengths)]: how often each pack is made. Every counted length is placed once."""
    room: dict[int, list[list]] = defaultdict(list)       # free space -> [count, lengths]
    for length in sorted(histogram, reverse=True):
        todo = histogram[length]
        while todo:
            free = max((f for f, packs in room.items() if packs and f >= length), default=None)
            if free is None:
                # as many copies in a pack as fit would hide shorter partners: open one each
                room[size - length].append([todo, (length,)])
                break
            pack = room[free].pop()
            take = min(todo, pack[0])
            if pack[0] > take:
                room[free].append([pack[0] - take, pack[1]])
            room[free - length].append([take, (*pack[1], length)])
            todo -= take
    made: dict[tuple[int, ...], int] = defaultdict(int)
    for packs in room.values():
        for count, lengths in packs:
            made[lengths] += count
    return sorted(((c, p) for p, c in made.items()), key=lambda x: (-len(x[1]), x[1]))


def _slots(patterns: list[tuple[int, tuple[int, ...]]]):
    """Per length, arrays (first rank, sequence of it, copies per sequence, offset of a copy 0, length)."""
    at: dict[int, int] = defaultdict(int)
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    base = 0
    for count, lengths in patterns:
        offset = 0
        for length in dict.fromkeys(lengths):
            m = lengths.count(length)
            rows[length].append((at[length], base, m, offset))
            at[length] += count * m
            offset += m * length
        base += count
    return {k: np.array(v, dtype=np.int64) for k, v in rows.items()}


def _placer(slots: dict[int, np.ndarray]):
    def run(batches):
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("rank").to_numpy()
            seq = np.zeros(len(length), dtype=np.int64)
            off = np.zeros(len(length), dtype=np.int64)
            for v in np.unique(length):
                at = np.flatnonzero(length == v)
                t = slots[int(v)]
                i = np.searchsorted(t[:, 0], rank[at], side="right") - 1
                first, base, copies, offset = t[i].T
                k = rank[at] - first
                seq[at] = base + k // copies
                off[at] = offset + (k % copies) * v
            keep = [c for c in b.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in keep], pa.array(seq), pa.array(off)],
                [*keep, "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, tokenizer_path: str, *, size: int = SIZE, id_col: str = "doc_id",
         text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset
    (and ``ids``, the piece's tokens, if ``with_ids``).

    A document's tokens are the tokenizer's plus a closing id 0; null text counts as empty and is
    one piece of that id. Pieces of a sequence fill it from offset 0 without gaps; sequences hold
    at most ``size`` tokens. Repeated rows and null ids are packed like any other row. Other
    columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
    pieces = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _cutter(tokenizer_path, size, with_ids), schema)
    pieces = cut_lineage(pieces if with_ids else pieces.drop("ids"), "pieces")
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}   # <= size rows
    slots = _slots(shortest_pack_first(histogram, size))

    n_slots = max(1, math.ceil(max(histogram.values(), default=1) / SLOT_ROWS))
    slot = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(n_slots))
    pieces = pieces.withColumn("slot", slot)
    sizes = pieces.groupBy("length", "slot").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("slot").rowsBetween(
        Window.unboundedPreceding, -1))
    sizes = sizes.select("length", "slot", F.coalesce(before, F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "slot").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = (pieces.withColumn("own", F.row_number().over(own)).join(sizes, ["length", "slot"])
                    .withColumn("rank", F.col("own") - 1 + F.col("before")).drop("own", "before", "slot"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
    out = ", ".join(f"{c} {'binary' if c == 'ids' else 'long'}" for c in names)
    return ranked.select(*names, "rank").mapInArrow(_placer(slots), f"{out}, sequence_id long, offset long")
