"""Operator 11: fill-in-middle transformation with a learned rank index over unit boundaries.

A text of n units has n + 1 boundaries; boundary r lies at some byte offset. The offsets of all
boundaries are fitted by a piecewise linear function of the rank: a segment grows as long as one
line passes within ``ERROR`` bytes of every offset it covers. The index keeps the segments and, one
byte a boundary, what the line misses (offset minus prediction). A cut at rank r is predicted by
its segment and corrected by its stored residual, so it is exact at any length, and no table of
offsets is kept. Texts are read in windows of ``WINDOW`` bytes, with which segments end, too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, bound_batches, utf8

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
ERROR = 120                  # bytes a line may miss a boundary by; a residual fits one byte
WINDOW = 1 << 20
_FIRST = 64                  # boundaries a new segment is tried on first; doubled while it fits
_ONE = 1 << 20               # slopes are whole multiples of 1 / _ONE bytes a unit
_CONTINUES = np.arange(256) & 0xC0 == 0x80


def boundaries(text: bytes, unit: str = "char", window: int = WINDOW):
    """Byte offsets of the starts of all units, in order, in arrays of bounded size, and at last the
    text's length. ``char``: code points; ``word``: runs of bytes other than ASCII white space, each
    with the white space behind it (what precedes the first word belongs to it); ``line``: up to and
    with each line feed. The first boundary is 0; an empty text has no unit and one boundary."""
    before = None            # the byte before the window: what it says about a unit's start
    held = np.zeros(0, dtype=np.int64)
    started = False
    for lo in range(0, len(text), window):
        b = np.frombuffer(text, dtype=np.uint8, count=min(window, len(text) - lo), offset=lo)
        if unit == "char":
            starts = ~_CONTINUES[b]
        elif unit == "word":
            space = SPACES[b]
            starts = ~space & np.concatenate(([before is None or SPACES[before]], space[:-1]))
        elif unit == "line":
            starts = np.concatenate(([before is None or before == 10], b[:-1] == 10))
        else:
            raise ValueError(f"unknown unit {unit!r}")
        at = np.flatnonzero(starts).astype(np.int64) + lo
        if len(at) and not started:
            at[0], started = 0, True
        before = int(b[-1])
        if len(at):
            if len(held):
                yield held
            held = at
    if len(text) and not started:
        held = np.zeros(1, dtype=np.int64)
    yield np.append(held, len(text))


class RankIndex:
    """rank -> byte offset of a text's boundary: segments (first rank, offset there, slope) and
    one residual per boundary."""

    def __init__(self, text: bytes, unit: str = "char", error: int = ERROR, window: int = WINDOW):
        rank, base, slope, left = [], [], [], []
        done = 0
        for part in boundaries(text, unit, window):
            n = 0
            while n < len(part):
                m, k = _longest(part[n:], error)
                run = part[n:n + m]
                rank.append(done + n)
                base.append(int(run[0]))
                slope.append(k)
                left.append((run - run[0] - (np.arange(m, dtype=np.int64) * k) // _ONE).astype(np.int8))
                n += m
            done += n
        self.n = done - 1
        self.rank, self.base = np.array(rank, np.int64), np.array(base, np.int64)
        self.slope, self.left = np.array(slope, np.int64), np.concatenate(left)

    def predict(self, r: int) -> int:
        s = int(np.searchsorted(self.rank, r, side="right")) - 1
        return int(self.base[s] + ((r - self.rank[s]) * self.slope[s]) // _ONE)

    def offset(self, r: int) -> int:
        """Exact byte offset of boundary ``r``."""
        return self.predict(r) + int(self.left[r])


def _longest(at: np.ndarray, error: int) -> tuple[int, int]:
    """How many of the offsets one line from the first passes within ``error`` of, and its slope.

    The slopes that serve the first i offsets form an interval that only shrinks; it is cut down
    over a stretch that doubles in length until it is empty or the offsets end."""
    size = _FIRST
    while True:
        rise = at[1:size] - at[0]
        if not len(rise):
            return 1, 0
        run = np.arange(1, len(rise) + 1, dtype=np.int64)
        low = np.maximum.accumulate(-((error - rise) * _ONE // run))
        high = np.minimum.accumulate((rise + error) * _ONE // run)
        ends = np.flatnonzero(low > high)
        m = int(ends[0]) if len(ends) else len(rise)
        if m == len(rise) and size < len(at):
            size *= 4
            continue
        return m + 1, int(low[m - 1] + high[m - 1]) // 2 if m else 0


def _transformer(unit: str, plain_from: int, spm_below: int):
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def one(text: bytes, h):  # noqa: ANN001
        index = RankIndex(text, unit)
        n = index.n
        if not n or p in text or s in text or m in text or h[2] % 100 >= plain_from:
            return n, "plain", None, None, text
        lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        a, e = index.offset(lo), index.offset(hi)
        parts = text[:a], text[a:e], text[e:]
        size = [len(x) if x.isascii() else int(np.count_nonzero(~_CONTINUES[np.frombuffer(x, np.uint8)])) for x in parts[:2]]
        if h[3] % 100 < spm_below:
            return n, "spm", *size, b"".join((s, parts[2], p, parts[0], m, parts[1]))
        return n, "psm", *size, b"".join((p, parts[0], s, parts[2], m, parts[1]))

    def run(batches):
        for b in batches:
            hashes = b.column(2).to_pylist()
            for i, text in enumerate(utf8(b.column(1))):
                n, form, pre, mid, out = one(text, hashes[i])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, 1), pa.array([n], pa.int64()), pa.array([form]), pa.array([pre], pa.int64()),
                     pa.array([mid], pa.int64()), pa.array([out], pa.binary()).cast(pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    def packed(batches):
        """Rows in batches again, of a bounded size in bytes."""
        held, size = [], 0
        for b in run(batches):
            held.append(b)
            size += b.nbytes
            if size > WINDOW or len(held) >= 512:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    return packed


def draws(id_col: str, seed: int = 1) -> F.Column:
    """Four 32-bit draws per id: the first four groups of eight hex digits of the sha256 of
    ``seed:id`` (null id: nothing behind the colon)."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit: str = "char", seed: int = 1,
                   plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), one row per row of ``docs``.

    A text is cut at two drawn unit boundaries into prefix, middle and suffix and written as
    ``<P>prefix<S>suffix<M>middle`` (psm) or ``<S>suffix<P>prefix<M>middle`` (spm); texts that are
    empty, hold a marker or draw at least ``plain_from`` of 100 stay as they are (plain, lengths
    null). A null text is an empty one. Draws depend on id and ``seed`` alone: rows that repeat
    an id draw alike. ``prefix_chars`` and ``middle_chars`` count code points whatever the unit.
    Other columns are left out, whatever their names; an empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                      draws(id_col, seed).alias("h"))
    return src.mapInArrow(_transformer(unit, plain_from, spm_below),
                          "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str = "output", form: str = "form") -> F.Column:
    """The text an output was made from. A text that is not plain holds no marker and no marker can
    arise across a seam, so each marker occurs once, where it was put."""
    part = F.split(F.col(output), "<[PSM]>", -1)
    return F.when(F.col(form) == "psm", F.concat(part[1], part[3], part[2])).when(
        F.col(form) == "spm", F.concat(part[2], part[3], part[1])).otherwise(F.col(output))
