"""Operator 1: substring dedup by hashing normalised units.

A text is cut at its line ends; a line is cut further behind sentence ends once a unit holds
``min_words`` words, so a passage that stands inside longer lines still yields the same units
in every document. With ``every_line`` a whole line is a unit however short it is, and a unit
inside a line may also hold ``MIN_CHARS`` characters, as scripts without spaces do. Units are lower-cased (A-Z) with white space collapsed and digested to 128
bits. Of all occurrences of a digest anywhere in the table the earliest by (document id, text
hash, offset) stays and every other one is removed; the original character offsets of what was
removed are returned with the text that is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import bound_batches, chunks, mix, powers, utf8, words_of

MIN_WORDS = 5
MIN_CHARS = 25         # of a unit inside a line, instead of the words
_STOP = np.isin(np.arange(256), [ord(c) for c in ".!?"])


def units_of(texts: list[bytes], min_words: int = MIN_WORDS, every_line: bool = False):
    """Units of all texts that are whole lines or long enough (see above), as arrays: text number, start
    and end (characters), two 64-bit halves of the digest. A unit reaches to the next one's
    first word; the first of a text begins with it and the last ends with it."""
    word, doc, first, starts, ends, at = words_of([t.lower() for t in texts])
    n = len(word)
    if not n:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    b = np.frombuffer(b" ".join(texts), dtype=np.uint8)
    lines = np.concatenate(([0], np.cumsum(b == 10)))
    nxt = np.concatenate((starts[1:], [len(b)]))
    last = np.zeros(n, dtype=bool)
    last[first[1:][np.diff(first) > 0] - 1] = True
    hard = last | (lines[nxt] > lines[ends])              # a line or the text ends here
    close = np.flatnonzero(hard | _STOP[b[ends - 1]])
    chars = np.concatenate(([0], np.cumsum((b & 0xC0) != 0x80)))   # characters before each byte
    from_char = chars[starts]
    lo, hi, at_word, line_starts = [], [], 0, True
    for e, h, c in zip((close + 1).tolist(), hard[close].tolist(), chars[ends[close]].tolist()):
        enough = e - at_word >= min_words or (every_line and c - from_char[at_word] >= MIN_CHARS)
        if h or enough:
            if enough or (every_line and line_starts):
                lo.append(at_word)
                hi.append(e)
            at_word, line_starts = e, h
    lo, hi = np.array(lo, dtype=np.int64), np.array(hi, dtype=np.int64)
    halves = []
    for k in range(2):
        p, q = powers(n + 1, k + 1)
        acc = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(mix(word + np.uint64(k)) * p[:n], out=acc[1:])
        halves.append(mix((acc[hi] - acc[lo]) * q[lo] + (hi - lo).astype(np.uint64)))
    d = doc[lo]
    begin = np.where(lo == first[d], at[d], starts[lo])
    stop = np.where(hi == first[d + 1], at[d + 1] - 1, starts[np.minimum(hi, n - 1)])
    return d, chars[begin] - chars[at[d]], chars[stop] - chars[at[d]], halves[0], halves[1]


def _digests(min_words: int, every_line: bool):
    def run(batches):
        for b in batches:
            texts = utf8(b.column(2))
            for lo, hi in chunks(map(len, texts)):
                d, start, end, x, y = units_of(texts[lo:hi], min_words, every_line)
                row = pa.array(d + lo)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(row), b.column(1).take(row), pa.array(start), pa.array(end),
                     pa.array(x.view(np.int64)), pa.array(y.view(np.int64))],
                    ["doc_id", "text_hash", "start", "end", "d1", "d2"])
    return run


def duplicate_units(docs: DataFrame, *, min_words: int = MIN_WORDS, every_line: bool = False,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, start, end, first_doc, first_start): every unit occurrence that an
    earlier one precedes. Rows equal in id and text count as one document; a null id ranks last."""
    bound_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                      F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    units = cut_lineage(src.mapInArrow(
        _digests(min_words, every_line), "doc_id long, text_hash long, start long, end long, d1 long, d2 long"), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "start")
    # repeats only: a count and a minimum per digest, combined on the map side, so the commonest
    # line is one row per task; written, so that both sides of the join back are shuffled anew
    # and AQE can split the commonest line's occurrences
    first = cut_lineage(units.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("first"))
                  .where(F.col("n") > 1).select("d1", "d2", "first"), "repeated_units")
    return (units.join(first, ["d1", "d2"]).where(rank != F.col("first"))
                 .select("doc_id", "text_hash", "start", "end", F.col("first.doc_id").alias("first_doc"),
                         F.col("first.start").alias("first_start")))


def _cut(text: str, spans) -> str:
    out, at = [], 0
    for s, e in spans:
        out.append(text[at:s])
        at = max(at, e)
    out.append(text[at:])
    return "".join(out)


def substring_dedup(docs: DataFrame, *, min_words: int = MIN_WORDS, every_line: bool = False,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated units cut out of ``text_col``, plus ``removed`` (array of struct
    start, end, first_doc, first_start: character offsets in the original text, in order).

    Every input row is returned, all columns kept. Null text stays null; an empty text stays
    empty; a text whose units all occurred before becomes empty. Rows equal in id and text are
    one document and are treated alike. A column called ``removed`` is replaced.
    """
    dup = duplicate_units(docs, min_words=min_words, every_line=every_line, id_col=id_col, text_col=text_col)
    spans = (dup.distinct().groupBy(F.col("doc_id").alias("__sd_id"), F.col("text_hash").alias("__sd_hash"))
                .agg(F.sort_array(F.collect_list(F.struct("start", "end", "first_doc", "first_start")))
                      .alias("__sd_spans")))

    @F.pandas_udf("string")
    def left(text, spans):  # noqa: ANN001
        return text.combine(spans, lambda t, s: t if t is None or s is None or not len(s)
                            else _cut(t, [(x["start"], x["end"]) for x in s]))

    d = docs.drop("removed").withColumn("__sd_hash", F.xxhash64(F.col(text_col)))
    j = d.join(spans, F.col(id_col).cast("long").eqNullSafe(F.col("__sd_id")) & (d["__sd_hash"] == spans["__sd_hash"]),
               "left").drop(spans["__sd_hash"])
    empty = F.array().cast("array<struct<start:bigint,end:bigint,first_doc:bigint,first_start:bigint>>")
    pos = F.transform("__sd_spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    text = F.when(F.col("__sd_spans").isNull(), F.col(text_col)).otherwise(left(F.col(text_col), pos))
    names = [F.col(c) if c != text_col else text.alias(c) for c in d.columns if c != "__sd_hash"]
    return j.select(*names, F.coalesce("__sd_spans", empty).alias("removed"))
