"""Operator 8: language identification by compression.

Per language a bounded raw-content zstandard dictionary is made of labelled training text; a
text takes the language whose dictionary compresses it to the fewest bytes. Long texts are
compressed in blocks, so what a text says about itself does not drown the dictionary. The
margin between the best and the second best size decides whether the answer is accepted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, worker_cache

DICT_BYTES = 256 << 10        # dictionary size per language (the bound of the fitted sample)
SAMPLE_CHARS = 1500           # of a sampled training text, if the language's texts then fill twice its dictionary
BLOCK = 8 << 10               # bytes compressed at once
LEVEL = 3
MARGIN = 0.005                # relative lead over the second language below which a text is rejected
_PLAIN = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(256))


def normal(text: str) -> bytes:
    """Lower-cased UTF-8 with ASCII non-letters as white space, runs of it collapsed."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split())


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        dict_bytes: int = DICT_BYTES, chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """{language: dictionary}. Of a text a window is taken at a place chosen by its hash: ``chars``
    long, doubled for a language whose windows do not fill twice ``dict_bytes`` until they do or
    are whole texts. At most about twice the rows that fill ``dict_bytes`` are gathered per
    language (four times their characters where windows were doubled), chosen by a hash of id and
    text over the whole table; the dictionary is cut to ``dict_bytes``. Rows with a null language or text are ignored; no rows: no languages."""
    src = docs.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(id_col, text_col).alias("h"),
                      F.col(text_col).alias("text"), F.length(text_col).alias("n")).where(
        F.col("lang").isNotNull() & (F.col("n") > 0))
    # per language: characters of all windows of each size, one aggregate over all training rows
    sizes = [chars]
    while sizes[-1] < 2 * dict_bytes:
        sizes.append(2 * sizes[-1])
    stats = {r[0]: list(r)[1:] for r in src.groupBy("lang").agg(
        *[F.sum(F.least("n", F.lit(s))) for s in sizes]).collect()}
    if not stats:
        return {}
    window, share = [], []
    for lang, total in stats.items():
        j = next((j for j, t in enumerate(total) if t >= 2 * dict_bytes), len(sizes) - 1)
        window.append((lang, sizes[j]))
        share.append((lang, min(1.0, 2.0 * dict_bytes / total[j]) if j == 0 else 1.0))

    def by_lang(pairs):  # noqa: ANN001
        return F.create_map(*[F.lit(x) for kv in pairs for x in kv])[F.col("lang")]
    u = (F.pmod("h", F.lit(1 << 30)) / float(1 << 30))
    size = by_lang(window)
    place = F.pmod(F.xxhash64("h"), F.greatest(F.col("n") - size + 1, F.lit(1))).cast("int") + 1
    rows = sorted((r["lang"], r["h"], r["text"]) for r in src.where(u < by_lang(share)).select(
        "lang", "h", F.col("text").substr(place, size).alias("text")).collect())
    out: dict[str, bytes] = {}
    for lang, _, text in rows:
        have = out.get(lang, b"")
        if len(have) < dict_bytes:
            out[lang] = have + normal(text) + b" "
    return {k: v[:dict_bytes] for k, v in out.items()}


def _compressors(dicts: dict[str, bytes], level: int):
    cache = worker_cache("zstd")
    key = (level, tuple((k, hash(v)) for k, v in sorted(dicts.items())))
    if cache.get("key") != key:
        import zstandard as zstd
        made = []
        for lang, raw in sorted(dicts.items()):
            d = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            made.append((lang, zstd.ZstdCompressor(dict_data=d, level=level, write_checksum=False,
                                                   write_content_size=False, write_dict_id=False)))
        cache.update(key=key, made=made)
    return cache["made"]


def classifier(spark: SparkSession, dicts: dict[str, bytes], *, margin: float = MARGIN,
               level: int = LEVEL, block: int = BLOCK):
    """A column function text -> struct(lang_pred, score, margin, accepted).

    A null text, a text without a letter, or an empty model gives ``und`` with score 0 and is not
    accepted. Ties go to the language first in order and have margin 0. With one language only,
    every text with a letter is accepted. Only the text is looked at.
    """
    bound_batches(spark)
    model = spark.sparkContext.broadcast(dicts)          # languages * DICT_BYTES at most

    def one(text, made):  # noqa: ANN001
        if text is None or not made or not any(map(str.isalpha, text)):
            return "und", 0.0, 0.0, False
        raw = normal(text) or b" "
        parts = [raw[i:i + block] for i in range(0, len(raw), block)]
        size = [sum(len(c.compress(p)) for p in parts) for _, c in made]
        best = min(range(len(made)), key=size.__getitem__)
        rest = min((s for i, s in enumerate(size) if i != best), default=None)
        lead = 1.0 if rest is None else (rest - size[best]) / rest
        # share of the best language in a softmax over relative excess sizes
        z = sum(math.exp((size[best] - s) / max(1.0, 0.05 * size[best])) for s in size)
        return made[best][0], 1.0 / z, lead, lead >= margin

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        made = _compressors(model.value, level)
        for texts in batches:
            yield pd.DataFrame([one(t, made) for t in texts],
                               columns=["lang_pred", "score", "margin", "accepted"])

    return F.pandas_udf(run, "lang_pred string, score double, margin double, accepted boolean").asNondeterministic()
