"""Operator 6: licence scan with a positional index of rare words, in DataFrame functions only.

Each template is indexed by its words of highest IDF, taken over all documents, with their
positions. A file looks up every indexed word it holds; every occurrence votes for the template
at the offset (file position - template position), and a template is a candidate where enough
of its indexed words agree on one offset. Its mandatory key phrases must then occur in the file. Nothing is shuffled but one count per licence word.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases and labels of the base scan
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Label, template text (public licence notices), mandatory phrases
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license",)),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    ("agpl-3.0", "gnu affero general public license version 3", ("affero general public license",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc0-1.0", "creative commons cc0 1 0 universal public domain dedication", ("cc0 1 0 universal",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)
INDEX_WORDS = 6      # indexed words per template
AGREE = 0.6          # share of a template's indexed words that must agree on an offset
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def canonical(text) -> F.Column:
    """The words of a text, lower-cased, one space around each; empty for null and wordless.

    ``lower`` also changes letters beyond ASCII; it maps none of them to a separator or to an
    ASCII letter of a phrase or template on its own, so words and matches are those of A-Z only.
    """
    one = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _BETWEEN, " "))
    return F.when(one == "", F.lit("")).otherwise(F.concat(F.lit(" "), one, F.lit(" ")))


def _words(canon) -> F.Column:
    return F.when(canon == "", F.array().cast("array<string>")).otherwise(F.split(F.trim(canon), " "))


def licence_words(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, t, _ in templates for w in t.split()})


def document_frequencies(docs: DataFrame, *, text_col: str = "text", templates=TEMPLATES) -> tuple[dict[str, int], int]:
    """In how many documents each licence word occurs, and the number of documents."""
    vocab = F.array(*[F.lit(w) for w in licence_words(templates)])
    present = F.array_intersect(_words(F.col("c")), vocab)
    counts = (docs.select(canonical(F.col(text_col)).alias("c")).select(present.alias("p"))
                  .select(F.explode(F.concat("p", F.array(F.lit("")))).alias("w")).groupBy("w").count())
    got = {r[0]: int(r[1]) for r in counts.collect()}        # one row per licence word at most
    return {w: got.get(w, 0) for w in licence_words(templates)}, got.get("", 0)


def index(df: dict[str, int], n: int, templates=TEMPLATES, words: int = INDEX_WORDS):
    """IDF per licence word; per template its rarest words with their first positions."""
    idf = {w: math.log((n + 1) / (c + 1)) + 1.0 for w, c in df.items()}
    out = []
    for label, text, must in templates:
        w = text.split()
        rare = sorted(set(w), key=lambda x: (-idf[x], x))[:words]
        out.append((label, [(x, w.index(x)) for x in sorted(rare, key=w.index)], must))
    return idf, out


def _template(label: str, ws, must, idf: dict[str, float], agree: float) -> F.Column:  # noqa: ANN001
    """struct(label, s) if the template's words agree on one offset and its phrases occur, else null."""
    def offsets(word: str, at: int) -> F.Column:
        return F.transform(F.filter("hits", lambda x: x["w"] == word), lambda x: x["i"] - at)

    lists = [offsets(w, q) for w, q in ws]
    need, total = math.ceil(agree * len(ws)), sum(idf[w] for w, _ in ws)

    def enough(d):  # noqa: ANN001
        return sum((F.array_contains(o, d).cast("int") for o in lists), F.lit(0)) >= need

    def share(d):  # noqa: ANN001
        return sum((F.when(F.array_contains(o, d), idf[w]).otherwise(0.0)
                    for o, (w, _) in zip(lists, ws)), F.lit(0.0)) / total

    # an offset on which ``need`` words agree is one of any len - need + 1 words': the rarest suffice
    rare = sorted(range(len(ws)), key=lambda j: -idf[ws[j][0]])[:len(ws) - need + 1]
    tried = F.array_distinct(F.concat(*[lists[j] for j in rare]))
    best = F.array_max(F.transform(F.filter(tried, enough), share))
    verified = F.col("hits").isNotNull()
    for m in must:
        verified = verified & F.contains(F.col("c"), F.lit(f" {m} "))
    # least() skips nulls: without an agreed offset the share must stay null
    return F.when(verified, F.struct(F.lit(label).alias("label"), F.when(best > 1.0, 1.0).otherwise(best).alias("s")))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES,
         base=BASE, agree: float = AGREE) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places) per row.

    ``places``: the starts of the base phrases as word numbers. Null, empty and wordless texts
    have no words, no labels and score 0. ``score`` is 1 with a base phrase, else the best share of
    IDF with which a template's indexed words agree. Repeated rows and null ids are scanned like
    any other; other columns are ignored; an empty table gives an empty result.
    """
    df, n = document_frequencies(docs, text_col=text_col, templates=templates)
    idf, tpl = index(df, n, templates)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), canonical(F.col(text_col)).alias("c"))
    n_words = F.when(F.col("c") == "", 0).otherwise(
        F.length("c") - F.length(F.replace(F.col("c"), F.lit(" "), F.lit(""))) - 1).cast("long")
    indexed = sorted({w for _, ws, _ in tpl for w, _ in ws})
    none = F.array().cast("array<int>")

    has_base = F.lit(False)
    for phrase, _ in base:
        has_base = has_base | F.contains(F.col("c"), F.lit(f" {phrase} "))
    # a file with a phrase or with two indexed words goes on; the others have nothing to find
    present = F.array_intersect(_words(F.col("c")), F.array(*[F.lit(w) for w in indexed]))
    src = src.select("doc_id", "c", n_words.alias("n_words"), has_base.alias("has_base"), present.alias("present"))
    go = F.col("has_base") | (F.size("present") >= 2)
    src = src.select("doc_id", "c", "n_words", "has_base",
                     F.when(go, _words(F.col("c"))).alias("w"), F.when(go, F.col("present")).alias("present"))
    hits = F.filter(F.transform("w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))),
                    lambda x: F.array_contains(F.col("present"), x["w"]))

    def places(phrase: str) -> F.Column:
        p = phrase.split()

        def here(i):  # noqa: ANN001
            ok = F.lit(True)
            for j, x in enumerate(p):
                ok = ok & (F.get(F.col("w"), i + j) == x)
            return F.coalesce(ok, F.lit(False))
        at = F.filter(F.sequence(F.lit(0), F.size("w") - 1), here)
        return F.when(F.contains(F.col("c"), F.lit(f" {phrase} ")), at).otherwise(none)

    src = src.select("doc_id", "c", "n_words", F.when(F.col("w").isNotNull(), hits).alias("hits"),
                     *[F.when(F.col("has_base"), places(p)).otherwise(none).alias(f"b{i}") for i, (p, _) in enumerate(base)])

    found = [_template(label, ws, must, idf, agree) for label, ws, must in tpl]
    got = F.filter(F.array(*found), lambda x: x.isNotNull() & x["s"].isNotNull())
    src = src.select("doc_id", "n_words", *[f"b{i}" for i in range(len(base))], got.alias("got"))
    at = F.array_sort(F.concat(*[F.col(f"b{i}") for i in range(len(base))]))
    base_labels = F.array_compact(F.array(*[F.when(F.size(f"b{i}") > 0, F.lit(lab)) for i, (_, lab) in enumerate(base)]))
    out = src.select("doc_id", "n_words", at.alias("at"), base_labels.alias("bl"), "got")
    own = F.transform("got", lambda x: x["label"])
    return out.select(
        "doc_id", "n_words", F.size("at").cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"), F.array_max("at").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("bl")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("bl", own))), ",").alias("labels"),
        F.when(F.size("bl") > 0, 1.0).otherwise(
            F.coalesce(F.array_max(F.transform("got", lambda x: x["s"])), F.lit(0.0))).alias("score"),
        F.col("at").alias("places"))
