"""Stages of the corpus pipeline, and repeated shingles, letters and special tokens."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from equilens.llm import decontaminate, language, near_dup, packing
from equilens.llm.queries import tokenizer_path
from llm_fixtures import EDGE, SF, make

A, B = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
ITEM = " ".join(f"term{i}" for i in range(40))


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


@pytest.fixture
def bench_dir(spark, tmp_path):
    make(spark, [(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_near_dup_stage_loses_no_text(spark):
    got = pairs(cp.near_dup_stage(spark, make(spark, [(1, A), (5, A), (5, B), (7, B)]), ""))
    assert got == [(1, A), (7, B)]
    got = pairs(cp.near_dup_stage(spark, make(spark, [(5, A), (5, B), (5, B), (None, B), (None, A), (None, None)]), ""))
    assert sorted(t for _, t in got if t) == [A, B] and (None, None) in got
    near = A.replace("a29", "zz")
    got = pairs(cp.near_dup_stage(spark, make(spark, [(9, A), (3, near), (4, B), (None, "")]).withColumn("__key", F.lit(0)), ""))
    assert got == sorted([(3, near), (4, B), (None, "")], key=repr)
    assert pairs(cp.near_dup_stage(spark, make(spark, []), "")) == []


def test_every_removed_text_has_a_near_copy_that_stays(spark, docs, texts):
    got = pairs(cp.near_dup_stage(spark, docs, SF))
    grams = lambda t: (lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or {tuple(w)} if w else set())((t or "").lower().split())
    kept = {i for i, _ in got}
    judged = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs, k=5, num=80).collect()}
    assert kept == {i for i, c in judged.items() if i == c}
    sets = {i: grams(t) for i, t in texts.items()}
    for i in set(texts) - kept:
        mates = [j for j, c in judged.items() if c == judged[i] and j != i]
        assert judged[i] in kept and any(5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in mates)


def test_decontaminate_stage_goes_by_rows(spark, bench_dir):
    rows = [(1, "x " + ITEM + " y"), (2, A), (3, B), (3, ITEM + " z"), (None, ITEM), (None, A), (None, None), (4, ""), (2, A)]
    got = pairs(cp.decontaminate_stage(spark, make(spark, rows).withColumn("item_id", F.lit(7)), bench_dir))
    assert got == sorted([(2, A), (2, A), (3, B), (None, A), (None, None), (4, "")], key=repr)
    assert pairs(cp.decontaminate_stage(spark, make(spark, []), bench_dir)) == []


def test_language_and_packing_stages(spark, docs):
    kept = cp.language_stage(spark, docs, SF)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    d = language.fit(docs)
    p = docs.select("doc_id", language.classifier(spark, d)("text").alias("p"))
    assert {r[0] for r in kept.select("doc_id").collect()} == {r[0] for r in p.where("p.accepted").collect()}
    packed = cp.packing_stage(spark, make(spark, EDGE), SF).collect()
    assert sum(r["length"] for r in packed if r["start"] == 0 and r["doc_id"] in (1, 2)) == 2
    assert cp.packing_stage(spark, make(spark, []), SF).count() == 0


def test_run_applies_the_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = docs
    for name, stage in cp.STAGES[:-1]:
        before = want
        want = stage(spark, want, SF)
        assert want.columns == docs.columns, name
        assert want.count() <= before.count()
    got = cp.run(spark, SF)
    assert {r[0] for r in got.select("doc_id").distinct().collect()} == {r[0] for r in want.select("doc_id").collect()}
    tokens = {r["doc_id"]: r["doc_tokens"] for r in got.collect()}
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    for r in want.collect():
        assert tokens[r["doc_id"]] == len(tok.encode(r["text"] or "", add_special_tokens=False).ids) + 1


def test_verbatim_copies_of_items_with_refrains_are_found(spark):
    items = [(i, " ".join([f"r{i}a r{i}b r{i}c r{i}d r{i}e"] * (5 + i) + [f"i{i}w{j}" for j in range(40)])) for i in range(60)]
    docs = [(100 + i, f"lead words {i} here " + t + " and some more behind it") for i, t in items]
    docs += [(300 + i, " ".join([f"r{i}a r{i}b r{i}c r{i}d r{i}e"] * 80)) for i in range(60)]
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminations(
        make(spark, docs), make(spark, items, "item_id long, text string")).collect()}
    assert set(got) == {(100 + i, i) for i, _ in items}
    assert all(r["similarity"] == pytest.approx(1.0) and r["bits"] == 0 for r in got.values())


def test_window_fingerprints_are_those_of_their_distinct_shingles():
    rng = np.random.default_rng(4)
    for n, m in ((50, 7), (200, 30), (20, 40)):
        h = rng.choice(rng.integers(1, 1 << 63, 15, dtype=np.uint64), n)
        weight = np.array([1.0 + x % 7 for x in (h % np.uint64(1000)).astype(int)])
        starts = np.arange(0, max(1, n - m + 1))
        got = decontaminate.fingerprints(h, weight, starts, m)
        for s in starts:
            own, at = np.unique(h[s:s + m], return_index=True)
            assert got[s] == decontaminate.fingerprints(own, weight[s:s + m][at], np.array([0]), len(own))[0]


def test_recall_of_near_copies(spark):
    """Items with words replaced down to the similarity: at least nine of ten are found."""
    rng = np.random.default_rng(8)
    items = [(i, " ".join(f"i{i}w{j}" for j in range(60))) for i in range(40)]
    docs, want = [], set()
    for i, t in items:
        for s in range(8):
            w = t.split()
            for j in rng.choice(60, 1 + s % 2, replace=False):
                w[j] = f"new{s}"
            g = lambda x: {tuple(x[k:k + 5]) for k in range(len(x) - 4)}
            if len(g(w) & g(t.split())) >= 0.8 * len(g(w) | g(t.split())):
                want.add((1000 * i + s, i))
            docs.append((1000 * i + s, "before " + " ".join(w) + " after"))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminations(
        make(spark, docs), make(spark, items, "item_id long, text string")).collect()}
    assert len(want) > 100 and got <= want and len(got) >= 0.9 * len(want)


def test_signs_that_are_no_letters_have_no_language(spark):
    t = make(spark, [(1, "½ ² ① Ⅷ 12 _"), (2, "das ist ein deutscher Satz"), (3, "ª"), (4, "文")])
    p = language.classifier(spark, {"de": b"das ist ein deutscher satz " * 20, "en": b"this is an english text " * 20})
    got = {r["doc_id"]: r["p"]["lang_pred"] for r in t.select("doc_id", p("text").alias("p")).collect()}
    assert got[1] == "und" and got[2] == "de" and got[3] != "und" and got[4] != "und"


def test_packing_gives_the_tokenizers_ids_of_special_strings(spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    texts = ["a <|endoftext|> b", "<|endoftext|>", " <|endoftext|>x y", "x<|endoftext|>y  z", "<|endoftext|><|endoftext|> end",
             "no special", "a <|endoftext|", "one two <|endoftext|> three four <|endoftext|> five"]
    got = packing.token_ids([t.encode() for t in texts], tokenizer_path())
    for t, ids in zip(texts, got):
        assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids, t
    assert 50256 in got[0]


def test_a_workers_cache_of_stretches_is_bounded_in_stretches_and_in_ids():
    from tokenizers import Tokenizer
    from equilens.llm.common import worker_cache
    tok, path = Tokenizer.from_file(tokenizer_path()), tokenizer_path()
    held = lambda t: sum(a.nbytes for a in vars(t).values() if isinstance(a, np.ndarray))
    assert held(packing.Stretches(path)) < 44e6
    tables, before = worker_cache("stretches"), worker_cache("stretches").get(path)
    small = tables[path] = packing.Stretches(path, bits=8, most_ids=700)
    try:
        size = held(small)
        texts = [" ".join(f"w{i * j}" for j in range(1, 40)) for i in range(60)] + ["", "文字" * 150, "a b  c\n d"]
        long = " ".join(f"q{i}" for i in range(400))          # more stretches and ids than the bounds
        for t in [*texts, long, *texts]:
            got = packing.token_ids([t.encode(), b"x y"], path)
            for x, ids in zip([t, "x y"], got):
                assert ids.dtype == np.uint32 and ids.tolist() == tok.encode(x, add_special_tokens=False).ids, x
            assert held(small) == size or t == long or small.bits > 8
        for t in texts[:8]:
            packing.token_ids([t.encode()], path)
        small.clear()
        assert held(small) == size
    finally:
        tables.pop(path)
        if before is not None:
            tables[path] = before


def test_span_hashes_hold_short_windows(monkeypatch):
    from equilens.llm import common
    b = np.frombuffer(b" ".join(b"word%d" % (i % 5000) for i in range(60_000)), dtype=np.uint8)
    space = np.flatnonzero(b == 32)
    starts, ends = np.concatenate(([0], space + 1)), np.concatenate((space, [len(b)]))
    common.worker_cache("powers").pop(0, None)
    h = common.span_hashes(b, starts, ends)
    assert len(common.worker_cache("powers")[0][0]) <= 1 << 18
    monkeypatch.setattr(common, "WINDOW", 1 << 20)
    assert (common.span_hashes(b, starts, ends) == h).all() and len(np.unique(h)) == 5000
