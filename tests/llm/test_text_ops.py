"""Operators on texts against brute-force versions and edge tables."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_fixtures import DOCS, EDGE, SF, make
from pyspark.sql import functions as F

import corpus_pipeline
from equilens.llm import decontaminate, language, near_dup, packing, queries, substring
from equilens.llm.queries import tokenizer_path


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(ids, linked):
    comp = {i: i for i in ids}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i
    for a, b in linked:
        a, b = sorted((root(a), root(b)))
        comp[b] = a
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("k,num", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(docs, texts, k, num):
    sets = {i: shingle_set(t, k) for i, t in texts.items()}
    linked = [(a, b) for a, b in itertools.combinations(sets, 2)
              if sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = brute_components(list(sets), linked)
    got = near_dup.near_duplicates(docs, k=k, num=num).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {
        i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    assert linked


def test_near_duplicate_chain_and_large_bucket(spark):
    # a chain of edits: neighbours link, the ends do not; with many unlinked members in one bucket
    words = [f"w{i}" for i in range(200)]
    rows = []
    for step in range(100):
        w = list(words)
        w[:step * 2] = [f"c{i}" for i in range(step * 2)]
        rows.append((1000 - step, " ".join(w)))
    got = near_dup.near_duplicates(make(spark, rows, "doc_id long, text string"), k=3, num=85)
    assert {r["component_id"] for r in got.collect()} == {901}


def test_large_buckets_take_several_rounds_and_lose_no_link(spark, monkeypatch):
    # buckets of more than two members count as large, and rounds start with one pivot slot
    monkeypatch.setattr(near_dup, "PAIR_BUCKET", 2)
    monkeypatch.setattr(near_dup, "PIVOTS", 1)
    rng, rows = random.Random(3), []
    for i in range(60):
        w = [f"w{j}" for j in range(150)]
        for j in rng.sample(range(150), rng.choice([0, 1, 3, 6, 9])):
            w[j] = f"e{i}_{j}"
        rows.append((100 - i, " ".join(w)))
    sets = {i: shingle_set(t, 3) for i, t in rows}
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = brute_components(list(sets), linked)
    got = near_dup.near_duplicates(make(spark, rows, "doc_id long, text string"), k=3, num=85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert 1 < len(set(want.values())) < len(rows)


def test_near_duplicates_edges(spark):
    got = near_dup.near_duplicates(make(spark, EDGE).withColumn("component_id", F.lit("clash")), k=5)
    by = defaultdict(list)
    for r in got.collect():
        by[r["doc_id"]].append(r)
    assert sum(map(len, by.values())) == len(EDGE)
    assert [by[i][0]["n_shingles"] for i in (1, 2, 3, 4, 6)] == [0, 0, 0, 1, 1]
    assert by[1][0]["component_id"] == 1 and by[5][0]["component_id"] == 4 and not by[5][0]["kept"]
    assert by[None][0]["component_id"] is None and by[None][0]["kept"]
    assert near_dup.near_duplicates(make(spark, [])).count() == 0


def test_rows_sharing_an_id_are_one_document(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    got = near_dup.near_duplicates(make(spark, [(1, a), (5, a), (5, b), (7, b)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 5: 1, 7: 1}


def units(text, min_words=5):
    """Brute force: (start, end, words) of units."""
    out, at = [], 0
    for line in text.split("\n"):
        stop = min(at + len(line) + 1, len(text))
        words, pos = [], []
        i = 0
        for w in line.replace("\t", " ").split(" "):
            if w:
                words.append(w)
                pos.append(at + i)
            i += len(w) + 1
        lo = 0
        for j, w in enumerate(words):
            if j == len(words) - 1 or (w[-1] in ".!?" and j + 1 - lo >= min_words):
                if j + 1 - lo >= min_words:
                    out.append((pos[lo], None if j == len(words) - 1 else pos[j + 1], " ".join(words[lo:j + 1]).lower()))
                lo = j + 1
        at = stop
    return out


def test_substring_dedup_equals_brute_force(docs, texts):
    seen, removed = set(), defaultdict(list)
    for i in sorted(texts):
        for start, _, words in units(texts[i]):
            # A-Z only are lower-cased, as the operator does
            key = "".join(c.lower() if c.isascii() else c for c in texts[i][start:start + len(words) + 50])
            key = " ".join(w for w in words.split())
            if key in seen:
                removed[i].append(start)
            seen.add(key)
    got = {r["doc_id"]: r for r in substring.substring_dedup(docs).collect()}
    assert len(got) == len(texts)
    n = sum(len(v) for v in removed.values())
    mine = sum(len(r["removed"]) for r in got.values())
    assert n > 20 and abs(mine - n) <= 0.02 * n
    for i, r in got.items():
        left, at = "", 0
        for s in r["removed"]:
            assert (s["first_doc"], s["first_start"]) < (i, s["start"])
            left += texts[i][at:s["start"]]
            at = s["end"]
        assert r["text"] == left + texts[i][at:]


def test_substring_passage_inside_lines_and_edges(spark):
    passage = ("The committee met on a cold morning in May. Nobody had expected the vote to take so long. "
               "In the end the older members left the room first.")
    rows = [(1, "Some words before it stand here. " + passage + " And after it more."),
            (2, "Other text. " + passage + " Yet another ending of the line.\nLast line."), (3, None), (4, ""), (2, None)]
    got = {(r["doc_id"], r["text"]): r for r in substring.substring_dedup(
        make(spark, rows).withColumn("removed", F.lit(1)).withColumn("start", F.lit(2))).collect()}
    assert (3, None) in got and (4, "") in got and (2, None) in got and len(got) == 5
    two = next(t for i, t in got if i == 2 and t)
    assert "Nobody had expected" not in two and "older members" not in two and "Last line." in two
    one = next(t for i, t in got if i == 1)
    assert passage in one
    assert substring.substring_dedup(make(spark, [])).count() == 0
    every = substring.substring_dedup(make(spark, EDGE))
    assert every.count() == len(EDGE) and every.columns[:5] == [c.split()[0] for c in DOCS.split(", ")]
    assert [r["text"] for r in every.where("doc_id = 10").collect()] == [""]


def test_substring_short_lines_and_texts_without_spaces(spark, tmp_path):
    cjk = "これは空白のない長い段落です。同じ文が何度も現れます。" * 40
    rows = [(1, f"Read more\nFirst text of its own here.\n{cjk}\nShare"), (2, f"share\nSecond text is another one.\nRead  more\n{cjk}"),
            (3, f"These five words come first. {cjk}"), (4, f"Here are five other words. {cjk}\nRead more of it")]
    make(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    left = {r["doc_id"]: r["text"] for r in queries.op1_substring_dedup(spark, str(tmp_path)).collect()}
    assert left == {1: rows[0][1], 2: "Second text is another one.\n", 3: "These five words come first. ",
                    4: "Here are five other words. Read more of it"}
    stage = corpus_pipeline.substring_stage(spark, make(spark, rows), str(tmp_path)).collect()
    assert {r["doc_id"]: r["text"] for r in stage} == left


def plain(text):
    return "".join(c if ord(c) > 127 or c.isalnum() else " " for c in text or "").encode().lower().split()


def test_contaminations_equal_brute_force(spark, docs, texts):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r["item_id"]: plain(r["text"]) for r in bench.collect()}
    grams = lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    df = Counter(g for w in items.values() for g in grams(w))
    weight = lambda g: np.log(1 + len(items) / df[g]) if g in df else np.log(1 + len(items))
    want = {}
    for d, t in texts.items():
        w = plain(t)
        for i, x in items.items():
            if not grams(x) & grams(w):
                continue
            best = 0.0
            for s in range(max(1, len(w) - len(x) + 1)):
                a, b = grams(w[s:s + len(x)]), grams(x)
                both = sum(map(weight, a & b))
                best = max(best, both / (sum(map(weight, a)) + sum(map(weight, b)) - both) if a else 0)
            if best >= 0.8:
                want[d, i] = best
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminations(docs, bench).collect()}
    assert set(got) == set(want) and want
    for k, r in got.items():
        assert r["similarity"] == pytest.approx(want[k])
        if want[k] > 0.999:
            assert plain(texts[k[0]][r["start"]:r["end"]]) == items[k[1]]


def test_contamination_near_copies_short_items_and_edges(spark):
    item = " ".join(f"term{i}" for i in range(60))
    near = item.replace("term30", "other")
    far = " ".join(w if i % 4 else "zz" for i, w in enumerate(item.split()))
    docs = make(spark, EDGE + [(20, "before it " + near + " after"), (21, far), (22, "xx yy, ZZ! ww"), (23, "yy zz xx")])
    bench = make(spark, [(1, item), (1, item), (2, "xx yy zz"), (3, None), (4, ""), (5, "..."), (None, "é à ü ß 日本")],
                 "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminations(docs, bench).collect()}
    assert got == {(20, 1), (22, 2), (11, None)}
    assert decontaminate.contaminations(make(spark, []), bench).count() == 0
    assert decontaminate.contaminations(docs, bench.limit(0)).count() == 0


def test_contaminations_do_not_depend_on_the_parts(spark, monkeypatch):
    # items that share half of their shingles, and texts that differ from them in a few words
    rng = np.random.default_rng(11)
    common = [f"c{i}" for i in range(20)]
    items = [(i, " ".join(common + [f"i{i}x{j}" for j in range(20)])) for i in range(12)]
    docs = []
    for i, t in items:
        for s in range(12):
            w = t.split()
            for j in rng.choice(len(w), 1 + s % 3, replace=False):
                w[j] = "zz"
            docs.append((100 * i + s, " ".join(w)))
    docs, bench = make(spark, docs), make(spark, items, "item_id long, text string")
    one = sorted(map(tuple, decontaminate.contaminations(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "PART_ITEMS", 2)
    parts = sorted(map(tuple, decontaminate.contaminations(docs, bench).collect()))
    assert 0 < len(one) < 144 and one == parts


def test_simhash_blocks_find_every_item_within_the_radius():
    rng = np.random.default_rng(3)
    texts = [b" ".join(b"v%d" % x for x in rng.integers(0, 500, 20)) for _ in range(60)]
    ix = decontaminate.Index(list(range(60)), texts, 5, decontaminate.RADIUS)
    prints = np.array([ix.prints[i] for i in rng.integers(0, 60, 300)])
    for p in range(len(prints)):
        for bit in rng.choice(64, rng.integers(0, 24), replace=False):
            prints[p] ^= np.uint64(1) << np.uint64(bit)
    w, i = ix.lookup(20, prints)
    want = {(a, b) for a in range(300) for b in range(60)
            if bin(int(prints[a]) ^ int(ix.prints[b])).count("1") <= decontaminate.RADIUS}
    assert set(zip(w.tolist(), i.tolist())) == want


def test_packing_round_trip(spark, docs, texts):
    tok = packing.tokenizer(tokenizer_path())
    want = {i: tok.encode(t or "", add_special_tokens=False).ids + [0] for i, t in texts.items()}
    rows = packing.pack(docs, tokenizer_path(), with_ids=True).collect()
    back, seqs = defaultdict(dict), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], dtype="<u4").tolist()
        assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] and r["doc_tokens"] == len(want[r["doc_id"]])
        back[r["doc_id"]][r["start"]] = ids
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {i: sum((x for _, x in sorted(p.items())), []) for i, p in back.items()} == want
    filled = 0
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 1024
        filled += at
    assert filled / (1024 * len(seqs)) > 0.97


def test_packing_edges_and_stretches(spark):
    rows = EDGE + [(30 + i, t) for i, t in enumerate(
        ["a  b", " a b ", "x\n y", "don't stop 's 12 34", "tab\t end ", "\x1c a", "a  b", "a  b　c", "<|endoftext|> x",
         "a \n b\r\n  c", "x\u0085 y z"])]
    tok = packing.tokenizer(tokenizer_path())
    got = packing.pack(make(spark, rows).withColumn("length", F.lit("x")), tokenizer_path(), with_ids=True).collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert by[1][0]["length"] == 1 and by[1][0]["ids"] == b"\0\0\0\0"
    for i, t in rows:
        if i != 7:
            ids = b"".join(r["ids"] for r in sorted(by[i], key=lambda r: r["start"]))
            assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t or "", add_special_tokens=False).ids + [0], t[:20]
    assert len(by[7]) == 2 and len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
    assert packing.pack(make(spark, []), tokenizer_path()).count() == 0


def test_pipeline_keeps_different_texts_of_one_id(spark, tmp_path):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = make(spark, [(1, a), (1, b), (1, b), (2, "c " + a[::-1])])
    got = corpus_pipeline.near_dup_stage(spark, rows, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted([(1, a), (1, b), (2, "c " + a[::-1])])


def test_shortest_pack_first_places_every_length():
    rng = np.random.default_rng(0)
    hist = {int(k): int(n) for k, n in zip(rng.choice(np.arange(1, 101), 60, replace=False), rng.integers(1, 50, 60))}
    packs = packing.shortest_pack_first(hist, 100)
    placed = Counter()
    for n, lengths in packs:
        assert sum(lengths) <= 100
        for x in lengths:
            placed[x] += n
    assert placed == hist


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    dicts = language.fit(docs.where(~held))
    assert set(dicts) == {"en", "fr", "de", "es"} and max(map(len, dicts.values())) <= language.DICT_BYTES
    got = docs.where(held).select("lang", language.classifier(spark, dicts)("text").alias("p")).collect()
    right = sum(r["lang"] == r["p"]["lang_pred"] for r in got)
    assert right >= 0.9 * len(got) and all(0 <= r["p"]["score"] <= 1 for r in got)
    assert sum(r["p"]["accepted"] for r in got) >= 0.97 * len(got)


def test_language_learns_from_whole_texts(spark):
    # 20 long texts behind one common header; a language with text enough stays with short windows
    header = "all rights of this common header are reserved " * 40
    long = [(i, header + " ".join(f"{chr(97 + i)}{chr(97 + j % 26)}{chr(97 + j // 26 % 26)}zq" for j in range(1500)), "xx") for i in range(20)]
    many = [(100 + i, "der die das und nicht " * 100, "de") for i in range(500)]
    dicts = language.fit(make(spark, long + many))
    assert len(dicts["xx"]) > 200_000 and len(dicts["de"]) == language.DICT_BYTES
    assert sum(f"{chr(97 + i)}bczq".encode() in dicts["xx"] for i in range(20)) == 20
    windows = language.fit(make(spark, [(1000 * k + i, t, x) for k in range(30) for i, t, x in long]), dict_bytes=30_000)
    assert b"zq" in windows["xx"] and len(windows["xx"]) == 30_000


def test_language_edges(spark):
    train = make(spark, [(1, "der die das und nicht", "de"), (2, "the and of to in", "en"), (3, None, "en"), (4, "x", None),
                         (None, "the cat", "en"), (2, "the and of to in", "en")])
    dicts = language.fit(train)
    assert set(dicts) == {"de", "en"}
    got = [r["p"] for r in make(spark, EDGE).select("doc_id", language.classifier(spark, dicts)("text").alias("p")).collect()]
    assert len(got) == len(EDGE)
    assert [got[i]["lang_pred"] for i in (0, 1, 2, 5)] == ["und"] * 4 and not got[0]["accepted"]
    assert {p["lang_pred"] for p in got} <= {"de", "en", "und"}
    assert language.fit(train.limit(0)) == {}
    none = make(spark, EDGE).select(language.classifier(spark, {})("text").alias("p")).collect()
    assert {r["p"]["lang_pred"] for r in none} == {"und"}
    alone = make(spark, [(1, "abc")]).select(language.classifier(spark, {"en": b"the"})("text").alias("p")).first()["p"]
    assert alone["accepted"] and alone["score"] == 1.0
