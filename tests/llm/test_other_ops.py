"""URL rules, vectors, licences, language model and chat against brute-force versions."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_fixtures import EDGE, SF, make
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from equilens.llm import chat, class_lm, lattice, license_scan, queries, url_rules

URLS = [(1, "http://Sub.Example.NET/en/x?q=1"), (2, "https://a.example.com/de/"), (3, "x://org/fr/1"), (4, "no scheme"), (5, None),
        (6, "http://net"), (7, "http://planet/"), (8, "ftp://EXAMPLE.com#/de/"), (9, "http://example.net/EN/"), (10, "a://b://c/d"),
        (None, "http://www.org/fr/?a#b"), (1, "http://Sub.Example.NET/en/x?q=1"), (11, "http://?x"), (12, "://h.net/")]


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for v, h, p in url_rules.LIST_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return host, path, best[0] if best else None, best[1] if best else None


def test_list_rules_equal_brute_force(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").unionByName(make(spark, URLS, "page_id long, url string"))
    got = url_rules.judge(pages.withColumn("verdict", F.lit("x")), url_rules.Rules(None)).collect()
    want = Counter((i, *judged(u)[:3], judged(u)[3] or "allow") for i, u in map(tuple, pages.collect()))
    assert Counter(tuple(r)[:5] for r in got) == want


def test_mined_rules_are_found_pruned_and_matched(spark):
    pages = [(i, f"http://{'casino' if i % 4 == 0 else 'news'}.site{i % 3}.com/{'play' if i % 8 == 0 else 'read'}/{i}") for i in range(400)]
    pages = make(spark, pages, "page_id long, url string")
    labels = make(spark, [(i, 1, 1 if i % 4 == 0 else 0) for i in range(400)] + [(0, 1, 1), (7, None, None)],
                  "doc_id long, quality int, toxic int")
    rules = url_rules.mine(pages, labels)
    table = rules.table.collect()
    # every subset-redundant rule is gone: the one token says it all
    assert any(r["need"] == ["host:casino"] and r["confidence"] == 1.0 for r in table)
    assert not any("host:casino" in r["need"] and len(r["need"]) > 1 for r in table)
    got = {r["page_id"]: r for r in url_rules.judge(pages, rules).collect()}
    assert all((got[i]["verdict"] == "block") == (i % 4 == 0) for i in range(400))
    assert url_rules.mine(pages, labels.limit(0)).table is None
    assert url_rules.judge(pages.limit(0), rules).count() == 0


def test_a_rule_needs_the_same_pages_at_every_size(spark):
    # 20 unwanted pages of one site make a rule among 400 labelled pages and among 20,000
    for n in (400, 20_000):
        pages = spark.range(n).select(F.col("id").alias("page_id"), F.when(F.col("id") < 20, "http://bad.example.com/").otherwise(
            F.concat(F.lit("http://h"), (F.col("id") % 50).cast("string"), F.lit(".example.org/"))).alias("url"))
        labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), (F.col("id") < 20).cast("int").alias("toxic"))
        rules = url_rules.mine(pages, labels)
        got = url_rules.judge(pages, rules).where("mined is not null").select("page_id", "confidence").collect()
        assert sorted(map(tuple, got)) == [(i, 1.0) for i in range(20)], n
        assert url_rules.mine(pages, labels.where("doc_id != 3")).table.isEmpty()         # 19 pages are too few


def brute_confidence(pages, bad, min_pages, min_confidence):
    """Highest confidence of a sure rule on any of a page's token sets, by counting them all."""
    held, unwanted = Counter(), Counter()
    subsets = {i: [c for k in range(1, len(t) + 1) for c in itertools.combinations(sorted(t), k)] for i, t in pages.items()}
    for i, cs in subsets.items():
        if i in bad:
            held.update(cs)
            if bad[i]:
                unwanted.update(cs)

    def sure(c):
        n, p = held[c], unwanted[c] / held[c]
        z2 = 1.645 ** 2
        return p >= min_confidence and (p + z2 / (2 * n) - 1.645 * math.sqrt((p * (1 - p) + z2 / (4 * n)) / n)) / (1 + z2 / n) > 0.5
    rules = {c: unwanted[c] / held[c] for c in unwanted if unwanted[c] >= min_pages and sure(c)}
    return {i: max((rules[c] for c in cs if c in rules), default=None) for i, cs in subsets.items()}, rules


def test_mined_rules_equal_brute_force(spark):
    rng = random.Random(5)
    urls = [(i, f"http://{rng.choice('abc')}.s{rng.randrange(3)}.com/{rng.choice('uvw')}/{rng.choice('xy')}") for i in range(600)]
    bad = {i: rng.random() < (0.9 if "/u/x" in u else 0.8 if "//b.s1" in u else 0.2) for i, u in urls[:500]}   # 100 pages unlabelled
    pages = make(spark, urls, "page_id long, url string")
    labels = make(spark, [(i, 1, int(b)) for i, b in bad.items()], "doc_id long, quality int, toxic int")
    toks = {r[0]: r[1] for r in pages.select("page_id", url_rules.tokens(F.col("url"))).collect()}
    rules = url_rules.mine(pages, labels, min_pages=10)
    want, every = brute_confidence(toks, bad, 10, url_rules.MIN_CONFIDENCE)
    got = {r["page_id"]: r["confidence"] for r in url_rules.judge(pages, rules).collect()}
    assert got == pytest.approx(want) and len(set(want.values())) > 3
    # no mined rule has a subset as sure, every rule without one is mined, its alternatives included
    least = {c for c in every if not any(every.get(s, -1) >= every[c] for k in range(1, len(c)) for s in itertools.combinations(c, k))}
    mined = {tuple(sorted(c)) for r in rules.table.select("any").distinct().collect() for c in itertools.product(*r["any"])}
    assert mined == least


def test_long_urls_on_many_pages_are_mined_in_bounded_time(spark):
    path = "/".join(f"part{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(30))
    pages = make(spark, [(i, f"http://bad.example.com/{path}/{i}") for i in range(40)] +
                 [(100 + i, f"http://good{i % 5}.example.org/{path if i < 3 else 'home'}") for i in range(40)], "page_id long, url string")
    labels = make(spark, [(i, 1, int(i < 100)) for i in [*range(40), *range(100, 140)]], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in url_rules.judge(pages, url_rules.mine(pages, labels)).collect()}
    assert all((got[i]["confidence"] == 1.0) == (i < 100) for i in got)
    assert got[101]["confidence"] == pytest.approx(40 / 43)          # the shared path, seen on three wanted pages too


def test_planted_unwanted_sites_are_blocked_on_unseen_pages(spark):
    rng = random.Random(11)
    def url(i):
        return f"https://{rng.choice(['casino', 'news', 'shop', 'wiki'])}.s{rng.randrange(40)}.com/{rng.choice(['play', 'read', 'buy'])}/{i}"
    urls = [(i, url(i)) for i in range(4000)]
    unwanted = {i: ("casino" in u and "/play/" in u) != (rng.random() < 0.05) for i, u in urls}     # one label in twenty is wrong
    pages = make(spark, urls, "page_id long, url string")
    labels = make(spark, [(i, 1, int(unwanted[i])) for i in range(2000)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r["verdict"] == "block" for r in url_rules.judge(pages, url_rules.mine(pages, labels)).collect()}
    true = {i: "casino" in u and "/play/" in u for i, u in urls}
    hit = sum(got[i] and true[i] for i in range(2000, 4000))
    assert hit / sum(true[i] for i in range(2000, 4000)) == 1.0                                      # recall on unseen pages
    assert hit / sum(got[i] for i in range(2000, 4000)) > 0.95                                       # precision


def brute_vectors(rows, threshold=0.98):
    ok = [i for i, (_, v, lab) in enumerate(rows) if v is not None and lab is not None and len(v) and all(
        x is not None and math.isfinite(x) for x in v) and any(v)]
    links = defaultdict(set)
    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], float) / max(map(abs, rows[k][1])) for k in (a, b))
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                    links[a].add(b)
                    links[b].add(a)
    out = []
    for i, (vid, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out.append((vid, len(links[i]), min(rows[j][0] for j in seen)))
    return out


@pytest.mark.parametrize("block", [lattice.BLOCK_ROWS, 5])
def test_near_vectors_equal_brute_force(spark, block):
    vecs = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r[0], list(r[1]), r[2]) for r in vecs.select("vec_id", "embedding", "label").collect()]
    rng = np.random.default_rng(5)
    base = rng.standard_normal(64)
    n = 10_000
    for i in range(40):                                   # a cloud of near copies and exact copies
        v = [float(np.float32(x)) for x in base + 0.08 * rng.standard_normal(64)]
        rows += [(n + 2 * i, v, 3), (n + 2 * i + 1, v if i % 2 else [2 * x for x in v], 3)]
    rows += [(20_000, None, 1), (20_001, [0.0] * 64, 1), (20_002, [float("nan")] * 64, 1), (20_003, [None, 1.0], 1),
             (20_004, [1.0, 0.0], 1), (20_005, [1.0, 0.0], None), (20_006, [1.0, 0.0], 1), (20_007, [], 1), (20_008, [1e200, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n_links", F.lit("clash"))
    got = lattice.near_vectors(df, block_rows=block).collect()
    want = brute_vectors(rows)
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == sorted(want)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_near_vectors_null_ids_and_empty(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (3, [0.0, 1.0], 1), (5, [0.0, 1.0], 1)],
                               "vec_id long, embedding array<double>, label int")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in lattice.near_vectors(df).collect())
    assert got == [(0, 1, None), (3, 1, 3), (3, 1, 3), (5, 1, 3)]
    assert lattice.near_vectors(df.limit(0)).count() == 0


def test_e8_decoder_and_recall():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 8)) * 3
    v = lattice.decode(x)
    near = v[:, None, :] + lattice.roots()[None]
    assert len(lattice.roots()) == 240 and (((lattice.roots() ** 2).sum(axis=1)) == 2).all()
    assert (((x - v) ** 2).sum(axis=1)[:, None] <= ((x[:, None] - near) ** 2).sum(axis=2) + 1e-9).all()
    u = rng.standard_normal((3000, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    w = rng.standard_normal((3000, 64))
    w -= (w * u).sum(axis=1)[:, None] * u
    w /= np.linalg.norm(w, axis=1)[:, None]
    a = lattice.codes(u, lattice.SCALE, lattice.PROBES, 1)
    b = lattice.codes(0.98 * u + math.sqrt(1 - 0.98 ** 2) * w, lattice.SCALE, lattice.PROBES, 1)
    found = ((a[:, :, :1] == b).any(axis=2) | (b[:, :, :1] == a).any(axis=2)).any(axis=1)
    assert found.mean() > 0.999                           # at the threshold itself; closer pairs more often


def test_license_scan_equals_brute_force(spark, docs, texts):
    extra = EDGE + [(9100, "CC BY cc by. All Rights\nReserved"), (9101, "cc-by xcc by"), (9102, "the general public licenses"),
                    (9103, "Licensed, under the Apache License -- Version 2.0!"), (9104, "apache license only"), (9104, "mit license, released under the MIT license")]
    rows = make(spark, extra).unionByName(docs.select("doc_id", "text", "lang", "source", "n_chars"))
    got = license_scan.scan(rows.withColumn("labels", F.lit(1))).collect()
    want = Counter()
    for i, t in [(r[0], r[1]) for r in rows.select("doc_id", "text").collect()]:
        low = "".join(c.lower() if c.isascii() else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at, labels = [], set()
        for p, lab in license_scan.BASE:
            k = len(p.split())
            here = [j for j in range(len(w) - k + 1) if w[j:j + k] == p.split()]
            at += here
            labels |= {lab} if here else set()
        want[(i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))] += 1
    assert Counter(tuple(r)[:6] for r in got) == want
    by = {r["doc_id"]: r for r in got}
    assert by[9100]["labels"] == "cc-by,reserved" and by[9103]["labels"] == "apache-2.0" and by[9102]["labels"] == ""
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    for i, t in texts.items():
        if "Licensed under the Apache License, Version 2.0" in (t or ""):
            assert "apache-2.0" in by[i]["labels"]
    assert license_scan.scan(make(spark, [])).count() == 0


def test_license_scan_finds_every_notice_of_a_file(spark, docs):
    by = {}
    for label, text, _ in license_scan.TEMPLATES:
        by.setdefault(label, text)
    by["mit"] = next(t for label, t, _ in license_scan.TEMPLATES if label == "mit" and t.startswith("permission"))
    groups = [("mit", "apache-2.0"), ("isc", "bsd", "apache-2.0"), ("bsd", "apache-2.0", "gpl-2.0", "mpl-2.0"), tuple(by)]
    rows = [(9200 + i, " some lines between them \n".join(by[x] for x in g)) for i, g in enumerate(groups)]
    table = make(spark, rows).unionByName(docs.select("doc_id", "text", "lang", "source", "n_chars"))
    got = {r["doc_id"]: r for r in license_scan.scan(table).where("doc_id >= 9200").collect()}
    for i, g in enumerate(groups):
        assert set(g) <= set(got[9200 + i]["labels"].split(",")), g
    # a mandatory phrase alone, without the words that stand around it in the template, is no notice
    alone = make(spark, [(1, "an eclipse public license and a mozilla public license, of the terms")])
    assert tuple(license_scan.scan(alone).select("labels", "score").first()) == ("", 0.0)


def test_class_lm_base_score_and_gain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    rows = docs.select("doc_id", "text", held.alias("h")).collect()
    c = Counter()
    for r in rows:
        if not r["h"]:
            c.update((r["text"] or "").encode().lower().split() + [None])
    n, v = sum(c.values()), len(c)
    # a small head sends most words through the join
    for head in (class_lm.HEAD, 300):
        counts, model = class_lm.train(docs.where(~held), head=head, units=200)
        assert len(model["words"]) <= head
        got = {r["doc_id"]: r for r in class_lm.score(docs, counts, model, held).collect()}
        for r in rows:
            toks = (r["text"] or "").encode().lower().split() + [None]
            g = got[r["doc_id"]]
            assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (
                r["h"], len(toks), sum(c[t] > 0 for t in toks), n)
            assert g["base_score"] == pytest.approx(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in toks))
        out = [r["doc_id"] for r in rows if r["h"]]
        assert sum(got[i]["score"] for i in out) > sum(got[i]["base_score"] for i in out)
        # the model is a distribution: transitions and emissions each sum to one
        assert (10 ** model["transition"]).sum(axis=1) == pytest.approx(np.ones(len(model["transition"])))


def test_class_lm_edges(spark):
    rows = make(spark, EDGE)
    counts, model = class_lm.train(rows)
    got = class_lm.score(rows.withColumn("score", F.lit(1)), counts, model, F.lit(False)).collect()
    assert len(got) == len(EDGE) and all(math.isfinite(r["score"]) for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    counts, model = class_lm.train(rows.limit(0))
    got = class_lm.score(rows, counts, model, F.lit(True)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 for r in got)
    assert class_lm.score(rows.limit(0), counts, model, F.lit(True)).count() == 0


def test_exchange_gains_likelihood_and_finds_blocks():
    rng = np.random.default_rng(4)
    size = 40                                             # two languages that rarely mix
    n = rng.poisson(20, (size, size)).astype(float)
    n[:20, 20:] = n[20:, :20] = 0
    n = np.pad(n, ((0, 1), (0, 1)), constant_values=1)
    g = class_lm.exchange(n, size, 2)
    assert len(set(g[:20])) == 1 and len(set(g[20:40])) == 1 and g[0] != g[20]

    def likelihood(g):
        onto = np.eye(g.max() + 1)[g]
        b = onto.T @ n @ onto
        f = lambda x: (x[x > 0] * np.log(x[x > 0])).sum()
        return f(b) - f(b.sum(axis=0)) - f(b.sum(axis=1))
    assert likelihood(g) > likelihood(np.append(np.arange(size) % 2, 2))


def test_chat_digests_equal_input(spark):
    rows = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"), (5, 2, "assistant", None),
            (5, 1, "system", "be \\ <<SYS>> <|image:0|>"), (5, 0, None, "é日"), (5, 3, "tool[/ROLE]", "[/TEXT]\\"), (5, 3, "tool[/ROLE]", "[/TEXT]\\"),
            (6, None, "assistant", "x"), (None, 1, "assistant", "y"), (7, 0, "user", "z " * 50_000), (7, 1, "assistant", "[TEXT]" * 3000)]
    turns = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(
        make(spark, rows, "conv_id long, turn long, role string, text string"))
    data = defaultdict(list)
    for c, t, r, x in map(tuple, turns.collect()):
        data[c].append(((t is not None, t or 0), r or "", x or ""))
    done = chat.format_chats(turns.withColumn("parts", chat.text_parts(F.col("text"))).withColumn("formatted", F.lit(1)))
    got = {r["conv_id"]: r for r in chat.digests(done).collect()}
    assert set(got) == set(data)
    for c, d in data.items():
        d = sorted(d)
        g = got[c]
        assert g["n_turns"] == len(d)
        assert g["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in d).encode()).hexdigest()
        loss = "".join(x for _, r, x in d if r == "assistant")
        assert (g["loss_chars"], g["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.format_chats(turns.limit(0).withColumn("parts", chat.text_parts(F.col("text"))))).count() == 0


def test_chat_attachments(spark):
    parts = [("text", "see <|image:9|>", None, None), ("image", None, "s3/a.png", None), ("audio", None, "b.wav", 10),
             (None, "and", None, None), ("document", None, "c.pdf", None), ("odd", "text", None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)],
                               f"conv_id long, turn long, role string, parts {chat.PARTS}")
    r = chat.format_chats(df).first()
    assert [(a["turn"], a["position"], a["type"], a["ref"], a["tokens"]) for a in r["attachments"]] == [
        (0, 1, "image", "s3/a.png", 576), (0, 2, "audio", "b.wav", 10), (0, 4, "document", "c.pdf", 1024)]
    assert r["attachment_tokens"] == 1610 and r["n_turns"] == 2
    assert r["formatted"] == "[INST]see \\<|image:9\\|><|image:0|><|audio:1|>and<|document:2|>text[/INST]<s></s>"
    assert chat.read_back(r["formatted"])[0][0] == "user"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "[ROLE]\\"]),
                          st.text(st.sampled_from(list("\\[]<>/|sINTSYROLEX:ima ge0")), max_size=30)), max_size=6))
def test_chat_reads_back_anything(turns):
    v = chat.Visitor()
    for i, (role, text) in enumerate(turns):
        v.visit(i, role, [{"type": "text", "text": text, "ref": None, "tokens": None}])
    out = "".join(v.out)
    assert chat.read_back(out) == turns
    assert [chat.unescape(out[a:b]) for a, b in v.spans] == [x for r, x in turns if r == "assistant"]


def test_queries_are_registered():
    assert [int(q[2:].split("_")[0]) for q in queries.QUERIES] == list(range(1, 11))
