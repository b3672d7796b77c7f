"""Operator 3: URL filtering by association rules.

URLs become sets of tokens (host parts, registered domain, path words, extension, query keys).
Spark's FP-growth mines the labelled pages; rules "tokens -> unwanted" are kept by their number of
unwanted pages (the same at every size of the corpus) and their confidence and dropped where a rule on fewer
of the tokens is as sure. Tokens on the very same labelled pages stand for each other. Rules are
filed under their rarest token; a URL meets only the rules filed under a token of its own and
matches those whose tokens it holds all. A fixed list of (host, path) rules overrides the mined ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import small

# The list rules (verdict, host, path)
LIST_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"),
              ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MIN_PAGES = 20           # labelled pages that must hold a rule's tokens and be unwanted
MIN_CONFIDENCE = 0.6
SURE = 0.5               # the 95 % lower bound (Wilson) of a rule's confidence must lie above this
_Z = 1.645
_RULES = ("rule_id long, need array<string>, any array<array<string>>, confidence double, support double, "
          "key string")
_REPEAT = 10_000         # equal transactions repeated by one row
UNWANTED = "!unwanted"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a URL column; empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def list_rule(host, path, rules=LIST_RULES) -> tuple[F.Column, F.Column]:
    """The longest fitting list rule and its verdict, or null."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens(url) -> F.Column:
    """Distinct tokens of a URL; an empty array if it has no host."""
    host, path = host_path(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    words = F.filter(F.split(host, r"[.\-]"), lambda x: x != "")
    parts = F.filter(F.split(F.lower(path), "/"), lambda x: x != "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    keys = F.filter(F.split(query, "&"), lambda x: x != "")
    named = lambda kind, a: F.transform(a, lambda x: F.concat(F.lit(kind), x))
    out = F.array_distinct(F.concat(
        named("host:", words),
        F.when(F.size(labels) > 1, F.array(F.concat(F.lit("site:"), F.array_join(F.slice(labels, -2, 2), "."))))
         .otherwise(F.array().cast("array<string>")),
        named("path:", F.transform(parts, lambda x: F.regexp_replace(x, r"[0-9]+", "#"))),
        named("query:", F.transform(keys, lambda x: F.split(x, "=")[0]))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.coalesce(out, F.array().cast("array<string>")))


@dataclass
class Rules:
    """Mined rules as a written table, or None: ``need`` (one token of each group), ``any`` (the groups;
    a URL must hold a token of each), ``key`` (a row per token of the rarest group), ``rule_id``,
    ``confidence``, ``support``."""
    table: DataFrame | None


def mine(pages: DataFrame, labels: DataFrame, *, id_col: str = "page_id", url_col: str = "url",
         label_id: str = "doc_id", min_pages: int = MIN_PAGES,
         min_confidence: float = MIN_CONFIDENCE) -> Rules:
    """Rules from all pages whose id has a label; a page is unwanted if any label of it says
    toxic = 1 or quality = 0. Labels null in both columns, null ids and URLs without a host teach
    nothing; no labelled page: no rules.

    Equal token sets are counted once. Tokens on fewer than ``min_pages`` unwanted pages can be in no
    rule and go first; tokens that stand on the very same pages are one item (``any``), so a long URL
    on many pages is one item and not two to the power of its length.
    """
    bad = (F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False)))
    known = (labels.where(F.col("toxic").isNotNull() | F.col("quality").isNotNull())
                   .groupBy(F.col(label_id).cast("long").alias("id")).agg(F.max(bad).alias("bad")))
    src = (pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url")).join(known, "id")
                .select(F.sort_array(tokens(F.col("url"))).alias("t"), "bad").where(F.size("t") > 0)
                .groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("n_bad")))
    src = cut_lineage(src, "token_sets")
    n = src.agg(F.sum("n")).first()[0] or 0
    if min_pages > n:                                      # fewer pages than any rule needs
        return Rules(None)
    groups = cut_lineage(_groups(src, min_pages), "token_groups")
    items = (src.withColumn("at", F.xxhash64("t")).select("at", "t", "n", "n_bad", F.explode("t").alias("token"))
                .join(small(groups.select(F.explode("tokens").alias("token"), "item")), "token")
                .groupBy("at", "t").agg(F.sort_array(F.collect_set("item")).alias("items"), F.first("n").alias("n"),
                                        F.first("n_bad").alias("n_bad"))
                .groupBy("items").agg(F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad")))
    sets = _item_sets(cut_lineage(items, "transactions"), min_pages)
    if sets is None:
        return Rules(src.sparkSession.createDataFrame([], _RULES))
    c, held = F.col("confidence"), F.col("held")           # pages that hold the tokens
    z2 = _Z * _Z
    least = (c + z2 / (2 * held) - _Z * F.sqrt((c * (1 - c) + z2 / (4 * held)) / held)) / (1 + z2 / held)
    sure = (c >= min_confidence) & (least > SURE)
    rules = _irredundant(sets, sure).select(
        F.xxhash64(F.concat_ws(" ", "need")).alias("rule_id"), "need", "confidence", (F.col("bad") / n).alias("support"))
    parts = rules.select("rule_id", F.explode("need").alias("item")).join(groups, "item").groupBy("rule_id").agg(
        F.sort_array(F.collect_list("tokens")).alias("any"), F.min(F.struct("pages", "item", "tokens")).alias("m"))
    return Rules(cut_lineage(rules.join(parts, "rule_id").select(
        "rule_id", "need", "any", "confidence", "support", F.explode("m.tokens").alias("key")), "rule_index"))


def _groups(src: DataFrame, min_pages: int) -> DataFrame:
    """(item, tokens, pages): tokens on at least ``min_pages`` unwanted pages, those on the same token
    sets together. Sets of token sets are compared by two independent 64-bit sums and their counts."""
    seen = (src.select(F.xxhash64("t").alias("h"), F.xxhash64(F.lit(1), "t").alias("g"), "n", "n_bad", F.explode("t").alias("token"))
               .groupBy("token").agg(F.sum("n").alias("pages"), F.sum("n_bad").alias("bad"), F.count(F.lit(1)).alias("sets"),
                                     F.bit_xor("h").alias("h"), F.bit_xor("g").alias("g"))
               .where(F.col("bad") >= min_pages))
    return seen.groupBy("pages", "bad", "sets", "h", "g").agg(F.sort_array(F.collect_list("token")).alias("tokens")).select(
        F.col("tokens")[0].alias("item"), "tokens", "pages")


def _item_sets(items: DataFrame, min_pages: int) -> DataFrame | None:
    """(need, size, bad, held, confidence) of every item set on at least ``min_pages`` unwanted pages, by FP-growth
    over one transaction a page; None if there is no item."""
    n = items.agg(F.sum("n")).first()[0] or 0
    if n == 0:
        return None
    both = items.select("items", (F.col("n") - F.col("n_bad")).alias("n")).unionByName(
        items.select(F.concat("items", F.array(F.lit(UNWANTED))).alias("items"), F.col("n_bad").alias("n"))).where("n > 0")
    shuffles = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a frequent set is dealt to many tasks before it is repeated
    parts = both.select("items", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {_REPEAT}"))).alias("i"))
    pages = (parts.select("items", F.least(F.lit(_REPEAT).cast("long"), F.col("n") - F.col("i") * _REPEAT).cast("int").alias("n"))
                  .repartition(max(items.sparkSession.sparkContext.defaultParallelism, shuffles))
                  .select("items", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")).select("items"))
    # half a page less than needed, as the product is rounded up to a count again
    model = FPGrowth(itemsCol="items", minSupport=(min_pages - 0.5) / n).fit(pages)
    found = cut_lineage(model.freqItemsets.select(F.sort_array(F.array_remove("items", UNWANTED)).alias("need"),
                                                  F.array_contains("items", UNWANTED).alias("is_bad"), "freq"), "item_sets")
    of = lambda is_bad, name: found.where(F.col("is_bad") == is_bad).select("need", F.col("freq").alias(name))
    return of(True, "bad").join(of(False, "held"), "need").select(
        "need", F.size("need").alias("size"), "bad", "held", (F.col("bad") / F.col("held")).alias("confidence"))


def _irredundant(sets: DataFrame, sure: F.Column) -> DataFrame:
    """The ``sure`` sets without a proper subset of at least their confidence. The best confidence below a
    set is carried up the lattice: from sets of one token fewer, level by level. (A subset of at
    least a sure set's confidence stands on more pages, so it is sure too.)"""
    sets = cut_lineage(sets, "lattice")
    top = sets.where(sure).agg(F.max("size")).first()[0] or 0
    below = sets.where(F.col("size") == 1).withColumn("best", F.lit(None).cast("double"))
    kept = below
    for size in range(2, top + 1):
        at = sets.where(F.col("size") == size)
        down = at.select("need", F.explode(F.transform("need", lambda x: F.array_remove("need", x))).alias("less"))
        best = (down.join(below.select(F.col("need").alias("less"), F.greatest("confidence", "best").alias("best")), "less")
                    .groupBy("need").agg(F.max("best").alias("best")))
        below = cut_lineage(at.join(best, "need"), "level")
        kept = kept.unionByName(below)
    return kept.where(sure & (F.col("best").isNull() | (F.col("best") < F.col("confidence")))).drop("best")


def judge(pages: DataFrame, rules: Rules, *, id_col: str = "page_id", url_col: str = "url",
          list_rules=LIST_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, confidence, mined) per row of ``pages``.

    The longest list rule decides; without one the verdict is block if a mined rule matches, with
    the highest confidence of those (``mined``: the URL's tokens that it needs), else allow. Null URLs and URLs
    without ``://`` have empty host and path, match nothing and are allowed. Repeated rows are
    judged alike, null ids like any other. Other columns are ignored.
    """
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))
    host, path = host_path(F.col("url"))
    rule, verdict = list_rule(F.col("host"), F.col("path"), list_rules)
    src = src.select("page_id", "url", host.alias("host"), path.alias("path"))
    if rules.table is None:
        none = src.withColumn("confidence", F.lit(None).cast("double")).withColumn("mined", F.lit(None).cast("string"))
    else:
        urls = src.where(F.col("host") != "").select("url").distinct().withColumn("t", tokens(F.col("url")))
        hit = (urls.select("url", "t", F.explode("t").alias("key")).join(small(rules.table), "key")
                   .where(F.forall("any", lambda g: F.arrays_overlap(g, F.col("t"))))
                   .select("url", "confidence", F.array_join(F.sort_array(F.transform(
                       "any", lambda g: F.array_min(F.array_intersect(g, F.col("t"))))), " ").alias("mined"))
                   .groupBy("url").agg(F.max(F.struct("confidence", "mined")).alias("m")))
        none = src.join(hit, "url", "left").select(*[src[c] for c in src.columns],
                                                   F.col("m.confidence").alias("confidence"), F.col("m.mined").alias("mined"))
    method = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return none.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"),
                       "confidence", "mined")
