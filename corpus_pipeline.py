"""The corpus pipeline: five stages over ``documents``, each one operator of ``equilens.llm``.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the
columns of ``documents``; the last returns packed sequences. ``run`` writes each stage's result
as a Parquet table in the shared folder and reads it back as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equilens.llm import decontaminate, language, near_dup, packing, queries, substring
from equilens.llm.common import small, table
from equilens.session import cut_lineage


ROW_KEYS = 1 << 62        # keys from here on are of rows that share an id or have none


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key per text, ``__key``: the id where one row has it; rows that share an id, or
    have none, have a key each by id and text, so that decisions take effect on rows and not on ids.
    Only rows of one id and text share a key."""
    docs = docs.drop("__key")
    again = cut_lineage(docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1")
                        .select(F.col("doc_id").alias("__again")), "repeated")
    own = F.lit(ROW_KEYS) + F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROW_KEYS - 1))
    if again.isEmpty():
        return docs.withColumn("__key", F.coalesce(F.col("doc_id").cast("long"), own))
    out = docs.join(small(again), docs["doc_id"] == F.col("__again"), "left")
    return out.withColumn("__key", F.when(F.col("__again").isNull(), F.coalesce(F.col("doc_id").cast("long"), own)).otherwise(own)).drop("__again")


def _without(keyed: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    """Rows whose key is not in ``column`` of ``gone``."""
    gone = cut_lineage(gone.select(F.col(column).alias("__gone")).distinct(), "gone")
    return keyed.join(small(gone), keyed["__key"] == gone["__gone"], "left_anti")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is told with a sufficient margin; texts without a
    letter, null texts and close calls go. Dictionaries come from the rows that state a language."""
    dicts = language.fit(docs)
    judged = docs.withColumn("__lang", language.classifier(spark, dicts)("text"))
    return judged.where(F.col("__lang.accepted")).drop("__lang")


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicate texts stays (5 words, similarity 0.8): that of the smallest
    id that no other row has, else one of those whose id is shared or null. Rows that repeat an id and
    its text are one document; different texts under one id, or without an id, are compared like any
    others. Null and wordless texts are no one's near-duplicates and stay."""
    keyed = _keyed(docs)
    judged = near_dup.near_duplicates(keyed, k=5, num=80, den=100, id_col="__key")
    kept = _without(keyed, judged.where(~F.col("kept")), "doc_id")
    shared = F.col("__key") >= ROW_KEYS
    return kept.where(~shared).unionByName(kept.where(shared).dropDuplicates(["__key"])).select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated units leave the texts; every document stays. ``n_chars`` follows the text."""
    out = substring.substring_dedup(docs, every_line=True).drop("removed")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item go, whatever their id; all others stay, also those that share
    an id with them. Null, empty and wordless texts hold nothing; repeated rows are judged alike."""
    keyed = _keyed(docs)
    found = decontaminate.contaminations(keyed, table(spark, sf_dir, "benchmark"), id_col="__key")
    return _without(keyed, found, "doc_id").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their tokens (little-endian uint32 ids), sequence and offset. A
    null or empty text is its end token alone; repeated rows are packed each."""
    return packing.pack(docs, queries.tokenizer_path(), with_ids=True)


STAGES = [("language_id", language_stage), ("minhash_near_dup", near_dup_stage), ("substring_dedup", substring_stage),
          ("decontaminate", decontaminate_stage), ("packing", packing_stage)]
ORACLE_SQL = None      # compression, MinHash and the tokenizer have no SQL form; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return docs
