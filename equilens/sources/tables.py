"""Readers and writers.

Parquet is the default format; CSV (header / no header / separator / null
tokens / leading-space skip) and nested JSON readers cover the reference's
inputs. Column pruning and filters are left to Catalyst, so callers select
only what they need and the scan reads only those columns.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..session import cut_lineage

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: list[str] | None = None) -> DataFrame:
    """Parquet table ``name`` under ``sf_dir``; optional column projection."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None, *,
             header: bool = True, sep: str = ",", null_tokens: list[str] | None = None,
             skip_leading_space: bool = False, comment: str | None = None) -> DataFrame:
    """CSV scan. ``null_tokens`` become NULL after the read (several allowed)."""
    r = spark.read.option("header", header).option("sep", sep)
    if skip_leading_space:
        r = r.option("ignoreLeadingWhiteSpace", True)
    if comment:
        r = r.option("comment", comment)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    df = r.csv(path)
    if null_tokens:
        from ..operators.prep import null_tokens as _nt
        df = _nt(df, null_tokens)
    return df


# Cells that a CSV reader of data frames takes for missing by default
MISSING_WORDS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
                 "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


class CsvScan(NamedTuple):
    """``rows`` in the wanted types; ``rejects`` (reason, column, value, n): broken lines, which are not
    among the rows, and cells that are no number, which are NULL there."""
    rows: DataFrame
    rejects: DataFrame


def scan_csv(spark: SparkSession, path: str | list[str], schema: StructType | None = None, *, header: bool = True, sep: str = ",",
             null_tokens: Sequence[str] = (), missing: Sequence[str] = MISSING_WORDS, skip_leading_space: bool = False,
             comment: str | None = None) -> CsvScan:
    """CSV scan that loses nothing silently. Cells are read as text; ``missing`` words and ``null_tokens``
    are NULL; of typed columns other text is cast, and what cannot be cast is NULL and among the rejects,
    as are lines with too few or too many cells, whole. Without a ``schema`` names come from the header and
    a column is long or double if all its cells that are not missing can be cast (one aggregate), else
    text. Lines are parsed once: the cells are written as a table that rows and rejects both read."""
    names = [f.name for f in schema.fields] if schema is not None else _header(spark, path, sep)
    text = StructType([StructField(c, StringType()) for c in [*names, "__line"]])
    r = (spark.read.schema(text).option("header", header).option("sep", sep).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", "__line").option("enforceSchema", True)
              .option("ignoreLeadingWhiteSpace", skip_leading_space))
    if comment:
        r = r.option("comment", comment)
    cells = cut_lineage(r.csv(path), "cells")
    none = list({*missing, *null_tokens})
    good = cells.where(F.col("__line").isNull())
    known = {c: F.when(~F.trim(f"`{c}`").isin(none), F.col(f"`{c}`")) for c in names}
    if schema is None:
        fits = good.agg(*[F.count(F.when(known[c].isNotNull() & F.trim(known[c]).try_cast(t).isNull(), 1)).alias(f"{t}{i}")
                          for i, c in enumerate(names) for t in ("bigint", "double")],
                        *[F.count(known[c]).alias(f"n{i}") for i, c in enumerate(names)]).first()
        kinds = [LongType() if fits[f"n{i}"] and not fits[f"bigint{i}"] else DoubleType() if fits[f"n{i}"] and not fits[f"double{i}"]
                 else StringType() for i in range(len(names))]
        schema = StructType([StructField(c, k) for c, k in zip(names, kinds)])
    typed = [f for f in schema.fields if not isinstance(f.dataType, StringType)]
    cast = {f.name: F.trim(known[f.name]).try_cast(f.dataType) for f in typed}
    rows = good.select(*[cast.get(f.name, known[f.name]).alias(f.name) for f in schema.fields])
    rejects = cells.where(F.col("__line").isNotNull()).groupBy(F.col("__line").alias("value")).agg(
        F.count(F.lit(1)).alias("n")).select(F.lit("broken line").alias("reason"), F.lit(None).cast("string").alias("column"), "value", "n")
    if typed:
        bad = good.select(F.inline(F.array(*[F.struct(
            F.lit(f.name).alias("column"), F.when(known[f.name].isNotNull() & cast[f.name].isNull(), F.col(f"`{f.name}`")).alias("value"))
            for f in typed]))).where(F.col("value").isNotNull())
        rejects = rejects.unionByName(bad.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).select(
            F.lit("not of the type").alias("reason"), "column", "value", "n"))
    return CsvScan(rows, rejects)


def _header(spark: SparkSession, path: str | list[str], sep: str) -> list[str]:
    """Column names of CSV files that share a header."""
    return spark.read.option("header", True).option("sep", sep).csv(path).columns


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_markdown(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``lines`` has one string column ``line``; written as text, one part per task."""
    lines.select(F.col("line").cast("string").alias("value")).write.mode(mode).text(path)


def sized_broadcast(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast-hint ``df`` only when it provably holds at most ``max_rows`` rows.

    The check reads at most ``max_rows + 1`` rows per partition (a limit, not a
    full count) at every use, since a table may grow under the same path; larger inputs stay unhinted and Spark/AQE picks a shuffle join.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
