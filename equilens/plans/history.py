"""Run history as a table that retries do not spoil.

A run is a partition (dataset, seed, config), config being a hash of what else the run was made with.
Saving it again replaces that partition only, so a repeated or retried run leaves one row, and runs
made side by side do not touch each other's rows. The audit summary is kept the same way: only the
partitions of the datasets whose runs changed are written anew.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import report as rp

KEYS = ("dataset", "seed", "config")


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


class RunStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _read(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.option("mergeSchema", True).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def _write(self, df: DataFrame, name: str, keys: tuple[str, ...]) -> None:
        # the key columns become folder names; their values stay as columns of their own, since folder
        # names are read back with guessed types
        df = df.withColumns({f"__{k}": F.col(k).cast("string") for k in keys})
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*[f"__{k}" for k in keys]).parquet(
            f"{self.path}/{name}")

    def save(self, runs: DataFrame, config: dict) -> None:
        """Adds the runs; those of the same dataset, seed and configuration are replaced."""
        self._write(runs.withColumn("config", F.lit(config_hash(config))), "runs", KEYS)

    def runs(self, config: dict | None = None) -> DataFrame:
        """Saved runs (of one configuration), in the schema of run rows."""
        df = self._read("runs")
        if df is None:
            return self.spark.createDataFrame([], rp.RUNS_SCHEMA)
        if config is not None:
            df = df.where(F.col("config") == config_hash(config))
        return df.select(*[f.name for f in rp.RUNS_SCHEMA.fields])

    def done(self, config: dict) -> set[tuple[str, int]]:
        return {(r["dataset"], r["seed"]) for r in self.runs(config).select("dataset", "seed").collect()}

    def refresh_summary(self, datasets: list[str] | None = None) -> DataFrame:
        """Writes the audit summary (A7) of the given datasets (None: all) anew and returns all of it."""
        df = self._read("runs")
        if df is not None:
            if datasets is not None:
                df = df.where(F.col("dataset").isin(list(datasets)))
            self._write(rp.audit_summary(df), "summary", ("dataset",))
        out = self._read("summary")
        return self.spark.createDataFrame([], "dataset string, seed int") if out is None else out.drop("__dataset")

    def export(self, folder: str) -> None:
        """Run rows as one CSV table (A6), the audit summary as JSON (A7), the console view as Markdown."""
        from ..sources.tables import write_json, write_markdown, write_table
        runs = self.runs()
        write_table(rp.flatten_runs(runs), f"{folder}/raw_measurements.csv", "csv")
        write_json(rp.audit_summary(runs), f"{folder}/audit_summary.json")
        view = rp.summary_view(runs)
        line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in view.columns]), F.lit(" |"))
        head = self.spark.createDataFrame([(0, "| " + " | ".join(view.columns) + " |"), (1, "|" + "---|" * len(view.columns))], "k int, line string")
        write_markdown(head.unionByName(view.select(F.lit(2).alias("k"), line.alias("line"))).orderBy("k", "line").select("line"),
                       f"{folder}/summary.md")
