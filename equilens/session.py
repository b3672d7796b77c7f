"""Session helpers: a local session for tests/bench, and the checkpoint folder.

On a cluster the session comes from the caller; we only read
``spark.checkpoint.dir`` from it. A directory of our own is set only when the
setting is absent (local tests), never on a cluster that names one.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession


def local_session(cores: int | str = "*", app: str = "equilens",
                  shuffle_partitions: int | None = None) -> SparkSession:
    parts = shuffle_partitions or (8 if cores == "*" else int(cores))
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("EQUILENS_DRIVER_MEM", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    d = spark.sparkContext.getCheckpointDir()
    if d:
        return d
    return spark.conf.get("spark.checkpoint.dir", None) or None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; set a local one only if unset."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        local = tempfile.mkdtemp(prefix="equilens-ckpt-")
        sc.setCheckpointDir(local)
        return sc.getCheckpointDir()
    raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows dealt over all cores (by ``keys`` if given), for steps that make much work of each row:
    Spark sizes the partitions of what it reads by bytes, so a table of few bytes would keep few cores busy."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def together(spark: SparkSession, steps: dict[str, Callable[[], Any]], at_once: int = 2) -> dict[str, Any]:
    """The results of steps that do not need each other, ``at_once`` of them side by side: while one waits for the
    driver or for its last tasks, the cores work for another. The first error in the order of the steps is raised."""
    def run(step: Callable[[], Any]) -> Any:
        spark._jvm.SparkSession.setActiveSession(spark._jsparkSession)
        return step()
    with ThreadPoolExecutor(max(1, min(at_once, len(steps)))) as pool:
        done = {k: pool.submit(inheritable_thread_target(spark)(run), f) for k, f in steps.items()}
    return {k: f.result() for k, f in done.items()}


def cut_observed(df: DataFrame, name: str, **metrics) -> tuple[DataFrame, dict]:  # noqa: ANN003
    """``cut_lineage`` and the given aggregates of its rows, observed while they are written (no job of
    their own)."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    out = cut_lineage(df.observe(seen, *[m.alias(k) for k, m in metrics.items()]), name)
    return out, seen.get


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a Parquet table under the shared checkpoint folder and read
    it back: one job, lineage cut, survives executor loss (the files live on the
    shared file system, not on an executor), and later reads prune columns."""
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
