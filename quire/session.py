"""Session helpers shared by every query."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quire")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("QUIRE_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, and keep Arrow batches small.

    Workers get the folder the driver imported the package from; where the package is installed on the
    executors the extra entry does no harm. Batches are bounded in bytes, so a batch of very long texts
    needs no more memory than one of short texts.
    """
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, path) if x)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def lean_workers(spark: SparkSession) -> None:
    """Let Python workers give the memory of large arrays back as soon as these are freed.

    For applications of many different stages, whose workers are reused and would keep the peak of each; it
    costs some time, since fresh pages have to be cleared.
    """
    env = spark.sparkContext.environment
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    env.setdefault("MALLOC_MMAP_THRESHOLD_", str(1 << 20))
    env.setdefault("MALLOC_TRIM_THRESHOLD_", str(4 << 20))
    env.setdefault("MALLOC_ARENA_MAX", "2")


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
