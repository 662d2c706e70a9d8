"""Lineage cuts, and joins that no single key can slow down."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most so many rows may be broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 500_000
#: A key with more than one in so many of a task's fair share of rows is joined without a shuffle.
FAIR = 4

_SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only a local master may do without: it gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quire-"))
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
    return known.get().rstrip("/")


@contextmanager
def sweeping(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside remove their shuffle files when they end, for what they write replaces them."""
    before = spark.conf.get(_SWEEP, "false")
    spark.conf.set(_SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.set(_SWEEP, before)


def delete_on_exit(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder as Parquet and return the written table.

    Later jobs read the files, so a lost executor costs no recomputation of what came before, and the
    shuffles that led to them are removed at once. The folder is removed when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire-{name}-{uuid.uuid4().hex}"
    with sweeping(spark):
        df.write.option("compression", codec).parquet(path)
    delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def small(side: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """side with a broadcast hint if it has at most so many rows (counted), else side as it is.

    The rows of such a side must be of a bounded width (keys and numbers, no texts).
    """
    return F.broadcast(side) if side.limit(rows + 1).count() <= rows else side


def looked_up(rows: DataFrame, side: DataFrame, key: str, weight: str, total: int, rows_bound: int = BROADCAST_ROWS) -> DataFrame:
    """rows with the columns of side (one row for each key that is not null; null where a key is missing).

    `weight` is a column of side, dropped again: how many of the `total` rows have the key. A side that is
    not small is shuffled, but keys with more than 1 / (FAIR * partitions) of the rows are broadcast (so
    there are at most FAIR * partitions of them), and rows without a key stay where they are.
    """
    spark = rows.sparkSession
    plain = side.drop(weight)
    if side.limit(rows_bound + 1).count() <= rows_bound:
        return rows.join(F.broadcast(plain), key, "left")
    shares = FAIR * int(spark.conf.get("spark.sql.shuffle.partitions"))
    many = F.col(weight) * shares > total
    hot = F.broadcast(side.where(many).drop(weight))
    known = F.broadcast(side.where(many).select(key, F.lit(True).alias("_hot")))
    marked = rows.join(known, key, "left")
    alone = F.col(key).isNull() | F.col("_hot").isNotNull()
    return marked.where(alone).join(hot, key, "left").unionByName(marked.where(~alone).join(side.where(~many).drop(weight), key, "left")).drop("_hot")
