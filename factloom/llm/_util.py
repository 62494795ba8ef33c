"""Helpers shared by the corpus operators: checkpoints, row keys, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sides of at most this many rows are broadcast; larger ones take the shuffle path.
BROADCAST_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Only a session that runs in one local process (tests) falls back to a temporary folder of its own.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir is not set")
        current = sc._jsc.sc().getCheckpointDir()
        folder = tempfile.mkdtemp(prefix="factloom-") if current.isEmpty() else current.get()
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the cluster's checkpoint folder, with its lineage cut."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def _hadoop(spark: SparkSession, at: str):
    """(file system, path) of a place."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def until_exit(spark: SparkSession, at: str) -> str:
    """``at``, which goes when the driver's JVM ends."""
    fs, path = _hadoop(spark, at)
    fs.deleteOnExit(path)
    return at


def remove(spark: SparkSession, at: str) -> None:
    fs, path = _hadoop(spark, at)
    fs.delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the cluster's shared folder, with its lineage cut; smaller than a checkpoint."""
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(until_exit(spark, at))


def fresh(prefix: str) -> str:
    """A column name that no input can have."""
    return f"__{prefix}_{uuid.uuid4().hex[:12]}"


def _part(c: Column) -> Column:
    """A text that tells NULL from any value."""
    return F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n"))


def row_key(df: DataFrame, seed: int) -> Column:
    """64-bit hash of all columns of a row; two seeds together identify its content."""
    return F.xxhash64(F.lit(seed), *[_part(F.col(f"`{c}`")) for c in df.columns])


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, else unhinted.

    ``df`` should be checkpointed: counting runs it.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)
