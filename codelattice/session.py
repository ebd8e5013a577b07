"""Session helpers: tables by name, and lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset, a local master gets a folder on this machine and a warning; on a cluster there is none to choose, so it fails.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        warnings.warn("spark.checkpoint.dir is unset; this machine's temporary folder serves a local master", stacklevel=2)
        where = "file://" + os.path.join(tempfile.gettempdir(), "codelattice-checkpoints")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_stored: list[str] = []


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` written once as parquet to the shared folder and read back; columnar, so later reads prune.

    The folder goes with ``discard_stored`` or at the end of the process.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _stored:
        atexit.register(discard_stored)
    _stored.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard_stored(spark: SparkSession | None = None) -> int:
    """Deletes the folders that ``stored`` wrote; DataFrames that read them can't be used any more. How many were deleted."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return 0
    jvm, conf, n = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _stored:
        where = jvm.org.apache.hadoop.fs.Path(_stored.pop())
        n += bool(where.getFileSystem(conf).delete(where, True))
    return n


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
