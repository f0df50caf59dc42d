"""Session helpers: shared scratch space, lineage cuts and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table may be broadcast or held by every Python worker.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where the session names none and all runs on one machine (tests) a
    temporary folder is set instead; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    here = spark.sparkContext._jsc.sc().getCheckpointDir()
    if here.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        here = spark.sparkContext._jsc.sc().getCheckpointDir()
    return here.get().rstrip("/")


def stash(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back; this runs its job at once.

    Cuts the lineage so that later stages neither recompute it nor depend on
    the executor that made it.  The tables of a session lie in one folder,
    which :func:`clear_stash` removes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_stash(spark: SparkSession) -> None:
    """Removes the tables that :func:`stash` wrote in this session; frames that still read them can't be used any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/stash-{spark.sparkContext.applicationId}")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``limit`` rows; reads no more than that."""
    return df.select(F.lit(1)).limit(limit + 1).count() <= limit


def hinted(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows allow it, else as it is."""
    return F.broadcast(df) if small(df, limit) else df
