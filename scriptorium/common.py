"""Session helpers shared by all operators: table access, the shared scratch folder, staged tables.

A staged table is a written one: it cuts the lineage and survives the loss of any executor.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCRATCH_KEY = "spark.checkpoint.dir"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory (a file or a directory of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where the setting is absent and Spark runs in one process (tests, a laptop) a local folder is
    made and set; on a cluster a missing setting is an error, since a local folder is not shared.
    """
    configured = spark.conf.get(SCRATCH_KEY, None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError(f"{SCRATCH_KEY} must name a folder all executors share")
    made = tempfile.mkdtemp(prefix="scriptorium-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for a table written by a running query."""
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def local_path(uri: str) -> str:
    """A ``file:`` URI as a plain path, so that Python workers can open it."""
    if uri.startswith("file:"):
        return "/" + uri[len("file:"):].lstrip("/")
    return uri


_STAGED: list[str] = []


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return a scan of it (columnar, prunable).

    Results read such tables, so they stay until ``release_stages``, or until Spark ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    _STAGED.append(path)
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)


def release_stages(spark: SparkSession) -> int:
    """Delete the tables staged so far, once the results that read them are written; returns how many."""
    jvm, configuration = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = len(_STAGED)
    while _STAGED:
        path = jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        path.getFileSystem(configuration).delete(path, True)
    return n


def block_of(index: Column, bits: int) -> Column:
    """The number of the ``2**bits`` wide key range an integer key falls in; NULL counts as 0."""
    return F.shiftright(F.coalesce(index.cast("long"), F.lit(0)), bits)


def env_path(name: str, default: str) -> str:
    return os.environ.get(name, default)
