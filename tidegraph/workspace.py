"""Shared scratch space: tables that cut lineage and outlive an executor.

Every intermediate result that is read more than once is written as Parquet under the folder
named by ``spark.checkpoint.dir``, which all executors and the driver can reach.  Only where
that setting is missing *and* the master is local is a folder of our own used.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}


def plain_unions(spark: SparkSession) -> None:
    """Switch off, for the session, that a union counts as partitioned as its tables are.

    Spark 4.1 takes a union for partitioned even where adaptive execution, or a bucketed table that is read otherwise, has changed one of its
    tables, and does not deal it out anew: groups then come out twice.  All queries of this library go through here.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def shared_root(spark: SparkSession) -> str:
    """The folder for scratch tables; raises on a cluster that names none."""
    plain_unions(spark)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        root = _LOCAL_ROOTS.setdefault(app, "file://" + tempfile.mkdtemp(prefix="tidegraph-"))
    return root.rstrip("/") + "/tidegraph"


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop_path.getParent())
    fs.deleteOnExit(hadoop_path)
    return path


def keep(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader of what was written."""
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._scratch = path
    return kept


def release(*kept: DataFrame) -> None:
    """Delete tables that ``keep`` wrote and that no DataFrame still to be run reads."""
    for df in kept:
        hadoop_path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch)
        fs = hadoop_path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
        fs.delete(hadoop_path, True)


@contextmanager
def configured(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Session settings for the jobs that run inside; as before afterwards."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
