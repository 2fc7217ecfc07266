"""Cutting long plans at results that are used several times."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="lectern-")


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``.

    Without one, a session in a single process takes a temporary folder; a cluster has no folder
    that all its machines see, so it must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder()


def run_folder(spark: SparkSession) -> str:
    """A folder of this application below the shared one, removed when the application ends."""
    path = f"{shared_folder(spark).rstrip('/')}/lectern-{spark.sparkContext.applicationId}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(hadoop)
    files.deleteOnExit(hadoop)
    return path


def let_workers_import(spark: SparkSession) -> None:
    """Python workers on this machine find the package from any folder; a cluster ships it."""
    root, environment = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])


#: With this setting the shuffle files of a query go when it ends, not when the driver collects its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def cut_lineage(df: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the run's shared folder and go on from there.

    The copy outlives any executor.  Being columnar it is read by column, filters are pushed
    into it, and its size is known, so later joins are planned with real numbers.  Nothing needs
    the shuffle files of the query that wrote it, so they go at once.  Python gets at most
    ``batch_rows`` rows at once, for tables of long rows.
    """
    path, conf = f"{run_folder(df.sparkSession)}/{uuid.uuid4().hex}", df.sparkSession.conf
    before = {k: conf.get(k) for k in (FREE_SHUFFLES, BATCH_ROWS)}
    conf.set(FREE_SHUFFLES, "true")
    conf.set(BATCH_ROWS, str(batch_rows or before[BATCH_ROWS]))
    try:
        df.write.parquet(path)
    finally:
        for k, value in before.items():
            conf.set(k, value)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Remove a table as ``cut_lineage`` returned it; nothing that reads it may be used any more."""
    root, context = run_folder(df.sparkSession), df.sparkSession.sparkContext
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(context._jvm.java.net.URI.create(folder))
        if path.getParent().getName() == os.path.basename(root):
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
