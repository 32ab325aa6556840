"""What the operators of this package share: scratch tables that every executor can read."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files of a finished job go at once; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it names none, a folder is made, but only on a single machine, as in tests: on a cluster, executors could not read it.
    """
    context = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not there and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(there or tempfile.mkdtemp(prefix="tidemark-"))
    if there:
        return there
    return context._jsc.sc().getCheckpointDir().get()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within, each job's shuffle files go when it ends. For tables that are written or checkpointed; what is to be run later is made outside."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, its lineage cut. For narrow tables: the files are not compressed."""
    scratch_dir(df.sparkSession)
    return df.checkpoint()


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clean(spark: SparkSession) -> None:
    """Removes the tables that ``written`` has left in the scratch folder. For when no result that was made from them is still to be read."""
    _remove(spark, f"{scratch_dir(spark)}/tables")


def removed(table: DataFrame) -> None:
    """Removes one table that ``written`` gave, once all that reads it has been written itself."""
    for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
        _remove(table.sparkSession, path)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared scratch folder, its lineage cut and its shuffle files removed. For wider tables."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tables/{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
