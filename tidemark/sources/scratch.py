"""Where derived tables may be kept that all executors have to read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder of ``spark.checkpoint.dir``; on a single machine without one, below a temporary folder."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{there or tempfile.mkdtemp(prefix='tidemark-')}/{name}-{uuid.uuid4().hex}"
