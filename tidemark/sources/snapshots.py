"""Results that are replaced as a whole, and loads that can be run again: readers see the old or the new state, never a half of one."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, replaced by one rename: written beside, then put in its place by the file system."""
    fs, at = _path(spark, path)
    _, aside = _path(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(aside, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(aside), fs.makeQualified(at), overwrite)


def get_text(spark: SparkSession, path: str) -> str | None:
    """The whole of a small file; null if it isn't there."""
    fs, at = _path(spark, path)
    if not fs.exists(at):
        return None
    return spark.read.text(path, wholetext=True).first()[0]


def replace(df: DataFrame, path: str, kind: str = "json", keep: int = 2) -> str:
    """Replaces the table at ``path`` as a whole, and returns its version.

    The rows are written to a folder of their own; then the pointer file is put in place by one rename. Who reads meanwhile goes on with
    the version that the pointer named; of older ones the last ``keep`` stay. A failure before the rename leaves all as it was.
    """
    spark = df.sparkSession
    version = uuid.uuid4().hex
    df.write.format(kind).save(f"{path}/v-{version}")
    before = json.loads(get_text(spark, f"{path}/current.json") or '{"versions": []}')["versions"]
    put_text(spark, f"{path}/current.json", json.dumps({"kind": kind, "versions": [version, *before][: keep + 1], "schema": df.schema.jsonValue()}))
    for old in before[keep:]:
        fs, at = _path(spark, f"{path}/v-{old}")
        fs.delete(at, True)
    return version


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table that was put at ``path`` last."""
    from pyspark.sql.types import StructType

    pointer = get_text(spark, f"{path}/current.json")
    if pointer is None:
        raise FileNotFoundError(path)
    pointer = json.loads(pointer)
    return spark.read.format(pointer["kind"]).schema(StructType.fromJson(pointer["schema"])).load(f"{path}/v-{pointer['versions'][0]}")


def load_new(rows: DataFrame, path: str, keys: Sequence[str], note: str = "") -> dict:
    """Appends to the Parquet table at ``path`` the rows whose keys it lacks (one of each), and tells of the load in its ledger.

    Rows are counted while they are written: the target is read once, its key columns alone, and no more. A load that failed is run again
    with the same rows: what it had committed is there, the rest is new. Returns the ledger's line: load, rows, note.
    """
    spark = rows.sparkSession
    fs, at = _path(spark, path)
    fresh = rows.dropDuplicates(list(keys))
    if fs.exists(at):
        there = spark.read.parquet(path).select(*(F.col(k).alias(f"_{k}") for k in keys))
        same = None
        for k in keys:
            one = F.col(k).eqNullSafe(F.col(f"_{k}"))
            same = one if same is None else same & one
        fresh = fresh.join(there, same, "left_anti")
    seen = Observation()
    load = uuid.uuid4().hex
    fresh.observe(seen, F.count("*").alias("rows")).write.mode("append").parquet(path)
    line = {"load": load, "rows": seen.get["rows"], "note": note}
    put_text(spark, f"{path}_ledger/{load}.json", json.dumps(line))
    return line


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """load, rows, note of each load of load_new()."""
    return spark.read.schema("load string, rows long, note string").json(f"{path}_ledger")
