"""A saved vector index: unit vectors in cells around pivots, as a table partitioned by cell, with a manifest that is written last.

Search is exact and reads only the cells that can matter: with an angle a between a query and a cell's pivot and r the widest angle in
the cell, no vector of the cell scores more than cos(a - r). The nearest cells with enough vectors give each query a floor;
of the other cells only those whose bound reaches it are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

#: Pivots at most: their vectors and the queries' bounds for all of them are held in a task.
MOST_CELLS = 1024
#: What bounds may be off by, from rounding.
SLACK = 2e-9


def unit(c: str) -> Column:
    """The vector of length 1; a zero vector stays."""
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(c, lambda x: x / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


@pandas_udf(DoubleType())
def dot(a: pd.Series, b: pd.Series) -> pd.Series:
    """Inner products, of vectors of one length in numpy."""
    if not len(a):
        return pd.Series([], dtype="float64")
    return pd.Series(np.einsum("ij,ij->i", np.stack(a.to_list()), np.stack(b.to_list())))


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Whether an index was saved whole: the manifest is complete, which is written after everything else."""
    fs, at = _fs(spark, f"{path}/manifest/_SUCCESS")
    return fs.exists(at)


def save(vectors: DataFrame, path: str, id_col: str, vector_col: str, cells: int = 64) -> None:
    """Writes the vectors below ``path``; an older index there is taken away first, its manifest before its vectors.

    Pivots are ``cells`` of the vectors, chosen by a hash of their ids: how they fall decides how much a search reads, not what it finds.
    Null vectors and ids are left out; all vectors must have one length.
    """
    if not 1 <= cells <= MOST_CELLS:
        raise ValueError(f"1 to {MOST_CELLS} cells")
    spark = vectors.sparkSession
    for part in ("manifest", "vectors"):
        fs, at = _fs(spark, f"{path}/{part}")
        fs.delete(at, True)
    own = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).withColumn("v", unit("v"))
    chosen = own.orderBy(F.xxhash64("id"), "id").limit(cells).collect()  # bounded by MOST_CELLS
    pivots = np.array([r.v for r in chosen], float) if chosen else np.zeros((0, 1))

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cosines = np.stack(frame["v"].to_list()) @ pivots.T if len(frame) else np.zeros((0, len(pivots)))
            yield frame.assign(cell=cosines.argmax(axis=1).astype("int32"), cosine=cosines.max(axis=1))

    kind = own.schema["id"].dataType.simpleString()
    placed = own.mapInPandas(nearest, f"id {kind}, v array<double>, cell int, cosine double")
    # A file or some for each cell: rows are dealt by cell, and large cells may be split by Spark.
    placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/vectors")
    fields = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pivots)], "cell int, pivot array<double>")
    if not chosen:
        return fields.withColumns({"n": F.lit(0).cast("long"), "least": F.lit(1.0)}).write.parquet(f"{path}/manifest")
    sizes = spark.read.parquet(f"{path}/vectors").groupBy("cell").agg(F.count("*").alias("n"), F.min("cosine").alias("least"))
    fields.join(sizes, "cell").coalesce(1).write.parquet(f"{path}/manifest")


def search(spark: SparkSession, path: str, queries: DataFrame, query_id: str, vector_col: str, k: int, digits: int = 9) -> DataFrame:
    """query_id, doc_id, score, rank of the ``k`` vectors with the highest cosine, ties (to ``digits`` digits, nine at the most) by id, as if all had been compared."""
    if not exists(spark, path):
        raise FileNotFoundError(f"no whole index at {path}")
    manifest = spark.read.parquet(f"{path}/manifest").orderBy("cell").collect()  # one row a cell
    asked = queries.where(F.col(vector_col).isNotNull()).select(F.col(query_id).alias("query_id"), F.col(vector_col).cast("array<double>").alias("q")).withColumn("q", unit("q"))
    kind = asked.schema["query_id"].dataType.simpleString()
    if manifest:
        stored = spark.read.parquet(f"{path}/vectors").schema
        ids = stored["id"].dataType.simpleString()
    else:
        return spark.createDataFrame([], f"query_id {kind}, doc_id long, score double, rank int")
    pivots, cells = np.array([r.pivot for r in manifest], float), np.array([r.cell for r in manifest])
    sizes, widest = np.array([r.n for r in manifest]), np.arccos(np.clip([r.least for r in manifest], -1, 1))

    def bounds(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for q_id, q in zip(frame["query_id"], frame["q"], strict=True):
                length = np.linalg.norm(q)
                near = np.arccos(np.clip(pivots @ q, -1, 1)) if length else np.zeros(len(pivots))
                most = np.cos(np.maximum(near - widest, 0)) if length else np.zeros(len(pivots))
                order = np.argsort(-most, kind="stable")
                first = np.cumsum(sizes[order]) - sizes[order] < k  # enough vectors for a floor
                out += [(q_id, q, int(cells[c]), float(most[c]), bool(f)) for c, f in zip(order, first, strict=True)]
            yield pd.DataFrame(out, columns=["query_id", "q", "cell", "most", "first"])

    pairs = asked.mapInPandas(bounds, f"query_id {kind}, q array<double>, cell int, most double, first boolean")

    def scored(wanted: DataFrame) -> DataFrame:
        needed = [r[0] for r in wanted.select("cell").distinct().collect()]  # at most one a cell
        if not needed:
            return spark.createDataFrame([], f"query_id {kind}, doc_id {ids}, score double")
        data = spark.read.option("basePath", f"{path}/vectors").schema(stored).parquet(*(f"{path}/vectors/cell={c}" for c in sorted(needed)))
        return data.join(wanted.select("query_id", "q", "cell"), "cell").select("query_id", F.col("id").alias("doc_id"), F.round(dot("q", "v"), digits).alias("score"))

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    rank = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    ahead = rank(scored(pairs.where("first")))
    floors = ahead.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    rest = pairs.where("NOT first").join(floors, "query_id", "left").where(F.col("floor").isNull() | (F.col("most") >= F.col("floor") - SLACK))
    return rank(ahead.drop("rank").union(scored(rest)))


def cells_read(result: DataFrame) -> int:
    """How many cells' files a search result reads."""
    return len({f.rpartition("cell=")[2].partition("/")[0] for f in result.inputFiles() if "cell=" in f})
