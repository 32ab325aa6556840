"""Exact top-k inner-product search by distributed histogram selection.

Vectors become blocks of rows, a numpy matrix each. Every block of queries meets every block of candidates (both dealt over
slots, so that no task gets all of a block's partners and nothing is broadcast) and all pairs are scored, once a round:

1. Each round counts the scores of a query in BINS equal bins of the range where its k-th score lies; the counts of all
   tasks are summed, and the bin that holds the k-th largest score is the next range, until a bin is one whole number. Of a
   pair of blocks only the bins down to its own k-th score are sent on: the global one can't be lower.
2. A last pass keeps the scores above the k-th value, and of those equal to it the k smallest ids of each block: enough,
   since no more can be needed. A ranked selection per query breaks the remaining ties by id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.shared import checkpointed, written
from tidemark.sources import table

BINS = 1024
#: Rows of a block of queries and of candidates; one pair of blocks is scored at a time.
QUERY_BLOCK, CANDIDATE_BLOCK = 512, 1024
#: Every block of queries is copied to so many slots, over which the blocks of candidates are dealt.
SLOTS = 16
SCALE = 256
#: Sums of products of whole numbers up to here are exact in doubles.
EXACT = float(1 << 53)
LOWEST = np.iinfo(np.int64).min


def whole_numbers(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and x, the components times SCALE rounded down, of the rows whose vector is whole and finite."""
    finite = F.forall("v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.where("vec_id IS NOT NULL AND v IS NOT NULL").where(finite).select("vec_id", F.transform("v", lambda v: F.floor(v * SCALE).cast("double")).alias("x"))


def _pack(part: pd.DataFrame) -> tuple[bytes, bytes, int, int]:
    """ids, matrix, bytes of a number, width of the rows; shorter vectors are filled up with zeros, which add nothing."""
    width = max(1, max(len(x) for x in part["x"]))
    m = np.zeros((len(part), width))
    for i, x in enumerate(part["x"]):
        m[i, : len(x)] = x
    small = np.abs(m).max(initial=0) < 32768
    return part["vec_id"].to_numpy("<i8").tobytes(), m.astype("<i2" if small else "<f8").tobytes(), 2 if small else 8, width


def _matrix(m: bytes, size: int, width: int) -> np.ndarray:
    return np.frombuffer(m, "<i2" if size == 2 else "<f8").astype(np.float64).reshape(-1, width)


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whole inner products; what one vector has beyond the other's length counts nothing."""
    width = min(q.shape[1], c.shape[1])
    q, c = q[:, :width], c[:, :width]
    most = width * max(1.0, np.abs(q).max(initial=0)) * max(1.0, np.abs(c).max(initial=0))
    if most < EXACT:
        return (q @ c.T).astype(np.int64)
    if most < 2.0**62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    raise OverflowError("inner products beyond 64 bits")


def _candidate_blocks(rows: DataFrame) -> DataFrame:
    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        slot = 7 * TaskContext.get().partitionId()
        for frame in frames:
            for at in range(0, len(frame), CANDIDATE_BLOCK):
                yield pd.DataFrame([(slot % SLOTS, *_pack(frame.iloc[at : at + CANDIDATE_BLOCK]))], columns=["slot", "ids", "m", "size", "width"])
                slot += 1

    return rows.mapInPandas(pack, "slot int, ids binary, m binary, size int, width int")


def _query_blocks(rows: DataFrame, blocks: int) -> DataFrame:
    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id")
        return pd.DataFrame([(frame["block"].iloc[0], *_pack(frame))], columns=["block", "q_ids", "q_m", "q_size", "q_width"])

    return rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).groupBy("block").applyInPandas(pack, "block int, q_ids binary, q_m binary, q_size int, q_width int")


def _scored(pairs: DataFrame, per_pair: Callable, schema: str) -> DataFrame:
    """``per_pair(query ids, candidate ids, scores, row)`` of each pair of blocks; a query's own row has the score LOWEST."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                q_ids, ids = np.frombuffer(row.q_ids, "<i8"), np.frombuffer(row.ids, "<i8")
                s = scores(_matrix(row.q_m, row.q_size, row.q_width), _matrix(row.m, row.size, row.width))
                s[q_ids[:, None] == ids[None]] = LOWEST
                yield per_pair(q_ids, ids, s, row)

    return pairs.mapInPandas(run, schema)


def top_k(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` highest scores of each row whose id meets ``is_query``.

    Score: inner product of the components times 256, rounded down. Candidates are all rows but those with the query's own
    id; fewer than ``k`` give all; ties go to the smaller vec_id. Rows with a null id or vector, or with a component that is
    null or not finite, take no part. Of vectors of unlike length the longer counts up to the shorter's length. Repeated
    candidate rows are ranked each; of queries with one id the smallest vector asks. An empty table gives no rows; other
    columns are ignored, whatever their names.
    """
    rows = whole_numbers(vectors, id_col, vector_col)
    asked = rows.where(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min("x").alias("x"))
    # The largest |score| by Cauchy and Schwarz: a bound on the first range.
    facts = rows.agg(F.max(F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))).alias("norm"), F.count(F.when(is_query(F.col("vec_id")), 1)).alias("queries")).first()
    bound = int((facts["norm"] or 0.0) ** 2 * (1 + 1e-9)) + 1
    rounds = 1
    while BINS**rounds < 2 * bound + 1:
        rounds += 1
    blocks = max(1, -(-facts["queries"] // QUERY_BLOCK))
    queries = written(_query_blocks(asked, blocks))
    candidates = _candidate_blocks(rows).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def joined(state: DataFrame | None) -> DataFrame:
        own = queries if state is None else queries.join(state.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("query_id", "low"))).alias("state")).select("block", F.col("state.low").alias("low")), "block")
        return candidates.join(own.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1)))), ["block", "slot"])

    state = None
    for r in range(rounds):
        width = BINS ** (rounds - 1 - r)

        def histogram(q_ids, ids, s, row, width=width, first=r == 0):
            low = np.full(len(q_ids), -bound) if first else np.asarray(row.low, dtype=np.int64)
            high = low + BINS * width
            n = min(k, s.shape[1])
            kth = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
            i, j = np.nonzero((s >= np.maximum(np.minimum(kth, high - 1), low)[:, None] - (width - 1)) & (s >= low[:, None]) & (s != LOWEST))
            # Scores above the range count in one bin beyond it.
            spot = i * (BINS + 1) + np.minimum((s[i, j] - low[i]) // width, BINS)
            spot, n = np.unique(spot, return_counts=True)
            return pd.DataFrame({"block": row.block, "query_id": q_ids[spot // (BINS + 1)], "low": low[spot // (BINS + 1)], "bin": (spot % (BINS + 1)).astype(np.int32), "n": n})

        counted = _scored(joined(state), histogram, "block int, query_id long, low long, bin int, n long").groupBy("block", "query_id", "low", "bin").agg(F.sum("n").alias("n"))
        bins = counted.groupBy("block", "query_id", "low").agg(F.reverse(F.array_sort(F.collect_list(F.struct("bin", "n")))).alias("bins"))
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).alias("bin"))
        reach = F.aggregate("bins", start, lambda a, b: F.when(a["seen"] >= k, a).otherwise(F.struct((a["seen"] + b["n"]).alias("seen"), b["bin"].alias("bin"))))
        state = checkpointed(bins.select("block", "query_id", (F.col("low") + reach["bin"] * F.lit(width)).alias("low")))

    def winners(q_ids, ids, s, row):
        low = np.asarray(row.low, dtype=np.int64)[:, None]
        order = np.argsort(ids, kind="stable")
        s, ids = s[:, order], ids[order]
        tie = (s == low) & (low != LOWEST)
        i, j = np.nonzero((s > low) | tie & (np.cumsum(tie, axis=1) <= k))
        return pd.DataFrame({"query_id": q_ids[i], "vec_id": ids[j], "score": s[i, j]})

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = _scored(joined(state), winners, "query_id long, vec_id long, score long")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``embeddings``; queries are the rows whose vec_id is divisible by 50."""
    return top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


ORACLE_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
