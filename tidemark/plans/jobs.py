"""Queries on progress, ranges, and indexes that are saved and loaded."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import metrics, ranges, vector_index
from tidemark.plans import retrieval
from tidemark.plans.registry import registry
from tidemark.sources import table
from tidemark.sources.scratch import scratch_path
from tidemark.streaming import progress

QUERIES, ORACLE, query = registry()


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, CASE WHEN event_type = 'signup' THEN 'QUEUED' WHEN event_type = 'view' THEN 'BUILDING_SECTION' WHEN event_type = 'click' THEN 'BUILDING_INDEX' WHEN event_type = 'purchase' AND value > 50 THEN 'READY' WHEN event_type = 'purchase' THEN 'BUILDING_PACKAGES'
      WHEN event_type = 'error' AND value < 5 THEN 'FAILED' WHEN event_type = 'error' THEN 'LOST' ELSE 'BUILDING_INDEX' END AS stage, CASE WHEN value > 90 THEN NULL ELSE CAST(floor(value) AS INT) END AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE user_id IS NOT NULL),
  f AS (SELECT user_id, 0::BIGINT AS n, 'QUEUED' AS now, 0 AS so_far, NULL::BIGINT AS event_id, 'ok' AS verdict FROM (SELECT DISTINCT user_id FROM e)
    UNION ALL SELECT user_id, n, CASE WHEN verdict = 'ok' THEN stage ELSE now END, CASE WHEN verdict = 'ok' AND stage <> 'FAILED' THEN coalesce(p, so_far) ELSE so_far END, event_id, verdict FROM (
      SELECT e.user_id, e.n, e.event_id, e.stage, e.p, f.now, f.so_far, CASE WHEN e.stage = 'LOST' THEN 'unknown' WHEN f.now IN ('READY', 'FAILED') THEN 'ended' WHEN e.stage = 'FAILED' THEN 'ok'
        WHEN e.stage <> f.now AND (f.now, e.stage) NOT IN (('QUEUED', 'BUILDING_SECTION'), ('QUEUED', 'READY'), ('BUILDING_SECTION', 'BUILDING_INDEX'), ('BUILDING_INDEX', 'BUILDING_PACKAGES'), ('BUILDING_PACKAGES', 'READY')) THEN 'skipped'
        WHEN e.p < f.so_far THEN 'backwards' ELSE 'ok' END AS verdict FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1))
  SELECT user_id::VARCHAR AS job, max_by(now, n) AS stage, max_by(so_far, n) AS progress, count(*) AS events, count(*) FILTER (verdict <> 'ok') AS illegal, min(event_id) FILTER (verdict <> 'ok') AS first_illegal FROM f WHERE n > 0 GROUP BY 1""")
def job_progress(spark, sf_dir):
    """Stages of jobs by the steps that are allowed; unknown, skipped, backward and late steps are counted and change nothing."""
    e = table(spark, sf_dir, "events")
    stage = F.expr("""CASE WHEN event_type = 'signup' THEN 'QUEUED' WHEN event_type = 'view' THEN 'BUILDING_SECTION' WHEN event_type = 'click' THEN 'BUILDING_INDEX' WHEN event_type = 'purchase' AND value > 50 THEN 'READY'
      WHEN event_type = 'purchase' THEN 'BUILDING_PACKAGES' WHEN event_type = 'error' AND value < 5 THEN 'FAILED' WHEN event_type = 'error' THEN 'LOST' ELSE 'BUILDING_INDEX' END""")
    rows = e.select(F.col("user_id").cast("string").alias("job"), F.col("event_id").alias("seq"), stage.alias("stage"), F.expr("CASE WHEN value > 90 THEN NULL ELSE CAST(floor(value) AS INT) END").alias("progress"))
    return progress.last_states(progress.judged(rows))


@query("""WITH p AS (SELECT event_id, user_id, epoch_us(ts) AS t, value, event_type FROM events), i AS (SELECT event_id AS from_event, user_id, t - CAST(floor(value * 600) AS BIGINT) * 1000000 AS start, t AS "end" FROM p WHERE event_type = 'error')
  SELECT from_event, count(*) AS n, count(*) FILTER (p.user_id = i.user_id) AS own, round(sum(value), 4) AS total FROM i JOIN p ON p.t > i.start AND p.t <= i."end" GROUP BY 1""")
def events_before_errors(spark, sf_dir):
    """All events in the time before each error, intervals of very unlike lengths."""
    p = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "value", "event_type")
    i = p.where("event_type = 'error'").select(F.col("event_id").alias("from_event"), F.col("user_id").alias("of_user"), (F.col("t") - F.floor(F.col("value") * 600) * 1000000).alias("start"), F.col("t").alias("end"))
    # Values as decimals, whose running sums are exact; what is no finite number is counted beside them.
    value, finite = F.col("value"), ~F.isnan("value") & (F.abs("value") != float("inf"))
    odd = {"nans": F.isnan("value"), "highs": value == float("inf"), "lows": value == float("-inf")}
    one = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    sums = {"n": F.lit(1).cast("long"), "valued": one(value.isNotNull()), "total": F.when(finite, value).cast("decimal(38,14)"), **{k: one(c) for k, c in odd.items()}}
    of_all = ranges.range_sums(p, "t", i, "start", "end", sums, "from_event")
    own = ranges.range_sums(p.select("user_id", "t"), "t", i.withColumnRenamed("of_user", "user_id"), "start", "end", {"own": F.lit(1).cast("long")}, "from_event", ["user_id"])
    total = F.when((F.col("nans") > 0) | (F.col("highs") > 0) & (F.col("lows") > 0), float("nan")).when(F.col("highs") > 0, float("inf")).when(F.col("lows") > 0, float("-inf"))
    total = F.when(F.col("valued") > 0, total.otherwise(F.round(F.col("total").cast("double"), 4)))
    met = of_all.where("n > 0").select("from_event", "n", F.lit(0).cast("long").alias("own"), total.alias("total")).unionByName(own.select("from_event", "own"), allowMissingColumns=True)
    return met.groupBy("from_event").agg(F.max("n").alias("n"), F.sum("own").alias("own"), F.max("total").alias("total")).where("n > 0")


@query(retrieval.ORACLE["vector_topk"])
def vector_index_topk(spark, sf_dir):
    """The vectors saved as an index of cells, loaded, and searched exactly by bounds of cells."""
    path = scratch_path(spark, "vector-index")
    e = table(spark, sf_dir, "embeddings")
    vector_index.save(e, path, "vec_id", "embedding")
    q = table(spark, sf_dir, "benchmark").join(e, F.col("item_id") == F.col("vec_id"))
    return vector_index.search(spark, path, q, "item_id", "embedding", retrieval.K).where("score > 0").withColumn("score", F.round("score", 6))


@query("""WITH w AS (SELECT doc_id, regexp_split_to_array(lower(text), '\\s+') AS r FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, r, list_filter(r, lambda x, i: i % 7 <> 0) AS c FROM w),
  n AS (SELECT unnest([1, 2, 3, 4]) AS n),
  gc AS (SELECT doc_id, n, array_to_string(c[i:i + n - 1], ' ') AS g, count(*) AS k FROM (SELECT doc_id, n, c, unnest(range(1, len(c) - n + 2)) AS i FROM c, n WHERE len(c) >= n) GROUP BY 1, 2, 3),
  gr AS (SELECT doc_id, n, array_to_string(r[i:i + n - 1], ' ') AS g, count(*) AS k FROM (SELECT doc_id, n, r, unnest(range(1, len(r) - n + 2)) AS i FROM c, n WHERE len(r) >= n) GROUP BY 1, 2, 3),
  o AS (SELECT n, sum(least(gc.k, coalesce(gr.k, 0))) AS hit, sum(gc.k) AS total FROM gc LEFT JOIN gr USING (doc_id, n, g) GROUP BY 1),
  s AS (SELECT sum(len(c)) AS c, sum(len(r)) AS r FROM c)
  SELECT round((SELECT exp(avg(ln(hit / total))) FROM o) * CASE WHEN c >= r THEN 1 ELSE exp(1 - r / c) END, 9) AS bleu4 FROM s""")
def bleu_of_shortened(spark, sf_dir):
    """M9: corpus BLEU-4 of texts with every seventh word left out against the whole ones."""
    words = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.split(F.lower("text"), r"\s+").alias("r"))
    cut = words.select("doc_id", F.array_join("r", " ").alias("whole"), F.array_join(F.filter("r", lambda x, i: (i + 1) % 7 != 0), " ").alias("short"))
    return metrics.bleu4(cut, "doc_id", "short", "whole").select(F.round("bleu4", 9).alias("bleu4"))
