"""Profiles and checks of datasets: frequencies, crosstabs, coverage, samples, page quality."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Samples of up to so many rows have their keys broadcast; those of larger ones are shuffled.
BROADCAST_KEYS = 100_000
#: Weights of the page score.
ROW_WEIGHT, NUMBER_WEIGHT, LENGTH_DIVISOR = 100, 5, 20

#: How near approximate quantiles are (one in so many rows), and by how many such steps bounds are set apart.
ACCURACY, MARGIN = 10_000, 3


def describe(df: DataFrame, column: str) -> DataFrame:
    """One row: n, mean, sample deviation, least, exact quartiles (linear interpolation), largest."""
    facts = df.agg(F.count(column).alias("n"), F.round(F.avg(column), 4).alias("mean"), F.round(F.stddev_samp(column), 4).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"))
    quartiles = exact_quantiles(df, column, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    out = facts.crossJoin(F.broadcast(quartiles))
    return out.select("n", "mean", "std", "min", *(F.round(q, 4).alias(q) for q in ("q25", "q50", "q75")), "max")


def exact_quantiles(df: DataFrame, column: str, shares: Mapping[str, float]) -> DataFrame:
    """One row of the exact quantiles (linear interpolation) by name, null without values; no task holds more than a small share of the values.

    Approximate quantiles on both sides enclose each; the values between are counted and ranked, with the number of those below.
    Where the two do not enclose it, all values are ranked.
    """
    v = F.col("_v")
    own = df.select(F.col(column).cast("double").alias("_v")).where(v.isNotNull())
    sides = [min(1.0, max(0.0, p + d)) for p in shares.values() for d in (-MARGIN / ACCURACY, MARGIN / ACCURACY)]
    first = own.agg(F.count("*").alias("n"), F.percentile_approx("_v", sides, ACCURACY).alias("sides"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).first()
    n = first["n"]
    if n == 0:
        return df.sparkSession.range(1).select(*(F.lit(None).cast("double").alias(name) for name in shares))
    bounds = list(zip(first["sides"][::2], first["sides"][1::2], strict=True))
    between = lambda lo, hi: (v >= F.lit(lo)) & (v <= F.lit(hi))
    counts = own.agg(*(c for i, (lo, hi) in enumerate(bounds) for c in (F.count_if(v < F.lit(lo)).alias(f"below{i}"), F.count_if(between(lo, hi)).alias(f"in{i}")))).first()
    out = None
    for i, ((name, p), (lo, hi)) in enumerate(zip(shares.items(), bounds, strict=True)):
        place, below = p * (n - 1), counts[f"below{i}"]
        low, high = math.floor(place), math.ceil(place)
        if not (below <= low and high < below + counts[f"in{i}"]):
            lo, hi, below = first["lo"], first["hi"], 0
        run = own.where(between(lo, hi)).groupBy("_v").agg(F.count("*").alias("c")).withColumn("_run", F.sum("c").over(Window.partitionBy(F.lit(i)).orderBy("_v")) + below)
        ends = run.agg(F.min(F.when(F.col("_run") > low, v)).alias("a"), F.min(F.when(F.col("_run") > high, v)).alias("b"))
        one = ends.select(F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((high - place) * F.col("a") + (place - low) * F.col("b")).alias(name))
        out = one if out is None else out.crossJoin(one)
    return out


def value_counts(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("value", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def nonnull_ratio(df: DataFrame, columns: Sequence[str], lowest: int | None = None) -> DataFrame:
    """column_name, ratio of values that are not null; the ``lowest`` of them if asked. One pass over the data."""
    wide = df.agg(*(F.round(F.count(c) / F.count("*"), 6).alias(c) for c in columns))
    tall = wide.unpivot([], list(columns), "column_name", "ratio")
    return tall.orderBy("ratio", "column_name").limit(lowest) if lowest else tall


def crosstab(df: DataFrame, rows: str, columns: str, values: Sequence[str]) -> DataFrame:
    """Counts of each pair, with the margins All, by one cube and a pivot over the known values."""
    cube = df.cube(rows, columns).agg(F.count("*").alias("n"), F.grouping(columns).alias("g"))
    cell = lambda v: F.coalesce(F.sum(F.when((F.col(columns) == v) & (F.col("g") == 0), F.col("n"))), F.lit(0)).alias(v)
    return cube.groupBy(F.coalesce(F.col(rows), F.lit("All")).alias(rows)).agg(*(cell(v) for v in values), F.sum(F.when(F.col("g") == 1, F.col("n"))).alias("All"))


def stratified(df: DataFrame, key: str, order: Column, strata: Sequence[tuple[str, Column, int]], total: int) -> DataFrame:
    """Greedy sample: of each stratum in turn at most its quota of rows not taken before, then a fill up to ``total``.

    Rows come in the order of ``order`` (a hash) and the key. A row's stratum is the first that it meets and that has
    room; since a stratum takes the first of what is left, each is a small ordered limit, and only the few taken rows are
    joined against.
    """
    rows = df.select("*", order.alias("_order"))
    taken: DataFrame | None = None
    left, most = total, total + sum(quota for _, _, quota in strata)
    for name, condition, quota in [*strata, ("fill", F.lit(True), total)]:
        if name == "fill":
            quota = left
        pool = rows.where(condition)
        if taken is not None:
            keys = taken.select(key)
            pool = pool.join(F.broadcast(keys) if most <= BROADCAST_KEYS else keys, key, "left_anti")
        part = pool.orderBy("_order", key).limit(quota).withColumn("stratum", F.lit(name))
        left -= quota
        taken = part if taken is None else taken.unionByName(part)
    return taken.drop("_order")


def page_quality(pages: DataFrame, key: str, html: str, row_tag: str = "<tr>") -> DataFrame:
    """score, confidence and the tags of the rules that hold."""
    n = pages.select(key, F.regexp_count(html, F.lit(row_tag)).alias("rows"), F.regexp_count(html, F.lit("[0-9]+")).alias("nums"), F.length(html).alias("n"))
    score = F.col("rows") * ROW_WEIGHT + F.col("nums") * NUMBER_WEIGHT + F.floor(F.col("n") / LENGTH_DIVISOR)
    rows, nums = F.col("rows"), F.col("nums")
    confidence = F.when((rows <= 4) & (nums < 3), "low").when((rows <= 4) | ((nums < 8) & (rows < 8)), "medium").otherwise("high")
    tags = F.filter(F.array(F.when(F.col("n") < 1500, "short"), F.when(nums > 12, "many_numbers"), F.when(rows == 0, "no_rows")), lambda x: x.isNotNull())
    return n.select(key, score.cast("long").alias("score"), confidence.alias("confidence"), F.array_join(tags, ";").alias("tags"))


def worst_of(parts: DataFrame, key: str, confidence: str, score: str) -> DataFrame:
    """Per key the weakest confidence and the best score of its parts."""
    rank = F.when(F.col(confidence) == "low", 0).when(F.col(confidence) == "medium", 1).otherwise(2)
    return parts.groupBy(key).agg(F.min_by(confidence, rank).alias(confidence), F.max(score).alias(score))


def coverage(spark: SparkSession, datasets: Sequence[tuple[str, DataFrame, str]], expected: Sequence[tuple[str, int, str]]) -> DataFrame:
    """name, least, n, first_day, status of each dataset: ok, too_few or starts_late."""
    stats = None
    for name, df, date in datasets:
        one = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.to_date(F.min(date)).alias("first_day"))
        stats = one if stats is None else stats.unionByName(one)
    e = spark.createDataFrame(list(expected), "name string, least int, latest string").withColumn("latest", F.to_date("latest"))
    status = F.when(F.col("n") < F.col("least"), "too_few").when(F.col("first_day") > F.col("latest"), "starts_late").otherwise("ok")
    return stats.join(F.broadcast(e), "name").select("name", "least", "n", "first_day", status.alias("status"))


def graded(rows: DataFrame, points: Sequence[tuple[Column, float]], caps: Sequence[tuple[Column, str]], grades: Sequence[tuple[float, str]], default: str) -> DataFrame:
    """Adds points and grade: the sum of the points whose condition holds, graded by the ends, but not better than a cap that holds."""
    total = sum((F.when(c, F.lit(p)).otherwise(0.0) for c, p in points), F.lit(0.0))
    grade = F.lit(default)
    for end, name in reversed(list(grades)):
        grade = F.when(total >= end, name).otherwise(grade)
    for condition, worst in caps:
        grade = F.when(F.coalesce(condition, F.lit(False)), F.greatest(grade, F.lit(worst))).otherwise(grade)
    return rows.withColumns({"points": total, "grade": grade})


def against_baseline(now: DataFrame, before: DataFrame, key: str, grade: str) -> DataFrame:
    """key, both grades, and better, worse, same, new or gone. Grades are letters, A is best."""
    a, b = now.select(key, F.col(grade).alias("now")), before.select(key, F.col(grade).alias("before"))
    change = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("now") < F.col("before"), "better").when(F.col("now") > F.col("before"), "worse").otherwise("same")
    return a.join(b, key, "full").withColumn("change", change)
