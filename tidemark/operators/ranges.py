"""Points in intervals: pairs as equality joins on bins, sums as differences of running sums."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: How near the quantile of lengths is taken.
ACCURACY = 1000
#: Spans into which the line of points is cut for running sums, without keys and with them.
SPANS, SPANS_OF_KEY = 4096, 16


def range_join(points: DataFrame, at: str, intervals: DataFrame, start: str, end: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of ``points`` beside those of ``intervals`` with start < at <= end, and equal ``keys``.

    Bins are as wide as the median interval is long, doubled for each level; an interval lies on the first level whose bins are as wide as
    itself, in two bins at most, however long it is. A point has a row for each level that occurs: no more than there are
    doublings between the median and the longest. Empty intervals, and null bounds or points, meet nothing. ``at``, ``start`` and ``end`` are
    whole numbers.
    """
    length = F.col(end) - F.col(start)
    own = intervals.where(length > 0)
    facts = own.agg(F.percentile_approx(length, 0.5, ACCURACY).alias("width")).first()
    width = max(1, int(facts["width"] or 1))
    level = F.greatest(F.ceil(F.log2(length / width)), F.lit(0)).cast("int")
    # Rounding of the logarithm may leave an interval on a level too low by one: the next one is always wide enough.
    level = F.when(F.lit(width) * F.pow(F.lit(2.0), level) < length, level + 1).otherwise(level)
    own = own.withColumn("_level", level)
    levels = sorted(r[0] for r in own.select("_level").distinct().collect())  # doublings, some dozens at the most
    bin_of = lambda x, n: F.floor(x / (F.lit(width) * F.pow(F.lit(2.0), n))).cast("long")
    own = own.withColumn("_bin", F.explode(F.sequence(bin_of(F.col(start) + 1, F.col("_level")), bin_of(F.col(end), F.col("_level")))))
    rows = points.where(F.col(at).isNotNull()).withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_bin", bin_of(F.col(at), F.col("_level")))
    return rows.join(own, [*keys, "_level", "_bin"]).where((F.col(at) > F.col(start)) & (F.col(at) <= F.col(end))).drop("_level", "_bin")


def range_sums(points: DataFrame, at: str, intervals: DataFrame, start: str, end: str, sums: Mapping[str, Column], of: str, keys: Sequence[str] = ()) -> DataFrame:
    """``of`` of the intervals beside the sums over the points with start < at <= end, and equal ``keys``; no pair is made.

    A sum is what has run up at an interval's end less what had at its start, so that ``sums`` have to be whole numbers or decimals. Running
    sums are taken within spans of the line, and what came before is carried over one row for each span: no task holds the
    whole line, however many points an interval has. Intervals of one ``of`` are pooled. Empty intervals, and null bounds, points or keys,
    meet nothing; their ``of`` has zeros or no row.
    """
    known = lambda df, *c: df.where(" AND ".join(f"`{x}` IS NOT NULL" for x in (*c, *keys)))
    p = known(points, at).select(*keys, F.col(at).alias("_at"), *(F.coalesce(c, F.lit(0)).alias(n) for n, c in sums.items()), F.lit(None).cast(intervals.schema[of].dataType).alias("_of"), F.lit(0).alias("_sign"))
    i = known(intervals, start, end).where(F.col(end) > F.col(start))
    bounds = F.inline(F.array(F.struct(F.col(start).alias("_at"), F.lit(-1).alias("_sign")), F.struct(F.col(end).alias("_at"), F.lit(1).alias("_sign"))))
    marks = i.select(*keys, F.col(of).alias("_of"), bounds).select(*keys, "_at", *(F.lit(0).cast(p.schema[n].dataType).alias(n) for n in sums), "_of", "_sign")
    line = p.agg(F.min("_at").alias("lo"), F.max("_at").alias("hi")).first()
    count = SPANS_OF_KEY if keys else SPANS
    width = max(1, -(-((line["hi"] or 0) - (line["lo"] or 0) + 1) // count))
    # Bounds beyond the points fall into the first or the last span.
    span = F.greatest(F.lit(0), F.least(F.lit(count - 1), F.floor((F.col("_at") - (line["lo"] or 0)) / width))).cast("int")
    both = p.union(marks).withColumn("_span", span)
    inside = Window.partitionBy(*keys, "_span").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy(*keys, "_span").agg(*(F.sum(n).alias(f"_{n}") for n in sums)).select(*keys, "_span", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums))
    run = both.withColumns({n: F.sum(n).over(inside) for n in sums}).where("_sign <> 0").join(carried, [*keys, "_span"])
    return run.groupBy(F.col("_of").alias(of)).agg(*(F.sum(F.col("_sign") * (F.col(n) + F.col(f"_{n}"))).alias(n) for n in sums))
