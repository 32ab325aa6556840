"""Runs in ordered rows: forward walks with stop reasons, scans until a boundary, sections by their starts, clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _w(keys: Sequence[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def walk(rows: DataFrame, keys: Sequence[str], order: str, goes_on: Column, most: int) -> DataFrame:
    """From each entity's first row, the consecutive rows while ``goes_on`` holds, at most ``most``; adds step and stop_reason.

    A row whose number does not follow ends the walk (gap), as does one where the condition fails (condition), or the limit
    (limit); what the rows themselves end is 'end'. All stops are running sums over one sort.
    """
    w = _w(keys, order)
    step = F.row_number().over(w) - 1
    gap = F.coalesce(F.col(order) - F.lag(order).over(w) != 1, F.lit(False))
    fails = (step > 0) & ~F.coalesce(goes_on, F.lit(False))
    marked = rows.withColumns({"step": step, "_why": F.when(gap, "gap").when(fails, "condition").when(step >= most, "limit")})
    marked = marked.withColumns({"_stops": F.count("_why").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_next": F.lead("_why").over(w)})
    return marked.where("_stops = 0").withColumn("stop_reason", F.coalesce("_next", F.when(F.lead("step").over(w).isNull(), "end"))).drop("_why", "_stops", "_next")


def until(rows: DataFrame, keys: Sequence[str], order: str, is_stop: Column, keeps_stop: Column) -> DataFrame:
    """Rows of each entity before its first stop; the stop row itself where ``keeps_stop`` holds."""
    w = _w(keys, order)
    before = F.coalesce(F.sum(F.coalesce(is_stop, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumns({"_before": before, "_stop": F.coalesce(is_stop, F.lit(False))}).where((F.col("_before") == 0) & (~F.col("_stop") | keeps_stop)).drop("_before", "_stop")


def runs(rows: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Adds run, the number (from 0) of the run of equal values in consecutive rows that a row belongs to. Nulls equal nulls."""
    w = _w(keys, order)
    new = ~F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1)
    return rows.withColumn("_new", new.cast("int")).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def first_run(rows: DataFrame, keys: Sequence[str], order: str, active: Column) -> DataFrame:
    """The first run of consecutive active rows of each entity, whatever comes after it."""
    w = _w(keys, order)
    marked = rows.withColumn("_on", F.coalesce(active, F.lit(False)))
    marked = marked.withColumn("_start", F.coalesce(F.col("_on") & ~F.coalesce(F.lag("_on").over(w), F.lit(False)), F.lit(False)).cast("int"))
    return marked.withColumn("_run", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_on AND _run = 1").drop("_on", "_start", "_run")


def spans(starts: DataFrame, keys: Sequence[str], start: str, last: Column) -> DataFrame:
    """Adds end: one before the next start of the entity, ``last`` for its last span."""
    return starts.withColumn("end", F.coalesce(F.lead(start).over(_w(keys, start)) - 1, last))


def interval_clusters(rows: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Adds cluster: intervals that overlap, directly or through others, share one, numbered from 0 by their starts."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_new", F.coalesce(F.col(start) > reach, F.lit(False)).cast("int")).withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def suffixed(rows: DataFrame, keys: Sequence[str], order: str, name: str) -> Column:
    """``name`` as it is at its first place within the keys, then with _i1, _i2, ... in order."""
    n = F.row_number().over(Window.partitionBy(*keys, name).orderBy(order)) - 1
    return F.when(n == 0, F.col(name).cast("string")).otherwise(F.concat(F.col(name).cast("string"), F.lit("_i"), n.cast("string")))
