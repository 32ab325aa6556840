"""Time-series operators on panels: one row per (entity, time), windows always partitioned by the entity.

Missing is null and stays null: means skip it, comparisons that meet it are given a value explicitly. A window that does not
hold all its rows gives null, not a partial aggregate, unless an operator says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def null_nan(df: DataFrame) -> DataFrame:
    """NaN as null in all floating columns; to be used where data come in."""
    return df.select(*(F.nanvl(c, F.lit(None).cast(t)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def by_time(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def full(value: Column, w: WindowSpec, n: int) -> Column:
    """``value`` where at least ``n`` rows of the entity have been seen, else null."""
    return F.when(F.row_number().over(w) >= n, value)


def change(value: Column | str, w: WindowSpec, n: int = 1) -> Column:
    """v(0) / v(-n) - 1; null without such a row, or if it is zero."""
    before = F.lag(value, n).over(w)
    return F.when(before != 0, F.col(value) / before - 1 if isinstance(value, str) else value / before - 1)


def rolling(agg, value: Column | str, w: WindowSpec, n: int, skip: int = 0) -> Column:
    """``agg`` over rows -(n-1+skip) to -skip, null while these are not all there."""
    return full(agg(value).over(w.rowsBetween(-(n - 1 + skip), -skip)), w, n + skip)


def rolling_max(value: str, w: WindowSpec, n: int, least: int) -> Column:
    """Maximum over the last ``n`` rows if at least ``least`` of them have a value."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(frame) >= least, F.max(value).over(frame))


def two_half_change(value: str, w: WindowSpec, n: int) -> Column:
    """Mean of the last ``n`` rows over that of the ``n`` before, minus one."""
    before = rolling(F.avg, value, w, n, n)
    return F.when(before != 0, rolling(F.avg, value, w, n) / before - 1)


def cumulative_index(ret: str, w: WindowSpec) -> Column:
    """Product of 1 + r up to each row; null returns count as zero."""
    return F.exp(F.sum(F.log1p(F.coalesce(ret, F.lit(0.0)))).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def forward_fill(value: str, w: WindowSpec) -> Column:
    return F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def max_drawdown(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, first: int = 20, least: int = 5) -> DataFrame:
    """Per entity the smallest v / running max - 1 over its first rows; taken first, then nulls are left out; needs ``least``."""
    w = by_time(keys, order)
    rows = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= first).where(F.col(value).isNotNull())
    peak = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_dd", F.try_divide(F.col(value), peak) - 1).groupBy(*keys).agg(F.when(F.count("*") >= least, F.min("_dd")).alias("max_drawdown"))


def nth_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, steps: Sequence[int], base: str | None = None) -> DataFrame:
    """Per entity base (first row) and the return of row n (from 0) against it, n in ``steps``; null without that row or with base 0.

    One aggregation after one ranking: rows beyond the largest step are dropped before they are grouped.
    """
    w = by_time(keys, order)
    rows = df.withColumn("_n", F.row_number().over(w) - 1).where(F.col("_n") <= max([*steps, 0]))
    at = lambda c, n: F.max(F.when(F.col("_n") == n, F.col(c)))
    out = rows.groupBy(*keys).agg(at(base or value, 0).alias("base_value"), *(at(value, n).alias(f"_v{n}") for n in steps))
    return out.select(*keys, "base_value", *(F.when(F.col("base_value") != 0, F.col(f"_v{n}") / F.col("base_value") - 1).alias(f"return_{n}") for n in steps))


def calendar(bounds: DataFrame, start: str, end: str, name: str = "date") -> DataFrame:
    """Every day between two columns of a one-row (or per-entity) table; other columns stay."""
    rest = [c for c in bounds.columns if c not in (start, end)]
    return bounds.select(*rest, F.explode(F.sequence(start, end, F.expr("interval 1 day"))).alias(name))


def range_counts(keys: Sequence[str], date: str, n: int, count: str) -> Column:
    """Sum of ``count`` over the calendar days (d - n, d]; 0 on empty windows."""
    w = Window.partitionBy(*keys).orderBy(F.unix_date(date)).rangeBetween(-(n - 1), 0)
    return F.coalesce(F.sum(count).over(w), F.lit(0)).cast("long")


def range_mean(keys: Sequence[str], date: str, n: int, total: str, count: str) -> Column:
    """Mean over (d - n, d] from daily sums and counts: null on empty windows."""
    w = Window.partitionBy(*keys).orderBy(F.unix_date(date)).rangeBetween(-(n - 1), 0)
    seen = F.sum(count).over(w)
    return F.when(seen > 0, F.sum(total).over(w) / seen)


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on equal keys, null with null."""
    r = right.withColumnsRenamed({k: f"{k}_right" for k in keys})
    match = F.lit(True)
    for k in keys:
        match &= F.col(k).eqNullSafe(F.col(f"{k}_right"))
    return left.join(r, match, "left").drop(*(f"{k}_right" for k in keys))


def asof_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, values: Sequence[str], by: Sequence[tuple[str, str]] = (), offset_days: int = 0, prefix: str = "", buckets: int | None = None) -> DataFrame:
    """``left`` with the ``values`` of the last row of ``right`` at or before left_time - offset_days, of the same ``by`` keys.

    The last *row* counts, also where its values are null; of right rows with equal times the last by ``values`` wins. No
    such row: nulls. Both sides are united and one window runs over them, so that there is one shuffle by the keys and
    no join; right rows sort first, which makes equal times match. Where keys are few or none, all rows would meet in few
    partitions, so with ``buckets`` each key's time line is cut into spans of so many days, and the last row of each span is
    carried into the next.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    value = F.struct(*(F.col(c).alias(f"v{i}") for i, c in enumerate(values)))
    l = left.select(F.struct(*left.columns).alias("_l"), F.date_sub(F.to_date(left_time), offset_days).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("_v"), *(F.col(a).alias(k) for k, (a, _) in zip(keys, by, strict=True)))
    r = right.where(F.col(right_time).isNotNull()).select(F.lit(None).cast(l.schema["_l"].dataType).alias("_l"), F.to_date(right_time).alias("_t"), F.lit(0).alias("_side"), value.alias("_v"), *(F.col(b).alias(k) for k, (_, b) in zip(keys, by, strict=True)))
    both = l.unionByName(r)
    order = ["_t", "_side", "_v"]
    if not buckets:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        found = both.withColumn("_f", F.last("_v", ignorenulls=True).over(w)).where(F.col("_l").isNotNull())
    else:
        span = F.floor(F.unix_date("_t") / buckets)
        both = both.withColumn("_span", span)
        w = Window.partitionBy(*keys, "_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        last = r.withColumn("_span", span).groupBy(*keys, "_span").agg(F.max_by("_v", F.struct("_t", "_v")).alias("_last"))
        # One row per key and span and a running last over them: as many rows as there are spans, however many the data are.
        spans = both.select(*keys, "_span").distinct()
        carried = _same(spans, last, [*keys, "_span"]).withColumn("_carry", F.last("_last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)))
        own = both.withColumn("_own", F.last("_v", ignorenulls=True).over(w)).where(F.col("_l").isNotNull())
        found = _same(own, carried.select(*keys, "_span", "_carry"), [*keys, "_span"]).withColumn("_f", F.coalesce("_own", "_carry"))
    return found.select("_l.*", *(F.col(f"_f.v{i}").alias(f"{prefix}{c}") for i, c in enumerate(values)))
