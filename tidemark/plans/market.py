"""Market queries: panels, baskets, heat around listings, as-of features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import timeseries as ts
from tidemark.operators.joins import keep_one
from tidemark.plans.registry import registry
from tidemark.sources import table

QUERIES, ORACLE, query = registry()


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, date, price, amount, volume: one row per supplier and shipping day."""
    l = table(spark, sf_dir, "lineitem")
    amount, volume = F.sum("l_extendedprice"), F.sum("l_quantity")
    return l.groupBy(F.col("l_suppkey").alias("entity"), F.to_date("l_shipdate").alias("date")).agg((amount / volume).alias("price"), amount.alias("amount"), volume.alias("volume"))


PANEL = """panel AS (SELECT l_suppkey AS entity, l_shipdate::DATE AS date, sum(l_extendedprice) / sum(l_quantity) AS price,
  sum(l_extendedprice) AS amount, sum(l_quantity) AS volume FROM lineitem GROUP BY ALL)"""


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer: segment, first order day, returns of later orders against the first, whether the first return is a loss."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderkey", "o_totalprice")
    returns = ts.nth_row(o, ["o_custkey"], ["day", "o_orderkey"], "o_totalprice", [1, 5, 20])
    first = o.groupBy("o_custkey").agg(F.min("day").alias("listed"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    return first.join(returns, "o_custkey").join(c, "o_custkey").withColumn("is_break", F.coalesce(F.col("return_1") < 0, F.lit(False)))


LISTINGS = """ranked AS (SELECT o_custkey, o_orderdate::DATE AS day, o_totalprice,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderkey) - 1 AS n FROM orders),
  base AS (SELECT o_custkey, min(day) AS listed, max(o_totalprice) FILTER (n = 0) AS b, max(o_totalprice) FILTER (n = 1) AS v1,
    max(o_totalprice) FILTER (n = 5) AS v5, max(o_totalprice) FILTER (n = 20) AS v20 FROM ranked GROUP BY 1),
  listings AS (SELECT o_custkey, c_mktsegment AS segment, listed, b AS base_value, v1 / nullif(b, 0) - 1 AS return_1,
    v5 / nullif(b, 0) - 1 AS return_5, v20 / nullif(b, 0) - 1 AS return_20,
    coalesce(v1 / nullif(b, 0) - 1 < 0, false) AS is_break FROM base JOIN customer ON c_custkey = o_custkey)"""


@query("""SELECT l_shipdate::DATE AS date, round(sum(l_extendedprice), 2) AS amount, round(sum(l_quantity), 2) AS volume,
  count(*) FILTER (l_extendedprice > 0) AS active FROM lineitem GROUP BY 1""")
def market_turnover_daily(spark, sf_dir):
    """A1-A3: sums and a conditional count by day; Spark splits them into partial and final by itself."""
    l = table(spark, sf_dir, "lineitem")
    return l.groupBy(F.to_date("l_shipdate").alias("date")).agg(F.round(F.sum("l_extendedprice"), 2).alias("amount"), F.round(F.sum("l_quantity"), 2).alias("volume"), F.count_if(F.col("l_extendedprice") > 0).alias("active"))


@query(f"""WITH {PANEL}, steps AS (SELECT *, price / nullif(lag(price) OVER w, 0) - 1 AS ret,
    CASE WHEN count(price) OVER w60 >= 20 THEN max(price) OVER w60 END AS high FROM panel
    WINDOW w AS (PARTITION BY entity ORDER BY date), w60 AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
  SELECT date, r_name AS industry, count(DISTINCT entity) AS n_members, round(avg(ret), 6) AS eq_return, round(sum(amount), 2) AS total_amount,
    round(avg(coalesce(price >= high, false)::INT), 6) AS newhigh_ratio
  FROM steps JOIN supplier ON s_suppkey = entity JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2""")
def industry_basket_daily(spark, sf_dir):
    """Equal-weight return, amount and share of 60-row highs by day and industry."""
    w = ts.by_time(["entity"], ["date"])
    p = panel(spark, sf_dir).withColumns({"ret": ts.change("price", w), "high": ts.rolling_max("price", w, 60, 20)})
    industry = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").alias("entity"), F.col("r_name").alias("industry"))
    # A panel has one row for an entity and day: its members are counted by the first of an entity's rows in an industry, without a set of them.
    industry = industry.groupBy("entity", "industry").agg(F.count("*").alias("_rows")).select("*", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int"))).alias("_row"))
    new_high = F.coalesce(F.col("price") >= F.col("high"), F.lit(False)).cast("int")
    return p.join(industry, "entity").groupBy("date", "industry").agg(F.count_if(F.col("_row") == 1).alias("n_members"), r6(F.avg("ret"), "eq_return"), F.round(F.sum("amount"), 2).alias("total_amount"), r6(F.avg(new_high), "newhigh_ratio"))


def heat(spark, sf_dir, keys: list[str]) -> DataFrame:
    """Daily listings, and over (d - N, d]: counts, mean first return, rate of losses. Aggregated to days before any window."""
    events = listings(spark, sf_dir)
    daily = events.groupBy(*keys, F.col("listed").alias("date")).agg(F.count("*").alias("n"), F.sum("return_1").alias("total"), F.count("return_1").alias("known"), F.sum(F.col("is_break").cast("int")).alias("breaks"))
    span = daily.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    grid = ts.calendar(span if not keys else daily.select(*keys).distinct().crossJoin(F.broadcast(span)), "lo", "hi")
    return grid.join(daily, [*keys, "date"], "left")


def _heat_columns(n_short: int, n_long: int, n_mean: int, keys: list[str]):
    return [
        ts.range_counts(keys, "date", n_short, "n").alias(f"count_{n_short}d"),
        ts.range_counts(keys, "date", n_long, "n").alias(f"count_{n_long}d"),
        r6(ts.range_mean(keys, "date", n_mean, "total", "known"), f"avg_return_{n_mean}d"),
        r6(ts.range_mean(keys, "date", n_mean, "breaks", "n"), f"break_rate_{n_mean}d"),
    ]


HEAT = f"""{LISTINGS}, daily AS (SELECT listed AS date, count(*) AS n, sum(return_1) AS total, count(return_1) AS known, sum(is_break::INT) AS breaks FROM listings GROUP BY 1),
  grid AS (SELECT unnest(generate_series(min(listed), max(listed), INTERVAL 1 DAY))::DATE AS date FROM listings),
  heat AS (SELECT g.date, coalesce(sum(n) OVER w30, 0)::BIGINT AS count_30d, coalesce(sum(n) OVER w90, 0)::BIGINT AS count_90d,
    round(CASE WHEN sum(known) OVER w60 > 0 THEN sum(total) OVER w60 / sum(known) OVER w60 END, 6) AS avg_return_60d,
    round(CASE WHEN sum(n) OVER w60 > 0 THEN sum(breaks) OVER w60 / sum(n) OVER w60 END, 6) AS break_rate_60d
    FROM grid g LEFT JOIN daily d ON d.date = g.date
    WINDOW w30 AS (ORDER BY g.date RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW), w60 AS (ORDER BY g.date RANGE BETWEEN INTERVAL 59 DAY PRECEDING AND CURRENT ROW), w90 AS (ORDER BY g.date RANGE BETWEEN INTERVAL 89 DAY PRECEDING AND CURRENT ROW))"""


@query(f"WITH {HEAT} SELECT * FROM heat")
def event_heat_daily(spark, sf_dir):
    """Calendar windows over all listings. The window sees one row per day, whatever the number of listings."""
    return heat(spark, sf_dir, []).select("date", *_heat_columns(30, 90, 60, []))


@query(f"""WITH {LISTINGS}, daily AS (SELECT segment, listed AS date, count(*) AS n, sum(return_1) AS total, count(return_1) AS known, sum(is_break::INT) AS breaks FROM listings GROUP BY 1, 2),
  grid AS (SELECT segment, d::DATE AS date FROM (SELECT DISTINCT segment FROM listings), (SELECT unnest(generate_series(min(listed), max(listed), INTERVAL 1 DAY)) AS d FROM listings))
  SELECT g.segment, g.date, coalesce(sum(n) OVER w, 0)::BIGINT AS count_365d,
    round(CASE WHEN sum(known) OVER w > 0 THEN sum(total) OVER w / sum(known) OVER w END, 6) AS avg_return_365d,
    round(CASE WHEN sum(n) OVER w > 0 THEN sum(breaks) OVER w / sum(n) OVER w END, 6) AS break_rate_365d
  FROM grid g LEFT JOIN daily d ON d.date = g.date AND d.segment = g.segment
  WINDOW w AS (PARTITION BY g.segment ORDER BY g.date RANGE BETWEEN INTERVAL 364 DAY PRECEDING AND CURRENT ROW)""")
def event_heat_by_segment(spark, sf_dir):
    """The same per segment, over 365 days."""
    k = ["segment"]
    return heat(spark, sf_dir, k).select("segment", "date", ts.range_counts(k, "date", 365, "n").alias("count_365d"), r6(ts.range_mean(k, "date", 365, "total", "known"), "avg_return_365d"), r6(ts.range_mean(k, "date", 365, "breaks", "n"), "break_rate_365d"))


@query(f"""WITH {HEAT} SELECT l.o_custkey, l.listed, round(l.return_1, 6) AS return_1, l.is_break, h.count_30d, h.count_90d, h.avg_return_60d, h.break_rate_60d
  FROM listings l ASOF LEFT JOIN heat h ON l.listed - 1 >= h.date""")
def event_heat_features(spark, sf_dir):
    """Flagship: each listing with the heat known the day before (J10). The calendar is dense, so that as-of is equality here."""
    days = event_heat_daily(spark, sf_dir).withColumn("listed", F.date_add("date", 1)).drop("date")
    events = listings(spark, sf_dir).select("o_custkey", "listed", r6(F.col("return_1"), "return_1"), "is_break")
    return events.join(days, "listed", "left").select("o_custkey", "listed", "return_1", "is_break", "count_30d", "count_90d", "avg_return_60d", "break_rate_60d")


@query(f"""WITH {LISTINGS} SELECT o_custkey, listed, segment, round(base_value, 6) AS base_value, round(return_1, 6) AS return_1, round(return_5, 6) AS return_5, round(return_20, 6) AS return_20, is_break,
  CASE WHEN coalesce(return_5, return_1) IS NULL THEN 'unknown' WHEN coalesce(return_5, return_1) <= -0.2 THEN 'plunge' WHEN coalesce(return_5, return_1) <= -0.05 THEN 'weak'
    WHEN coalesce(return_5, return_1) < 0.3 THEN 'flat' ELSE 'strong' END AS performance FROM listings""")
def post_listing_returns(spark, sf_dir):
    """N-th row returns against the first row, and their class by day 5, else day 1."""
    x = F.coalesce("return_5", "return_1")
    kind = F.when(x.isNull(), "unknown").when(x <= -0.2, "plunge").when(x <= -0.05, "weak").when(x < 0.3, "flat").otherwise("strong")
    return listings(spark, sf_dir).select("o_custkey", "listed", "segment", r6(F.col("base_value"), "base_value"), r6(F.col("return_1"), "return_1"), r6(F.col("return_5"), "return_5"), r6(F.col("return_20"), "return_20"), "is_break", kind.alias("performance"))


@query(f"""WITH {PANEL}, firsts AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date) AS n FROM panel),
  peaks AS (SELECT entity, price / max(price) OVER (PARTITION BY entity ORDER BY date) - 1 AS dd FROM firsts WHERE n <= 20 AND price IS NOT NULL)
  SELECT entity, round(CASE WHEN count(*) >= 5 THEN min(dd) END, 6) AS max_drawdown FROM peaks GROUP BY 1""")
def max_drawdown_first20(spark, sf_dir):
    """A9, W13, W14."""
    return ts.max_drawdown(panel(spark, sf_dir), ["entity"], ["date"], "price").select("entity", r6(F.col("max_drawdown"), "max_drawdown"))


@query(f"""WITH {PANEL}, r AS (SELECT *, row_number() OVER w AS n, price / nullif(lag(price) OVER w, 0) - 1 AS ret FROM panel WINDOW w AS (PARTITION BY entity ORDER BY date))
  SELECT entity, date, round(price / nullif(lag(price, 20) OVER w, 0) - 1, 6) AS return_20, round(CASE WHEN n >= 21 THEN stddev_samp(ret) OVER w20 END, 6) AS vol_20,
    round(CASE WHEN n >= 20 THEN avg(price) OVER w20 END, 6) AS mean_20, round(CASE WHEN n >= 20 THEN sum(amount) OVER w20 END, 2) AS amount_20,
    round(CASE WHEN n >= 40 THEN sum(amount) OVER p20 END, 2) AS amount_prev_20,
    round(CASE WHEN n >= 40 THEN avg(amount) OVER w20 / nullif(avg(amount) OVER p20, 0) - 1 END, 6) AS amount_change
  FROM r WINDOW w AS (PARTITION BY entity ORDER BY date), w20 AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), p20 AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 39 PRECEDING AND 20 PRECEDING)""")
def series_returns_vol(spark, sf_dir):
    """One sort per entity serves all frames."""
    w = ts.by_time(["entity"], ["date"])
    p = panel(spark, sf_dir).withColumn("ret", ts.change("price", w))
    vol = ts.full(F.stddev_samp("ret").over(w.rowsBetween(-19, 0)), w, 21)
    return p.select("entity", "date", r6(ts.change("price", w, 20), "return_20"), r6(vol, "vol_20"), r6(ts.rolling(F.avg, "price", w, 20), "mean_20"), F.round(ts.rolling(F.sum, "amount", w, 20), 2).alias("amount_20"), F.round(ts.rolling(F.sum, "amount", w, 20, 20), 2).alias("amount_prev_20"), r6(ts.two_half_change("amount", w, 20), "amount_change"))


def series(spark, sf_dir) -> DataFrame:
    """date, value, and its return over 20 rows. One row per day; the daily sums come first."""
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("value"))
    return days.withColumn("return_20", ts.change("value", Window.orderBy("date"), 20))


SERIES = """series AS (SELECT date, value, value / nullif(lag(value, 20) OVER (ORDER BY date), 0) - 1 AS return_20
  FROM (SELECT o_orderdate::DATE AS date, sum(o_totalprice) AS value FROM orders GROUP BY 1))"""


@query(f"""WITH {LISTINGS}, {SERIES} SELECT l.o_custkey, l.listed, round(a.value, 2) AS value, round(a.return_20, 6) AS return_20, round(a.value - b.value, 2) AS change_30cd
  FROM listings l ASOF LEFT JOIN series a ON l.listed >= a.date ASOF LEFT JOIN series b ON l.listed - 30 >= b.date""")
def asof_macro_features(spark, sf_dir):
    """Value and row-lag return as of the listing, and the change over 30 calendar days."""
    s = series(spark, sf_dir)
    events = listings(spark, sf_dir).select("o_custkey", "listed")
    now = ts.asof_join(events, s, "listed", "date", ["value", "return_20"], buckets=32)
    then = ts.asof_join(now, s, "listed", "date", ["value"], offset_days=30, prefix="old_", buckets=32)
    return then.select("o_custkey", "listed", F.round("value", 2).alias("value"), r6(F.col("return_20"), "return_20"), F.round(F.col("value") - F.col("old_value"), 2).alias("change_30cd"))


@query(f"""WITH {LISTINGS}, d AS (SELECT segment, listed AS date, count(*) AS n, round(avg(return_1), 6) AS mean_return FROM listings GROUP BY 1, 2)
  SELECT l.o_custkey, l.segment, l.listed, d.n, d.mean_return FROM listings l ASOF LEFT JOIN d ON l.segment = d.segment AND l.listed - 1 >= d.date""")
def asof_segment_heat(spark, sf_dir):
    """As-of per segment, the day before; days without listings are bridged."""
    events = listings(spark, sf_dir)
    days = events.groupBy("segment", F.col("listed").alias("date")).agg(F.count("*").alias("n"), r6(F.avg("return_1"), "mean_return"))
    return ts.asof_join(events.select("o_custkey", "segment", "listed"), days, "listed", "date", ["n", "mean_return"], by=[("segment", "segment")], offset_days=1, buckets=32)


@query(f"""WITH {SERIES}, grid AS (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM series)
  SELECT g.date, round(last_value(value IGNORE NULLS) OVER (ORDER BY g.date), 2) AS value, s.date IS NULL AS filled FROM grid g LEFT JOIN series s ON s.date = g.date""")
def calendar_ffill(spark, sf_dir):
    """Dense calendar, last value carried on."""
    s = series(spark, sf_dir).withColumn("known", F.lit(True))
    grid = ts.calendar(s.agg(F.min("date").alias("lo"), F.max("date").alias("hi")), "lo", "hi")
    return grid.join(s, "date", "left").select("date", F.round(ts.forward_fill("value", Window.orderBy("date")), 2).alias("value"), F.col("known").isNull().alias("filled"))


@query(f"""WITH {PANEL}, r AS (SELECT entity, date, price / nullif(lag(price) OVER (PARTITION BY entity ORDER BY date), 0) - 1 AS ret FROM panel)
  SELECT entity, date, round(exp(sum(ln(1 + coalesce(ret, 0))) OVER (PARTITION BY entity ORDER BY date)), 4) AS index_value FROM r""")
def cumulative_index(spark, sf_dir):
    """W4."""
    w = ts.by_time(["entity"], ["date"])
    r = panel(spark, sf_dir).withColumn("ret", ts.change("price", w))
    return r.select("entity", "date", F.round(ts.cumulative_index("ret", w), 4).alias("index_value"))


@query(f"""WITH {PANEL}, r AS (SELECT *, row_number() OVER w AS n, price / nullif(lag(price, 20) OVER w, 0) - 1 AS own FROM panel WINDOW w AS (PARTITION BY entity ORDER BY date)),
  closes AS (SELECT entity, count(*) AS rows FROM panel GROUP BY 1), basket AS (SELECT date, avg(own) AS mean FROM r GROUP BY 1)
  SELECT r.entity, r.date, round(CASE WHEN c.rows >= 60 AND own IS NOT NULL THEN own ELSE b.mean END, 6) AS industry_return,
    CASE WHEN c.rows >= 60 AND own IS NOT NULL THEN 'index' WHEN b.mean IS NOT NULL THEN 'basket' ELSE 'missing' END AS return_source,
    round(CASE WHEN c.rows >= 60 AND own IS NOT NULL THEN own ELSE b.mean END - b.mean, 6) AS excess
  FROM r JOIN closes c USING (entity) JOIN basket b USING (date)""")
def fallback_industry_return(spark, sf_dir):
    """W10 and the fallback chain: an index with fewer than 60 rows, or without a full window, gives way to the basket."""
    w = ts.by_time(["entity"], ["date"])
    rows = F.count("*").over(Window.partitionBy("entity"))
    r = panel(spark, sf_dir).select("entity", "date", ts.change("price", w, 20).alias("own"), rows.alias("rows"))
    both = r.join(r.groupBy("date").agg(F.avg("own").alias("mean")), "date")
    usable = (F.col("rows") >= 60) & F.col("own").isNotNull()
    value = F.when(usable, F.col("own")).otherwise(F.col("mean"))
    return both.select("entity", "date", r6(value, "industry_return"), F.when(usable, "index").when(F.col("mean").isNotNull(), "basket").otherwise("missing").alias("return_source"), r6(value - F.col("mean"), "excess"))


@query("""SELECT o_custkey, o_orderdate::DATE AS day, o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate::DATE ORDER BY o_orderkey) AS n
  FROM orders WHERE o_totalprice IS NOT NULL AND o_orderdate::DATE BETWEEN DATE '1996-01-01' AND DATE '1999-12-31') WHERE n = 1""")
def dedupe_keep_first(spark, sf_dir):
    """Date range (pushed to the scan), not null, first row of each key."""
    o = table(spark, sf_dir, "orders").where("o_orderdate >= TIMESTAMP_NTZ '1996-01-01' AND o_orderdate < TIMESTAMP_NTZ '2000-01-01' AND o_totalprice IS NOT NULL")
    rows = o.select("o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))
    return keep_one(rows, ["o_custkey", "day"], ["o_orderkey"])
