"""Dataset queries: classifiers, profiles, resolution, merges, set operations, samples, page quality, metrics, event summaries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import joins, quality
from tidemark.operators.rules import first_match, keyword_class
from tidemark.plans.market import r6
from tidemark.plans.registry import registry
from tidemark.sources import table

QUERIES, ORACLE, query = registry()


@query("""SELECT p_partkey, lpad(regexp_replace(p_brand, '[^0-9]', '', 'g'), 5, '0') AS code, upper(split_part(p_type, ' ', 1)) AS head,
  CASE WHEN contains(lower(p_name), 'red') THEN 'warm' WHEN contains(lower(p_name), 'blue') OR contains(lower(p_name), 'green') THEN 'cold' ELSE 'other' END AS family,
  CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 25 THEN 'medium' WHEN p_size < 40 THEN 'large' ELSE 'huge' END AS size_class FROM part""")
def part_classes(spark, sf_dir):
    """Classifiers in the order of their rules, padded codes (longer ones are not cut)."""
    digits = F.regexp_replace("p_brand", "[^0-9]", "")
    code = F.when(F.length(digits) >= 5, digits).otherwise(F.lpad(digits, 5, "0"))
    size = first_match([(F.col("p_size") < 10, "small"), (F.col("p_size") < 25, "medium"), (F.col("p_size") < 40, "large")], "huge")
    return table(spark, sf_dir, "part").select("p_partkey", code.alias("code"), F.upper(F.split_part("p_type", F.lit(" "), F.lit(1))).alias("head"), keyword_class(F.lower("p_name"), [("warm", ["red"]), ("cold", ["blue", "green"])], "other").alias("family"), size.alias("size_class"))


@query("""WITH raw AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '000' || (c_custkey % 120)::VARCHAR WHEN 1 THEN (c_custkey % 120)::VARCHAR WHEN 2 THEN 'X' || c_custkey::VARCHAR ELSE lpad((c_custkey % 120)::VARCHAR, 4, '0') END AS raw FROM customer),
  c AS (SELECT *, ltrim(raw, '0') AS a, CASE WHEN length(raw) >= 4 THEN raw ELSE lpad(raw, 4, '0') END AS b FROM raw)
  SELECT c_custkey, raw, CASE WHEN a IN (SELECT s_suppkey::VARCHAR FROM supplier) THEN a WHEN b IN (SELECT s_suppkey::VARCHAR FROM supplier) THEN b END AS resolved_key,
    CASE WHEN a IN (SELECT s_suppkey::VARCHAR FROM supplier) THEN 'strip_zero' WHEN b IN (SELECT s_suppkey::VARCHAR FROM supplier) THEN 'pad4' ELSE 'unmatched' END AS resolved_rule FROM c""")
def key_resolution(spark, sf_dir):
    """Messy codes by the first rule whose candidate exists."""
    k, small = F.col("c_custkey"), (F.col("c_custkey") % 120).cast("string")
    raw = F.when(k % 4 == 0, F.concat(F.lit("000"), small)).when(k % 4 == 1, small).when(k % 4 == 2, F.concat(F.lit("X"), k.cast("string"))).otherwise(F.when(F.length(small) >= 4, small).otherwise(F.lpad(small, 4, "0")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw"))
    pad4 = F.when(F.length("raw") >= 4, F.col("raw")).otherwise(F.lpad("raw", 4, "0"))
    return joins.resolve_keys(rows, "raw", table(spark, sf_dir, "supplier"), "s_suppkey", [("strip_zero", F.ltrim("raw", F.lit("0"))), ("pad4", pad4)])


@query("""SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) AS large,
  EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS pending FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)
  AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice < 2000)""")
def semi_anti_mark(spark, sf_dir):
    """Semi, anti and mark joins."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    region = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(region, "c_nationkey", "left_semi").join(o.where("o_totalprice < 2000"), "c_custkey", "left_anti")
    return joins.mark(joins.mark(c, o.where("o_totalprice > 400000"), ["c_custkey"], "large"), o.where("o_orderstatus = 'P'"), ["c_custkey"], "pending").select("c_custkey", "large", "pending")


@query("""WITH x AS (SELECT page_id, url, length(html) AS n, contains(url, '?') AS asked, length(html) > 9000 AS long FROM pages), b AS (SELECT * FROM x WHERE NOT asked OR long), p AS (SELECT page_id, url || '#v2' AS url, n + (length(url) % 5) - 2 AS n FROM x WHERE asked OR long)
  SELECT coalesce(b.page_id, p.page_id) AS page_id, CASE WHEN b.page_id IS NULL OR p.n > b.n THEN p.url ELSE b.url END AS url, CASE WHEN b.page_id IS NULL OR p.n > b.n THEN p.n ELSE b.n END AS n,
    CASE WHEN b.page_id IS NULL THEN 'inserted' WHEN p.page_id IS NULL THEN 'kept' WHEN p.n > b.n THEN 'updated' ELSE 'skipped' END AS action FROM b FULL JOIN p ON b.page_id = p.page_id""")
def upsert_merge_pages(spark, sf_dir):
    """Full outer merge of all pages, with or without a query in their address; a patch replaces a page only if it is better."""
    x = table(spark, sf_dir, "pages").select("page_id", "url", F.length("html").cast("long").alias("n"))
    asked, long = F.contains("url", F.lit("?")), F.col("n") > 9000
    patch = x.where(asked | long).select("page_id", F.concat("url", F.lit("#v2")).alias("url"), (F.col("n") + F.length("url") % 5 - 2).alias("n"))
    return joins.upsert(x.where(~asked | long), patch, ["page_id"], F.col("p.n") > F.col("b.n"))


@query("""WITH a AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1), b AS (SELECT o_custkey AS k, min(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
  SELECT c_custkey AS k, coalesce(a.v, b.v) AS multiple, CASE WHEN a.v IS NOT NULL THEN 'urgent' WHEN b.v IS NOT NULL THEN 'pending' ELSE 'missing' END AS multiple_source FROM customer LEFT JOIN a ON a.k = c_custkey LEFT JOIN b ON b.k = c_custkey""")
def source_priority_merge(spark, sf_dir):
    """The first source with a value, and which one it was."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k")
    first = o.where("o_orderpriority = '1-URGENT'").groupBy("k").agg(F.max("o_totalprice").alias("v"))
    second = o.where("o_orderstatus = 'P'").groupBy("k").agg(F.min("o_totalprice").alias("v"))
    return joins.by_priority(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), [("urgent", first, "v"), ("pending", second, "v")], ["k"], "multiple")


@query("""SELECT coalesce(yr::VARCHAR, 'All') AS year, coalesce(sum(n) FILTER (s = 'F'), 0)::BIGINT AS "F", coalesce(sum(n) FILTER (s = 'O'), 0)::BIGINT AS "O", coalesce(sum(n) FILTER (s = 'P'), 0)::BIGINT AS "P", sum(n) FILTER (s IS NULL)::BIGINT AS "All"
  FROM (SELECT year(o_orderdate) AS yr, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY CUBE (yr, s)) GROUP BY 1""")
def crosstab_margins(spark, sf_dir):
    """Counts by year and status with margins."""
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("string").alias("year"), F.col("o_orderstatus").alias("status"))
    return quality.crosstab(o, "year", "status", ["F", "O", "P"])


@query("""SELECT count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.25), 4) AS q25,
  round(median(o_totalprice), 4) AS q50, round(quantile_cont(o_totalprice, 0.75), 4) AS q75, max(o_totalprice) AS max FROM orders""")
def describe_numeric(spark, sf_dir):
    """Exact quartiles with linear interpolation."""
    return quality.describe(table(spark, sf_dir, "orders"), "o_totalprice")


@query("SELECT o_orderpriority AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 6) AS share FROM orders GROUP BY 1")
def value_counts(spark, sf_dir):
    """Frequencies, nulls counted."""
    return quality.value_counts(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("""SELECT column_name, ratio FROM (SELECT unnest(['lang', 'quality', 'text', 'toxic']) AS column_name, unnest([round(count(lang) / count(*), 6), round(count(quality) / count(*), 6), round(count(text) / count(*), 6), round(count(toxic) / count(*), 6)]) AS ratio
  FROM documents LEFT JOIN labels USING (doc_id))""")
def nonnull_ratio(spark, sf_dir):
    """Share of values in each column, all in one pass, then turned to rows."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return quality.nonnull_ratio(d, ["lang", "quality", "text", "toxic"])


@query("""SELECT 'both' AS part, count(*) AS n FROM (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900 INTERSECT SELECT s_nationkey FROM supplier) UNION ALL
  SELECT 'only_customers', count(*) FROM (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900 EXCEPT SELECT s_nationkey FROM supplier) UNION ALL
  SELECT 'either', count(*) FROM (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900 UNION SELECT s_nationkey FROM supplier) UNION ALL
  SELECT 'all', count(*) FROM (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900 UNION ALL SELECT s_nationkey FROM supplier)""")
def set_operations(spark, sf_dir):
    """U1-U4."""
    a = table(spark, sf_dir, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("k"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    parts = {"both": a.intersect(b), "only_customers": a.exceptAll(a.join(b, "k", "left_semi")).distinct(), "either": a.union(b).distinct(), "all": a.unionByName(b)}
    out = None
    for name, rows in parts.items():
        counted = rows.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
        out = counted if out is None else out.unionByName(counted)
    return out


SAMPLE_HASH = "(c_custkey * 2654435761) % 4294967296"


@query(f"""WITH s AS (SELECT c_custkey, c_mktsegment, {SAMPLE_HASH} AS h FROM customer), a AS (SELECT c_custkey, 'rich' AS stratum FROM s JOIN customer USING (c_custkey) WHERE c_acctbal > 9500 ORDER BY h, c_custkey LIMIT 8),
  b AS (SELECT c_custkey, 'building' AS stratum FROM s WHERE c_mktsegment = 'BUILDING' AND c_custkey NOT IN (SELECT c_custkey FROM a) ORDER BY h, c_custkey LIMIT 12),
  c AS (SELECT c_custkey, 'fill' AS stratum FROM s WHERE c_custkey NOT IN (SELECT c_custkey FROM a UNION ALL SELECT c_custkey FROM b) ORDER BY h, c_custkey LIMIT 34) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""")
def stratified_sample(spark, sf_dir):
    """Strata in order, each without what came before, then a fill; in hash order instead of a random one."""
    c = table(spark, sf_dir, "customer")
    return quality.stratified(c, "c_custkey", (F.col("c_custkey") * 2654435761) % 4294967296, [("rich", F.col("c_acctbal") > 9500, 8), ("building", F.col("c_mktsegment") == "BUILDING", 12)], 54).select("c_custkey", "stratum")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, ((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) % 4)::INT AS shard FROM events")
def round_robin(spark, sf_dir):
    """Running number within a user and its shard."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select("event_id", n.cast("long").alias("n"), ((n - 1) % 4).alias("shard"))


@query("""WITH m AS (SELECT page_id, len(regexp_extract_all(html, '<li>')) AS rows, len(regexp_extract_all(html, '[0-9]+')) AS nums, length(html) AS n FROM pages), s AS (SELECT *, rows * 100 + nums * 5 + n // 20 AS score FROM m)
  SELECT page_id, score::BIGINT AS score, CASE WHEN rows <= 4 AND nums < 3 THEN 'low' WHEN rows <= 4 OR (nums < 8 AND rows < 8) THEN 'medium' ELSE 'high' END AS confidence,
    array_to_string(list_filter([CASE WHEN n < 1500 THEN 'short' END, CASE WHEN nums > 12 THEN 'many_numbers' END, CASE WHEN rows = 0 THEN 'no_rows' END], lambda x: x IS NOT NULL), ';') AS tags FROM s""")
def page_quality_rules(spark, sf_dir):
    """Score by rows, numbers and length; tags of the rules that hold."""
    return quality.page_quality(table(spark, sf_dir, "pages"), "page_id", "html", row_tag="<li>")


@query("""SELECT c.name, c.least, c.n, c.first_day, CASE WHEN n < least THEN 'too_few' WHEN first_day > latest_start THEN 'starts_late' ELSE 'ok' END AS status FROM (
  SELECT 'orders' AS name, 10 AS least, DATE '1995-01-05' AS latest_start, count(*) AS n, min(o_orderdate)::DATE AS first_day FROM orders UNION ALL
  SELECT 'events', 100000000, DATE '2024-01-01', count(*), min(ts)::DATE FROM events UNION ALL SELECT 'shipments', 10, DATE '1990-01-01', count(*), min(l_shipdate)::DATE FROM lineitem) c""")
def coverage_expectations(spark, sf_dir):
    """Rows and first day of each dataset against what is expected of it."""
    spans = [("orders", "orders", "o_orderdate"), ("events", "events", "ts"), ("shipments", "lineitem", "l_shipdate")]
    expected = [("orders", 10, "1995-01-05"), ("events", 100_000_000, "2024-01-01"), ("shipments", 10, "1990-01-01")]
    return quality.coverage(spark, [(n, table(spark, sf_dir, t), c) for n, t, c in spans], expected)


@query("""WITH x AS (SELECT quality AS y, (doc_id % 3 = 0)::INT AS p FROM labels) SELECT count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 0 AND p = 0) AS tn,
  round(count(*) FILTER (y = 1 AND p = 1) / nullif(count(*) FILTER (p = 1), 0), 6) AS "precision", round(count(*) FILTER (y = 1 AND p = 1) / nullif(count(*) FILTER (y = 1), 0), 6) AS recall,
  round(2 * count(*) FILTER (y = 1 AND p = 1) / nullif(count(*) FILTER (p = 1) + count(*) FILTER (y = 1), 0), 6) AS f1, round(count(*) FILTER (y = p) / count(*), 6) AS accuracy, round(count(*) FILTER (p = 1) / count(*), 6) AS yes_ratio FROM x""")
def binary_metrics(spark, sf_dir):
    """M7: counts and rates in one pass; no predicted positive gives null precision."""
    from tidemark.operators import metrics

    x = table(spark, sf_dir, "labels").select(F.col("quality").alias("y"), (F.col("doc_id") % 3 == 0).cast("int").alias("p"))
    return metrics.binary(x, "y", "p")


@query("""WITH x AS (SELECT p_partkey, lower(trim(p_name)) AS a, lower(trim(p_type)) AS b FROM part), d AS (SELECT *, levenshtein(a, b) AS d, greatest(length(a), length(b)) AS m FROM x)
  SELECT p_partkey, round(CASE WHEN m = 0 THEN 1 WHEN 1 - d / m >= 0.5 THEN 1 - d / m ELSE 0 END, 6) AS anls FROM d""")
def anls_similarity(spark, sf_dir):
    """M2, M6."""
    from tidemark.operators import metrics

    return table(spark, sf_dir, "part").select("p_partkey", r6(metrics.anls(F.col("p_name"), F.col("p_type")), "anls"))


@query("""WITH b AS (SELECT p_partkey, p_size AS x1, p_size % 7 AS y1, p_size + 10 AS x2, p_size % 7 + 8 AS y2, p_size + p_partkey % 9 AS u1, p_size % 5 AS v1, p_size + 12 AS u2, p_size % 5 + 6 AS v2 FROM part),
  i AS (SELECT *, greatest(0, least(x2, u2) - greatest(x1, u1)) * greatest(0, least(y2, v2) - greatest(y1, v1)) AS inter FROM b)
  SELECT p_partkey, round(inter / nullif(((x2 - x1) * (y2 - y1) + (u2 - u1) * (v2 - v1) - inter)::DOUBLE, 0), 6) AS iou FROM i""")
def box_iou(spark, sf_dir):
    """M3."""
    from tidemark.operators import metrics

    s, k = F.col("p_size"), F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", r6(metrics.iou([s, s % 7, s + 10, s % 7 + 8], [s + k % 9, s % 5, s + 12, s % 5 + 6]), "iou"))


@query("""WITH x AS (SELECT c_custkey, c_acctbal AS pred, c_acctbal * (1 + (c_custkey % 11 - 5) / 100.0::DOUBLE) AS gold FROM customer)
  SELECT c_custkey, CASE WHEN gold = 0 THEN pred = 0 ELSE abs(pred - gold) / abs(gold) <= 0.05 END AS correct FROM x WHERE abs(abs(pred - gold) / nullif(abs(gold), 0) - 0.05) > 0.0001""")
def relaxed_accuracy(spark, sf_dir):
    """M1: numbers within five per cent."""
    from tidemark.operators import metrics

    x = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("pred"), (F.col("c_acctbal") * (1 + (F.col("c_custkey") % 11 - 5) / F.lit(100.0))).alias("gold"))
    x = x.where(F.abs(F.try_divide(F.abs(F.col("pred") - F.col("gold")), F.abs("gold")) - 0.05) > 0.0001)
    return x.select("c_custkey", metrics.relaxed(F.col("pred").cast("string"), F.col("gold").cast("string")).alias("correct"))


@query("""WITH a AS (SELECT l_orderkey AS q, l_returnflag AS answer, count(*) AS n FROM lineitem GROUP BY 1, 2), t AS (SELECT q, sum(n) AS total FROM a GROUP BY 1)
  SELECT q, answer, n, round((n * least(1, (n - 1) / 3.0::DOUBLE) + (total - n) * least(1, n / 3.0::DOUBLE)) / total, 6) AS soft_score FROM a JOIN t USING (q)""")
def consensus_accuracy(spark, sf_dir):
    """M4, M5: leave-one-out agreement with the other answers to a question, from counts: no join of answers with each other."""
    from tidemark.operators import metrics

    x = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_returnflag").alias("answer"))
    return metrics.soft_answers(x, "q", "answer").select("q", "answer", "n", r6(F.col("soft_score"), "soft_score"))


@query("""SELECT user_id, count(*) AS steps, count(DISTINCT event_type) AS kinds, round(nullif(sum(value), 0), 4) AS total, max(event_type) FILTER (ts = last_ts AND event_id = last_id) AS last_type
  FROM (SELECT *, last_value(ts) OVER w AS last_ts, last_value(event_id) OVER w AS last_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) GROUP BY 1""")
def event_trace_summary(spark, sf_dir):
    """Steps, kinds, total (null for 0) and the latest event per user, by one aggregation."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.count("*").alias("steps"), F.countDistinct("event_type").alias("kinds"), F.round(F.nullif(F.sum("value"), F.lit(0.0)), 4).alias("total"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))


@query("SELECT event_id, user_id, (props->>'$.k')::BIGINT AS k FROM events WHERE json_valid(props)")
def event_props(spark, sf_dir):
    """JSON by a schema; what does not parse is skipped."""
    e = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k bigint"))
    return e.where("p IS NOT NULL").select("event_id", "user_id", "p.k")


@query("""WITH g AS (SELECT conv_id, turn, role, min(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS gate FROM conversations)
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role = 'user' AND turn < coalesce(gate, 1000000) THEN coalesce(gate, 1000000) ELSE turn END, CASE WHEN role = 'user' AND turn < coalesce(gate, 1000000) THEN 1 ELSE 0 END, turn) AS emitted FROM g""")
def ordered_emitter_batch(spark, sf_dir):
    """Rows of one kind are held back until the gate of their key, then come in order; without a gate, at the end."""
    from tidemark.streaming.eventlog import emitted_order

    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return emitted_order(c, "conv_id", "turn", held=F.col("role") == "user", gate=F.col("role") == "assistant").select("conv_id", "turn", "emitted")


@query("""SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\\s+', ' ', 'g')) AS title, len(regexp_extract_all(html, '<a [^>]*href=')) AS links,
  split_part(split_part(url, '://', 2), '/', 1) AS host, length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS n_text FROM pages""")
def html_text_fields(spark, sf_dir):
    """Title, links, host, and the length of the text without tags."""
    from tidemark.functions.scalars import strip_tags

    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)</title>", 1), r"\s+", " ")).alias("title"), F.regexp_count("html", F.lit("<a [^>]*href=")).cast("long").alias("links"), F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host"), F.length(strip_tags(F.col("html"))).cast("long").alias("n_text"))
