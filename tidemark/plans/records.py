"""Queries on records: filters, orders, merges, values as they are parsed, routes and gates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import scalars
from tidemark.operators import documents, islands, joins, metrics, rules
from tidemark.plans.market import r6
from tidemark.plans.registry import registry
from tidemark.sources import table

QUERIES, ORACLE, query = registry()


@query("""SELECT p_partkey, p_brand, p_size FROM part WHERE p_brand <> 'Brand#11' AND p_size BETWEEN 10 AND 20 AND p_retailprice > 1000""")
def inequality_filter(spark, sf_dir):
    """What is not of a brand, within a range; all three reach the scan."""
    return table(spark, sf_dir, "part").where("p_brand <> 'Brand#11' AND p_size BETWEEN 10 AND 20 AND p_retailprice > 1000").select("p_partkey", "p_brand", "p_size")


@query("""SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey) AS place FROM orders
  QUALIFY place <= 3""")
def custom_order(spark, sf_dir):
    """O1: an order of one's own, then the price downward; three a customer."""
    own = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    w = Window.partitionBy("o_custkey").orderBy(own, F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("place", F.row_number().over(w)).where("place <= 3").select("o_custkey", "o_orderkey", "o_totalprice", "place")


@query("""SELECT o_custkey, o_orderdate::DATE AS day, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate::DATE ORDER BY o_orderkey DESC) = 1""")
def dedupe_keep_last(spark, sf_dir):
    """The last order of a customer's day."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderkey", "o_totalprice")
    return joins.keep_one(o, ["o_custkey", "day"], [F.desc("o_orderkey")])


@query("""WITH h AS (SELECT page_id, length(html) AS score, CASE page_id % 4 WHEN 0 THEN 'appendix' WHEN 1 THEN 'summary' WHEN 2 THEN 'discussion' ELSE 'other' END AS role, contains(html, '<article') AS body, len(string_split(url, '/')) AS span, split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages)
  SELECT page_id, host, row_number() OVER (PARTITION BY host ORDER BY body DESC, CASE role WHEN 'appendix' THEN 3 WHEN 'summary' THEN 2 WHEN 'discussion' THEN 1 ELSE 0 END DESC, score DESC, span DESC, page_id) AS rank FROM h""")
def composite_rank(spark, sf_dir):
    """Bodies, then roles, score and span."""
    role = F.element_at(F.array(*map(F.lit, ("appendix", "summary", "discussion", "other"))), (F.col("page_id") % 4 + 1).cast("int"))
    h = table(spark, sf_dir, "pages").select("page_id", F.length("html").alias("score"), role.alias("role"), F.contains("html", F.lit("<article")).alias("body"), F.size(F.split("url", "/")).alias("span"), F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host"))
    return documents.composite_rank(h, ["host"], F.col("body"), F.col("role"), "score", F.col("span"), ["page_id"]).select("page_id", "host", "rank")


@query("""WITH a AS (SELECT o_custkey AS k, o_orderkey AS v, 0 AS g FROM orders WHERE o_orderstatus = 'P'), b AS (SELECT o_custkey, o_orderkey, 1 FROM orders WHERE o_orderstatus = 'O'), c AS (SELECT o_custkey, o_orderkey, 2 FROM orders)
  SELECT k, v, g AS "group" FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) QUALIFY row_number() OVER (PARTITION BY k ORDER BY g, v) = 1""")
def ordered_merge(spark, sf_dir):
    """A customer's first pending order, else the first open one, else any."""
    o = table(spark, sf_dir, "orders")
    part = lambda rows: rows.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))
    return joins.first_of_groups([part(o.where("o_orderstatus = 'P'")), part(o.where("o_orderstatus = 'O'")), part(o)], ["k"], ["v"])


@query("""WITH a AS (SELECT l_suppkey AS k, l_orderkey AS a, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) - 1 AS place FROM lineitem WHERE l_returnflag = 'R'),
  b AS (SELECT l_suppkey AS k, l_orderkey AS b, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) - 1 AS place FROM lineitem WHERE l_returnflag = 'A')
  SELECT k, place, a, b FROM a FULL JOIN b USING (k, place)""")
def side_by_side(spark, sf_dir):
    """The n-th dearest returned item of a supplier beside the n-th dearest accepted one."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), "l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    of = lambda flag, side: l.where(F.col("l_returnflag") == flag).select("k", F.col("l_orderkey").alias(side), F.col("l_linenumber").alias(f"{side}_line"), F.col("l_extendedprice").alias(f"{side}_price"))
    order = lambda side: [F.desc(f"{side}_price"), side, f"{side}_line"]
    return joins.side_by_side(of("R", "a"), of("A", "b"), ["k"], order("a"), order("b")).select("k", "place", "a", "b")


@query("""WITH p AS (SELECT doc_id, (length(text) > 600)::INT AS p FROM documents) SELECT count(*) FILTER (p IS NOT NULL AND quality IS NOT NULL) AS matched, count(*) FILTER (p IS NOT NULL AND quality IS NULL) AS unlabelled,
  count(*) FILTER (p IS NULL AND quality IS NOT NULL) AS unpredicted, count(*) FILTER (p = quality) AS agreeing FROM p FULL JOIN labels USING (doc_id)""")
def prediction_labels(spark, sf_dir):
    """Lengths as predictions of quality, beside the labels."""
    p = table(spark, sf_dir, "documents").select("doc_id", (F.length("text") > 600).cast("int").alias("p"))
    return joins.predictions_with_labels(p, table(spark, sf_dir, "labels"), "doc_id", "p", "quality")


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, round(l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_suppkey), 4) AS off_mean FROM lineitem""")
def group_transform(spark, sf_dir):
    """A value against its group's mean, in every row."""
    l = table(spark, sf_dir, "lineitem")
    return l.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_extendedprice") - F.avg("l_extendedprice").over(Window.partitionBy("l_suppkey")), 4).alias("off_mean"))


@query("""SELECT l_shipdate::DATE AS date, count(*) FILTER (l_discount > 0.05) AS discounted, round(exp(avg(ln(l_quantity))), 6) AS geometric_mean, max(l_quantity) - min(l_quantity) AS spread FROM lineitem GROUP BY 1""")
def custom_aggregates(spark, sf_dir):
    """Aggregates of one's own as compositions of built-in ones, with partial sums in each task."""
    l = table(spark, sf_dir, "lineitem")
    return l.groupBy(F.to_date("l_shipdate").alias("date")).agg(F.count_if(F.col("l_discount") > 0.05).alias("discounted"), r6(F.exp(F.avg(F.log("l_quantity"))), "geometric_mean"), (F.max("l_quantity") - F.min("l_quantity")).alias("spread"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN -abs(c_acctbal) ELSE c_acctbal END AS balance, lpad((c_custkey % 10000)::VARCHAR, 4, '0') || '.HK' AS code, (regexp_extract(c_name, '[0-9]+'))::DOUBLE AS first_number, c_custkey % 1000 + 0.5 AS plain FROM customer""")
def parsed_values(spark, sf_dir):
    """Numbers as accounts write them, codes, the first number of a text; read back from texts made of the table's values."""
    balance = F.when(F.col("c_acctbal") < 0, F.concat(F.lit("("), F.format_number(F.abs("c_acctbal"), 2), F.lit(")"))).otherwise(F.format_number("c_acctbal", 2))
    c = table(spark, sf_dir, "customer").withColumns({"b": balance, "t": F.concat((F.col("c_custkey") % 10000).cast("string"), F.lit(".hk")), "n": F.format_number(F.col("c_custkey") % 1000 + 0.5, 1)})
    return c.select("c_custkey", scalars.accounting_number(F.col("b")).alias("balance"), scalars.ticker(F.col("t")).alias("code"), scalars.first_number(F.col("c_name")).alias("first_number"), scalars.plain_number(F.concat("n", F.lit("%"))).alias("plain"))


@query("""SELECT o_orderkey, o_orderdate::DATE AS packed, o_orderdate::DATE AS slashed, o_orderdate::DATE AS day_first, NULL::DATE AS wrong, datediff('day', DATE '1995-01-01', o_orderdate::DATE) AS days, o_orderdate::DATE + 90 AS later, strftime(o_orderdate, '%Y%m') AS month FROM orders""")
def parsed_dates(spark, sf_dir):
    """Days in mixed forms; differences, shifts and formats."""
    day = F.to_date("o_orderdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", day.alias("day"), F.date_format(day, "yyyyMMdd").alias("a"), F.date_format(day, "yyyy/M/d").alias("b"), F.date_format(day, "dd-MM-yyyy").alias("c"), F.date_format(day, "yyyy-99-dd").alias("d"))
    read = lambda c: scalars.to_day(F.col(c))
    return o.select("o_orderkey", read("a").alias("packed"), read("b").alias("slashed"), read("c").alias("day_first"), read("d").alias("wrong"), F.datediff("day", F.lit("1995-01-01").cast("date")).alias("days"), F.date_add("day", 90).alias("later"), F.date_format("day", "yyyyMM").alias("month"))


@query("""SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events""")
def json_from_text(spark, sf_dir):
    """The object within a fenced block, and the whole objects of an array that was cut off."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("Result:\n```json\n"), "props", F.lit("\n```\nDone.")).alias("fenced"), F.concat(F.lit("["), "props", F.lit(',{"k": 1')).alias("cut"))
    one = F.get_json_object(scalars.json_text(F.col("fenced")), "$.k").cast("long")
    first = F.get_json_object(scalars.whole_array(F.col("cut")), "$[0].k").cast("long")
    return e.select("event_id", F.when(one == first, one).alias("k"))


@query("""SELECT p_partkey, [round_even(p_size * 1.5, 0)::INT, round_even(p_size * 0.1, 0)::INT, p_size * 2] AS box, least(greatest(p_size - 5, 0), 25)::DOUBLE AS clamped, CASE WHEN p_size % 3 = p_size % 2 THEN [p_size % 3] ELSE [p_size % 3, p_size % 2] END AS seen, p_name <> '' AS filled FROM part""")
def boxes_and_bounds(spark, sf_dir):
    """Boxes scaled and rounded half to even, bounds, ordered distinct values, non-empty texts."""
    p = table(spark, sf_dir, "part")
    scaled = F.concat(scalars.scaled_box(F.array("p_size"), 1.5), scalars.scaled_box(F.array("p_size"), 0.1), scalars.scaled_box(F.array("p_size"), 2.0))
    seen = F.array_distinct(F.array(F.col("p_size") % 3, F.col("p_size") % 2, F.col("p_size") % 3))
    return p.select("p_partkey", scaled.alias("box"), rules.clamp((F.col("p_size") - 5).cast("double"), 0.0, 25.0).alias("clamped"), seen.alias("seen"), scalars.nonempty(F.col("p_name")).alias("filled"))


@query("""SELECT doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > 0 AS latin, len(regexp_extract_all(text, '[0-9]+(\\.[0-9]+)?\\s*%')) AS percents FROM documents""")
def text_measures(spark, sf_dir):
    """Share of Latin letters, and how many percentages a text names; see measures_of_texts for other scripts, series and bounds."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", scalars.mostly_latin(F.col("text")).alias("latin"), F.size(F.regexp_extract_all("text", F.lit(r"([0-9]+(\.[0-9]+)?\s*%)"), F.lit(1))).alias("percents"))


@query("""WITH n AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS n FROM conversations) SELECT conv_id, turn, CASE WHEN n = 0 THEN role ELSE role || '_i' || n END AS label FROM n""")
def sequence_suffixes(spark, sf_dir):
    """The second and further turns of a role numbered."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", islands.suffixed(c, ["conv_id"], "turn", "role").alias("label"))


@query("""WITH i AS (SELECT o_custkey AS image, o_totalprice > 150000 AS r FROM orders), g AS (SELECT image, sum(r::INT) AS ok, count(*) AS n FROM i GROUP BY 1) SELECT round(sum(ok) / sum(n), 9) AS accuracy, round(avg((ok = n)::INT), 9) AS accuracy_plus FROM g""")
def paired_accuracy(spark, sf_dir):
    """M8: answers that are right, and images all of whose answers are."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("image"), (F.col("o_totalprice") > 150000).alias("r"))
    return metrics.paired(o, "image", "r").select(F.round("accuracy", 9).alias("accuracy"), F.round("accuracy_plus", 9).alias("accuracy_plus"))


@query("""WITH r AS (SELECT event_id, user_id % 500 AS parent FROM events) SELECT event_id, parent FROM r WHERE parent NOT IN (SELECT event_id FROM events)""")
def parent_exists(spark, sf_dir):
    """Events that name a parent that is no event."""
    return joins.orphans(table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 500).alias("parent")), "event_id", "parent").select("event_id", "parent")


@query("""WITH spans AS (SELECT conv_id AS doc, role AS section, min(turn) AS start, max(turn) AS "end" FROM conversations GROUP BY 1, 2), routes(intent, position, section) AS (VALUES ('ask', 0, 'user'), ('ask', 1, 'assistant'), ('setup', 0, 'system')),
  requests AS (SELECT DISTINCT conv_id AS doc, unnest(['ask', 'setup', 'else']) AS intent FROM conversations),
  w AS (SELECT doc, intent, position, section FROM requests JOIN routes USING (intent) UNION ALL SELECT doc, intent, p, s FROM requests, (VALUES (0, 'assistant'), (1, 'user')) o(p, s) WHERE intent = 'else')
  SELECT doc, intent, position, section, start, "end" FROM w JOIN spans USING (doc, section)""")
def section_routes(spark, sf_dir):
    """The sections in which each intent is searched, by its route or by the usual one."""
    c = table(spark, sf_dir, "conversations")
    spans = c.groupBy(F.col("conv_id").alias("doc"), F.col("role").alias("section")).agg(F.min("turn").alias("start"), F.max("turn").alias("end"))
    routes = spark.createDataFrame([("ask", 0, "user"), ("ask", 1, "assistant"), ("setup", 0, "system")], "intent string, position int, section string")
    requests = c.select(F.col("conv_id").alias("doc")).distinct().select("doc", F.explode(F.array(*map(F.lit, ("ask", "setup", "else")))).alias("intent"))
    return documents.routed_sections(requests, routes, spans, ["assistant", "user"])


@query("""WITH q AS (SELECT item_id, CASE WHEN contains(text, 'the') THEN 'pipeline' ELSE 'finance' END AS section, length(text) > 200 AS is_open FROM benchmark WHERE text IS NOT NULL)
  SELECT item_id, 'scaled' AS way, CASE WHEN section = 'pipeline' AND NOT is_open THEN 'downweight' ELSE 'active' END AS gate, CASE WHEN section = 'pipeline' AND NOT is_open THEN 0.15 ELSE 1.0 END::DOUBLE AS score_scale FROM q
  UNION ALL SELECT item_id, 'skipped', CASE WHEN section = 'pipeline' AND NOT is_open THEN 'skipped' ELSE 'active' END, CASE WHEN section = 'pipeline' AND NOT is_open THEN 0.0 ELSE 1.0 END::DOUBLE FROM q""")
def query_gating(spark, sf_dir):
    """P20: queries of a gated section are scaled down, or skipped, where their gate is shut."""
    q = table(spark, sf_dir, "benchmark").where("text IS NOT NULL").select("item_id", F.when(F.contains("text", F.lit("the")), "pipeline").otherwise("finance").alias("section"), (F.length("text") > 200).alias("is_open"))
    ways = [documents.gated_queries(q, ["pipeline"], F.col("is_open"), skip).select("item_id", F.lit("skipped" if skip else "scaled").alias("way"), "gate", "score_scale") for skip in (False, True)]
    return ways[0].union(ways[1])


@query("""WITH c AS (SELECT conv_id AS doc, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS n_pages FROM conversations), f AS (SELECT doc, role AS section, min(n) AS start, any_value(n_pages) AS n_pages FROM c GROUP BY 1, 2),
  s AS (SELECT doc, section, start, coalesce(lead(start) OVER (PARTITION BY doc ORDER BY start) - 1, n_pages) AS "end", n_pages FROM f WHERE start > 1)
  SELECT d.doc, count(section) AS sections, 4 - count(section) FILTER (section IN ('user', 'assistant', 'system', 'tool')) AS missing, coalesce(sum("end" - start + 1), 0)::BIGINT AS covered, coalesce(sum("end" - start + 1), 0) / any_value(d.n_pages) AS coverage
  FROM (SELECT DISTINCT doc, n_pages FROM c) d LEFT JOIN s ON s.doc = d.doc GROUP BY d.doc""")
def section_map_quality(spark, sf_dir):
    """Expected sections found and not, and the share of a document that their pages cover; what comes before the first is in none."""
    of = Window.partitionBy("doc")
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), "role", "turn").withColumns({"n": F.row_number().over(of.orderBy("turn")), "n_pages": F.count("*").over(of)})
    first = c.groupBy("doc", F.col("role").alias("section")).agg(F.min("n").alias("start"), F.any_value("n_pages").alias("n_pages")).where("start > 1")
    spans = first.withColumn("end", F.coalesce(F.lead("start").over(of.orderBy("start")) - 1, F.col("n_pages")))
    expected = spark.createDataFrame([("user",), ("assistant",), ("system",), ("tool",)], "section string")
    return documents.section_map_quality(spans, expected, c.select("doc", "n_pages").distinct())


@query("""SELECT c_custkey, round(l / CASE WHEN abs(a) > 1e-9 THEN a END * 100, 2) AS debt_to_assets, round(p / CASE WHEN abs(r) > 1e-9 THEN r END * 100, 2) AS margin FROM
  (SELECT c_custkey, c_acctbal AS a, max(o_totalprice) AS r, min(o_totalprice) AS l, avg(o_totalprice) AS p FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)""")
def derived_ratios(spark, sf_dir):
    """Ratios of metrics that lie in rows."""
    by = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey", "c_acctbal").agg(F.max("o_totalprice").alias("revenue"), F.min("o_totalprice").alias("total_liabilities"), F.avg("o_totalprice").alias("net_profit"))
    rows = by.select("c_custkey", F.col("c_acctbal").alias("total_assets"), "revenue", "total_liabilities", "net_profit").unpivot("c_custkey", ["total_assets", "revenue", "total_liabilities", "net_profit"], "metric", "value")
    return documents.derived_ratios(rows, ["c_custkey"], "metric", "value")
