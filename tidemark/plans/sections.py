"""Queries on section maps: an order is a document, its lines are pages, weekdays of shipping are sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import sections
from tidemark.plans.registry import registry
from tidemark.sources import table

QUERIES, ORACLE, query = registry()

DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def elements(spark, sf_dir):
    """Each order's lines as pages, two after the number printed in the contents; a line's weekday is the page's header, title or text."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("n"), F.date_format("l_shipdate", "EEEE").alias("weekday"), "l_linestatus", "l_returnflag")
    entry = F.concat("weekday", F.lit(" / "), "l_linestatus", F.lit(" ..... "), F.col("n").cast("string"))
    kind = F.when(F.col("l_returnflag") == "R", "header").when(F.col("l_returnflag") == "N", "title").otherwise("text")
    element = lambda page, position, category, text: F.struct(page.cast("int").alias("page"), position.alias("position"), category.alias("category"), text.alias("text"))
    # Both elements of a line are made where it lies: by document, as the map needs them.
    both = F.array(element(F.lit(1), F.col("n"), F.lit("text"), entry), element(F.col("n") + 2, F.lit(0), kind, F.col("weekday")))
    return lines.repartition("doc").select("doc", F.inline(both))


def _map(spark, sf_dir):
    aliases = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{m}', '{m.lower()}', {i})" for i, m in enumerate(DAYS)) + " AS a(alias, section, priority)")
    return sections.section_map(elements(spark, sf_dir), aliases)


STARTS = """a AS (SELECT doc, section, page, h FROM (SELECT *, bool_or(h) OVER (PARTITION BY doc, page) AS top FROM (SELECT l_orderkey AS doc, lower(dayname(l_shipdate)) AS section, l_linenumber + 2 AS page, l_returnflag = 'R' AS h FROM lineitem WHERE l_returnflag IN ('R', 'N'))) WHERE h OR NOT top),
  u AS (SELECT * FROM (SELECT *, bool_or(h) OVER (PARTITION BY doc, section) AS headed FROM a) WHERE h OR NOT headed),
  s AS (SELECT doc, section, min(page) AS start, count(DISTINCT page) AS pages, bool_or(headed) AS headed FROM u GROUP BY 1, 2)"""


@query(f"""WITH {STARTS}, last AS (SELECT l_orderkey AS doc, max(l_linenumber) + 2 AS last FROM lineitem GROUP BY 1)
  SELECT doc, section, start, greatest(start, coalesce(lead(start) OVER (PARTITION BY doc ORDER BY start, section) - 1, last)) AS "end", pages, CASE WHEN headed AND pages >= 2 THEN 0.95 ELSE 0.8 END::DOUBLE AS confidence FROM s JOIN last USING (doc)""")
def section_map_spans(spark, sf_dir):
    """Anchors of headers before titles, sections from where they begin to where the next one does."""
    return _map(spark, sf_dir)[0]


@query(f"""WITH {STARTS}, l AS (SELECT l_orderkey AS doc, l_linenumber AS n, dayname(l_shipdate) AS weekday, l_linestatus AS i, count(*) OVER (PARTITION BY l_orderkey) AS lines FROM lineitem),
  e AS (SELECT l.*, start FROM l LEFT JOIN s ON s.doc = l.doc AND s.section = lower(l.weekday) WHERE lines >= 2),
  o AS (SELECT doc, round_even(median(start - n), 0)::INT AS "offset" FROM e WHERE start IS NOT NULL GROUP BY 1)
  SELECT e.doc, row_number() OVER (PARTITION BY e.doc ORDER BY n, weekday, i) - 1 AS entry, weekday || ' / ' || i AS title, n::VARCHAR AS printed, lower(weekday) AS section, coalesce(start, n + "offset") AS target, CASE WHEN start IS NULL THEN 0.8 ELSE 0.9 END::DOUBLE AS confidence, "offset"
  FROM e LEFT JOIN o ON o.doc = e.doc""")
def section_map_entries(spark, sf_dir):
    """Pages of contents found by their lines, entries with leaders, and pages by anchors or by the median offset."""
    return _map(spark, sf_dir)[1].select("doc", "entry", "title", "printed", "section", "target", "confidence", "offset")
