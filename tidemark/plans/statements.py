"""Queries on statements and named fields in tables: each text is made from the tables by Spark, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import html_tables
from tidemark.operators import statements
from tidemark.plans.registry import registry
from tidemark.sources import table

QUERIES, ORACLE, query = registry()

#: Names of the rows of statements, by table and metric; the last two tables' metrics are parts of totals.
LABELS = {
    "TBL_IS": {
        "REV": ["營業收入", "营业收入", "營業額", "营业额", "收入", "收益"],
        "OTHER_INCOME": ["其他收入及收益", "其他收入", "其他收益", "其他淨收入", "其他净收入"],
        "COGS": ["銷售成本", "销售成本", "营业成本"],
        "GP": ["毛利"],
        "NET_LOSS": ["年內利潤", "年内利润", "期內利潤", "期内利润", "年內虧損", "期內虧損"],
    },
    "TBL_BS": {
        "TOTAL_ASSETS": ["總資產", "总资产", "資產總額", "资产总额", "資產總值", "资产总值"],
        "TOTAL_LIAB": ["負債總額", "负债总额", "总负债", "總負債"],
        "NET_ASSETS": ["資產淨值", "资产净值", "淨資產", "净资产", "權益總額", "权益总额"],
        "NONCURRENT_ASSETS": ["非流動資產總值", "非流动资产总值"],
        "CURRENT_ASSETS": ["流動資產總值", "流动资产总值"],
        "NONCURRENT_LIAB": ["非流動負債總額", "非流动负债总额"],
        "CURRENT_LIAB": ["流動負債總額", "流动负债总额"],
    },
    "TBL_CF": {"CFO": ["經營活動所得現金流量淨額", "經營活動所得／（所用）"], "CFI": ["投資活動所用現金流量淨額"], "END_CASH": ["年末現金及現金等價物"]},
}
#: Words of rows that are not the metric's.
REJECT = {"REV": ["其他收入", "其他收益", "利息收入", "公允價值收益", "公允价值收益", "政府補助", "政府补助"], "TOTAL_ASSETS": ["減", "减"], "TOTAL_LIAB": ["流動負債總額", "流动负债总额"]}
DEFAULT_PERIODS = ["2021", "2022", "2023", "2024"]

#: Whole amounts of each customer and year; years are moved to those that headers name.
AMOUNTS = """y AS (SELECT o_custkey, year(o_orderdate) + 30 AS year, sum(CAST(round(o_totalprice * 100) AS BIGINT)) // 100 AS rev, count(*) * 1000 AS oi FROM orders GROUP BY 1, 2),
  a AS (SELECT o_custkey, c_mktsegment AS segment, year, rev, oi, rev * 6 // 10 AS cogs, rev - rev * 6 // 10 AS gp, CASE WHEN rev % 3 = 0 THEN -(rev // 7) ELSE rev // 7 END AS net, rev + 500 AS nca, rev // 2 + 300 AS ca, rev // 3 + 200 AS cl, rev // 5 + 200 AS ncl
    FROM y JOIN customer ON c_custkey = o_custkey),
  b AS (SELECT *, nca + ca AS ta, cl + ncl AS tl, nca + ca - cl - ncl AS na FROM a)"""


def _amounts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey", (F.year("o_orderdate") + 30).alias("year")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"), (F.count("*") * 1000).alias("oi"))
    o = o.withColumn("rev", F.expr("cents div 100")).join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment")), "o_custkey")
    o = o.selectExpr("*", "rev * 6 div 10 AS cogs", "rev - rev * 6 div 10 AS gp", "CASE WHEN rev % 3 = 0 THEN -(rev div 7) ELSE rev div 7 END AS net", "rev + 500 AS nca", "rev div 2 + 300 AS ca", "rev div 3 + 200 AS cl", "rev div 5 + 200 AS ncl")
    return o.selectExpr("*", "nca + ca AS ta", "cl + ncl AS tl", "nca + ca - cl - ncl AS na")


def _statements(spark, sf_dir):
    """code, text of each customer: an HTML income statement, a balance sheet in lines, a cash flow statement with a name over two rows.

    Segments write differently: names with a space within, leaders after them, notes' numbers, brackets, totals that are left out
    or wrong, rows that look like a metric's.
    """
    money = lambda x: F.when(x < 0, F.concat(F.lit("("), F.format_number(-x, 0), F.lit(")"))).otherwise(F.format_number(x, 0))
    # Amounts are written before they are gathered, each once.
    written = {c: money(F.col(c)) for c in ("oi", "rev", "gp", "net")} | {"cogs": money(-F.col("cogs"))} | {c: F.concat(F.format_number(F.col(c), 0), F.lit(".00")) for c in ("nca", "ca", "cl", "ncl", "ta", "tl", "na")}
    years = F.array_sort(F.collect_list(F.struct("year", F.concat(F.col("year").cast("string"), F.lit("年")).alias("name"), F.lit("999").alias("odd"), F.lit("1,000").alias("thousand"), F.lit("1,000.00").alias("low"), *(c.alias(n) for n, c in written.items()))))
    o = _amounts(spark, sf_dir).groupBy("o_custkey", "segment").agg(years.alias("y"))
    cells = lambda tag, value: F.concat(F.lit(f"<{tag}>"), F.array_join(F.col(f"y.{value}"), f"</{tag}><{tag}>"), F.lit(f"</{tag}>"))
    row = lambda name, value: F.concat(F.lit("<tr><td>"), name, F.lit("</td><td>4</td>"), cells("td", value), F.lit("</tr>"))
    head = F.concat(F.lit("<tr><th></th><th>附註</th>"), cells("th", "name"), F.lit("</tr>"))
    spaced = F.when(F.col("segment") == "BUILDING", "收 入").when(F.col("segment") == "MACHINERY", "收入．．．．").otherwise("收入")
    income = F.concat(
        F.lit("<p>千元</p><table>"), head, row(F.lit("其他收入及收益"), "oi"), row(F.lit("收入其他收益"), "odd"), row(spaced, "rev"),
        row(F.lit("銷售成本"), "cogs"), row(F.lit("毛利。"), "gp"), row(F.lit("年內利潤"), "net"), F.lit("</table>"),
    )
    line = lambda name, value: F.concat(F.lit(name), F.lit(" "), F.array_join(F.col(f"y.{value}"), " "))
    stated = F.when(F.col("segment") == "FURNITURE", "").when(F.col("segment") == "HOUSEHOLD", F.concat(line("總資產", "low"), F.lit("\n"))).otherwise(F.concat(line("資產總值", "ta"), F.lit("\n")))
    liabilities = F.when(F.col("segment") == "AUTOMOBILE", "").otherwise(F.concat(line("負 債總額", "tl"), F.lit("\n")))
    balance = F.concat(
        F.lit("千元 "), F.array_join("y.name", " "), F.lit("\n"), line("資產總值減流動負債", "na"), F.lit("\n"), line("非流動資產總值", "nca"), F.lit("\n"), line("流動資產總值", "ca"), F.lit("\n"),
        stated, line("流動負債總額", "cl"), F.lit("\n"), line("非流動負債總額", "ncl"), F.lit("\n"), liabilities, line("權益總額", "na"),
    )
    flows = F.concat(F.lit("<table>"), head, F.lit("<tr><td>經營活動所得／（所用）</td></tr>"), row(F.lit("現金流量淨額"), "net"), row(F.lit("投資活動"), "thousand"), F.lit("</table>"))
    texts = [("TBL_IS", income), ("TBL_BS", balance), ("TBL_CF", flows)]
    # Three years make a header; customers with fewer fall back on the default periods, which the SQL below leaves out with them.
    return o.where(F.size("y") >= statements.HEADER_YEARS).select("o_custkey", F.inline(F.array(*(F.struct(F.lit(c).alias("code"), t.alias("text")) for c, t in texts))))


_SERIES = f"""WITH {AMOUNTS}, many AS (SELECT o_custkey FROM y GROUP BY 1 HAVING count(*) >= 3), c AS (SELECT b.* FROM b SEMI JOIN many USING (o_custkey)),
  s AS (SELECT o_custkey, 'TBL_IS' AS code, 'REV' AS metric, year, rev AS v, 'row' AS source FROM c UNION ALL SELECT o_custkey, 'TBL_IS', 'OTHER_INCOME', year, oi, 'row' FROM c UNION ALL SELECT o_custkey, 'TBL_IS', 'COGS', year, -cogs, 'row' FROM c
    UNION ALL SELECT o_custkey, 'TBL_IS', 'GP', year, gp, 'row' FROM c UNION ALL SELECT o_custkey, 'TBL_IS', 'NET_LOSS', year, net, 'row' FROM c UNION ALL SELECT o_custkey, 'TBL_CF', 'CFO', year, net, 'row' FROM c
    UNION ALL SELECT o_custkey, 'TBL_BS', 'TOTAL_ASSETS', year, CASE WHEN segment = 'HOUSEHOLD' THEN 1000 ELSE ta END, 'row' FROM c WHERE segment <> 'FURNITURE' UNION ALL SELECT o_custkey, 'TBL_BS', 'NET_ASSETS', year, na, 'row' FROM c
    UNION ALL SELECT o_custkey, 'TBL_BS', 'TOTAL_LIAB', year, tl, 'line' FROM c WHERE segment <> 'AUTOMOBILE' UNION ALL SELECT o_custkey, 'TBL_BS', 'NONCURRENT_ASSETS', year, nca, 'row' FROM c UNION ALL SELECT o_custkey, 'TBL_BS', 'CURRENT_ASSETS', year, ca, 'row' FROM c
    UNION ALL SELECT o_custkey, 'TBL_BS', 'CURRENT_LIAB', year, cl, 'row' FROM c UNION ALL SELECT o_custkey, 'TBL_BS', 'NONCURRENT_LIAB', year, ncl, 'row' FROM c)"""


def _series(spark, sf_dir):
    return statements.metric_series(_statements(spark, sf_dir), "o_custkey", LABELS, REJECT, DEFAULT_PERIODS)


@query(f"""{_SERIES} SELECT o_custkey, code, metric, year::VARCHAR AS period, v::DOUBLE AS value, source FROM s""")
def metric_extraction(spark, sf_dir):
    """Series of metrics out of statements as tables and lines, names that only look alike rejected."""
    return _series(spark, sf_dir).select("o_custkey", "code", "metric", "period", "value", "source")


@query(f"""WITH {AMOUNTS}, many AS (SELECT o_custkey FROM y GROUP BY 1 HAVING count(*) >= 3), c AS (SELECT b.* FROM b SEMI JOIN many USING (o_custkey)),
  m AS (SELECT o_custkey, year::VARCHAR AS period, unnest([{{'metric': 'REV', 'value': rev, 'origin': 'read'}}, {{'metric': 'OTHER_INCOME', 'value': oi, 'origin': 'read'}}, {{'metric': 'COGS', 'value': -cogs, 'origin': 'read'}}, {{'metric': 'GP', 'value': gp, 'origin': 'read'}},
    {{'metric': 'NET_LOSS', 'value': net, 'origin': 'read'}}, {{'metric': 'CFO', 'value': net, 'origin': 'read'}}, {{'metric': 'NET_ASSETS', 'value': na, 'origin': 'read'}},
    {{'metric': 'TOTAL_LIAB', 'value': tl, 'origin': CASE WHEN segment = 'AUTOMOBILE' THEN 'parts' ELSE 'read' END}},
    {{'metric': 'TOTAL_ASSETS', 'value': ta, 'origin': CASE WHEN segment IN ('FURNITURE', 'HOUSEHOLD') THEN 'parts' ELSE 'read' END}}], recursive := true) FROM c)
  SELECT o_custkey, metric, period, value::DOUBLE AS value, origin FROM m UNION ALL SELECT o_custkey, 'GP_MARGIN', year::VARCHAR, round(gp / rev * 100, 2), 'derived' FROM c WHERE rev <> 0""")
def statement_metrics(spark, sf_dir):
    """Totals out of their parts where they are missing or too small, assets reconciled, margins derived."""
    return statements.statement_metrics(_series(spark, sf_dir), "o_custkey", ["NONCURRENT_ASSETS", "CURRENT_ASSETS"], ["NONCURRENT_LIAB", "CURRENT_LIAB"])


@query("""WITH f AS (SELECT o_orderkey, unnest([{'field': 'day', 'value': strftime(o_orderdate, '%d-%m-%Y'), 'position': 0}, {'field': 'status', 'value': o_orderstatus, 'position': 0}, {'field': 'customer', 'value': o_custkey::VARCHAR, 'position': 2}], recursive := true) FROM orders)
  SELECT o_orderkey, field, value, position::INT AS position FROM f""")
def labelled_fields(spark, sf_dir):
    """Whitelisted fields out of two cells or pairs of cells of a scraped table; other rows and names are left alone."""
    td = lambda *x: F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), c if not isinstance(c, str) else F.lit(c), F.lit("</td>")) for c in x), F.lit("</tr>"))
    html = F.concat(F.lit("<html><table>"), td("Day listed ：", F.date_format("o_orderdate", "dd-MM-yyyy"), "Status:", F.col("o_orderstatus")), td("Customer", ""), td("Customer", F.col("o_custkey").cast("string")), td("Priority", F.col("o_orderpriority")), td("Customer", "later"), F.lit("</table></html>"))
    pages = table(spark, sf_dir, "orders").select("o_orderkey", html.alias("html"))
    return statements.field_pairs(pages, "o_orderkey", "html", {"day": ["Daylisted", "ListingDay"], "status": ["Status"], "customer": ["Customer"]})


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
  g AS (SELECT o_custkey, 0 AS r, unnest(['customer', 'order', 'order']) AS cell, unnest([0, 1, 2]) AS c FROM o WHERE n = 1
    UNION ALL SELECT o_custkey, n, unnest(['no. ' || o_custkey, o_orderkey::VARCHAR, CASE WHEN o_orderstatus = 'F' THEN o_orderkey::VARCHAR ELSE o_orderstatus END]), unnest([0, 1, 2]) FROM o)
  SELECT o_custkey, r::INT AS row_number, c AS column_number, cell FROM g""")
def spanned_grid(spark, sf_dir):
    """Tables with row and column spans as rectangles of cells."""
    o = table(spark, sf_dir, "orders")
    wide = F.when(F.col("o_orderstatus") == "F", F.format_string("<td colspan=2>%d</td>", "o_orderkey")).otherwise(F.format_string("<td>%d</td><td>%s</td>", "o_orderkey", "o_orderstatus"))
    rows = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", wide.alias("td")))).alias("rows"))
    first = F.format_string("<td rowspan='%d'>no. %d</td>", F.size("rows"), "o_custkey")
    body = F.array_join(F.transform("rows", lambda r, i: F.concat(F.lit("<tr>"), F.when(i == 0, first).otherwise(""), r["td"], F.lit("</tr>"))), "")
    html = F.concat(F.lit("<table><tr><th>customer</th><th colspan=2>order</th></tr>"), body, F.lit("</table>"))
    return html_tables.cells(rows.select("o_custkey", html.alias("html")), "o_custkey", "html")
