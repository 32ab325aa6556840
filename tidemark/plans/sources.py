"""Queries on readers and writers: tables are written by Spark in the formats of exports, documents and logs, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import documents, quality, rules, text
from tidemark.plans.registry import registry
from tidemark.sources import files, snapshots, table
from tidemark.sources.scratch import scratch_path
from tidemark.streaming import eventlog

QUERIES, ORACLE, query = registry()


@query("""SELECT lpad(o_orderkey::VARCHAR, 8, '0') AS code, '單 "' || o_orderstatus || '", ' || o_orderpriority AS name, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price FROM orders""")
def csv_export(spark, sf_dir):
    """An export in a legacy encoding with quotes, NaN, lines that do not fit and notes at its end; codes stay text, one column is left out."""
    path = scratch_path(spark, "csv")
    o = table(spark, sf_dir, "orders")
    fields = {"code": F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), "name": F.concat(F.lit('單 "'), "o_orderstatus", F.lit('", '), "o_orderpriority"), "price": F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice").cast("string")).otherwise("NaN"), "day": F.date_format("o_orderdate", "yyyy-MM-dd")}
    rows = o.select(*(c.alias(n) for n, c in fields.items()))
    notes = o.groupBy("o_orderstatus").count().select(F.concat(F.lit("數據來源 "), "o_orderstatus").alias("code"), F.lit("").alias("name"), F.lit("1").alias("price"), F.lit("").alias("day"))
    unfit = o.groupBy("o_orderpriority").count().select(F.lit("00000000").alias("code"), F.col("o_orderpriority").alias("name"), F.lit("no number").alias("price"), F.lit("").alias("day"))
    files.allow_encoding(spark, "gb18030")
    rows.union(notes).union(unfit).write.option("header", True).option("encoding", "gb18030").option("escape", '"').csv(path)
    back = files.csv(spark, path, "code string, name string, price double, day string", encoding="gb18030", tolerant=True, columns=["code", "name", "price"], escape='"')
    return files.with_footers(back, "code", r"^\d{8}$")


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS date, event_type, count(*)::DOUBLE AS value FROM events WHERE event_type IN ('click', 'error', 'view') GROUP BY 1, 2)
  SELECT date, event_type AS code, 'Index ' || upper(event_type) AS name, value FROM d""")
def wide_export(spark, sf_dir):
    """A wide export with a row of names, one of codes and a row per day, turned into rows; empty cells left out."""
    path = scratch_path(spark, "wide")
    kinds = ["click", "error", "view"]
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("date")).pivot("event_type", kinds).count()
    line = F.concat_ws(";", F.date_format("date", "yyyyMMdd"), *(F.coalesce(F.format_number(k, 0), F.lit("0")) for k in kinds))
    # An export is one file: its days are few, however many events there are.
    text_ = days.agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))
    head = "x;" + ";".join(f"Index {k.upper()}" for k in kinds) + "\ndate;" + ";".join(kinds) + "\n"
    text_.select(F.concat(F.lit(head), "body", F.lit("\nSource: z;;;"))).write.text(path)
    return files.index_export(spark, path)


@query("""SELECT event_id, event_type, value FROM events""")
def json_line_export(spark, sf_dir):
    """One object a line; blank and broken lines are left out."""
    path = scratch_path(spark, "jsonl")
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    broken = e.groupBy("event_type").count().select(F.concat(F.lit('{"event_id": 1, "event_type": "'), "event_type").alias("value"))
    e.select(F.to_json(F.struct("*")).alias("value")).union(broken).union(broken.select(F.lit("  "))).write.text(path)
    return files.json_lines(spark, path, "event_id long, event_type string, value double")


@query("""SELECT event_type AS event, user_id, count(*) AS n, min(event_id) AS first_id FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2""")
def event_log(spark, sf_dir):
    """A log written in two parts and tailed in two goes: what was read before is not read again, broken lines are passed over."""
    log, out, at = (scratch_path(spark, n) for n in ("log", "read", "checkpoint"))
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL AND ts IS NOT NULL")
    line = F.to_json(F.struct(F.col("event_type").alias("event"), F.create_map(F.lit("id"), F.col("event_id").cast("string"), F.lit("user"), F.col("user_id").cast("string")).alias("data"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts")))
    for part in ("event_type < 'error'", "event_type >= 'error'"):
        lines = e.where(part).select(line.alias("value"))
        lines.union(lines.limit(1).select(F.lit("not json"))).write.mode("append").text(log)
        eventlog.append(eventlog.tail(spark, log), out, at).awaitTermination()
    back = spark.read.schema("event string, data map<string,string>, ts string").json(out)
    return back.groupBy("event", F.col("data.user").cast("long").alias("user_id")).agg(F.count("*").alias("n"), F.min(F.col("data.id").cast("long")).alias("first_id"))


@query("""SELECT o_orderstatus AS status, count(*) AS n, sum(o_custkey)::BIGINT AS customers, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS first_load, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS second_load, 0 AS third_load FROM orders GROUP BY 1""")
def incremental_load(spark, sf_dir):
    """A table loaded in parts that overlap, each row once, counted while it is written."""
    path = scratch_path(spark, "load")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    loads = [snapshots.load_new(o.where(part), path, ["o_orderkey"], note)["rows"] for part, note in (("o_orderstatus = 'F'", "first"), ("true", "all"), ("true", "again"))]
    rows = spark.read.parquet(path).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.sum("o_custkey").alias("customers"))
    return rows.select("status", "n", "customers", F.lit(loads[0]).cast("long").alias("first_load"), F.lit(loads[1]).cast("long").alias("second_load"), F.lit(loads[2]).cast("int").alias("third_load"))


@query("""SELECT o_custkey, sum(o_totalprice > 150000)::BIGINT AS large, count(*) AS n FROM orders GROUP BY 1""")
def replaced_report(spark, sf_dir):
    """A JSON report put in the place of an older one by one rename; what a reader opened before stays whole."""
    path = scratch_path(spark, "report")
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_totalprice") > 150000).alias("large"), F.count("*").alias("n"))
    snapshots.replace(o.select("o_custkey", F.lit(0).cast("long").alias("large"), F.lit(0).cast("long").alias("n")), path)
    snapshots.replace(o, path)
    return snapshots.current(spark, path)


@query("""SELECT count(*) AS "rows", 3 AS columns, strftime(min(o_orderdate), '%Y-%m-%d') AS date_min, strftime(max(o_orderdate), '%Y-%m-%d') AS date_max, 'orders' AS note FROM orders""")
def export_statistics(spark, sf_dir):
    """Rows, columns and days of an export, told beside it and counted while it is written."""
    path = scratch_path(spark, "stats")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_totalprice")
    files.write_with_stats(o, path, "day", note="orders", kind="csv")
    told = spark.read.schema("rows long, columns array<string>, date_min string, date_max string, note string").json(f"{path}_meta")
    return told.withColumn("columns", F.size("columns"))


@query("""WITH c AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS pages FROM conversations),
  s AS (SELECT conv_id, n + 2 AS start, coalesce(lead(n + 2) OVER (PARTITION BY conv_id ORDER BY n) - 1, pages + 5) AS "end", 'Part ' || n || ' ' || role AS title FROM c)
  SELECT conv_id, title, start::INT AS start, "end"::INT AS "end" FROM s""")
def contents_spans(spark, sf_dir):
    """Lines of a table of contents to titles and printed pages, the median offset to the pages found, and sections from page to page."""
    from pyspark.sql.window import Window

    of = Window.partitionBy("conv_id")
    c = table(spark, sf_dir, "conversations").withColumn("n", F.row_number().over(of.orderBy("turn")))
    line = F.concat(F.lit("Part "), F.col("n").cast("string"), F.lit(" "), "role", F.lit(" ......... "), F.col("n").cast("string"))
    toc = c.groupBy("conv_id").agg(F.concat(F.lit("CONTENTS\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("l")))), lambda x: x["l"]), "\n"), F.lit("\nno dots 7")).alias("text"), F.count("*").alias("pages"))
    entries = documents.toc_entries(toc, "conv_id", "text")
    # Titles are found two pages after what is printed; one in three is found a page or two off.
    found = c.select("conv_id", F.concat(F.lit("Part "), F.col("n").cast("string"), F.lit(" "), "role").alias("title"), (F.col("n") + 2 + F.when(F.col("n") % 3 == 2, F.col("n") % 2 + 1).otherwise(0)).alias("found"))
    pairs = entries.join(found, ["conv_id", "title"])
    offset = documents.page_offset(pairs, "conv_id", "found", "page")
    spans = entries.join(offset, "conv_id").withColumn("start", F.col("page") + F.col("offset"))
    end = F.coalesce(F.lead("start").over(of.orderBy("start")) - 1, F.col("pages") + 5)
    return spans.join(toc.select("conv_id", "pages"), "conv_id").select("conv_id", "title", "start", end.cast("int").alias("end"))


@query("""WITH c AS (SELECT conv_id, string_agg('## Page ' || turn || chr(10) || text, chr(10) ORDER BY turn) AS t FROM conversations GROUP BY 1), p AS (SELECT conv_id, string_agg(trim(text, ' ' || chr(10) || chr(9) || chr(13)), chr(10) || chr(10) ORDER BY turn) AS t FROM conversations WHERE turn BETWEEN 1 AND 2 GROUP BY 1)
  SELECT c.conv_id, coalesce(p.t, '') AS pages FROM c LEFT JOIN p USING (conv_id)""")
def markdown_pages(spark, sf_dir):
    """The pages two and three of documents with a header line before each page."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("## Page "), F.col("turn").cast("string"), F.lit("\n"), "text").alias("p")))).alias("t"))
    return c.select("conv_id", scalars.page_slice(F.array_join(F.transform("t", lambda x: x["p"]), "\n"), 1, 2).alias("pages"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus AS s, o_totalprice AS v, o_orderkey % 130 AS x, o_orderkey % 7 AS y FROM orders)
  SELECT o_orderkey, CASE WHEN x < 100 THEN [x + 0.5] ELSE [] END::DOUBLE[] || [y + 1]::DOUBLE[] AS shares, least(greatest(x - 20, 0), 100)::DOUBLE AS bounded, s <> 'P' AS latin, CASE WHEN s = 'F' THEN 'high=' || x || '.00; low=' || y || '.00' ELSE 'high=' || x || '.00; low=—' END AS series,
    CASE WHEN s = 'F' THEN ['total', 'net'] WHEN s = 'O' THEN ['total', 'net', 'open'] ELSE ['total', 'net', 'of', 'part'] END AS terms, s = 'P' AND y > 3 AS groups, s IN ('F', 'O') AS labelled FROM o""")
def measures_of_texts(spark, sf_dir):
    """Percentages in (0, 100], bounded values, mostly Latin or not, series as text, ordered distinct terms, ands of ors, row labels."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderstatus AS s", "o_orderkey % 130 AS x", "o_orderkey % 7 AS y")
    words = F.when(F.col("s") == "F", "Revenue of 2024").when(F.col("s") == "O", "收入 revenue total").otherwise("收入及其他收益 x")
    query_ = F.when(F.col("s") == "F", "net total a").when(F.col("s") == "O", "net total open net").otherwise("net of part x")
    label = F.when(F.col("s") == "F", "收入 (3)").when(F.col("s") == "O", "  收入").otherwise("其他收入")
    clause = F.when((F.col("s") == "P") & (F.col("y") > 3), "net assets and total").when(F.col("s") == "P", "net assets").otherwise("total")
    series = F.create_map(F.lit("low"), F.when(F.col("s") == "F", F.col("y")).cast("double"), F.lit("high"), F.col("x").cast("double"))
    return o.select(
        "o_orderkey", scalars.percentages(F.concat(F.lit("a share of "), F.col("x").cast("string"), F.lit(".5%, 0% and 250 %, then "), (F.col("y") + 1).cast("string"), F.lit(" ％ of 12"))).alias("shares"),
        rules.clamp((F.col("x") - 20).cast("double")).alias("bounded"), scalars.mostly_latin(words).alias("latin"), scalars.series_text(series).alias("series"),
        text.query_terms(F.array(F.lit("total")), query_).alias("terms"), text.all_groups_hit(clause, [["net", "gross"], ["total", "sum"]]).alias("groups"), text.label_row(label, "收入").alias("labelled"),
    )


@query("""WITH p AS (SELECT o_custkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'low' WHEN o_orderpriority = '3-MEDIUM' THEN 'medium' ELSE 'high' END AS c, o_totalprice AS s FROM orders)
  SELECT o_custkey, CASE WHEN bool_or(c = 'low') THEN 'low' WHEN bool_or(c = 'medium') THEN 'medium' ELSE 'high' END AS confidence, max(s) AS score FROM p GROUP BY 1""")
def worst_confidence(spark, sf_dir):
    """The weakest confidence and the best score of what belongs together."""
    c = F.when(F.col("o_orderpriority") == "5-LOW", "low").when(F.col("o_orderpriority") == "3-MEDIUM", "medium").otherwise("high")
    return quality.worst_of(table(spark, sf_dir, "orders").select("o_custkey", c.alias("confidence"), F.col("o_totalprice").alias("score")), "o_custkey", "confidence", "score")
