"""Queries on findings of themes in passages, evidence for reports, and parse documents of two shapes. Passages are made from the tables by Spark."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import findings
from tidemark.plans.registry import registry
from tidemark.sources import files, table

QUERIES, ORACLE, query = registry()


def _passages(spark, sf_dir):
    """A passage of each order: customers' and suppliers' shares, transactions of related parties, clauses, trials, and noise, by status and priority."""
    o = table(spark, sf_dir, "orders").selectExpr("*", "o_orderkey % 60 + 1 AS x", "o_orderkey % 37 + 2 AS y", "o_orderkey % 23 + 3 AS z")
    say = lambda *parts: F.concat(*(F.col(p[1:]).cast("string") if p.startswith("$") else F.lit(p) for p in parts))
    text = (
        F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "5-LOW"), say("<table><tr><td>供應商A</td><td>1,000</td><td>", "$x", ".5</td></tr><tr><td>供應商B</td><td>900</td><td>", "$y", "</td></tr></table>"))
        .when(F.col("o_orderstatus") == "F", say("最大客戶佔總收入", "$x", ".5%，前五大客戶佔", "$y", "%。同期，最大供應商佔總採購", "$z", "%。"))
        .when((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT"), say("優先股持有人有權要求公司贖回，年利率 ", "$y", ".25%，於 ", "$x", " 個月內"))
        .when((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "2-HIGH"), say("購回股份的一般授權及贖回，核心關連人士佔", "$z", "%"))
        .when(F.col("o_orderstatus") == "O", say("本公司訂有持續關連交易，年度上限佔", "$z", ".5%，上年佔", "$y", "%"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", say("核心产品HX", "$x", "因安全性问题被临床搁置"))
        .when(F.col("o_orderpriority") == "1-URGENT", say("我们的产品管线候选产品已完成一项常规I期临床研究"))
        .otherwise(say("關連人士的核心關連安排佔", "$x", "%"))
    )
    return o.select("o_custkey", F.col("o_orderkey").alias("page"), F.col("o_orderkey").alias("rank"), F.lit(None).cast("string").alias("code"), text.alias("text"))


@query("""WITH o AS (SELECT *, o_orderkey % 60 + 1 AS x, o_orderkey % 37 + 2 AS y, o_orderkey % 23 + 3 AS z, o_orderstatus AS s, o_orderpriority AS p FROM orders),
  c AS (SELECT *, p = '5-LOW' AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN p = '5-LOW' THEN 7 ELSE 3 END DESC, o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS all_ FROM o WHERE s = 'F'),
  cg AS (SELECT o_custkey, 'concentration' AS theme, any_value(all_) AS n_relevant, 0 AS n_noise, any_value(all_) AS n_found, NULL::DOUBLE AS ratio, NULL::DOUBLE AS rate, NULL::INT AS months,
      min_by(greatest(x + 0.5, y), n) FILTER (NOT t) AS c1, min_by(y, n) FILTER (NOT t) AS c5, min_by(z, n) FILTER (NOT t) AS s1, max(greatest(x + 0.5, y, CASE WHEN t THEN 0 ELSE z END)) AS top, sum(x + 0.5 + y + CASE WHEN t THEN 0 ELSE z END) AS total, max(x + 0.5) AS dummy
    FROM c WHERE n <= 15 GROUP BY 1),
  cf AS (SELECT o_custkey, theme, n_relevant, n_noise, n_found, ratio, rate, months, c1::DOUBLE AS top1_customer, c5::DOUBLE AS top5_customer, coalesce(s1, top)::DOUBLE AS top1_supplier, CASE WHEN total <= 100 THEN round(total, 2) ELSE coalesce(s1, top) END::DOUBLE AS top5_supplier, false AS alarm FROM cg),
  r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM o WHERE s = 'O' AND p = '1-URGENT'),
  -- buy-back mandates are noise to redemption, and to related parties where these are named
  rq AS (SELECT o_custkey, count(*) FILTER (p = '1-URGENT') AS found, count(*) FILTER (p = '2-HIGH') AS noise FROM o WHERE s = 'O' AND p IN ('1-URGENT', '2-HIGH') GROUP BY 1),
  rf AS (SELECT o_custkey, 'redemption' AS theme, found + noise AS n_relevant, noise AS n_noise, found AS n_found, NULL::DOUBLE AS ratio, (SELECT y + 0.25 FROM r WHERE r.o_custkey = rq.o_custkey AND n = 1)::DOUBLE AS rate, (SELECT x FROM r WHERE r.o_custkey = rq.o_custkey AND n = 1)::INT AS months,
      NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, false FROM rq),
  l AS (SELECT *, CASE WHEN s = 'P' THEN 1 WHEN p = '2-HIGH' THEN -1 ELSE 2 END AS grade FROM o WHERE s = 'O' AND p <> '1-URGENT' OR s = 'P' AND p NOT IN ('1-URGENT', '3-MEDIUM')),
  lk AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, grade ORDER BY o_orderkey) AS n, max(grade) OVER (PARTITION BY o_custkey) AS best FROM l),
  lf AS (SELECT o_custkey, 'related_party' AS theme, count(*) AS n_relevant, count(*) FILTER (grade = -1) AS n_noise, count(*) FILTER (grade = best AND grade > 0) AS n_found, max(CASE WHEN grade = 2 THEN greatest(z + 0.5, y) ELSE x END) FILTER (grade = best AND grade > 0 AND n <= 10)::DOUBLE AS ratio, NULL::DOUBLE AS rate, NULL::INT AS months,
      NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, false FROM lk GROUP BY 1),
  pf AS (SELECT o_custkey, 'pipeline' AS theme, count(*) AS n_relevant, 0 AS n_noise, count(*) AS n_found, NULL::DOUBLE AS ratio, NULL::DOUBLE AS rate, NULL::INT AS months, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, bool_or(p = '3-MEDIUM') FROM o WHERE s = 'P' AND p IN ('1-URGENT', '3-MEDIUM') GROUP BY 1),
  e AS (SELECT * FROM cf UNION ALL SELECT * FROM rf UNION ALL SELECT * FROM lf UNION ALL SELECT * FROM pf)
  SELECT *, n_found > 0 AS found, coalesce(CASE theme WHEN 'redemption' THEN months < 12 WHEN 'related_party' THEN ratio > 30 WHEN 'concentration' THEN greatest(top1_customer, top5_customer, top1_supplier, top5_supplier) > 50 ELSE alarm END, false) AS high FROM e""")
def theme_findings(spark, sf_dir):
    """Redemption, related parties, concentration and trials: passages told from noise, numbers by the cue they belong to, the largest ratio."""
    out = findings.findings(_passages(spark, sf_dir), "o_custkey")
    return out.select("o_custkey", "theme", "n_relevant", "n_noise", "n_found", "ratio", "rate", "months", *findings.SHARES, "alarm", "found", "high")


@query("""WITH s AS (SELECT c_custkey, unnest(['F', 'O', 'P']) AS section, CASE WHEN c_mktsegment = 'BUILDING' THEN 'not asked of builders' END AS skipped FROM customer),
  a AS (SELECT o_custkey AS c_custkey, o_orderstatus AS section, 0 AS n, 'snippet' AS source, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS position, 'urgent order ' || o_orderkey AS text FROM orders WHERE o_orderpriority = '1-URGENT'
    UNION ALL SELECT o_custkey, o_orderstatus, 1, 'table', row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey), 'record ' || o_orderkey FROM orders WHERE o_totalprice > 200000
    UNION ALL SELECT o_custkey, o_orderstatus, 2, 'hit', row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey), 'order ' || o_orderkey FROM orders),
  q AS (SELECT *, min(n) OVER (PARTITION BY c_custkey, section) AS first FROM a WHERE position <= CASE n WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 5 END)
  SELECT c_custkey, section, CASE WHEN skipped IS NOT NULL THEN 'skipped' ELSE coalesce(source, 'absent') END AS source, CASE WHEN skipped IS NOT NULL THEN 1 ELSE coalesce(position, 1) END::INT AS position, coalesce(skipped, text, 'no evidence') AS text
  FROM s LEFT JOIN (SELECT * FROM q WHERE n = first) USING (c_custkey, section) WHERE skipped IS NULL OR coalesce(position, 1) = 1""")
def report_evidence(spark, sf_dir):
    """Evidence of each section: snippets before table records before hits, with quotas; placeholders for sections that are skipped or have none."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("section"), "o_orderkey", "o_orderpriority", "o_totalprice")
    said = lambda word, df: df.select("c_custkey", "section", "o_orderkey", F.concat(F.lit(f"{word} "), F.col("o_orderkey").cast("string")).alias("text"))
    sources = {"snippet": (said("urgent order", o.where("o_orderpriority = '1-URGENT'")), 2), "table": (said("record", o.where("o_totalprice > 200000")), 3), "hit": (said("order", o), 5)}
    skipped = F.when(F.col("c_mktsegment") == "BUILDING", "not asked of builders")
    sections = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(*map(F.lit, "FOP"))).alias("section"), skipped.alias("skipped"))
    return findings.assembled(sections, "section", sources, "c_custkey", ["o_orderkey"])


_KEYWORDS = ["the", "und", "le", "?", "ß"]


@query(f"""WITH c AS (SELECT conv_id, turn, role, text, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations),
  m AS (SELECT conv_id, position, CASE WHEN n = 1 THEN nullif(turn, 0) WHEN n = 3 THEN coalesce(nullif(turn, 0), 7) ELSE turn + 1 END AS page, role AS category, text[1:500] AS excerpt, list_filter({_KEYWORDS}, lambda w: contains(text, w)) AS matched FROM c WHERE text <> ''),
  r AS (SELECT *, len(matched)::DOUBLE AS score, row_number() OVER (PARTITION BY conv_id ORDER BY len(matched) DESC, position) AS rank FROM m WHERE len(matched) > 0)
  SELECT conv_id, position::INT AS position, page, category, excerpt, array_to_string(matched, '|') AS matched, score FROM r WHERE rank <= 3""")
def keyword_grep(spark, sf_dir):
    """Chunks of parse documents of several shapes in one table, as semi-structured values; those with most keywords."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    # Documents of one turn are lists of chunks, of three turns objects with chunks and elements, all others pages with one element each.
    as_list = F.to_json(F.transform("t", lambda x: F.struct(x["turn"].alias("page"), x["role"].alias("type"), x["text"].alias("content"))))
    chunk = lambda x: F.struct(F.coalesce(F.nullif(x["turn"], F.lit(0)), F.lit(7)).alias("page_number"), x["role"].alias("category"), x["text"].alias("excerpt"))
    mixed = F.to_json(F.struct(F.lit("x").alias("pages"), F.transform(F.slice("t", 1, 1), chunk).alias("risk_chunks"), F.transform(F.slice("t", 2, 9), chunk).alias("elements")))
    pages = F.to_json(F.struct(F.transform("t", lambda x: F.struct((x["turn"] + 1).alias("page"), F.array(F.struct(x["role"].alias("category"), x["text"].alias("text"))).alias("elements"))).alias("pages")))
    broken = F.concat(F.substring(pages, 1, 10), F.lit("{"))
    docs = c.select("conv_id", F.when(F.size("t") == 1, as_list).when(F.size("t") == 3, mixed).otherwise(pages).alias("json"))
    docs = docs.union(c.select(F.col("conv_id") + 1_000_000_000, broken))  # malformed ones are set aside
    chunks, _ = files.parsed_chunks(docs, "conv_id", "json")
    return files.keyword_hits(chunks, "conv_id", _KEYWORDS, 3).withColumn("matched", F.array_join("matched", "|"))


_FIELDS = [("statements", True, 2, 1.0, ["The", "Le", "Und", "Re", "In", "La", "An", "De"], ["the", "le", "und"]), ("clauses", False, 0, 0.5, [], ["an", "ou"]), ("gated", False, 0, 0.0, [], ["the"])]


@query(f"""WITH q(field, whole_table, min_labels, score_scale, labels, terms) AS (VALUES {", ".join(f"('{f}', {w}, {m}, {s}, {l}::VARCHAR[], {t})" for f, w, m, s, l, t in _FIELDS)}),
  c AS (SELECT conv_id AS doc, turn AS page, CASE WHEN length(text) > 110 THEN 'table' ELSE 'text' END AS category, CASE WHEN turn = 0 THEN 'summary' WHEN length(text) > 300 THEN 'appendix' ELSE 'other' END AS role, text FROM conversations),
  h AS (SELECT doc, field, page, 0.01 * len(list_filter(terms, lambda t: contains(lower(text), t))) AS score, 'grep' AS source FROM c, q WHERE score_scale > 0 AND len(list_filter(terms, lambda t: contains(lower(text), t))) > 0),
  l AS (SELECT DISTINCT doc, field, page, label FROM c, (SELECT field, unnest(labels) AS label FROM q WHERE score_scale > 0) WHERE category = 'table' AND regexp_matches(text, '(?m)^\\s*' || label)),
  m AS (SELECT doc, field, page, max(score) AS score, list_sort(list(DISTINCT source)) AS sources FROM (SELECT * FROM h UNION ALL SELECT doc, field, page, 0.08 + 0.02 * count(*), 'row_label' FROM l GROUP BY 1, 2, 3) GROUP BY 1, 2, 3),
  p AS (SELECT m.doc, m.field, m.page, m.score * score_scale AS score, sources, whole_table, min_labels, role, category FROM m JOIN q USING (field) JOIN c ON c.doc = m.doc AND c.page = m.page),
  t AS (SELECT doc, page, least(max(page) OVER (PARTITION BY doc, page - n), page + 3) AS last FROM (SELECT doc, page, row_number() OVER (PARTITION BY doc ORDER BY page) AS n FROM c WHERE category = 'table')),
  w AS (SELECT p.*, last, (SELECT count(DISTINCT label) FROM l WHERE l.doc = p.doc AND l.field = p.field AND l.page BETWEEN p.page AND last) AS labels FROM p JOIN t ON t.doc = p.doc AND t.page = p.page WHERE whole_table AND category = 'table'),
  g AS (SELECT *, max(last) OVER (PARTITION BY doc, field ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w WHERE labels >= min_labels),
  k AS (SELECT *, sum(CASE WHEN before IS NULL OR page > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc, field ORDER BY page) AS cluster FROM g),
  e AS (SELECT doc, field, min(page) AS page, max(last) AS last, min_by(role, page) AS role, max(score) AS score, list_sort(list_distinct(flatten(list(sources)))) AS sources, max(labels) AS labels, 3 AS k FROM k GROUP BY doc, field, cluster
    UNION ALL SELECT doc, field, page, page, role, score, sources, 0, 5 FROM p WHERE NOT whole_table),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc, field ORDER BY CASE role WHEN 'appendix' THEN 3 WHEN 'summary' THEN 2 WHEN 'discussion' THEN 1 ELSE 0 END DESC, score DESC, last - page DESC, page) AS rank FROM e)
  SELECT doc, field, rank::INT AS rank, page, last, role, round(score, 9)::DOUBLE AS score, array_to_string(sources, ',') AS sources, labels FROM r WHERE rank <= k""")
def agent_evidence(spark, sf_dir):
    """From search and row labels over packs of pages to each field's ranked evidence, gated fields left out, in one plan."""
    from tidemark.operators import driver

    queries = spark.createDataFrame(_FIELDS, "field string, whole_table boolean, min_labels int, score_scale double, labels array<string>, terms array<string>")
    category, role = F.when(F.length("text") > 110, "table").otherwise("text"), F.when(F.col("turn") == 0, "summary").when(F.length("text") > 300, "appendix").otherwise("other")
    chunks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("chunk"), F.col("turn").alias("page"), category.alias("category"), role.alias("role"), "text")
    # A dozen of queries goes with every chunk, whose text is lowered once.
    lowered = chunks.select("doc", "chunk", F.lower("text").alias("low"))
    found = lowered.withColumn("q", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.array(*map(F.lit, terms)).alias("terms")) for f, *_, s, _, terms in _FIELDS if s > 0))))
    hits = found.withColumn("n", F.size(F.filter("q.terms", lambda t: F.contains("low", t)))).where("n > 0").select("doc", "q.field", "chunk", (0.01 * F.col("n")).alias("score"), F.lit("grep").alias("source"))
    out = driver.field_evidence(hits, chunks, queries.drop("terms"))
    return out.withColumns({"score": F.round("score", 9), "sources": F.array_join("sources", ",")})
