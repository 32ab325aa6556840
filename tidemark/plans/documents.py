"""Queries on documents and pages: titles, sections, roles, scores, grades, matrices, findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import documents, joins, quality
from tidemark.plans import retrieval, scoring
from tidemark.plans.market import r6
from tidemark.plans.registry import registry
from tidemark.sources import table

QUERIES, ORACLE, query = registry()


@query("""WITH a(alias, section, priority) AS (VALUES ('blog', 'journal', 1), ('m', 'mobile', 2), ('example', 'sample', 3)), h AS (SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages),
  p AS (SELECT *, regexp_replace(lower(host), '[^a-z0-9]+', '', 'g') AS plain FROM h),
  m AS (SELECT page_id, section, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN plain = alias THEN 0 WHEN starts_with(plain, alias) THEN 1 ELSE 2 END, priority, alias) AS n FROM p JOIN a ON contains(plain, alias))
  SELECT p.page_id, host, section FROM p LEFT JOIN m ON m.page_id = p.page_id AND n = 1""")
def canonical_titles(spark, sf_dir):
    """Equal, prefix, contained aliases in this order."""
    aliases = spark.createDataFrame([("blog", "journal", 1), ("m", "mobile", 2), ("example", "sample", 3)], "alias string, section string, priority int")
    hosts = table(spark, sf_dir, "pages").select("page_id", F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host"))
    return documents.canonical_titles(hosts, "host", aliases).select("page_id", "host", "section")


@query("""WITH t AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS term FROM part), m AS (SELECT p_partkey, min(term) AS matched_term FROM part JOIN t ON contains(p_name, term) GROUP BY 1)
  SELECT part.p_partkey, matched_term FROM part LEFT JOIN m USING (p_partkey)""")
def substring_join(spark, sf_dir):
    """The first term that a name contains."""
    part = table(spark, sf_dir, "part")
    terms = part.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("term")).distinct()
    return joins.contains_lookup(part.select("p_partkey", "p_name"), "p_name", terms, "term", []).select("p_partkey", "matched_term")


@query("""WITH a AS (SELECT conv_id, turn, role AS section, CASE WHEN length(text) > 150 THEN 'header' ELSE 'title' END AS kind, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
  s AS (SELECT conv_id, section, min(turn) AS start, count(DISTINCT turn) AS pages, max(last) AS last, bool_or(kind = 'header') AS h FROM a GROUP BY 1, 2)
  SELECT conv_id, section, start, coalesce(lead(start) OVER (PARTITION BY conv_id ORDER BY start, section) - 1, last) AS "end", pages, CASE WHEN h AND pages >= 2 THEN 0.95 ELSE 0.8 END::DOUBLE AS confidence FROM s""")
def section_spans(spark, sf_dir):
    """Sections from their first page to the page before the next; confidence by headers."""
    from pyspark.sql.window import Window

    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("section"), F.when(F.length("text") > 150, "header").otherwise("title").alias("kind"))
    return documents.section_spans(c.withColumn("last", F.max("turn").over(Window.partitionBy("conv_id"))), "conv_id", "turn", "section", "kind", "last")


@query("""WITH p AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1)
  SELECT conv_id, length(text) AS n_chars, CASE WHEN regexp_matches(text, '[0-9]{3}') THEN 'numbers' WHEN regexp_matches(lower(text), 'licen|rights') THEN 'terms' WHEN regexp_matches(text, 'ß|ü') THEN 'german' ELSE 'prose' END AS role,
    (contains(text, 'the')::INT + contains(text, 'und')::INT + 0.5 * contains(text, '?')::INT)::DOUBLE AS score FROM p""")
def page_roles(spark, sf_dir):
    """Elements joined per page, ordered patterns, labels and cues."""
    p = documents.page_texts(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text")
    role = documents.by_patterns(F.col("text"), [("numbers", "[0-9]{3}"), ("terms", "(?i)licen|rights"), ("german", "ß|ü")], "prose")
    return p.select("conv_id", F.length("text").cast("long").alias("n_chars"), role.alias("role"), documents.body_score(F.col("text"), ["the", "und"], ["?"]).alias("score"))


@query(f"""WITH {retrieval.GREP}, {retrieval.BM25}, s AS (SELECT g.query_id, g.doc_id, round(g.score + 0.12 * least(coalesce(b.score, 0), 10) + length(d.text) / 10000 + CASE WHEN d.lang = 'en' THEN 0.5 ELSE 0 END, 9) AS score
    FROM grep_all g LEFT JOIN bm25_all b USING (query_id, doc_id) JOIN documents d USING (doc_id)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS position FROM s)
  SELECT query_id, doc_id, round(score, 6) AS score, position FROM r WHERE position <= 10""")
def section_first_search(spark, sf_dir):
    """Substring terms, capped BM25, a trace of the length, a bonus by kind; then the best ten."""
    from tidemark.operators import best_documents, text

    t, d = retrieval.terms(spark, sf_dir), table(spark, sf_dir, "documents")
    long = t.where(F.length("term") >= 4).select("query_id", "term")
    bonus = F.when(F.col("lang") == "en", 0.5).otherwise(0.0)
    if best_documents.possible(t, d, "doc_id"):
        extra = F.length("text") / documents.LENGTH_SCALE + bonus
        s = best_documents.best_documents(d, "doc_id", "text", 10, grep=long, bm25=t, score=documents.section_first_scores, extra=extra)
    else:
        g = text.grep_scores(long, d, "doc_id", "text")
        b = text.bm25_scores(t, d, "doc_id", "text").withColumn("bm25", F.round("score", 9)).drop("score")
        kinds = d.select("doc_id", F.length("text").alias("length"), bonus.alias("bonus"))
        s = g.join(b, ["query_id", "doc_id"], "left").join(kinds, "doc_id").withColumn("score", F.round(documents.section_first_score(F.col("score"), F.col("bm25"), F.col("length"), F.col("bonus")), 9))
    return text.best(s, 10).select("query_id", "doc_id", r6(F.col("score"), "score"), "position")


@query(f"""WITH {retrieval.GREP}, n AS (SELECT query_id, count(*) FILTER (rank <= 10) AS hits, max(score) FILTER (rank <= 10) AS best FROM grep GROUP BY 1),
  g AS (SELECT item_id AS query_id, coalesce(hits, 0) AS hits, 40.0 * (coalesce(hits, 0) >= 10)::INT + 40.0 * (coalesce(best, 0) >= 4)::INT + 20.0 * (coalesce(hits, 0) > 0)::INT AS points FROM benchmark LEFT JOIN n ON query_id = item_id),
  x AS (SELECT *, CASE WHEN points >= 90 THEN 'A' WHEN points >= 60 THEN 'B' WHEN points >= 20 THEN 'C' ELSE 'D' END AS raw FROM g), y AS (SELECT query_id, points::DOUBLE AS points, CASE WHEN query_id % 9 = 0 THEN greatest(raw, 'B') ELSE raw END AS now FROM x)
  SELECT query_id, points, now, CASE WHEN query_id % 3 = 0 THEN 'A' WHEN query_id % 3 = 1 THEN 'B' ELSE NULL END AS before,
    CASE WHEN query_id % 3 = 2 THEN 'new' WHEN now < CASE WHEN query_id % 3 = 0 THEN 'A' ELSE 'B' END THEN 'better' WHEN now > CASE WHEN query_id % 3 = 0 THEN 'A' ELSE 'B' END THEN 'worse' ELSE 'same' END AS change FROM y""")
def retrieval_grades(spark, sf_dir):
    """Points, caps, grades, and the change against a baseline."""
    g = retrieval.grep(spark, sf_dir, 10).groupBy("query_id").agg(F.count("*").alias("hits"), F.max("score").alias("best"))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    rows = q.join(g, "query_id", "left").fillna({"hits": 0, "best": 0.0})
    now = quality.graded(rows, [(F.col("hits") >= 10, 40.0), (F.col("best") >= 4, 40.0), (F.col("hits") > 0, 20.0)], [(F.col("query_id") % 9 == 0, "B")], [(90.0, "A"), (60.0, "B"), (20.0, "C")], "D")
    before = q.where("query_id % 3 < 2").withColumn("grade", F.when(F.col("query_id") % 3 == 0, "A").otherwise("B"))
    return quality.against_baseline(now, before, "query_id", "grade").join(now.select("query_id", "points"), "query_id").select("query_id", "points", "now", "before", "change")


@query("""SELECT o_custkey AS id, coalesce(format('{:,.2f}', round(sum(o_totalprice) FILTER (year(o_orderdate) = 1995), 2)), '—') AS "1995", coalesce(format('{:,.2f}', round(sum(o_totalprice) FILTER (year(o_orderdate) = 1998), 2)), '—') AS "1998",
  coalesce(format('{:,.2f}', round(sum(o_totalprice) FILTER (year(o_orderdate) = 2001), 2)), '—') AS "2001" FROM orders GROUP BY 1""")
def period_matrix(spark, sf_dir):
    """Periods as columns of formatted numbers, a dash where there is none."""
    y = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id"), F.year("o_orderdate").cast("string").alias("period")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return documents.period_matrix(y, ["id"], "period", "v", ["1995", "1998", "2001"])


@query(f"""WITH {scoring.YEARS}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY period DESC) AS n FROM years), t AS (SELECT id, max(cash) FILTER (n = 2) AS prev, max(cash) FILTER (n = 1) AS cur FROM r GROUP BY 1)
  SELECT id, prev, cur, coalesce(prev < 0 AND cur < 0 AND abs(cur) > 1.3::DOUBLE * abs(prev), false) AS grown FROM t""")
def burn_growth(spark, sf_dir):
    """The last two years, both negative, the amount up by more than 30 %."""
    return documents.worsening(scoring.yearly(spark, sf_dir), "id", "period", "cash")


@query("""SELECT l_orderkey, CASE WHEN count(CASE WHEN l_discount > 0.001 THEN l_extendedprice END) = count(*) AND count(*) >= 2 THEN round(sum(l_extendedprice), 2) END AS total FROM lineitem GROUP BY 1""")
def complete_sums(spark, sf_dir):
    """A sum only if every part is there."""
    parts = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_discount") > 0.001, F.col("l_extendedprice")).alias("v"))
    return documents.complete_sum(parts, ["l_orderkey"], "v").withColumn("total", F.round("total", 2))


@query(f"""WITH {scoring.FLAGS} SELECT id, factor, round(score, 6) AS score, round(score * w, 6) AS contribution FROM (SELECT id, 'loss' AS factor, 75.0::DOUBLE AS score, 0.3::DOUBLE AS w FROM flags WHERE latest_loss
  UNION ALL SELECT id, 'cash', least(100, evidence * 4)::DOUBLE, 0.25::DOUBLE FROM flags WHERE cash_out UNION ALL SELECT id, 'runway', 80.0::DOUBLE, 0.2::DOUBLE FROM flags WHERE runway < 12)""")
def factor_details(spark, sf_dir):
    """The factors that count, with what each adds."""
    f = scoring.flags(spark, sf_dir)
    out = documents.factors(f, "id", [("loss", F.col("latest_full_year_loss"), F.lit(75.0), 0.3), ("cash", F.col("cfo_persistently_negative"), F.least(F.lit(100), F.col("evidence") * 4), 0.25), ("runway", F.col("runway_lt_12"), F.lit(80.0), 0.2)])
    return out.select("id", "factor", r6(F.col("score"), "score"), r6(F.col("contribution"), "contribution"))


@query(f"""WITH {scoring.FLAGS} SELECT id, array_to_string(list_filter([CASE WHEN NOT latest_loss THEN 'profit in the latest year' END, CASE WHEN NOT coalesce(cash_out, false) THEN 'cash flow not negative' END, CASE WHEN NOT margin_drop THEN 'no drop' END], lambda x: x IS NOT NULL), '; ') AS findings,
  NOT latest_loss AND NOT coalesce(cash_out, false) AND NOT margin_drop AS healthy FROM flags""")
def negative_findings(spark, sf_dir):
    """What is good, and whether all of it is."""
    f = scoring.flags(spark, sf_dir)
    good = [(~F.col("latest_full_year_loss"), "profit in the latest year"), (~F.coalesce("cfo_persistently_negative", F.lit(False)), "cash flow not negative"), (~F.coalesce("gp_margin_drop_gt_5pp", F.lit(False)), "no drop")]
    healthy = good[0][0] & good[1][0] & good[2][0]
    return documents.findings(f, "id", good, healthy.alias("healthy"))


@query("""WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1) SELECT user_id, last, last < (SELECT max(ts) FROM events) - INTERVAL 6 HOUR AS stale FROM l""")
def stale_users(spark, sf_dir):
    """Last event of each user against the newest of all, passed in as a one-row table."""
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("now"))
    return e.groupBy("user_id").agg(F.max("ts").alias("last")).crossJoin(F.broadcast(now)).select("user_id", "last", documents.stale(F.col("last"), F.col("now"), 6).alias("stale"))


@query("""SELECT role, kind, count(*) AS n, round(avg(length(text)), 4) AS mean_chars, max(turn) AS last_turn FROM (SELECT *, CASE WHEN length(regexp_replace(text, '[^0-9]', '', 'g')) / length(text) > 0.02 THEN 'numbers' ELSE 'words' END AS kind FROM conversations) GROUP BY 1, 2""")
def category_histogram(spark, sf_dir):
    """Elements by category and kind."""
    from tidemark.operators.text import digit_ratio

    c = table(spark, sf_dir, "conversations").withColumn("kind", F.when(digit_ratio("text") > 0.02, "numbers").otherwise("words"))
    return c.groupBy("role", "kind").agg(F.count("*").alias("n"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"), F.max("turn").alias("last_turn"))
