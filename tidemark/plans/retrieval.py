"""Retrieval queries: chunks, the three channels, fusion with and without a filter, dedupes, runs in conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import best_documents, islands, text
from tidemark.operators.joins import keep_one, overlapping_pairs, points_in_spans
from tidemark.plans.market import r6
from tidemark.plans.registry import registry
from tidemark.sources import table

QUERIES, ORACLE, query = registry()
K = 10
TOKEN_SQL = r"[a-z0-9]+|[\x{4e00}-\x{9fff}]"

CHUNKS = """lines AS (SELECT doc_id, (unnest(range(len(xs))))::INT AS position, trim(unnest(xs)) AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS xs FROM documents)),
  chunks AS (SELECT doc_id, position, content, greatest(1, length(content) // 2)::BIGINT AS token_count,
    CASE WHEN length(regexp_replace(content, '[^0-9]', '', 'g')) / length(content) > 0.3 THEN 'table' ELSE 'text' END AS kind FROM lines WHERE length(content) >= 20)"""


@query(f"WITH {CHUNKS} SELECT doc_id, position, length(content) AS n_chars, token_count, kind, sha256(content) AS content_sha256 FROM chunks")
def chunk_documents(spark, sf_dir):
    """Lines of 20 characters or more, token estimate, kind by the share of digits."""
    c = text.line_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")
    return c.select("doc_id", "position", F.length("content").cast("long").alias("n_chars"), "token_count", "kind", F.sha2("content", 256).alias("content_sha256"))


@query()
def packed_chunks(spark, sf_dir):
    """Paragraphs packed to 512 characters with 128 of overlap; held against a loop in the tests."""
    return text.packed_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", separator="\n").select("doc_id", "chunk", F.length("content").alias("n_chars"), F.sha2("content", 256).alias("content_sha256"))


def terms(spark, sf_dir):
    """query_id, term, n: tokens of each benchmark passage."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(text.tokens("text")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("n"))


TERMS = f"""terms AS (SELECT query_id, term, count(*) AS n FROM (SELECT item_id AS query_id,
  unnest(regexp_extract_all(lower(text), '{TOKEN_SQL}')) AS term FROM benchmark) GROUP BY 1, 2)"""
GREP = f"""{TERMS}, grep_all AS (SELECT query_id, doc_id, count(*)::DOUBLE AS score FROM documents JOIN terms ON length(term) >= 4 AND contains(text, term) GROUP BY 1, 2),
  grep AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM grep_all)"""
BM25 = f"""toks AS (SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN_SQL}') AS t FROM documents),
  sizes AS (SELECT count(*) AS docs, avg(len(t)) AS mean_size FROM toks),
  tf AS (SELECT doc_id, size, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS size, unnest(t) AS term FROM toks) GROUP BY 1, 2, 3),
  raw AS (SELECT term, ln((docs - df + 0.5) / (df + 0.5)) AS raw FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), sizes),
  idf AS (SELECT term, CASE WHEN raw < 0 THEN (SELECT avg(raw) FROM raw) * 0.25 ELSE raw END AS idf FROM raw),
  bm25_all AS (SELECT query_id, doc_id, round(sum(n * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean_size))), 9) AS score FROM tf JOIN idf USING (term) JOIN terms USING (term), sizes GROUP BY 1, 2),
  bm25 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm25_all WHERE score > 0)"""
VECTOR = """unit AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / n) AS v FROM (SELECT *, CASE WHEN n0 = 0 THEN 1 ELSE n0 END AS n FROM
    (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n0 FROM embeddings))),
  vector_all AS (SELECT q.vec_id AS query_id, u.vec_id AS doc_id, round(list_sum(list_transform(list_zip(q.v, u.v), lambda p: p[1] * p[2])), 9) AS score
    FROM unit q JOIN benchmark ON item_id = q.vec_id, unit u),
  vector AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM vector_all WHERE score > 0)"""


def grep(spark, sf_dir, most: int):
    asked, d = terms(spark, sf_dir).where(F.length("term") >= 4).select("query_id", "term"), table(spark, sf_dir, "documents")
    near = best_documents.possible(asked, d, "doc_id")
    return text.ranked(best_documents.best_documents(d, "doc_id", "text", most, grep=asked) if near else text.grep_scores(asked, d, "doc_id", "text"), most)


def bm25(spark, sf_dir, most: int):
    asked, d = terms(spark, sf_dir), table(spark, sf_dir, "documents")
    near = best_documents.possible(asked, d, "doc_id")
    return text.ranked(best_documents.best_documents(d, "doc_id", "text", most, bm25=asked) if near else text.bm25_scores(asked, d, "doc_id", "text"), most)


def vector(spark, sf_dir, most: int):
    e = table(spark, sf_dir, "embeddings")
    asked = e.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    return text.ranked(text.vector_scores(asked, e, "vec_id", "vec_id", "embedding"), most)


@query(f"WITH {GREP} SELECT query_id, doc_id, score, rank FROM grep WHERE rank <= {K}")
def grep_topk(spark, sf_dir):
    """Distinct terms that occur as substrings."""
    return grep(spark, sf_dir, K)


@query(f"WITH {TERMS}, {BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM bm25 WHERE rank <= {K}")
def bm25_topk(spark, sf_dir):
    """T1, T2, O4, W16."""
    return bm25(spark, sf_dir, K).withColumn("score", F.round("score", 6))


@query(f"WITH {VECTOR} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM vector WHERE rank <= {K}")
def vector_topk(spark, sf_dir):
    """Exact inner products of unit vectors."""
    return vector(spark, sf_dir, K).withColumn("score", F.round("score", 6))


def _fused_sql(most: int) -> str:
    return f"""{GREP}, {BM25}, {VECTOR},
  tall AS (SELECT query_id, doc_id, 'grep' AS channel, rank, 0.4::DOUBLE AS weight FROM grep WHERE rank <= {most} UNION ALL SELECT query_id, doc_id, 'bm25', rank, 0.3::DOUBLE FROM bm25 WHERE rank <= {most}
    UNION ALL SELECT query_id, doc_id, 'vector', rank, 0.3::DOUBLE FROM vector WHERE rank <= {most}),
  fused AS (SELECT query_id, doc_id, round(sum(weight / (60 + rank) + CASE WHEN channel = 'grep' AND rank <= 3 THEN 1 / 61::DOUBLE ELSE 0 END), 9) AS score,
    min(rank) FILTER (channel = 'grep') AS grep_rank, min(rank) FILTER (channel = 'bm25') AS bm25_rank, min(rank) FILTER (channel = 'vector') AS vector_rank,
    string_agg(channel, ',' ORDER BY channel) AS channels FROM tall GROUP BY 1, 2)"""


def _fused(spark, sf_dir, most: int):
    f = text.fused({"grep": (grep(spark, sf_dir, most), 0.4), "bm25": (bm25(spark, sf_dir, most), 0.3), "vector": (vector(spark, sf_dir, most), 0.3)}, boost_within=3)
    return f.withColumn("score", F.round("score", 9))


COLUMNS = ["query_id", "doc_id", "grep_rank", "bm25_rank", "vector_rank", "channels", "position"]


@query(f"WITH {_fused_sql(text.pool(K, False))} SELECT {', '.join(COLUMNS)}, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS position FROM fused) WHERE position <= {K}")
def rrf_fusion(spark, sf_dir):
    """Weighted reciprocal rank fusion with a boost for the first substring hits."""
    return text.best(_fused(spark, sf_dir, text.pool(K, False)), K).select(*COLUMNS, r6(F.col("score"), "score"))


@query(f"""WITH {_fused_sql(text.pool(K, True))} SELECT {', '.join(COLUMNS)}, round(score, 6) AS score FROM (SELECT f.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS position
  FROM fused f JOIN documents d USING (doc_id) WHERE d.lang = 'en') WHERE position <= {K}""")
def rrf_filtered(spark, sf_dir):
    """The filter comes after the fusion and before the cut, over a wider pool, so that it does not change ranks."""
    english = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    return text.best(_fused(spark, sf_dir, text.pool(K, True)).join(english, "doc_id", "left_semi"), K).select(*COLUMNS, r6(F.col("score"), "score"))


@query(f"""WITH {GREP}, {BM25}, g AS (SELECT query_id, doc_id, rank FROM grep WHERE rank <= 20), b AS (SELECT query_id, doc_id, rank FROM bm25 WHERE rank <= 20)
  SELECT query_id, doc_id, grep_rank, bm25_rank, round(score, 6) AS score, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS position FROM (
    SELECT query_id, doc_id, g.rank AS grep_rank, b.rank AS bm25_rank, 1 / (60 + coalesce(g.rank, 21))::DOUBLE + 1 / (60 + coalesce(b.rank, 21))::DOUBLE AS score FROM g FULL JOIN b USING (query_id, doc_id))) WHERE position <= {K}""")
def rrf_legacy(spark, sf_dir):
    """A missing rank counts as one past the last."""
    f = text.fused_legacy({"grep": grep(spark, sf_dir, 20), "bm25": bm25(spark, sf_dir, 20)}, {"grep": 20, "bm25": 20})
    return text.best(f, K).select("query_id", "doc_id", "grep_rank", "bm25_rank", r6(F.col("score"), "score"), "position")


@query(f"""WITH {CHUNKS} SELECT lang, doc_id, position, n_chars FROM (SELECT d.lang, c.doc_id, c.position, length(content) AS n_chars,
  row_number() OVER (PARTITION BY d.lang, substr(regexp_replace(content, '\\s+', '', 'g'), 1, 80) ORDER BY length(content) DESC, c.doc_id, c.position) AS n FROM chunks c JOIN documents d USING (doc_id)) WHERE n = 1""")
def dedupe_near_key(spark, sf_dir):
    """One chunk per language and first 80 characters that are not white space, the longest."""
    d = table(spark, sf_dir, "documents")
    lines = d.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("position", "content")).withColumn("content", F.trim("content")).where(F.length("content") >= 20)
    keyed = lines.select("lang", "doc_id", "position", F.length("content").cast("long").alias("n_chars"), text.near_key("content").alias("near"))
    return keep_one(keyed, ["lang", "near"], [F.desc("n_chars"), "doc_id", "position"]).drop("near")


@query(f"""WITH {CHUNKS} SELECT doc_id, position, kind, regexp_matches(lower(content), 'license|licence|rights|password|secret|stupid') AS has_risk FROM chunks
  WHERE kind = 'table' OR regexp_matches(lower(content), 'license|licence|rights|password|secret|stupid')""")
def risk_chunks(spark, sf_dir):
    """Tables, and texts with a risk word."""
    c = text.line_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")
    risk = F.lower("content").rlike("license|licence|rights|password|secret|stupid")
    return c.where((F.col("kind") == "table") | risk).select("doc_id", "position", "kind", risk.alias("has_risk"))


@query(f"""WITH {GREP}, {BM25}, tall AS (SELECT query_id, doc_id, score, 'grep' AS source FROM grep WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, score, 'bm25' FROM bm25 WHERE rank <= 20)
  SELECT doc_id, round(max(score), 6) AS score, count(*) AS hits, string_agg(DISTINCT source, ',' ORDER BY source) AS source, string_agg(DISTINCT query_id::VARCHAR, ',' ORDER BY query_id::VARCHAR) AS query FROM tall GROUP BY 1""")
def merge_hits(spark, sf_dir):
    """One row per document, best score, union of channels and queries."""
    hits = grep(spark, sf_dir, 20).withColumn("source", F.lit("grep")).unionByName(bm25(spark, sf_dir, 20).withColumn("source", F.lit("bm25"))).withColumn("query", F.col("query_id").cast("string"))
    return text.merged_hits(hits, ["doc_id"], "score", ["source", "query"]).withColumn("score", F.round("score", 6))


TURNS = "t AS (SELECT conv_id, turn, role, text, lead(turn) OVER w AS next_turn, row_number() OVER w - 1 AS step, lag(turn) OVER w AS prev FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"


@query(f"""WITH {TURNS}, m AS (SELECT *, CASE WHEN turn - prev <> 1 THEN 'gap' WHEN step > 0 AND role = 'system' THEN 'condition' WHEN step >= 4 THEN 'limit' END AS why FROM t),
  s AS (SELECT *, count(why) OVER (PARTITION BY conv_id ORDER BY turn) AS stops, lead(why) OVER (PARTITION BY conv_id ORDER BY turn) AS nw FROM m)
  SELECT conv_id, turn, step::INT AS step, CASE WHEN nw IS NOT NULL THEN nw WHEN next_turn IS NULL THEN 'end' END AS stop_reason FROM s WHERE stops = 0""")
def conversation_walk(spark, sf_dir):
    """Forward walk over consecutive turns, at most four, with the reason why it stopped."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return islands.walk(c, ["conv_id"], "turn", F.col("role") != "system", 4).select("conv_id", "turn", "step", "stop_reason")


@query("""WITH s AS (SELECT *, role = 'assistant' AS stop FROM conversations), b AS (SELECT *, coalesce(sum(stop::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
  SELECT conv_id, turn, role FROM b WHERE before = 0 AND (NOT stop OR length(text) > 200)""")
def until_boundary(spark, sf_dir):
    """Turns before the first answer, and the answer itself if it is long."""
    c = table(spark, sf_dir, "conversations")
    return islands.until(c, ["conv_id"], "turn", F.col("role") == "assistant", F.length("text") > 200).select("conv_id", "turn", "role")


@query("""WITH m AS (SELECT conv_id, turn, length(text) > 100 AS is_on, coalesce(lag(length(text) > 100) OVER (PARTITION BY conv_id ORDER BY turn), false) AS was FROM conversations),
  r AS (SELECT *, sum((is_on AND NOT was)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM m) SELECT conv_id, turn FROM r WHERE is_on AND run = 1""")
def first_active_run(spark, sf_dir):
    """The first run of long turns."""
    return islands.first_run(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", F.length("text") > 100).select("conv_id", "turn")


@query("""WITH starts AS (SELECT conv_id, turn AS start, max(turn) OVER (PARTITION BY conv_id) AS last, role FROM conversations QUALIFY role = 'user'),
  spans AS (SELECT conv_id, start, coalesce(lead(start) OVER (PARTITION BY conv_id ORDER BY start) - 1, last) AS "end" FROM starts)
  SELECT c.conv_id, c.turn, s.start, s."end" FROM conversations c LEFT JOIN spans s ON s.conv_id = c.conv_id AND c.turn BETWEEN s.start AND s."end" """)
def interval_join_sections(spark, sf_dir):
    """Sections from a user's turn to the next; each turn with the section that holds it."""
    from pyspark.sql.window import Window

    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").withColumn("last", F.max("turn").over(Window.partitionBy("conv_id")))
    spans = islands.spans(c.where("role = 'user'").select("conv_id", F.col("turn").alias("start"), "last"), ["conv_id"], "start", F.col("last")).drop("last")
    return points_in_spans(c.select("conv_id", "turn"), "turn", spans, "start", "end", ["conv_id"])


@query("""WITH iv AS (SELECT user_id, event_id, floor(epoch(ts) / 60)::BIGINT AS lo, floor(epoch(ts) / 60)::BIGINT + 240 AS hi FROM events),
  m AS (SELECT *, max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv)
  SELECT user_id, cluster, min(lo) AS lo, max(hi) AS hi, count(*) AS events FROM (SELECT *, sum(coalesce(lo > reach, false)::INT) OVER (PARTITION BY user_id ORDER BY lo, hi, event_id) AS cluster FROM m) GROUP BY 1, 2""")
def interval_clusters(spark, sf_dir):
    """Clusters of overlapping intervals: four hours from each event of a user."""
    minute = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 60)
    e = table(spark, sf_dir, "events").select("user_id", "event_id", minute.alias("lo"), (minute + 240).alias("hi"))
    return islands.interval_clusters(e, ["user_id"], "lo", "hi").groupBy("user_id", "cluster").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("events"))


@query("""WITH x AS (SELECT DISTINCT o_custkey AS id, p_brand AS member, c_nationkey AS nation FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 480000 AND l_quantity > 48)
  SELECT a.nation, a.id AS left_id, b.id AS right_id, count(*) AS shared FROM x a JOIN x b ON a.nation = b.nation AND a.member = b.member AND a.id < b.id GROUP BY 1, 2, 3""")
def pairwise_overlap(spark, sf_dir):
    """Customers of one nation whose sets of brands meet, by a join on the brand."""
    o, l, p, c = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part", "customer"))
    x = o.where("o_totalprice > 480000").join(l.where("l_quantity > 48"), F.col("o_orderkey") == F.col("l_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    sets = x.groupBy(F.col("c_nationkey").alias("nation"), F.col("o_custkey").alias("id")).agg(F.collect_set("p_brand").alias("brands"))
    return overlapping_pairs(sets, "id", "brands", ["nation"])
