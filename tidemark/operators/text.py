"""Text retrieval: tokens, substring, BM25 and vector channels, rank fusion, chunking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Latin words and digits as runs, Chinese characters one by one.
TOKEN = r"[a-z0-9]+|[一-鿿]"
#: BM25 parameters, and the constant that rank fusion adds to a rank.
K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
#: Characters of the pieces by which substrings are joined with texts.
GRAM = 4
#: Query vectors of a block, on average, and slots over which the vectors are dealt where there are several blocks.
QUERY_BLOCK, SLOTS = 256, 16


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


#: Terms that may be sent to the tasks that cut texts into pieces.
FEW_TERMS = 100_000


def query_terms(explicit: Column, query: Column, lexicon: Sequence[str] = ()) -> Column:
    """Ordered distinct terms: the explicit ones, the query's parts of two characters or more, and the lexicon's that it contains."""
    parts = F.filter(F.split(query, r"\s+"), lambda t: F.length(t) >= 2)
    known = F.filter(F.array(*map(F.lit, lexicon)).cast("array<string>"), lambda t: F.contains(query, t))
    return F.array_distinct(F.concat(F.coalesce(explicit, F.array().cast("array<string>")), parts, known))


def _grams(text: Column, sizes: Sequence[int]) -> Column:
    """Distinct pieces of each size."""
    of = lambda k: F.when(F.length(text) >= k, F.transform(F.sequence(F.lit(1), F.length(text) - (k - 1)), lambda i: F.substring(text, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*(of(k) for k in sizes)))


def substring_pairs(texts: DataFrame, text: str, terms: DataFrame, term: str) -> DataFrame:
    """Distinct ``text``, ``term`` of all terms that occur in a text; an equality join on pieces, not each text with each term.

    A term's anchor is its piece of GRAM characters that the fewest texts have (of a shorter term, itself); texts that have the
    anchor are searched for the term. Pieces carry a text's hash, not the text, which is joined once, at the end; where hashes clash, the
    search tells. Neither side is bounded: up to FEW_TERMS terms go to the pieces' tasks, more are joined by a shuffle. Nulls and
    empty terms match nothing.
    """
    wanted = terms.select(F.col(term).alias("_term")).where("_term <> ''").distinct()
    facts = wanted.groupBy(F.least(F.length("_term"), F.lit(GRAM)).alias("size")).agg(F.count("*").alias("n")).collect()  # GRAM rows at most
    sizes = sorted(r["size"] for r in facts) or [GRAM]
    small = F.broadcast if sum(r["n"] for r in facts) <= FEW_TERMS else lambda df: df
    own = F.when(F.length("_term") < GRAM, F.array("_term")).otherwise(_grams(F.col("_term"), [GRAM]))
    pieces = wanted.select("_term", F.explode(own).alias("_gram"))
    base = texts.select(F.col(text).alias("_text")).where("_text IS NOT NULL").distinct().withColumn("_id", F.xxhash64("_text"))
    grams = base.select("_id", F.explode(_grams(F.col("_text"), sizes)).alias("_gram"))
    held = grams.join(small(pieces.select("_gram").distinct()), "_gram", "left_semi").groupBy("_gram").agg(F.count("*").alias("_texts"))
    anchors = pieces.join(held, "_gram").groupBy("_term").agg(F.min_by("_gram", F.struct("_texts", "_gram")).alias("_gram"))
    met = grams.join(small(anchors), "_gram").select("_id", "_term").distinct()
    return met.join(base, "_id").where(F.contains("_text", "_term")).select(F.col("_text").alias(text), F.col("_term").alias(term))


def grep_scores(queries: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """query_id, doc_id, score: how many distinct terms of each query occur in a text. ``queries``: query_id, term.

    Terms without white space occur within words, so that each distinct word of the corpus is searched, however often and in
    however many documents it stands; terms with white space are searched in whole texts.
    """
    queries = queries.select("query_id", "term").distinct()
    spaced = F.col("term").rlike(r"\s")
    words = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.array_distinct(F.split(text, r"\s+"))).alias("word"))
    hits = words.join(substring_pairs(words, "word", queries.where(~spaced), "term"), "word").select("doc_id", "term").distinct()
    if not queries.where(spaced).isEmpty():
        whole = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
        hits = hits.union(whole.join(substring_pairs(whole, "text", queries.where(spaced), "term"), "text").select("doc_id", "term").distinct())
    return hits.join(queries, "term").groupBy("query_id", "doc_id").agg(F.count("*").cast("double").alias("score"))


def bm25_weights(queries: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """term, mean_size (tokens of a document), idf of the terms of ``queries`` that ``docs`` have.

    A negative idf is replaced by EPSILON times the mean idf of all terms. One pass gives the number of documents of each term and,
    under the empty term, of all documents with their sizes.
    """
    by_doc = docs.select(tokens(text).alias("tokens"))
    size = F.coalesce(F.size("tokens"), F.lit(0))
    marked = F.array_append(F.array_distinct(F.coalesce("tokens", F.array().cast("array<string>"))), F.lit(""))
    frequency = by_doc.select(F.explode(marked).alias("term"), size.alias("size")).groupBy("term").agg(F.count("*").alias("df"), F.sum("size").alias("size"))
    sizes = frequency.where("term = ''").select(F.col("df").alias("docs"), (F.col("size") / F.col("df")).alias("mean_size"))
    idf = frequency.where("term <> ''").select("term", "df").crossJoin(F.broadcast(sizes)).withColumn("raw", F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    floor = idf.agg((F.avg("raw") * EPSILON).alias("floor"))
    asked = idf.join(queries.select("term").distinct(), "term", "left_semi").crossJoin(F.broadcast(floor))
    return asked.select("term", "mean_size", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))


def bm25_scores(queries: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """query_id, doc_id, score by BM25 Okapi over all ``docs``. ``queries``: query_id, term, n (how often the query has it).

    After the pass for the weights only the queries' terms are kept, before any shuffle where they are few.
    """
    by_doc = docs.select(F.col(doc_id).alias("doc_id"), tokens(text).alias("tokens"))
    size = F.coalesce(F.size("tokens"), F.lit(0))
    asked = bm25_weights(queries, docs, text)
    tf = by_doc.select("doc_id", size.alias("size"), F.explode("tokens").alias("term")).join(asked, "term").groupBy("doc_id", "size", "term", "mean_size", "idf").agg(F.count("*").alias("tf"))
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean_size")))
    return tf.join(queries, "term").groupBy("query_id", "doc_id").agg(F.sum(weight * F.col("n")).alias("score"))


def vector_scores(queries: DataFrame, vectors: DataFrame, query_id: str, vec_id: str, vector: str) -> DataFrame:
    """query_id, doc_id, score: inner products of the unit vectors (a zero vector counts as it is).

    One block of queries is broadcast; more are dealt by hash, and each is copied to the slots over which the vectors are dealt.
    """

    def unit(c: str) -> Column:
        norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
        return F.transform(c, lambda x: x / F.when(norm == 0, F.lit(1.0)).otherwise(norm))

    q = queries.select(F.col(query_id).alias("query_id"), F.col(vector).cast("array<double>").alias("q")).withColumn("q", unit("q"))
    v = vectors.select(F.col(vec_id).alias("doc_id"), F.col(vector).cast("array<double>").alias("v")).withColumn("v", unit("v"))
    blocks = max(1, -(-q.count() // QUERY_BLOCK))
    if blocks == 1:
        pairs = v.crossJoin(F.broadcast(q))
    else:
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        q = q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("slot", every(SLOTS))
        v = v.withColumn("slot", F.pmod(F.xxhash64("doc_id", "v"), F.lit(SLOTS)).cast("int")).withColumn("block", every(blocks))
        pairs = v.join(q, ["block", "slot"])
    return pairs.select("query_id", "doc_id", F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x).alias("score"))


def ranked(scores: DataFrame, most: int, digits: int = 9) -> DataFrame:
    """query_id, doc_id, score, rank (from 1) of the best ``most`` with a positive score; ties go to the smaller id.

    Spark drops what cannot be among the best before the shuffle (window group limit).
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("score", F.round("score", digits)).where("score > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def fused(channels: dict[str, tuple[DataFrame, float]], boost_within: int = 0, boost_channel: str = "grep") -> DataFrame:
    """query_id, doc_id, score, one rank per channel, channels: weighted reciprocal ranks, summed.

    A document in the first ``boost_within`` of ``boost_channel`` gets the weight of a first rank in addition.
    """
    tall = None
    for name, (r, weight) in channels.items():
        part = r.select("query_id", "doc_id", F.lit(name).alias("channel"), "rank", F.lit(float(weight)).alias("weight"))
        tall = part if tall is None else tall.unionByName(part)
    gain = F.col("weight") / (RRF_K + F.col("rank")) + F.when((F.col("channel") == boost_channel) & (F.col("rank") <= boost_within), F.lit(1.0 / (RRF_K + 1))).otherwise(0.0)
    ranks = [F.min(F.when(F.col("channel") == n, F.col("rank"))).alias(f"{n}_rank") for n in channels]
    return tall.groupBy("query_id", "doc_id").agg(F.sum(gain).alias("score"), *ranks, F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"))


def fused_legacy(channels: dict[str, DataFrame], sizes: dict[str, int]) -> DataFrame:
    """Unweighted fusion in which a channel without the document counts as one rank past its last."""
    out = None
    for name, r in channels.items():
        part = r.select("query_id", "doc_id", F.col("rank").alias(f"{name}_rank"))
        out = part if out is None else out.join(part, ["query_id", "doc_id"], "full")
    score = sum((1.0 / (RRF_K + F.coalesce(F.col(f"{n}_rank"), F.lit(sizes[n] + 1))) for n in channels), F.lit(0.0))
    return out.withColumn("score", score)


def best(scores: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def pool(k: int, filtered: bool) -> int:
    """Candidates of a channel: more when a filter comes after the fusion. Fixed values."""
    return max(8 * k, 100) if filtered else max(2 * k, 20)


def digit_ratio(text: Column | str) -> Column:
    return F.when(F.length(text) > 0, F.length(F.regexp_replace(text, "[^0-9]", "")) / F.length(text)).otherwise(0.0)


def chunk_type(text: Column | str) -> Column:
    return F.when(digit_ratio(text) > 0.3, "table").otherwise("text")


def line_chunks(docs: DataFrame, doc_id: str, text: str, least: int = 20, separator: str = "\n") -> DataFrame:
    """doc_id, position, content, token_count, kind of each line (or paragraph) of at least ``least`` characters."""
    lines = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(text, separator)).alias("position", "content"))
    lines = lines.withColumn("content", F.trim("content")).where(F.length("content") >= least)
    return lines.withColumns({"token_count": F.greatest(F.lit(1), F.floor(F.length("content") / 2)).cast("long"), "kind": chunk_type("content")})


def packed_chunks(docs: DataFrame, doc_id: str, text: str, size: int = 512, overlap: int = 128, least: int = 20, separator: str = "\n\n") -> DataFrame:
    """doc_id, chunk, content: paragraphs longer than ``least`` packed in order up to ``size`` characters; each chunk but the
    first begins with the last ``overlap`` characters of the one before. A fold over a document's paragraphs, in the JVM.
    """
    paragraphs = F.filter(F.transform(F.split(text, separator), lambda p: F.trim(p)), lambda p: F.length(p) > least)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(a: Column, p: Column) -> Column:
        fits = (a["open"] == "") | (F.length(a["open"]) + 1 + F.length(p) <= size)
        grown = F.when(a["open"] == "", p).otherwise(F.concat(a["open"], F.lit("\n"), p))
        tail = F.substring(a["open"], -overlap, overlap)
        return F.when(fits, F.struct(a["done"].alias("done"), grown.alias("open"))).otherwise(F.struct(F.array_append(a["done"], a["open"]).alias("done"), F.concat(tail, F.lit("\n"), p).alias("open")))

    folded = F.aggregate(paragraphs, start, step, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.array_append(a["done"], a["open"])))
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(folded).alias("chunk", "content"))


def merged_hits(hits: DataFrame, keys: Sequence[str], score: str, unions: Sequence[str]) -> DataFrame:
    """One row per key with the best score, and the sorted union of what each hit came from."""
    return hits.groupBy(*keys).agg(F.max(score).alias(score), F.count("*").alias("hits"), *(F.array_join(F.array_sort(F.collect_set(u)), ",").alias(u) for u in unions))


def near_key(text: Column | str, n: int = 80) -> Column:
    """The first ``n`` characters that are not white space: equal for texts that differ in spacing or later on."""
    return F.substring(F.regexp_replace(text, r"\s+", ""), 1, n)


def label_row(cell: Column | str, label: str) -> Column:
    """Whether a cell is the label: equal, with a footnote number after it, or at the start of a line."""
    c = F.col(cell) if isinstance(cell, str) else cell
    quoted = r"\Q" + label.replace(r"\E", r"\E\\E\Q") + r"\E"
    return (F.trim(c) == label) | c.rlike(rf"^\s*{quoted}\s*[(\[]?\d{{1,2}}[)\]]?\s*$") | c.rlike(rf"(?m)^\s*{quoted}")


def all_groups_hit(text: Column | str, groups: Sequence[Sequence[str]]) -> Column:
    """Whether each group has at least one label that occurs in the text (an and of ors)."""
    out = F.lit(True)
    for g in groups:
        hit = F.lit(False)
        for label in g:
            hit = hit | F.contains(F.col(text) if isinstance(text, str) else text, F.lit(label))
        out = out & hit
    return out
