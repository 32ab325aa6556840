"""Exact document deduplication by content-defined chunk recipes, in DataFrame functions only.

A text is cut into chunks whose ends depend on the content alone. The distinct chunks are the chunk store: a digest that
the store holds with one content only is a verified identifier of this content. A document then is its recipe, the ordered
list of its chunks' identifiers, and equal documents are those with equal recipes. Each chunk's text is moved once, to the
store (copies within a task are merged before); what is grouped and joined afterwards are the short recipes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import table

#: Characters that a chunk has at least (but for the last) and at most; between them it ends at the first end of a sentence or line.
MIN_CHUNK, MAX_CHUNK = 512, 8192


def chunks(text, least: int = MIN_CHUNK, most: int = MAX_CHUNK):
    """Column of the text's chunks, in order; joined they are the text again. Empty text: no chunk."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most}}}?[.!?\n]|.{{1,{most}}}"), F.lit(0))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty, so that null and empty texts form one group. The largest id of a
    group stays. Rows that repeat the id that stays are all kept; null ids lose to any other, and a group of nothing but
    null ids has a null keep_id and is kept. Empty table: no rows. Other columns are ignored, whatever their names.

    Digests may clash: a document with a chunk whose digest the store holds with two contents is told from others with the
    same recipe by the SHA-256 of its text as well. ``digest`` is a parameter so that tests can force clashes.
    """
    cut = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cut = cut.select("doc_id", F.sha2("text", 256).alias("text_sha256"), chunks(F.col("text")).alias("chunks"))
    recipes = cut.select("doc_id", "text_sha256", F.transform("chunks", lambda c: digest(c)).alias("recipe"))

    store = cut.select(F.explode("chunks").alias("chunk")).select(digest(F.col("chunk")).alias("digest"), "chunk").distinct()
    clashes = store.groupBy("digest").agg(F.count("*").alias("contents")).where("contents > 1").select("digest")

    # Hot groups of copies shrink to one row per task here, before anything is shuffled.
    texts = recipes.groupBy("recipe", "text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    unclear = texts.select("recipe", F.explode(F.array_distinct("recipe")).alias("digest")).join(clashes, "digest", "left_semi").select("recipe").distinct().withColumn("unclear", F.lit(True))
    groups = (
        texts.join(unclear, "recipe", "left")
        .withColumn("only_sha", F.when(F.col("unclear"), F.col("text_sha256")))
        .groupBy("recipe", "only_sha")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    )
    # By one expression more than the groups are dealt by: the join then has exchanges of its own, whose large partitions, those of
    # hot groups of copies, Spark may split.
    d, g = recipes.alias("d"), groups.alias("g")
    same = (F.col("d.recipe") == F.col("g.recipe")) & (F.size("d.recipe") == F.size("g.recipe")) & (F.col("g.only_sha").isNull() | (F.col("g.only_sha") == F.col("d.text_sha256")))
    return d.join(g, same).select("d.doc_id", "g.keep_id", "g.group_size", F.col("d.doc_id").eqNullSafe(F.col("g.keep_id")).alias("kept"), "d.text_sha256")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``."""
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
