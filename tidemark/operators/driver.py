"""The retrieval driver as one plan: what each field of each document has for evidence, from channels to packs of pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import documents, islands
from tidemark.operators.text import FEW_TERMS

#: What a hit by row labels scores, and each label more; pages that a pack may go on for.
LABEL_SCORE, EACH_LABEL, MOST_PAGES = 0.08, 0.02, 4
#: White space that may stand before a row's label.
WHITE = " \t\n\x0b\f\r"


def label_hits(chunks: DataFrame, queries: DataFrame, categories: Sequence[str] = ("table",)) -> DataFrame:
    """doc, field, chunk, label: labels of a field's rows that stand as rows in chunks of the ``categories``.

    A label stands at the beginning of a line, after white space, so that a line meets labels by equality on its own beginnings, one of each
    length that labels have; neither texts nor pieces of them are shuffled where labels are few (FEW_TERMS). Null and empty labels match nothing.
    """
    wanted = queries.select("field", F.explode("labels").alias("label")).where("label <> ''")
    breaks = F.length("label") - F.length(F.replace("label", F.lit("\n")))
    known = wanted.agg(F.count("*").alias("n"), F.collect_set(F.length("label")).alias("sizes"), F.max(breaks).alias("breaks")).first()
    wanted = F.broadcast(wanted.distinct()) if known["n"] <= FEW_TERMS else wanted.distinct()
    sizes = F.array(*map(F.lit, sorted(known["sizes"]))).cast("array<int>")
    body = chunks.where(F.col("category").isin(*categories)).select("doc", "chunk", F.split("text", "\n").alias("lines"))
    if known["breaks"]:  # a label of several lines: a line is followed by as many as the longest has
        body = body.withColumn("lines", F.transform("lines", lambda _, i: F.array_join(F.slice("lines", i + 1, known["breaks"] + 1), "\n")))
    starts = F.transform("lines", lambda line: F.transform(sizes, lambda size: F.substring(F.ltrim(line, F.lit(WHITE)), F.lit(1), size)))
    met = body.select("doc", "chunk", F.explode(F.array_distinct(F.flatten(starts))).alias("label"))
    return met.join(wanted, "label").select("doc", "field", "chunk", "label")


def packs(chunks: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """doc, chunk, page, role, category, last: for each chunk with a table the last page of the tables that go on after it without a gap, ``most`` pages in all."""
    tables = Window.partitionBy("doc", "_table")
    run = chunks.select("doc", "chunk", "page", "role", "category", (F.col("category").eqNullSafe(F.lit("table")) & F.col("page").isNotNull()).alias("_table"))
    run = run.withColumn("_run", F.col("page") - F.dense_rank().over(tables.orderBy("page")))
    last = F.least(F.max("page").over(Window.partitionBy("doc", "_table", "_run")), F.col("page") + most - 1)
    return run.withColumn("last", F.when(F.col("_table"), last)).drop("_run", "_table")


def field_evidence(hits: DataFrame, chunks: DataFrame, queries: DataFrame, k_field: int = 5, k_table: int = 3, most: int = MOST_PAGES) -> DataFrame:
    """doc, field, rank, page, last, role, score, sources, labels: each field's best evidence in each document.

    ``hits``: doc, field, chunk, score, source of the search channels; ``chunks``: doc, chunk, page, category, role, text; ``queries``: field,
    whole_table, min_labels, score_scale, labels, one row a field. Hits of a chunk are merged with those by row labels: the best score, all
    sources. A field of whole tables goes on over the pages after a hit that have tables, needs ``min_labels`` different labels within its
    pages, and keeps one pack of those that overlap: from the first page to the last, with the best score. Other fields keep a page's best
    hit. Ranked by role (appendix, summary, discussion, other), score, length, page; ``k_table`` or ``k_field`` stay. Fields that are
    gated with a score_scale of 0 have none. Fields of both kinds take one way, so that nothing is made twice; labels go with the hit.
    """
    queries = queries.where("score_scale > 0")
    by_label = label_hits(chunks, queries).select("doc", "field", "chunk", F.lit(None).cast("double").alias("score"), F.lit("row_label").alias("source"), "label")
    every = hits.select("doc", "field", "chunk", "score", "source", F.lit(None).cast("string").alias("label")).union(by_label)
    merged = every.groupBy("doc", "field", "chunk").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("source")).alias("sources"), F.collect_set("label").alias("found"))
    merged = merged.withColumn("score", F.greatest("score", F.when(F.size("found") > 0, LABEL_SCORE + EACH_LABEL * F.size("found"))))
    facts = queries.select("field", "whole_table", "min_labels", "score_scale")
    facts = F.broadcast(facts) if facts.limit(FEW_TERMS + 1).count() <= FEW_TERMS else facts
    whole = F.col("whole_table")
    placed = merged.join(facts, "field").join(packs(chunks, most), ["doc", "chunk"]).withColumn("score", F.col("score") * F.col("score_scale"))
    placed = placed.withColumn("last", F.when(whole, F.col("last")).otherwise(F.col("page"))).where(~whole | (whole & F.col("last").isNotNull()))

    # A pack has ``most`` pages at the most, so that a window over as many sees all its labels.
    ahead = Window.partitionBy("doc", "field").orderBy("page").rangeBetween(0, most - 1)
    near = placed.withColumn("_near", F.collect_list(F.when(whole, F.struct("page", "found"))).over(ahead))
    of_pack = F.transform(F.filter("_near", lambda n: n["page"] <= F.col("last")), lambda n: n["found"])
    counted = near.withColumn("labels", F.when(whole, F.size(F.array_distinct(F.flatten(of_pack)))).otherwise(0).cast("long")).drop("_near", "found").where(~whole | (F.col("labels") >= F.col("min_labels")))
    clustered = islands.interval_clusters(counted, ["doc", "field"], "page", "last")
    one = clustered.withColumns({"_pack": F.when(whole, F.col("cluster")), "_page": F.when(~whole, F.col("page"))}).groupBy("doc", "field", "whole_table", "_pack", "_page").agg(
        F.min("page").alias("first"), F.max("last").alias("last"), F.min_by("role", F.struct("page", -F.col("score"), "chunk")).alias("role"), F.max("score").alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources"), F.max("labels").alias("labels"),
    ).select("doc", "field", F.col("first").alias("page"), "last", "role", "score", "sources", "labels", F.when(whole, k_table).otherwise(k_field).alias("k"))
    ranked = documents.composite_rank(one, ["doc", "field"], F.lit(True), F.col("role"), "score", F.col("last") - F.col("page"), ["page"])
    return ranked.where(F.col("rank") <= F.col("k")).select("doc", "field", "rank", "page", "last", "role", "score", "sources", "labels")


def bundles(evidence: DataFrame, queries: DataFrame) -> DataFrame:
    """doc, bundle (JSON by field, in the order of rank), skipped (fields that are gated)."""
    item = F.struct("rank", "page", "last", "role", "score", "sources")
    fields = evidence.groupBy("doc", "field").agg(F.array_sort(F.collect_list(item)).alias("items"))
    skipped = queries.where("score_scale = 0").agg(F.array_sort(F.collect_set("field")).alias("skipped"))
    out = fields.groupBy("doc").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "items"))))).alias("bundle"))
    return out.crossJoin(F.broadcast(skipped))
