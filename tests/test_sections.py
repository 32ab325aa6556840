"""Section maps on small documents: runs of contents, leaders, ranks of anchors, conflicts, offsets."""

import random

from pyspark.sql import functions as F

from tidemark.operators import sections

SCHEMA = "doc long, page int, position int, category string, text string"
ALIASES = [("Summary", "summary", 1), ("Risk Factors", "risks", 2), ("Business", "business", 3), ("Appendix I", "appendix_one", 4)]


def built(spark, rows):
    aliases = spark.createDataFrame(ALIASES, "alias string, section string, priority int")
    return sections.section_map(spark.createDataFrame(rows, SCHEMA), aliases)


ROWS = [
    (1, 1, 0, "title", "A company"),
    (1, 2, 0, "title", "CONTENTS"), (1, 2, 1, "text", "Summary ..... 1 Risk Factors …… 5"),
    (1, 3, 0, "table", "Our  Business ... 9\nGlossary .... iv"), (1, 3, 1, "title", "Risk Factors"), (1, 3, 2, "text", " "),
    (1, 4, 0, "text", "prose"),
    (1, 5, 0, "text", "One ... 1 two ... 2"),  # led, but after the first run
    (1, 6, 0, "header", "SUMMARY"), (1, 6, 1, "title", "Risk factors"),  # the header counts, the title does not
    (1, 7, 0, "header", "Summary"),
    (1, 10, 0, "title", "Risk Factors"), (1, 11, 0, "title", "Risk Factors"), (1, 12, 0, "text", "end"),
    (2, 1, 0, "header", "Summary"), (2, 1, 1, "header", "Appendix I"), (2, 2, 0, "header", "Business"), (2, 2, 1, "header", "Risk Factors"),
    (None, 1, 0, "header", "Summary"), (3, None, 0, "header", "Summary"), (3, 1, 0, "text", None),
]


def test_section_map(spark):
    of, entries, found = built(spark, [*ROWS, *ROWS[7:9]])  # repeated elements change nothing
    assert sorted(tuple(r) for r in of.collect()) == [
        (1, "risks", 10, 12, 2, 0.8), (1, "summary", 6, 9, 2, 0.95),
        (2, "appendix_one", 1, 1, 1, 0.8), (2, "business", 2, 2, 1, 0.8), (2, "risks", 2, 2, 1, 0.8), (2, "summary", 1, 1, 1, 0.8),
    ]
    got = [(r.doc, r.entry, r.page, r.title, r.printed, r.section, r.target, r.confidence, r.offset) for r in entries.orderBy("doc", "entry").collect()]
    assert got == [
        (1, 0, 2, "Summary", "1", "summary", 6, 0.9, 5),
        (1, 1, 2, "Risk Factors", "5", "risks", 10, 0.9, 5),
        (1, 2, 3, "Our Business", "9", "business", 14, 0.8, 5),
        (1, 3, 3, "Glossary", "iv", None, None, 0.55, 5),
    ]
    clash = lambda wins: sorted((r.doc, r.page, r.sections) for r in sections.conflicts(found, wins).collect())
    assert clash(None) == [(2, 1, ["appendix_one", "summary"]), (2, 2, ["business", "risks"])]
    assert clash("appendix_one") == [(2, 2, ["business", "risks"])]


def test_contents_within_the_first_pages(spark):
    rows = [(1, p, 0, "title", "Contents" if p in (3, 4, 6, 41) else "x") for p in range(1, 45)] + [(2, p, 0, "title", "Contents" if p == 41 else "x") for p in range(1, 45)]
    assert sorted(map(tuple, sections.contents_pages(spark.createDataFrame(rows, SCHEMA)).collect())) == [(1, 3), (1, 4)]


def test_empty(spark):
    assert all(x.isEmpty() for x in built(spark, []))


def test_one_shuffle_of_the_elements(spark):
    """Lines are read once and lie by document from then on: no key of few values (a section, a title) deals them anew."""
    from tidemark.plans.sections import section_map_entries, section_map_spans

    for made in (section_map_entries, section_map_spans):
        plan = made(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning(doc") == 1
        assert "SortMergeJoin" not in plan and "Exchange hashpartitioning(title" not in plan


def test_many_aliases_are_few_ones(spark, monkeypatch):
    from tidemark.operators import documents

    rng = random.Random(11)
    words = ["Risk", "Factors", "risk factors", "Business", "-", "  ", "Our", "摘要", ""]
    titles = [(i, None if i % 17 == 0 else "".join(rng.choice(words) for _ in range(rng.randrange(5)))) for i in range(200)]
    aliases = [("Risk", "risk", 3), ("Risk Factors", "risks", 2), ("factors", "factors", None), ("摘要", "summary", 1), ("Business!", None, 1), (None, "nothing", 0), ("--", "empty", 0), ("our", "us", 5)]
    titles, aliases = spark.createDataFrame(titles, "i int, title string"), spark.createDataFrame(aliases, "alias string, section string, priority int")
    rows = lambda df: sorted(map(repr, df.collect()))
    few = documents.canonical_titles(titles, "title", aliases)
    assert "Join" not in few._jdf.queryExecution().optimizedPlan().toString()
    mapped = [rows(x) for x in built(spark, ROWS)]
    monkeypatch.setattr(documents, "FEW_ALIASES", 0)
    monkeypatch.setattr(sections, "BROADCAST_ALIASES", -1)
    assert rows(few) == rows(documents.canonical_titles(titles, "title", aliases)) and few.where("section IS NOT NULL").count() > 100
    assert [rows(x) for x in built(spark, ROWS)] == mapped


def test_entries_are_the_patterns(spark):
    rng = random.Random(3)
    pieces = ["a", "B c", ".", "..", ". .", "…", "·", "•", ".....", " ", "  ", "   ", "\t", "\n", "　", "1", "12", "iv", "XII-3", "ABCD-1", "x", "-", "目錄", "long " * 30]
    texts = spark.createDataFrame([("".join(rng.choice(pieces) for _ in range(rng.randrange(18))),) for _ in range(1500)], "text string")
    found = lambda pattern, k: F.regexp_extract_all("text", F.lit(pattern), F.lit(k))
    got = texts.select(found(sections.LED, 0).alias("a"), found(sections.LEADERS, 0).alias("b"), F.col("text").rlike(sections.ANY_LEADERS).alias("any")).collect()
    assert all(r.a == r.b and (r.any or not r.b) for r in got) and sum(bool(r.b) for r in got) > 100
    elements = texts.select(F.lit(1).alias("doc"), F.lit(1).alias("page"), F.monotonically_increasing_id().alias("position"), F.lit("table").alias("category"), "text")
    entries = sections.section_map(elements, spark.createDataFrame(ALIASES, "alias string, section string, priority int"))[1].orderBy("entry").collect()
    flat = texts.select(F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text")).select(F.explode(F.arrays_zip(found(sections.LEADERS, 1).alias("t"), found(sections.LEADERS, 2).alias("p"))).alias("x"))
    want = flat.select(F.regexp_replace("x.t", r"^[ .…·•]+|[ .…·•]+$", ""), "x.p").collect()
    assert [(r.title, r.printed) for r in entries] == [tuple(r) for r in want]
