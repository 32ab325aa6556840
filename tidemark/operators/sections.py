"""Section maps: the contents of a document, the places where its sections begin, and both made to agree.

``elements``, here and below: doc, page, position, category (header, title, text, table), text. Elements without text count for nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.documents import BY_HEADER, BY_TITLE, canonical_titles, plain_title

#: Titles of a page of contents; an entry's title, leaders and page (a number, a Roman one, or one with a letter before it).
MARKERS = ["目錄", "目录", "contents"]
LEADERS = r"(?i)([^.…·•]{2,100}?)\s*(?:[.…·•]{2,}|\s{3,})\s*((?:[IVXLCM]+|[A-Z]{1,3})-\d+|\d+|[ivxlcm]+)(?=\s|$)"
#: The same matches, sooner: what follows a title that ends here is white space or a leader. Texts without ANY_LEADERS have none.
LED, ANY_LEADERS = LEADERS.replace("{2,100}?)", r"{2,100}?)(?=[\s.…·•])"), r"[.…·•]{2}|\s{3}"
#: Pages among which contents are looked for, entries that make a page one of contents, and the confidence of an entry
#: of no known section, of a known one, and of one whose section was found.
WITHIN, LEAST_ENTRIES = 40, 2
UNKNOWN, KNOWN, FOUND = 0.55, 0.8, 0.9
#: Aliases that may be broadcast; more are joined by Spark's own choice.
BROADCAST_ALIASES = 50_000


def _pages(elements: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """doc, page, last (the document's last page), contents (whether the page is in the first unbroken run of pages of contents among the
    document's first WITHIN pages), lines (its elements in order, of pages that look like contents), named (kinds and sections of its anchors).

    One pass over the elements: a page's few elements are gathered, windows hold a document's pages, and nothing is joined but ``aliases``.
    """
    of = lambda *categories: F.col("category").isin(*categories) & (F.trim("text") != "")
    elements = elements.select("doc", "page", "position", "category", "text", F.when(of("header", "title"), plain_title(F.col("text"))).alias("_plain"))
    named = F.array().cast("array<struct<kind: string, section: string>>")
    if aliases is not None:
        known = aliases.select(plain_title(F.col("alias")).alias("_plain"), "section", "priority").groupBy("_plain").agg(F.min_by("section", F.struct("priority", "section")).alias("_section"), F.lit(True).alias("_known"))
        # By a shuffle, the names of a few sections would gather all elements in a few tasks.
        elements = elements.join(F.broadcast(known) if aliases.count() <= BROADCAST_ALIASES else known, "_plain", "left")
        named = F.collect_set(F.when(F.col("_known"), F.struct(F.col("category").alias("kind"), F.col("_section").alias("section"))))
    lines = F.array_sort(F.collect_list(F.when(of("text", "table", "title"), F.struct("position", "text", "category"))))
    pages = elements.groupBy("doc", "page").agg(F.coalesce(F.bool_or(F.col("_plain").isin(*MARKERS)), F.lit(False)).alias("_marked"), lines.alias("lines"), named.alias("named"))
    # Elements of a page follow each other by a line break, which is white space to the pattern.
    body = F.array_join(F.transform(F.filter("lines", lambda x: x["category"] != "title"), lambda x: x["text"]), "\n")
    led = F.when(F.col("_body").rlike(ANY_LEADERS), F.regexp_count("_body", F.lit(LED))).otherwise(0)
    pages = pages.withColumn("_body", body).withColumn("_is", F.col("_marked") | (led >= LEAST_ENTRIES)).withColumn("lines", F.when(F.col("_is"), F.col("lines"))).drop("_body")
    whole, in_order = Window.partitionBy("doc"), Window.partitionBy("doc").orderBy("page")
    # A run's pages have the same number of other pages before them; the first run has the least such number.
    pages = pages.withColumns({"_n": F.row_number().over(in_order), "_run": F.sum((~F.col("_is")).cast("int")).over(in_order)})
    among = F.col("_is") & (F.col("_n") <= WITHIN)
    pages = pages.withColumns({"_first": F.min(F.when(among, F.col("_run"))).over(whole), "last": F.max("page").over(whole)})
    return pages.select("doc", "page", "last", F.coalesce(among & (F.col("_run") == F.col("_first")), F.lit(False)).alias("contents"), "lines", "named")


def contents_pages(elements: DataFrame) -> DataFrame:
    """doc, page of the first unbroken run of pages of contents among a document's first WITHIN pages."""
    return _pages(elements).where("contents").select("doc", "page")


def _anchored(elements: DataFrame, aliases: DataFrame) -> DataFrame:
    """``_pages`` with the anchors that count: headers that are a section's alias; on a page without one, titles that are (not on pages of contents).

    ``aliases``: alias, section, priority; of sections with one alias the smaller priority counts.
    """
    headers = F.filter("named", lambda x: x["kind"] == "header")
    return _pages(elements, aliases).withColumn("named", F.when(F.size(headers) > 0, headers).when(~F.col("contents"), F.col("named")))


def _entries(pages: DataFrame, aliases: DataFrame) -> DataFrame:
    """doc, entry (from 0, in the order of the document), page, title, printed (the page as text), section, start (page where the span of
    the section begins) of each entry on the contents among ``_anchored`` pages.

    Anchors and entries pass the same windows of their document, which bring an entry its section's start without a join.
    """
    none = lambda kind: F.lit(None).cast(kind)
    item = lambda kind, section, line, text: F.struct(kind.alias("kind"), section.alias("_section"), line.alias("line"), text.alias("text"))
    anchors = F.transform("named", lambda x: item(x["kind"], x["section"], none("int"), none("string")))
    lines = F.transform(F.when(F.col("contents"), F.col("lines")), lambda x, i: item(none("string"), none("string"), i, x["text"]))
    empty = F.array().cast("array<struct<kind: string, _section: string, line: int, text: string>>")
    items = pages.select("doc", "page", F.inline(F.concat(F.coalesce(anchors, empty), F.coalesce(lines, empty))))
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    items = items.select("doc", "page", "kind", "_section", "line", F.posexplode_outer(F.regexp_extract_all(text, F.lit(LED), F.lit(0))).alias("_at", "_led")).where("kind IS NOT NULL OR _at IS NOT NULL")
    # A page has neither spaces nor leaders, and a title has no leaders: both are cut out of what was found, which is searched for once.
    printed = F.substring_index(F.translate("_led", ".…·•", "    "), " ", -1)
    items = items.withColumn("printed", printed).withColumn("title", F.btrim(F.substring("_led", F.lit(1), F.length("_led") - F.length("printed")), F.lit(" .…·•"))).drop("_led")
    named = canonical_titles(items, "title", aliases).withColumn("section", F.when(F.col("kind").isNotNull(), F.col("_section")).otherwise(F.col("section")))
    first = lambda which: F.min(F.when(which, F.col("page"))).over(Window.partitionBy("doc", "section"))
    # A section's headers count alone where it has any.
    start = F.when(F.col("section").isNotNull(), F.coalesce(first(F.col("kind") == "header"), first(F.col("kind").isNotNull())))
    entries = named.withColumn("start", start).where("kind IS NULL")
    place = F.row_number().over(Window.partitionBy("doc").orderBy("page", "line", "_at")) - 1
    return entries.select("doc", place.alias("entry"), "page", "title", "printed", "section", "start")


def conflicts(found: DataFrame, wins: str | None = None) -> DataFrame:
    """doc, page, sections (sorted) of pages with anchors of several sections, unless ``wins`` is one of them."""
    of_page = found.groupBy("doc", "page").agg(F.array_sort(F.collect_set("section")).alias("sections")).where(F.size("sections") > 1)
    return of_page if wins is None else of_page.where(~F.array_contains("sections", wins))


def spans(found: DataFrame) -> DataFrame:
    """doc, section, start, end, pages, confidence from anchors (doc, page, last, section, kind): a section's headers count alone where it
    has any; it ends before the next one begins, the last with its document."""
    by_header = F.bool_or(F.col("kind") == "header").over(Window.partitionBy("doc", "section"))
    used = found.withColumn("_headed", by_header).where("kind = 'header' OR NOT _headed")
    starts = used.groupBy("doc", "section").agg(F.min("page").alias("start"), F.countDistinct("page").alias("pages"), F.any_value("_headed").alias("_headed"), F.max("last").alias("last"))
    following = F.lead("start").over(Window.partitionBy("doc").orderBy("start", "section"))
    end = F.greatest("start", F.coalesce(following - 1, F.col("last")))
    return starts.select("doc", "section", "start", end.alias("end"), "pages", F.when(F.col("_headed") & (F.col("pages") >= 2), BY_HEADER).otherwise(BY_TITLE).alias("confidence"))


def resolved(entries: DataFrame) -> DataFrame:
    """``entries`` with target, confidence, offset instead of start: an entry goes to where the span of its section starts, else to its
    printed number and the document's offset, the median difference of the two. Null where neither is known."""
    number: Column = F.expr("try_cast(printed AS INT)")
    offset = F.bround(F.median(F.col("start") - number).over(Window.partitionBy("doc"))).cast("int")
    confidence = F.when(F.col("start").isNotNull(), FOUND).when(F.col("section").isNotNull(), KNOWN).otherwise(UNKNOWN)
    target = F.coalesce("start", number + F.col("offset")).cast("int")
    return entries.withColumn("offset", offset).select("doc", "entry", "page", "title", "printed", "section", target.alias("target"), confidence.alias("confidence"), "offset")


def section_map(elements: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Spans, resolved entries and anchors of all documents. Documents are independent: every step is keyed by document, so that elements
    that lie by document are shuffled no more, and windows hold a document's pages, entries or sections. Null documents and pages have
    no place in a map and are left out."""
    pages = _anchored(elements.where("doc IS NOT NULL AND page IS NOT NULL"), aliases)
    found = pages.select("doc", "page", "last", F.inline("named")).select("doc", "page", "last", "section", "kind")
    return spans(found), resolved(_entries(pages, aliases)), found.drop("last")
