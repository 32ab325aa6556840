"""Operators on parsed documents: titles, contents, anchors, page roles, kinds of statements, and the scores of what was found."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.rules import first_match
from tidemark.operators.text import substring_pairs

#: Confidence of a section found by a running header on two pages, and of any other.
BY_HEADER, BY_TITLE = 0.95, 0.8
#: Fixed values of the section-first score: weight and cap of BM25, and what a character counts.
BM25_WEIGHT, BM25_CAP, LENGTH_SCALE = 0.12, 10.0, 10_000.0
#: Aliases that are looked for in each title; a row each goes to the driver, and with the plan to the tasks.
FEW_ALIASES = 100
#: A line of a table of contents: title, dots, page.
TOC_LINE = r"(?m)^\s*(.{2,80}?)\s*[.．·…]{3,}\s*(\d{1,4})\s*$"


def plain_title(title: Column) -> Column:
    return F.lower(F.regexp_replace(title, r"[\s\p{P}\p{S}]+", ""))


def canonical_titles(rows: DataFrame, title: str, aliases: DataFrame) -> DataFrame:
    """``rows`` with section: that of an alias equal to the plain title, else one that it begins with, else one that it contains.

    ``aliases``: alias, section, priority; of equal matches the smaller priority. Neither side is bounded: up to FEW_ALIASES are looked for
    in each row, which stays where it is; more meet the distinct titles by their pieces.
    """
    a = aliases.select(plain_title(F.col("alias")).alias("alias"), "section", "priority")
    few = a.limit(FEW_ALIASES + 1).collect()
    if len(few) <= FEW_ALIASES:
        known = sorted((row for row in few if row["alias"]), key=lambda row: (row["priority"] is not None, row["priority"], row["alias"]))
        plain, section = F.col("_plain_title"), F.when(F.lit(False), F.lit(None))
        for meets in (lambda x: plain == x, lambda x: plain.startswith(x), lambda x: F.contains(plain, x)):
            for row in known:
                section = section.when(meets(F.lit(row["alias"])), F.lit(row["section"]))
        return rows.withColumn("_plain_title", plain_title(F.col(title))).select(*rows.columns, section.cast(a.schema["section"].dataType).alias("section"))
    distinct = rows.select(title).distinct().withColumn("plain", plain_title(F.col(title)))
    how = F.when(F.col("plain") == F.col("alias"), 0).when(F.col("plain").startswith(F.col("alias")), 1).otherwise(2)
    hit = distinct.join(substring_pairs(distinct, "plain", a, "alias"), "plain").join(a, "alias").groupBy(title).agg(F.min_by("section", F.struct(how, F.col("priority"), F.col("alias"))).alias("section"))
    return rows.join(hit, title, "left").select(*rows.columns, "section")


def toc_entries(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, entry (from 0), title, page of each line with dot leaders."""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(TOC_LINE), F.lit(1)).alias("title"), F.regexp_extract_all(text, F.lit(TOC_LINE), F.lit(2)).alias("page"))
    return rows.select(key, F.posexplode(found).alias("entry", "x")).select(key, "entry", F.col("x.title").alias("title"), F.col("x.page").cast("int").alias("page"))


def page_offset(pairs: DataFrame, key: str, found: str, printed: str) -> DataFrame:
    """key, offset: the median difference between pages found and pages printed, rounded half to even."""
    return pairs.groupBy(key).agg(F.bround(F.median(F.col(found) - F.col(printed))).cast("int").alias("offset"))


def section_spans(anchors: DataFrame, key: str, page: str, section: str, kind: str, last_page: str) -> DataFrame:
    """key, section, start, end, pages, confidence from anchors (headers count before titles on a page with both); a page with
    anchors of two sections is in conflict and left out."""
    strongest = F.min(F.when(F.col(kind) == "header", 0).otherwise(1)).over(Window.partitionBy(key, page))
    used = anchors.withColumn("_best", strongest).where(F.when(F.col(kind) == "header", 0).otherwise(1) == F.col("_best"))
    clear = used.withColumn("_lo", F.min(section).over(Window.partitionBy(key, page))).withColumn("_hi", F.max(section).over(Window.partitionBy(key, page))).where("_lo = _hi")
    s = clear.groupBy(key, section).agg(F.min(page).alias("start"), F.countDistinct(page).alias("pages"), F.max(last_page).alias("_last"), F.bool_or(F.col(kind) == "header").alias("_header"))
    following = F.lead("start").over(Window.partitionBy(key).orderBy("start", section))
    confidence = F.when(F.col("_header") & (F.col("pages") >= 2), BY_HEADER).otherwise(BY_TITLE)
    return s.select(key, section, "start", F.coalesce(following - 1, F.col("_last")).alias("end"), "pages", confidence.alias("confidence"))


def page_texts(elements: DataFrame, keys: Sequence[str], position: str, text: str) -> DataFrame:
    """keys, text: a page's elements joined in order. A page's elements are few."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(position, text))), lambda x: x[text])
    return elements.groupBy(*keys).agg(F.array_join(ordered, "\n").alias("text"))


def by_patterns(text: Column, patterns: Sequence[tuple[str, str]], default: str) -> Column:
    """The name of the first pattern that is found: page roles, kinds of statements."""
    return first_match([(F.coalesce(text.rlike(p), F.lit(False)), name) for name, p in patterns], default)


def body_score(text: Column, labels: Sequence[str], cues: Sequence[str]) -> Column:
    """One for each row label found, and a half for each cue."""
    hit = lambda xs: sum((F.contains(text, F.lit(x)).cast("double") for x in xs), F.lit(0.0))
    return hit(labels) + 0.5 * hit(cues)


def adjusted(score: Column, bonuses: Sequence[tuple[Column, float]]) -> Column:
    """``score`` and the bonuses whose condition holds."""
    return score + sum((F.when(c, F.lit(b)).otherwise(0.0) for c, b in bonuses), F.lit(0.0))


def section_first_score(terms: Column, bm25: Column, length: Column, bonus: Column) -> Column:
    """Terms found, some of BM25, a trace of the length, and what the kind of element adds."""
    return terms + BM25_WEIGHT * F.least(F.coalesce(bm25, F.lit(0.0)), F.lit(BM25_CAP)) + length / LENGTH_SCALE + bonus


def section_first_scores(terms: np.ndarray, bm25: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """The same of arrays, ``extra`` being the trace of the length and the kind's bonus; -inf where no term is found."""
    return np.where(terms > 0, terms + BM25_WEIGHT * np.minimum(bm25, BM25_CAP) + extra, -np.inf)


def complete_sum(parts: DataFrame, keys: Sequence[str], value: str, least: int = 2) -> DataFrame:
    """keys, total: the sum if no part is null and there are enough of them, else null."""
    return parts.groupBy(*keys).agg(F.when((F.count(value) == F.count("*")) & (F.count("*") >= least), F.sum(value)).alias("total"))


def period_matrix(series: DataFrame, keys: Sequence[str], period: str, value: str, periods: Sequence[str]) -> DataFrame:
    """One row per key, one text column per period (full years first, then interim ones, as given); a dash for what is missing."""
    wide = series.groupBy(*keys).pivot(period, list(periods)).agg(F.first(value, ignorenulls=True))
    return wide.select(*keys, *(F.coalesce(F.format_number(F.col(f"`{p}`"), 2), F.lit("—")).alias(p) for p in periods))


def worsening(series: DataFrame, key: str, period: str, value: str, by: float = 0.3) -> DataFrame:
    """key, prev, cur, grown of the last two periods: both negative, and the amount larger by more than ``by``."""
    w = Window.partitionBy(key).orderBy(F.desc(period))
    last = series.where(F.col(value).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n <= 2")
    two = last.groupBy(key).agg(F.max(F.when(F.col("_n") == 2, F.col(value))).alias("prev"), F.max(F.when(F.col("_n") == 1, F.col(value))).alias("cur"))
    return two.withColumn("grown", F.coalesce((F.col("prev") < 0) & (F.col("cur") < 0) & (F.abs("cur") > (1 + by) * F.abs("prev")), F.lit(False)))


def factors(rows: DataFrame, key: str, cases: Sequence[tuple[str, Column, Column, float]]) -> DataFrame:
    """key, factor, score, contribution of the cases (name, condition, score, weight) that hold."""
    made = F.array(*(F.when(c, F.struct(F.lit(n).alias("factor"), s.cast("double").alias("score"), (s * w).cast("double").alias("contribution"))) for n, c, s, w in cases))
    return rows.select(key, F.explode(F.filter(made, lambda x: x.isNotNull())).alias("x")).select(key, "x.*")


def findings(rows: DataFrame, key: str, cases: Sequence[tuple[Column, str]], *more: Column) -> DataFrame:
    """key, findings, ``more``: the texts of the conditions that hold, in order; what is good when nothing fired."""
    return rows.select(key, F.array_join(F.filter(F.array(*(F.when(c, t) for c, t in cases)), lambda x: x.isNotNull()), "; ").alias("findings"), *more)


def stale(ts: Column, now: Column, hours: int = 24) -> Column:
    """Older than ``hours`` before ``now``, or missing."""
    return F.coalesce(ts < now - F.expr(f"interval {hours} hours"), F.lit(True))


def report(rows: DataFrame, title: str, columns: Sequence[str], most: int = 200) -> str:
    """A Markdown table of at most ``most`` rows of a small result: a report, not a way to move data."""
    lines = [f"## {title}", "", "| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    for r in rows.select(*columns).limit(most).collect():
        lines.append("| " + " | ".join("—" if v is None else str(v).replace("|", "\\|") for v in r) + " |")
    return "\n".join(lines) + "\n"


def routed_sections(requests: DataFrame, routes: DataFrame, spans: DataFrame, otherwise: Sequence[str]) -> DataFrame:
    """doc, intent, position, section, start, end of the sections that each request is to be searched in, in the order of its route.

    ``requests``: doc, intent; ``routes``: intent, position, section; ``spans``: doc, section, start, end. An intent without a route
    takes ``otherwise``; sections that a document lacks are passed over.
    """
    default = F.posexplode(F.array(*map(F.lit, otherwise))).alias("position", "section")
    unknown = requests.join(routes.select("intent").distinct(), "intent", "left_anti").select("doc", "intent", default)
    wanted = requests.join(routes, "intent").select("doc", "intent", "position", "section").unionByName(unknown)
    return wanted.join(spans, ["doc", "section"]).select("doc", "intent", "position", "section", "start", "end")


def gated_queries(queries: DataFrame, gated: Sequence[str], is_open: Column, skip: bool, scale: float = 0.15) -> DataFrame:
    """``queries`` with score_scale and gate: those of a gated section are skipped or scaled down unless the gate is open."""
    shut = F.col("section").isin(*gated) & ~F.coalesce(is_open, F.lit(False))
    return queries.withColumns({"gate": F.when(shut, "skipped" if skip else "downweight").otherwise("active"), "score_scale": F.when(shut, 0.0 if skip else scale).otherwise(1.0)})


def composite_rank(hits: DataFrame, keys: Sequence[str], is_body: Column, role: Column, score: str, span: Column, last: Sequence[str]) -> DataFrame:
    """Adds rank (from 1): bodies first, then by role (appendix, summary, discussion, other), score and span, each descending."""
    order = F.when(role == "appendix", 3).when(role == "summary", 2).when(role == "discussion", 1).otherwise(0)
    w = Window.partitionBy(*keys).orderBy(F.desc(is_body.cast("int")), F.desc(order), F.desc(score), F.desc(span), *last)
    return hits.withColumn("rank", F.row_number().over(w))


def section_map_quality(spans: DataFrame, expected: DataFrame, pages: DataFrame) -> DataFrame:
    """doc, sections, missing, covered, coverage: of each document the expected sections found and not, and the share of its pages in a section.

    ``spans``: doc, section, start, end; ``expected``: section; ``pages``: doc, n_pages. Spans of one document do not overlap.
    """
    found = spans.groupBy("doc").agg(F.countDistinct("section").alias("sections"), F.sum(F.col("end") - F.col("start") + 1).alias("covered"))
    known = spans.join(expected.select("section").distinct(), "section", "left_semi").groupBy("doc").agg(F.countDistinct("section").alias("known"))
    all_of = expected.agg(F.countDistinct("section").alias("all"))
    out = pages.join(found, "doc", "left").join(known, "doc", "left").crossJoin(F.broadcast(all_of)).withColumn("missing", F.col("all") - F.coalesce("known", F.lit(0)))
    whole = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("doc", whole("sections"), whole("missing"), whole("covered"), F.try_divide(F.coalesce("covered", F.lit(0)), F.col("n_pages")).alias("coverage"))


def derived_ratios(metrics: DataFrame, key: Sequence[str], metric: str, value: str) -> DataFrame:
    """key, debt_to_assets and margin in per cent, of metrics in rows; null without a part, or over zero."""
    at = lambda name: F.max(F.when(F.col(metric) == name, F.col(value)))
    parts = metrics.groupBy(*key).agg(at("total_liabilities").alias("_l"), at("total_assets").alias("_a"), at("net_profit").alias("_p"), at("revenue").alias("_r"))
    share = lambda a, b: F.round(F.try_divide(F.col(a), F.when(F.abs(b) > 1e-9, F.col(b))) * 100, 2)
    return parts.select(*key, share("_l", "_a").alias("debt_to_assets"), share("_p", "_r").alias("margin"))
