"""Financial statements: periods, labelled rows and metrics out of tables and text lines, all labels in one pass.

A statement is a text (HTML with a table, or lines) of a document under a table code. Its rows are parsed once in Arrow batches;
all else is column work. A few labels are held against every row's name where it lies; with more, every name gives its beginnings in the
lengths that labels have, which meet the labels of all metrics in one equality join. Ranked matches keep their row as evidence.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.html_tables import table_rows

#: Scores of how a row's name meets a label, and what a name may have beyond a label that it begins with.
EQUAL, EQUAL_WITHOUT_SPACES, SHORT_ENDING, BEGINS, CONTINUED = 100, 90, 80, 50, 85
ENDING = 4
#: What in a cell tells an interim period; what in the headers tells a balance at the year's end, and within the year.
INTERIM = r"(?i)個月|个月|中期|interim|截至|止\s*\d+\s*[個个]?月"
YEAR_END, WITHIN_YEAR = r"12\s*月\s*31|止年度|年末", r"[689]\s*月\s*30?1?|個月|个月|中期|止\s*八"
#: Names of rows that go on with the row before, and what a continuing name may hold.
CONTINUATION = r"^(現金流量淨額|现金净额|現金淨額|的現金淨額|净额|淨額)$|淨額|净额"
#: Rows that headers are looked for in, years that make a header, numbers that a line must have.
HEADER_ROWS, HEADER_YEARS, LINE_NUMBERS = 8, 3, 3
#: Labels that may be broadcast; more are joined by Spark's own choice.
BROADCAST_LABELS = 50_000
#: Labels that each name is held against where it lies; more are met by equality joins on beginnings of names.
FEW_LABELS = 200
#: White space as Unicode has it, and leaders behind a name.
WHITE, LEADERS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000", ".．…⋯"


def periods(rows: Column) -> Column:
    """Periods of the first row (of eight) that names three years or more, in the order of its columns; none without one.

    A column whose year stood before, or whose own cell speaks of months, is an interim period: _i1, _i2 after its year. So is the last
    column, if it is not one yet, where it alone has its year and interim columns stand before it, or where the headers name
    both the year's end and a day within the year.
    """
    years = lambda row: F.transform(F.filter(row, lambda c: c.rlike(r"20\d{2}")), lambda c: F.struct(F.regexp_extract(c, r"20\d{2}", 0).alias("year"), c.rlike(INTERIM).alias("interim")))
    none = F.filter(F.array(F.struct(F.lit("").alias("year"), F.lit(False).alias("interim"))), lambda c: c["interim"])
    header = lambda head: F.coalesce(F.get(F.filter(F.transform(head, years), lambda r: F.size(r) >= HEADER_YEARS), F.lit(0)), none)

    def numbered(found: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            same = F.filter(F.slice(found, F.lit(1), i), lambda x: x["year"] == c["year"])
            first = F.coalesce(F.get(same, F.lit(0)), c)
            return F.struct(c["year"].alias("year"), (F.size(same) + first["interim"].cast("int")).alias("number"))

        return F.transform(found, one)

    def named(columns: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            before = F.slice(columns, F.lit(1), i)
            alone = F.exists(before, lambda x: x["number"] > 0) & ~F.exists(before, lambda x: x["year"] == c["year"])
            words = F.array_join(F.flatten(F.slice(rows, 1, HEADER_ROWS)), " ")
            tail = (i == F.size(columns) - 1) & (c["number"] == 0) & (alone | words.rlike(YEAR_END) & words.rlike(WITHIN_YEAR))
            number = F.when(tail, 1).otherwise(c["number"])
            return F.when(number == 0, c["year"]).otherwise(F.concat(c["year"], F.lit("_i"), number.cast("string")))

        return F.transform(columns, one)

    return _given(_given(header(F.slice(rows, 1, HEADER_ROWS)), numbered), named)


def _given(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it stands in what is made of it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def row_numbers(cells: Column) -> Column:
    """Numbers of a row's cells after the first; dashes are null ones, blanks, notes' numbers (one or two digits) and words are left out."""
    # Longer cells are no notes' numbers, and commas and blanks go without a pattern.
    long = lambda c: (F.length(F.trim(c)) > 4) | ~F.trim(c).rlike(r"^\d{0,2}$")
    plain = F.transform(F.filter(F.slice(cells, 2, 1 << 30), long), lambda c: F.replace(F.replace(c, F.lit(","), F.lit("")), F.lit(" "), F.lit("")))
    read = F.transform(plain, lambda c: F.struct(plain_number(c).alias("value"), c.isin("–", "-", "—", "N/A", "n/a", "NA").alias("dash")))
    return F.transform(F.filter(read, lambda c: c["dash"] | c["value"].isNotNull()), lambda c: c["value"])


def plain_number(text: Column) -> Column:
    """The number of a text without separators, in brackets a negative one; null if it is none."""
    inside = F.regexp_extract(text, r"^\((.*)\)$", 1)
    return F.when(text.startswith("(") & (inside != ""), -inside.try_cast("double")).otherwise(text.try_cast("double"))


def line_numbers(text: Column) -> Column:
    """The numbers that stand in a line, but for those of one or two digits."""
    found = F.regexp_extract_all(text, F.lit(r"\(?-?[\d,]+(?:\.\d+)?\)?"), F.lit(0))
    kept = F.filter(found, lambda n: ~n.rlike(r"^\d{1,2}$"))
    return F.filter(F.transform(kept, lambda n: plain_number(F.regexp_replace(n, ",", ""))), lambda v: v.isNotNull())


def label_table(spark: SparkSession, labels: Mapping[str, Mapping[str, Sequence[str]]], reject: Mapping[str, Sequence[str]]) -> DataFrame:
    """code, metric, label, rejected (words that a row of the metric must not hold)."""
    rows = [(code, metric, label, list(reject.get(metric, ()))) for code, metrics in labels.items() for metric, names in metrics.items() for label in names if label]
    return spark.createDataFrame(rows, "code string, metric string, label string, rejected array<string>")


def matched(named: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``named`` (code, name, all: the text that must not hold rejected words) with metric, score and length of each label they meet.

    Only beginnings count: a label in the middle of a name is another row's ("other income" is not income).
    """
    lengths = [r[0] for r in labels.select(F.length("label")).distinct().collect()]  # as many as there are lengths of names
    if labels.count() <= BROADCAST_LABELS:
        labels = F.broadcast(labels)
    name = F.col("name")
    beginnings = F.transform(F.filter(F.array(*map(F.lit, sorted(lengths))), lambda n: n <= F.length(name)), lambda n: F.substring(name, F.lit(1), n))
    probes = F.array_distinct(F.concat(beginnings, F.array(F.replace(name, F.lit(" "), F.lit("")))))
    met = named.where(F.length("name") > 0).withColumn("label", F.explode(probes)).join(labels, ["code", "label"])
    begins = name.startswith(F.col("label"))
    score = F.when(name == F.col("label"), EQUAL).when(F.replace(name, F.lit(" "), F.lit("")) == F.col("label"), EQUAL_WITHOUT_SPACES).when(begins & (F.length(name) <= F.length("label") + ENDING), SHORT_ENDING).when(begins, BEGINS)
    met = met.withColumns({"score": score, "length": F.when(begins, F.length("label")).otherwise(0)})
    return met.where(F.col("score").isNotNull() & ~F.exists("rejected", lambda w: F.contains(F.col("all"), w))).drop("rejected")


def held_against(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` (code, line, name_0, all; of lines also name_1) with metric, m (probe, s, l, label) and length of the labels they meet as in
    ``matched``: for lines the best label of each metric, for rows, which have one name, every one.

    Few labels: a row is held against those of its code where it lies, and makes no row for each of its beginnings.
    """
    own = labels.distinct().withColumn("_of", F.collect_set("label").over(Window.partitionBy("code", "metric")))
    label, names, texts = F.col("label"), (F.col("name_0"), F.col("name_1")), (F.col("_plain_0"), F.col("_plain_1"))

    def scored(k: int, x: Column) -> Column:
        begins = names[k].startswith(x)
        return F.when(names[k] == x, EQUAL).when(texts[k] == x, EQUAL_WITHOUT_SPACES).when(begins & (F.length(names[k]) <= F.length(x) + ENDING), SHORT_ENDING).when(begins, BEGINS)

    within = lambda k, x: F.when(names[k].startswith(x), F.length(x)).otherwise(0)
    hit = lambda k, x: F.struct(F.lit(k).alias("probe"), (-scored(k, x)).alias("s"), (-within(k, x)).alias("l"), x.alias("label"))
    meets = lambda k: names[k].startswith(label) | (texts[k] == label)
    met = rows.withColumns({f"_plain_{k}": F.replace(f"name_{k}", F.lit(" "), F.lit("")) for k in (0, 1)}).alias("r")
    met = met.join(F.broadcast(own.withColumnRenamed("code", "_code")), (F.col("code") == F.col("_code")) & F.coalesce(meets(0) | F.coalesce(meets(1), F.lit(False)), F.lit(False))).where(~F.exists("rejected", lambda w: F.contains(F.col("all"), w)))
    hits = F.filter(F.concat(F.transform("_of", lambda x: hit(0, x)), F.transform("_of", lambda x: hit(1, x))), lambda h: h["s"].isNotNull())
    length = F.when(F.col("line"), F.array_max(F.transform("_of", lambda x: F.greatest(within(0, x), within(1, x))))).otherwise(within(0, label))
    best = F.when(F.col("line"), F.array_min(hits)).otherwise(hit(0, label))
    # An array of one is a row of its own: the filter neither makes its value anew nor moves into the join.
    met = met.select(*(c for c in rows.columns if c not in ("name_0", "name_1")), "metric", "label", length.alias("length"), F.explode(F.array(best)).alias("m"))
    return met.where("NOT line OR label = m.label").drop("label")


def metric_series(statements: DataFrame, key: str, labels: Mapping[str, Mapping[str, Sequence[str]]], reject: Mapping[str, Sequence[str]] | None = None, default_periods: Sequence[str] = (), code_col: str = "code", text_col: str = "text") -> DataFrame:
    """key, code, metric, period, value, source, position, label, evidence: one row per period of each metric found.

    ``statements``: one text per key and code. A metric's values are those of the table row whose name meets one of its labels best (of
    equal ones the first) and that has numbers, in its own cells or in those of a continuing row after it, the i-th number for the
    i-th period. Where that row has none but dashes, or there is no such row, the line that meets best counts (score, then how
    many and how large numbers, then the first), at least three numbers. source: row or line; position: its number from 0;
    evidence: its text, 200 characters at most. Null texts have no rows; metrics without any number are left out.
    """
    own = statements.select(F.col(key).alias("_key"), F.col(code_col).alias("code"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = own.withColumn("rows", table_rows("text"))
    own = own.withColumn("periods", periods(F.col("rows")))
    own = own.withColumn("periods", F.when(F.size("periods") > 0, F.col("periods")).otherwise(F.array(*map(F.lit, default_periods)).cast("array<string>")))
    strip = lambda c: F.btrim(c, F.lit(WHITE))
    clean = lambda c: strip(F.rtrim(strip(c), F.lit(LEADERS)))

    # Rows (each with the one after it, not with its whole table) and lines are candidates of one pass: texts are read and parsed once.
    none = F.array().cast("array<string>")
    first_cell = lambda cells: clean(F.coalesce(F.get(cells, F.lit(0)), F.lit("")))
    one = lambda line, i, text, cells, following: F.struct(F.lit(line).alias("line"), i.alias("position"), text.alias("all"), cells.alias("cells"), following.alias("next"))
    rows = F.transform("rows", lambda cells, i: one(False, i, F.lit("").cast("string"), F.coalesce(cells, none), F.coalesce(F.get("rows", i + 1), none)))
    lines = F.transform(F.split("text", r"\r\n|[\r\n]"), lambda x, i: one(True, i, x, none, none))
    found = own.select("_key", "code", "periods", F.inline(F.concat(rows, lines))).withColumn("all", F.when(F.col("line"), strip("all")).otherwise(first_cell("cells")))
    head = F.nullif(strip(F.regexp_extract("all", r"(?U)^(.*?)(?:\s{2,}|\t|(?=\d)|$)", 1)), F.lit(""))
    found = found.withColumn("name_0", F.when(F.col("line"), clean(F.coalesce(head, F.substring("all", 1, 40)))).otherwise(F.col("all")))
    found = found.withColumn("name_1", F.when(F.col("line"), clean(F.substring("all", 1, 48))))
    table = label_table(statements.sparkSession, labels, reject or {})
    if sum(len(names) for metrics in labels.values() for names in metrics.values()) <= FEW_LABELS:
        found = held_against(found, table)
    else:
        names = F.when(F.col("line"), F.array("name_0", "name_1")).otherwise(F.array("name_0"))
        found = matched(found.select("*", F.posexplode(names).alias("probe", "name")).drop("name_0", "name_1"), table)
        found = found.groupBy("_key", "code", "metric", "line", "position").agg(
            F.min(F.struct("probe", (-F.col("score")).alias("s"), (-F.col("length")).alias("l"), "label")).alias("m"), F.max("length").alias("length"), *(F.any_value(c).alias(c) for c in ("periods", "all", "cells", "next")),
        )

    row = ~F.col("line")
    own_numbers = F.when(row, row_numbers(F.col("cells"))).otherwise(line_numbers(F.substring(F.col("all"), F.col("length") + 1, F.length("all"))))
    found = found.select("*", F.explode(F.array(own_numbers)).alias("numbers"))  # made once, not again for the filter
    found = found.withColumn("continued", row & (F.size("numbers") == 0) & first_cell(F.col("next")).rlike(CONTINUATION))
    found = found.withColumn("numbers", F.when(F.col("continued"), row_numbers(F.col("next"))).otherwise(F.col("numbers"))).where(F.size("numbers") >= F.when(row, 1).otherwise(LINE_NUMBERS))
    score = F.when(F.col("continued"), F.greatest(-F.col("m.s"), F.lit(CONTINUED))).otherwise(-F.col("m.s"))
    line_score = score * 10 + F.size("numbers") + F.least(F.abs(F.get("numbers", F.lit(0))) / 1e6, F.lit(50.0))
    row_values = F.transform("periods", lambda p, i: F.struct(p.alias("period"), F.get("numbers", i).alias("value")))
    line_values = F.transform("numbers", lambda v, i: F.struct(F.coalesce(F.get("periods", i), F.concat(F.lit("p"), i.cast("string"))).alias("period"), v.alias("value")))
    evidence = F.when(row, F.array_join(F.when(F.col("continued"), F.concat("cells", "next")).otherwise(F.col("cells")), " ")).otherwise(F.col("all"))
    kept = F.struct((-F.when(row, score.cast("double")).otherwise(line_score)).alias("s"), "position", F.when(row, F.col("m.l")).otherwise(0).alias("l"), F.col("m.label").alias("label"), F.when(row, row_values).otherwise(line_values).alias("values"), evidence.alias("evidence"))
    best = found.groupBy("_key", "code", "metric").agg(F.min(F.when(row, kept)).alias("row"), F.min(F.when(~row, kept)).alias("line"))

    by_row = F.coalesce(F.exists("row.values", lambda v: v["value"].isNotNull()), F.lit(False))
    pick = lambda c: F.when(by_row, F.col(f"row.{c}")).otherwise(F.col(f"line.{c}")).alias(c)
    out = best.where(by_row | F.col("line").isNotNull()).select(F.col("_key").alias(key), "code", "metric", F.when(by_row, "row").otherwise("line").alias("source"), *map(pick, ("position", "label", "values", "evidence")))
    return out.select(key, "code", "metric", F.inline("values"), "source", "position", "label", F.substring("evidence", 1, 200).alias("evidence")).select(key, "code", "metric", "period", "value", "source", "position", "label", "evidence")


def statement_metrics(series: DataFrame, key: str, asset_parts: Sequence[str], liability_parts: Sequence[str]) -> DataFrame:
    """key, metric, period, value, origin (read, parts, reconciled, derived): the metrics of ``series`` as a whole, no null values.

    Total assets and liabilities without a number other than 0 are the sum of two parts, where both are known; so are total assets below
    net assets in any period. Revenue that is nothing but other income goes. Gross margin is 100 * gross profit / revenue. Total
    assets that are missing, below net assets, or more than 15 % off net assets and liabilities together become their sum.
    """
    wide = series.groupBy(key, "period").agg(*(F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in _WIDE + [*asset_parts, *liability_parts]))
    mine = Window.partitionBy(key)  # periods of one document
    some = lambda c: F.coalesce(F.max(c).over(mine), F.lit(False))

    def summed(parts: Sequence[str]) -> Column:
        known = [some(F.col(p).isNotNull()) for p in parts]
        return F.when(known[0] & known[1], F.round(F.col(parts[0]) + F.col(parts[1]), 2))

    c = F.col
    wide = wide.withColumns({"_ta": summed(asset_parts), "_tl": summed(liability_parts)})
    wide = wide.withColumns({"_no_ta": ~some(c("TOTAL_ASSETS") != 0) & some(c("_ta").isNotNull()), "_no_tl": ~some(c("TOTAL_LIAB") != 0) & some(c("_tl").isNotNull())})
    wide = wide.withColumns({"_a": F.when(c("_no_ta"), c("_ta")).otherwise(c("TOTAL_ASSETS")), "_l": F.when(c("_no_tl"), c("_tl")).otherwise(c("TOTAL_LIAB"))})
    wide = wide.withColumn("_low", some(c("_a") < c("NET_ASSETS")) & some(c("_ta").isNotNull()))
    wide = wide.withColumn("_a", F.when(c("_low"), c("_ta")).otherwise(c("_a")))
    wide = wide.withColumn("_rev", F.when(some(c("REV").isNotNull() & ~c("REV").eqNullSafe(c("OTHER_INCOME"))) | ~some(c("OTHER_INCOME").isNotNull()), c("REV")))
    wide = wide.withColumn("_margin", F.when(c("_rev") != 0, F.round(c("GP") / c("_rev") * 100, 2)))
    total = c("NET_ASSETS") + c("_l")
    off = c("_a").isNull() | (c("_a") < c("NET_ASSETS")) | (total != 0) & (F.abs(c("_a") - total) / F.greatest(F.abs(total), F.lit(1.0)) > 0.15)
    wide = wide.withColumn("_new", F.when(total.isNotNull() & off, F.round(total, 2)))
    out = {"REV": ("_rev", F.lit("read")), "GP_MARGIN": ("_margin", F.lit("derived")), "TOTAL_LIAB": ("_l", F.when(c("_no_tl"), "parts").otherwise("read"))}
    out |= {m: (m, F.lit("read")) for m in _WIDE if m not in ("REV", "TOTAL_LIAB", "TOTAL_ASSETS")}
    entries = [F.struct(F.lit(m).alias("metric"), c(v).cast("double").alias("value"), o.alias("origin")) for m, (v, o) in out.items()]
    origin = F.when(c("_new").isNotNull(), "reconciled").when(c("_no_ta") | c("_low"), "parts").otherwise("read")
    entries.append(F.struct(F.lit("TOTAL_ASSETS").alias("metric"), F.coalesce("_new", "_a").cast("double").alias("value"), origin.alias("origin")))
    return wide.select(key, "period", F.inline(F.array(*entries))).where("value IS NOT NULL").select(key, "metric", "period", "value", "origin")


_WIDE = ["REV", "OTHER_INCOME", "COGS", "GP", "RD_EXP", "SGA", "NET_LOSS", "TOTAL_ASSETS", "TOTAL_LIAB", "NET_ASSETS", "CASH_EQ", "CV_PREF", "CFO", "CFI", "CFF", "END_CASH"]


def field_pairs(pages: DataFrame, key: str, text_col: str, fields: Mapping[str, Sequence[str]]) -> DataFrame:
    """key, field, value, position: named fields of the tables that have a name beside its value, in two cells or in pairs of cells.

    ``fields``: field to the names under which it is known; a name counts without white space and a colon at its end. The first value that
    isn't empty counts. Other cells are left alone.
    """
    names = pages.sparkSession.createDataFrame([(name, field) for field, all_ in fields.items() for name in all_], "name string, field string")
    rows = pages.select(F.col(key), F.posexplode(table_rows(text_col)).alias("position", "cells")).where("size(cells) >= 2")
    pairs = F.transform(F.sequence(F.lit(0), F.size("cells") - 2, F.lit(2)), lambda i: F.struct(F.regexp_replace(F.get("cells", i), r"\s+|[:：]\s*$", "").alias("name"), F.trim(F.get("cells", i + 1)).alias("value"), i.alias("at")))
    rows = rows.select(key, "position", F.inline(pairs)).where("value <> ''")
    if names.count() <= BROADCAST_LABELS:
        names = F.broadcast(names)
    found = rows.join(names, "name").groupBy(key, "field").agg(F.min(F.struct("position", "at", "value")).alias("f"))
    return found.select(key, "field", "f.value", "f.position")

