"""Scalar functions on columns: codes, numbers, dates, texts, JSON, boxes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The character references that are decoded, in this order.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def zfill(x: Column, n: int) -> Column:
    """Padded with zeros on the left; longer values stay whole."""
    return F.when(F.length(x) >= n, x).otherwise(F.lpad(x, n, "0"))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def ticker(x: Column) -> Column:
    """'700.hk', '00700' -> '0700.HK'; null if there is no number."""
    n = digits(F.regexp_replace(F.upper(x), r"\.HK$", "")).try_cast("int")
    return F.when(n.isNotNull(), F.concat(zfill(n.cast("string"), 4), F.lit(".HK")))


def plain_number(x: Column) -> Column:
    """Thousands separators and per cent signs dropped; what then is no number is null."""
    return F.regexp_replace(F.trim(x), "[,%]", "").try_cast("double")


def accounting_number(x: Column) -> Column:
    """(1,234.5) is negative; dashes, N/A and blanks are null."""
    t = F.regexp_replace(F.trim(x), r"[,\s%]", "")
    inside = F.regexp_extract(t, r"^[(（](.+)[)）]$", 1)
    return F.when(t.isin("", "-", "–", "—", "N/A", "n/a"), F.lit(None).cast("double")).when(inside != "", -inside.try_cast("double")).otherwise(t.try_cast("double"))


def first_number(x: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(x, ",", ""), r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")


def to_day(x: Column) -> Column:
    """yyyymmdd, dd-mm-yyyy, yyyy-m-d and yyyy/m/d; anything else is null."""
    pick = lambda pattern, order: F.concat_ws("-", *(zfill(F.regexp_extract(x, pattern, g), 2 if g != order[0] else 4) for g in order))
    forms = [(r"^(\d{4})(\d{2})(\d{2})$", (1, 2, 3)), (r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})$", (1, 2, 3)), (r"^(\d{1,2})-(\d{1,2})-(\d{4})$", (3, 2, 1))]
    return F.coalesce(*(F.when(x.rlike(p), F.try_to_timestamp(pick(p, o), F.lit("yyyy-MM-dd")).cast("date")) for p, o in forms))


def strip_tags(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), r"\s+", " "))


def excerpt(x: Column, n: int = 200) -> Column:
    t = strip_tags(x)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("…"))).otherwise(t)


def decode_entities(x: Column) -> Column:
    out = F.regexp_replace(x, r"(?i)<br\s*/?>", " ")
    for ref, char in ENTITIES:
        out = F.replace(out, F.lit(ref), F.lit(char))
    return out


def page_slice(markdown: Column, first: int, last: int, header: str = r"(?m)^## Page (\d+)$") -> Column:
    """The text of the pages first to last of a document with a header line before each page."""
    pages = F.zip_with(F.regexp_extract_all(markdown, F.lit(header), F.lit(1)), F.slice(F.split(markdown, header), 2, 1_000_000), lambda n, t: F.struct(n.cast("int").alias("n"), F.regexp_replace(t, r"^\s+|\s+$", "").alias("t")))
    return F.array_join(F.transform(F.filter(pages, lambda p: p["n"].between(first, last)), lambda p: p["t"]), "\n\n")


def json_text(x: Column) -> Column:
    """The JSON of a fenced block, or from the first brace to the last; the text as it is if there is neither."""
    fenced = F.regexp_extract(x, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(x, r"(?s)(\{.*\})", 1)
    return F.when(fenced != "", F.regexp_replace(fenced, r"^\s+|\s+$", "")).when(braces != "", braces).otherwise(x)


def whole_array(x: Column) -> Column:
    """A JSON array of objects that may be cut off: up to its last whole object, closed."""
    t = F.trim(x)
    cut = F.regexp_extract(t, r"(?s)^(\[.*\})", 1)
    return F.when(t.endswith("]"), t).when(cut != "", F.concat(cut, F.lit("]"))).otherwise("[]")


def scaled_box(box: Column, factor: float) -> Column:
    return F.transform(box, lambda v: F.bround(v * factor).cast("int"))


def period_key(period: Column) -> Column:
    """Sorts '2023' before '2024_i1' before '2024_i2'."""
    return F.struct(F.split_part(period, F.lit("_i"), F.lit(1)).try_cast("int").alias("year"), F.coalesce(F.nullif(F.split_part(period, F.lit("_i"), F.lit(2)), F.lit("")).try_cast("int"), F.lit(0)).alias("part"))


def number_text(x: Column, places: int = 2) -> Column:
    return F.coalesce(F.format_number(x, places), F.lit("—"))


def series_text(series: Column) -> Column:
    """A map as 'k=v;' in the order of its keys."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(series)), lambda e: F.concat(e["key"], F.lit("="), number_text(e["value"]))), "; ")


def mostly_latin(x: Column, share: float = 0.6) -> Column:
    letters = F.length(F.regexp_replace(x, r"[^A-Za-z]", ""))
    han = F.length(F.regexp_replace(x, "[^一-鿿]", ""))
    return F.when(letters + han == 0, False).otherwise(letters / (letters + han) >= share)


def garbled(x: Column) -> Column:
    """No Chinese character, not plain ASCII either."""
    return ~x.rlike("[一-鿿]") & x.rlike(r"[^\x00-\x7F]")


def nonempty(x: Column) -> Column:
    return F.coalesce((F.trim(x) != "") & (F.lower(F.trim(x)) != "nan"), F.lit(False))


def percentages(x: Column) -> Column:
    """The numbers before per cent signs that lie in (0, 100]."""
    found = F.transform(F.regexp_extract_all(x, F.lit(r"(\d+(?:\.\d+)?)\s*[%％]"), F.lit(1)), lambda n: n.try_cast("double"))
    return F.filter(found, lambda v: (v > 0) & (v <= 100))


def file_name_fields(path: Column, patterns: Sequence[str]) -> Column:
    """code, day, company, kind of a file name by the first pattern (with these four groups in order) that matches."""
    name = F.regexp_extract(path, r"([^/]+?)(?:\.[A-Za-z]+)?$", 1)
    group = lambda p, g: F.regexp_extract(name, p, g)
    return F.coalesce(*(F.when(name.rlike(p), F.struct(group(p, 1).alias("code"), to_day(group(p, 2)).alias("day"), group(p, 3).alias("company"), group(p, 4).alias("kind"))) for p in patterns))
