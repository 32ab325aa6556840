"""Files in and out: encodings, index exports with two header rows, JSON documents, file names, side statistics, incremental loads."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.functions.scalars import file_name_fields
from tidemark.operators.timeseries import null_nan

#: What Spark reads as it is; other encodings (GBK, GB18030, ...) need a setting of the session.
CHARSETS = frozenset("us-ascii iso-8859-1 utf-8 utf-16be utf-16le utf-16 utf-32".split())
#: Column of lines that do not fit a schema.
UNFIT = "_unfit"
ELEMENT = "struct<category string, text string, bbox array<int>, image_path string>"
PAGE = f"page int, parse_status string, rotation_applied int, truncated boolean, table_structure_confidence string, table_quality_score int, elements array<{ELEMENT}>"


def allow_encoding(spark: SparkSession, encoding: str) -> None:
    """Lets the session read and write encodings beyond Spark's own list."""
    if encoding.lower() not in CHARSETS:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def csv(spark: SparkSession, path: str, schema: str | StructType, encoding: str = "UTF-8", tolerant: bool = False, columns: Sequence[str] | None = None, escape: str = "\\") -> DataFrame:
    """CSV with a header by an explicit schema (codes stay text); NaN is null. ``tolerant`` leaves out lines that do not fit."""
    allow_encoding(spark, encoding)
    reader = spark.read.option("header", True).option("encoding", encoding).option("escape", escape)
    if not tolerant:
        df = reader.schema(schema).csv(path)
        return null_nan(df.select(*columns) if columns else df)
    wanted = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    df = reader.schema(StructType([*wanted, StructField(UNFIT, StringType())])).option("columnNameOfCorruptRecord", UNFIT).csv(path)
    # Whether a line fits shows in all its columns; the hash, always true here, has them all read, whichever are selected later.
    df = df.where(F.col(UNFIT).isNull() & (F.hash(*wanted.names) >= F.lit(-(1 << 31))))
    return null_nan(df.select(*(columns or wanted.names)))


def with_footers(df: DataFrame, first: str, wanted: str) -> DataFrame:
    """Without the rows, notes and sources at the end of an export, whose first column does not look like ``wanted``."""
    return df.where(F.col(first).rlike(wanted))


def index_export(spark: SparkSession, path: str, encoding: str = "UTF-8", separator: str = ";") -> DataFrame:
    """date, code, name, value of a wide export: a row of names, one of codes, then a row per day; blank and zero cells are left out.

    The two header rows are read apart, as the first two lines; the data are turned to rows by an unpivot.
    """
    allow_encoding(spark, encoding)
    head = [line.split(separator) for line in spark.read.option("encoding", encoding).text(path).limit(2).toPandas()["value"]]
    names, codes = head[0][1:], head[1][1:]
    schema = StructType([StructField("date", StringType()), *(StructField(f"c{i}", StringType()) for i in range(len(codes)))])
    rows = spark.read.schema(schema).option("sep", separator).option("encoding", encoding).csv(path).where(F.col("date").rlike(r"^\d{4}-?\d{2}-?\d{2}$"))
    labels = F.create_map(*(F.lit(x) for i, (c, n) in enumerate(zip(codes, names, strict=True)) for x in (f"c{i}", f"{c}|{n}")))
    tall = rows.unpivot(["date"], [f"c{i}" for i in range(len(codes))], "column", "text").withColumn("value", F.regexp_replace("text", ",", "").try_cast("double")).where("value <> 0")
    label = F.element_at(labels, F.col("column"))
    return tall.select(F.to_date(F.regexp_replace("date", "-", ""), "yyyyMMdd").alias("date"), F.split_part(label, F.lit("|"), F.lit(1)).alias("code"), F.split_part(label, F.lit("|"), F.lit(2)).alias("name"), "value")


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Known columns under their canonical names, those that are there."""
    return df.select(*(F.col(f"`{old}`").alias(new) for old, new in names.items() if old in df.columns))


def by_header_part(df: DataFrame, parts: dict[str, str]) -> DataFrame:
    """Columns whose header, on one or more lines, contains a part: new name to part. The first that does counts."""
    flat = {c: "".join(c.split()) for c in df.columns}
    found = {new: next((c for c, f in flat.items() if part in f), None) for new, part in parts.items()}
    return df.select(*(F.col(f"`{c}`").alias(new) if c else F.lit(None).cast("string").alias(new) for new, c in found.items()))


def parsed_document(spark: SparkSession, path: str) -> DataFrame:
    """Pages of JSON documents that are arrays of pages, with the file's path."""
    return spark.read.schema(PAGE).option("multiLine", True).json(path).withColumn("path", F.input_file_name())


def elements(pages: DataFrame, key: str) -> DataFrame:
    """key, page, position and fields of each element that counts: no footers, empty figures or blank texts; boxes and states stay."""
    e = pages.select(key, "page", "parse_status", F.posexplode("elements").alias("position", "e")).select(key, "page", "parse_status", "position", "e.*")
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    return e.where((F.col("category") != "footer") & ~(blank & (F.coalesce("image_path", F.lit("")) == "")) & ~(blank & (F.col("category") != "figure")))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines and lines that do not parse are left out."""
    return spark.read.text(path).where(F.try_parse_json("value").isNotNull()).select(F.from_json("value", schema).alias("x")).select("x.*")


def files_by_name(spark: SparkSession, folder: str, glob: str, patterns: Sequence[str]) -> DataFrame:
    """path, size, code, day, company, kind of the files below ``folder`` whose names fit a pattern. Contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder).select("path", F.col("length").alias("size"))
    return found.withColumn("f", file_name_fields(F.col("path"), patterns)).where("f IS NOT NULL").select("path", "size", "f.*")


def preferred_file(files: DataFrame, key: str, preferred: str) -> DataFrame:
    """One file per key: one whose path contains ``preferred``, else the first by path; with how many there were."""
    rank = F.struct(F.when(F.contains("path", F.lit(preferred)), 0).otherwise(1), F.col("path"))
    return files.groupBy(key).agg(F.min_by("path", rank).alias("path"), F.count("*").alias("files"))


def first_valid(sources: Sequence[Callable[[], DataFrame]], least: int) -> DataFrame:
    """The first source with at least ``least`` rows; a source that fails or is shorter gives way to the next."""
    for read in sources:
        try:
            df = read()
            if df.limit(least).count() >= least:
                return df
        except Exception as error:  # noqa: BLE001  the next source is the answer to any failure
            last = error
        else:
            last = ValueError(f"fewer than {least} rows")
    raise last


def write_with_stats(df: DataFrame, path: str, date: str, note: str = "", kind: str = "parquet") -> dict:
    """Writes ``df`` and beside it, in path_meta, one JSON row: rows, columns, first and last day, note. Counted while writing."""
    from pyspark.sql import Observation

    seen = Observation()
    watched = df.observe(seen, F.count("*").alias("rows"), F.min(date).cast("string").alias("date_min"), F.max(date).cast("string").alias("date_max"))
    writer = watched.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.format(kind).save(path)
    stats = seen.get | {"columns": df.columns, "note": note}
    df.sparkSession.createDataFrame([(json.dumps(stats, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}_meta")
    return stats


def parsed_chunks(documents: DataFrame, key: str, json_col: str) -> tuple[DataFrame, DataFrame]:
    """key, position, page, category, text of every chunk in JSON documents of two shapes; and the rows whose JSON does not parse.

    A list is one of chunks. An object has pages (or content) of elements (or items), and may have lists of chunks beside them:
    risk_chunks, chunks, elements. Chunks without text are left out; null documents have none, and count as parsed.
    """
    parsed = documents.select(F.col(key), F.col(json_col).alias("_json"), F.try_parse_json(json_col).alias("_v"))
    text = lambda v, *names: F.coalesce(*(F.nullif(F.try_variant_get(v, f"$.{n}", "string"), F.lit("")) for n in names))
    page = lambda v, *names: F.coalesce(*(F.nullif(F.try_variant_get(v, f"$.{n}", "long"), F.lit(0)) for n in names))
    items = lambda v, *names: F.coalesce(*(F.nullif(F.try_variant_get(v, f"$.{n}", "array<variant>").cast("array<string>"), F.array().cast("array<string>")) for n in names), F.array().cast("array<string>"))
    as_variant = lambda s: F.try_parse_json(s)

    def chunk(v):
        return F.struct(page(v, "page", "page_number").alias("page"), F.coalesce(text(v, "type", "category"), F.lit("text")).alias("category"), text(v, "content", "excerpt", "text").alias("text"))

    def element(number, v):
        return F.struct(F.coalesce(number, F.try_variant_get(v, "$.page", "long")).alias("page"), F.coalesce(text(v, "category", "type"), F.lit("text")).alias("category"), text(v, "text", "content", "html").alias("text"))

    v = F.col("_v")
    whole = F.coalesce(F.try_variant_get(v, "$", "array<variant>").cast("array<string>"), F.array().cast("array<string>"))
    of_pages = F.flatten(F.transform(items(v, "pages", "content"), lambda p: F.transform(items(as_variant(p), "elements", "items"), lambda e: element(page(as_variant(p), "page", "page_number", "page_idx"), as_variant(e)))))
    lists = F.concat(whole, *(items(v, n) for n in ("risk_chunks", "chunks", "elements")))
    chunks = parsed.select(key, F.posexplode(F.concat(of_pages, F.transform(lists, lambda c: chunk(as_variant(c))))).alias("position", "c")).select(key, "position", "c.*").where("text IS NOT NULL")
    return chunks, parsed.where("_v IS NULL AND _json IS NOT NULL").select(key, F.col("_json").alias(json_col))


def keyword_hits(chunks: DataFrame, key: str, keywords: Sequence[str], k: int = 8, excerpt: int = 500) -> DataFrame:
    """key, position, page, category, excerpt, matched (the keywords in order), score: each key's ``k`` chunks with the most of the keywords, ties by position."""
    from pyspark.sql.window import Window

    matched = F.filter(F.array(*map(F.lit, keywords)), lambda w: F.contains("text", w))
    hits = chunks.withColumn("matched", matched).where(F.size("matched") > 0).withColumn("score", F.size("matched").cast("double"))
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "position"))).where(F.col("rank") <= k)
    return hits.select(key, "position", "page", "category", F.substring("text", 1, excerpt).alias("excerpt"), "matched", "score")


def yaml_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per YAML file at ``path`` (profiles, lexicons, rules), by an explicit schema, with the file's path as ``file``.

    Dates become text; a key that the schema lacks is left out, one that a file lacks is null. A file that doesn't parse is an error.
    """
    @pandas_udf(StringType())
    def as_json(texts: pd.Series) -> pd.Series:
        try:
            import yaml
        except ModuleNotFoundError as error:
            raise ModuleNotFoundError("YAML files need the yaml package") from error
        return texts.map(lambda t: json.dumps(yaml.safe_load(t), ensure_ascii=False, default=str))

    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), as_json("value").alias("json"))
    return whole.select("file", F.from_json("json", schema).alias("x")).select("file", "x.*")
