"""WARC archives: writing and reading records, and revisit resolution over a whole crawl.

Spark's text writer makes the files: a row is one record, and the line separator is the pair of line ends that closes a WARC
record. Reading goes by Content-Length, so that payloads may hold anything. Resolution shuffles headers only: of the
records with one payload (by SHA-1, which archives use, and SHA-256, as SHA-1 can be made to clash) the one with the smallest page id stays a response; each other record
is joined with it and becomes a revisit. The deduplicated archives then get fresh headers, and payloads for responses alone.
Payloads are hashed once, where the first archives are read; what is written thereafter carries their digests.

A file is one gzip member, as Spark's text writer makes it; readers that want a member for each record need it recompressed.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import scratch_dir, written
from tidemark.sources import table

END = "\r\n"
#: Up to so many revisits (some 100 bytes each) are broadcast to the records; beyond, both are shuffled.
BROADCAST_REVISITS = 100_000
#: Records and bytes of payload in a file at most (one longer payload is a file of its own): a file is read by one task.
RECORDS_PER_FILE, BYTES_PER_FILE = 5000, 512 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def now() -> str:
    """The time of writing. It is taken once for an archive, so that a task that is run again writes the same bytes."""
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page {page_id}' if page_id is not None else f'url {url}')}>"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(value: str) -> str:
    """A header's value on one line: white space and control characters are percent-encoded."""
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, html: str, date: str, refers_to: int | None = None, digest: str | None = None, size: int | None = None, sha256: str | None = None, refers_url: str | None = None, refers_date: str | None = None) -> str:
    """One record as text, without the two line ends that close it. With ``refers_to`` a revisit, whose block is empty.

    Digests and a size that are known are taken as they are.
    """
    revisit = refers_to is not None
    if digest is None or sha256 is None and not revisit:
        payload = html.encode("utf-8", "surrogatepass")
        digest, size, sha256 = payload_digest(payload), len(payload), hashlib.sha256(payload).hexdigest()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, url)}",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {_uri(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([] if revisit else [f"WARC-Block-Digest: sha256:{sha256}"]),
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, None)}", f"WARC-Refers-To-Page: {refers_to}"] if revisit else []),
        *([f"WARC-Refers-To-Target-URI: {_uri(refers_url)}"] if revisit and refers_url is not None else []),
        *([f"WARC-Refers-To-Date: {refers_date}"] if revisit and refers_date is not None else []),
        *([f"WARC-Page: {page_id}"] if page_id is not None else []),
        f"WARC-Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {0 if revisit else size}",
    ]
    return END.join(lines) + END + END + ("" if revisit else html)


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a file."""
    at = 0
    while data.startswith(b"WARC/", at):
        end = data.index(b"\r\n\r\n", at)
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:end].decode("utf-8", "replace").split(END)[1:])}
        size = int(headers["content-length"])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def write_archives(lines: DataFrame, path: str, longest: int = 0) -> None:
    """Writes the column ``record`` as gzipped archives below ``path``, which every executor must reach.

    ``longest``: bytes of the longest payload, by which the records of a file are bounded.
    """
    most = max(1, min(RECORDS_PER_FILE, BYTES_PER_FILE // max(1, longest)))
    lines.select("record").write.option("lineSep", END + END).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", most).text(path)


COLUMNS = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, sha256 string, html string, date string"


def read_archives(spark: SparkSession, path: str, hashed: bool = True) -> DataFrame:
    """COLUMNS of all records below ``path``.

    With ``hashed``, or where its headers have no block digest, a response's digests and length are computed again from its
    payload; else, and for revisits, they are those of the headers. The sha256 of a revisit is null.
    """

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gzip

        names = [c.split()[0] for c in COLUMNS.split(", ")]
        whole = lambda v: None if v is None else int(v)
        for frame in frames:
            for content in frame["content"]:
                rows, size = [], 0
                for h, block in records(gzip.decompress(content)):
                    revisit = h["warc-type"] == "revisit"
                    again = not revisit and (hashed or "warc-block-digest" not in h)
                    rows.append((whole(h.get("warc-page")), h.get("warc-target-uri"), h["warc-type"], payload_digest(block) if again else h["warc-payload-digest"].removeprefix("sha1:"), len(block) if again else int(h["warc-payload-length"]), whole(h.get("warc-refers-to-page")), None if revisit else hashlib.sha256(block).hexdigest() if again else h["warc-block-digest"].removeprefix("sha256:"), None if revisit else block.decode("utf-8", "surrogatepass"), h.get("warc-date")))
                    size += len(block)
                    if len(rows) == 500 or size > 16 << 20:
                        yield _typed(rows, names)
                        rows, size = [], 0
                if rows:
                    yield _typed(rows, names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInPandas(batches, COLUMNS)


def _typed(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({c: "Int64" for c in ("page_id", "payload_bytes", "refers_to")})


def _as_records(rows: DataFrame, date: str) -> DataFrame:
    fields = ["page_id", "url", "html", "refers_to", "payload_digest", "payload_bytes", "sha256", "refers_url", "refers_date"]

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = lambda v: None if pd.isna(v) else v
        for frame in frames:
            columns = [frame[c].astype("Int64") if c in ("page_id", "refers_to", "payload_bytes") else frame[c] for c in fields]
            yield pd.DataFrame({"record": [record(none(i), none(u), h, date, *map(none, known)) for i, u, h, *known in zip(*columns, strict=True)]})

    return rows.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), *fields[3:]).mapInPandas(batches, "record string")


def resolve(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, payload_digest, sha256, payload_bytes, and of revisits refers_to, refers_url and refers_date, of each record with a page id."""
    keyed = headers.where("page_id IS NOT NULL").select("page_id", "payload_digest", "sha256", "payload_bytes", F.struct("page_id", "url", "date").alias("own"))
    firsts = keyed.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "sha256").agg(F.min("own").alias("first"), F.count("*").alias("records")).where("records > 1").drop("records")
    other = F.col("first.page_id") != F.col("page_id")
    return keyed.join(firsts, ["payload_digest", "sha256"], "left").select("page_id", "payload_digest", "sha256", "payload_bytes", *(F.when(other, F.col("first")[c]).alias(n) for c, n in (("page_id", "refers_to"), ("url", "refers_url"), ("date", "refers_date"))))


def deduplicate(spark: SparkSession, source: str, target: str, least_bytes: int = 0, longest: int = 0) -> None:
    """Reads the archives below ``source`` and writes them to ``target`` with revisits for repeated payloads.

    A revisit is joined to the records by page and both digests, as a page may have been fetched twice with other payloads.
    """
    copies = written(resolve(read_archives(spark, source), least_bytes).where("refers_to IS NOT NULL").select("page_id", "payload_digest", "refers_to", "refers_url", "refers_date", "sha256").dropDuplicates(["page_id", "payload_digest", "sha256"]))
    if copies.count() <= BROADCAST_REVISITS:
        copies = F.broadcast(copies)
    read = read_archives(spark, source, hashed=False).drop("refers_to")
    marked = read.join(copies, ["page_id", "payload_digest", "sha256"], "left").withColumn("html", F.when(F.col("refers_to").isNull(), F.col("html")))
    write_archives(_as_records(marked, now()), target, longest)


def warc_dedup(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` below ``path``/raw, the deduplicated archives below ``path``/dedup, and reads these back.

    One row per row of ``pages``: page_id, payload_bytes, payload_digest, record_type, refers_to. The payload is the html in
    UTF-8, null as empty. Payloads below ``least_bytes`` are all responses. Rows with a null id are always responses; a
    repeated row is written each time, as its first occurrence would be. Empty table: no rows. Null urls have no
    WARC-Target-URI. Other columns are ignored, whatever their names.
    """
    spark = pages.sparkSession
    none = lambda t: F.lit(None).cast(t)
    later = {"refers_to": "long", "payload_digest": "string", "payload_bytes": "long", "sha256": "string", "refers_url": "string", "refers_date": "string"}
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), *(none(t).alias(c) for c, t in later.items()))
    longest = rows.agg(F.max(F.octet_length("html"))).first()[0] or 0
    write_archives(_as_records(rows, now()), f"{path}/raw", longest)
    deduplicate(spark, f"{path}/raw", f"{path}/dedup", least_bytes, longest)
    return read_archives(spark, f"{path}/dedup", hashed=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``pages``, with archives in the shared scratch folder."""
    return warc_dedup(table(spark, sf_dir, "pages"), f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}")


ORACLE_SQL = """
WITH hashed AS (SELECT page_id, coalesce(html, '') AS p, sha1(coalesce(html, '')) AS h FROM pages)
SELECT page_id, octet_length(encode(p)) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(h, (1 + 5 * (i // 4))::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = min(page_id) OVER same THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> min(page_id) OVER same THEN min(page_id) OVER same END AS refers_to
FROM hashed WINDOW same AS (PARTITION BY p)
"""
