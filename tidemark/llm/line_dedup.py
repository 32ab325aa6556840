"""Near-duplicate line removal by a deletion-neighbourhood join, in DataFrame functions only.

Lines are equal when identical after trimming; of equal lines the earliest occurrence (by doc_id, then line number) stays.
Two different lines are near when one edit (a unit put in, taken out or replaced) turns one into the other. The bound is one
edit in ten units at least: the units are words where both lines have ``UNITS`` words or more, else characters, and lines of
fewer than ``UNITS`` characters are compared exactly. A line goes when an earlier line is near to it, whether or not that one stays.

1. Occurrences are grouped by a 128-bit hash of the line (with partial sums in each task): the earliest one stays.
2. A line within one edit of another shares the units before or after its middle with it. Which halves it shares, and with
   lines of which length, tells at which places an edit may lie; lines that share no half need no variants. This filter is exact.
3. The rest emits its deletion variants, one hashed key for each such unit left out: with the place of the unit (to be joined with
   another line that has another unit there) and without it (to be joined with the whole of a line that lacks the unit).
   The hashes are sums of hashes of the units with their places, so that another order of units is another key.
   Each line meets the earliest line of each key only, so that a key with n lines makes n pairs, not n * n: all lines
   of a key with a place are near to each other, and a key without one joins longer lines with one shorter line.
4. The edit distance of each pair is verified on the units themselves.
5. Documents are joined with the places of the lines that they keep. Texts are shuffled twice, one after the other: for the
   lines that step 3 asks for, and for the result; all else that is shuffled are hashes and places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import removed, written
from tidemark.sources import table

#: Lines of so many words or more are rows of words, with fewer rows of characters, of which they need as many to be near to another.
UNITS = 10
#: Sums of hashes are taken modulo this prime, 2^61 - 1, so that none overflows a long.
PRIME = (1 << 61) - 1
WORD, CHARACTER = 0, 1
#: How a line shares a half: with another of its length (EVEN), as the shorter or as the longer of a pair. Bits of a mask.
EVEN, SHORTER, LONGER = 1, 2, 4


def _residue(*columns) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(PRIME))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda total, x: F.pmod(total + x, F.lit(PRIME)))


def _words(line) -> Column:
    return F.filter(F.split(line, r"\s+"), lambda w: w != "")


def _units(line, kind: int) -> Column:
    return _words(line) if kind == WORD else F.split(line, "")


def _kinds(line: Column, words: Column) -> list[tuple[int, Column]]:
    """Both kinds, and whether a line takes part in them. A line of just UNITS words meets longer ones by words, shorter ones by characters."""
    return [(WORD, F.size(words) >= UNITS), (CHARACTER, (F.size(words) <= UNITS) & (F.length(line) >= UNITS))]


def _half_keys(units: Column, kind: int) -> list[Column]:
    """Structs of key, kind, part and longer: the units before (part 0) and after (1) the middle, for this line as the longer or not."""
    n, keys = F.size(units), []
    for longer in (False, True):
        s = n - 1 if longer else n  # units of the shorter line of a pair
        half = F.floor(s / 2).cast("int")
        for part, cut in ((0, F.slice(units, F.lit(1), half)), (1, F.slice(units, n - (s - half) + 1, s - half))):
            keys.append(F.struct(F.xxhash64(F.lit(2 * kind + part), s, cut).alias("key"), F.lit(8 * (2 * kind + part) + longer).cast("byte").alias("code")))
    return keys


def _let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` evaluated once, not once for each element that a lambda in it goes over."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _running_sums(values: Column) -> Column:
    """Sum of all values before each place, and of all, modulo PRIME: by blocks of the square root of their number."""
    n = F.size(values)

    def by_place(width: Column, before: Column) -> Column:
        block = lambda i: F.floor(i / width).cast("int")
        return F.transform(F.sequence(F.lit(0), n), lambda i: F.pmod(F.get(before, block(i)) + _sum(F.slice(values, block(i) * width + 1, i - block(i) * width)), F.lit(PRIME)))

    def by_block(width: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor(n / width).cast("int"))
        sums = F.transform(starts, lambda j: _sum(F.slice(values, j * width + 1, width)))
        return _let(sums, lambda x: _let(F.transform(starts, lambda j: _sum(F.slice(x, F.lit(1), j))), lambda before: by_place(width, before)))

    return _let(F.greatest(F.lit(1), F.floor(F.sqrt(n)).cast("int")), by_block)


def _variant_keys(lines: DataFrame) -> DataFrame:
    """doc_id, pos, kind, role, key of each deletion variant that may meet another. role: 0 with a place, 1 longer line, 2 whole line.

    ``lines``: doc_id, pos, kind, units, before and after (masks of how the half is shared).
    """
    shares = lambda part, how: F.col(part).bitwiseAND(F.lit(how).cast("byte")) > 0
    as_longer = shares("before", LONGER) | shares("after", LONGER)
    placed = lines.select("doc_id", "pos", "kind", "before", "after", F.size("units").alias("n"), F.transform("units", lambda u, i: _residue(u, i)).alias("placed"), F.when(as_longer, F.transform("units", lambda u, i: _residue(u, i - 1))).alias("shifted"))
    placed = placed.withColumns({"total": _sum(F.col("placed")), "sums": F.when(as_longer, _running_sums(F.col("placed"))), "shifted_sums": F.when(as_longer, _running_sums(F.col("shifted")))})
    n, total = F.col("n"), F.col("total")
    half, short_half = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    # What lies beyond a shared half may differ: its places, from 0.
    places = lambda how, low, high: F.when(shares("before", how) | shares("after", how), F.sequence(F.when(shares("after", how), F.lit(0)).otherwise(low), F.when(shares("before", how), n - 1).otherwise(high))).otherwise(F.array().cast("array<int>"))
    even, longer = places(EVEN, half, half - 1), places(LONGER, short_half, short_half)
    row = lambda role, key: F.struct(F.lit(role).cast("byte").alias("role"), key.alias("key"))
    mod = lambda x: F.pmod(x, F.lit(PRIME))
    left_out = F.array_distinct(F.transform(longer, lambda i: mod(F.get("sums", i) + F.get("shifted_sums", n) - F.get("shifted_sums", i + 1))))
    rows = F.concat(
        F.transform(even, lambda i: row(0, F.xxhash64(F.lit("placed"), "kind", n, i, mod(total - F.get("placed", i))))),
        F.transform(left_out, lambda x: row(1, F.xxhash64(F.lit("whole"), "kind", n - 1, x))),
        F.when(shares("before", SHORTER) | shares("after", SHORTER), F.array(row(2, F.xxhash64(F.lit("whole"), "kind", n, total)))).otherwise(F.array()),
    )
    return placed.select("doc_id", "pos", "kind", F.inline(rows))


def _within_one_edit(a: Column, b: Column) -> Column:
    """Whether at most one unit differs, is put in or is taken out."""

    def without(longer, shorter):
        at = F.array_position(F.zip_with(longer, shorter, lambda x, y: ~x.eqNullSafe(y)), True).cast("int")
        return F.concat(F.slice(longer, F.lit(1), at - 1), F.slice(longer, at + 1, F.size(longer))) == shorter

    differ = F.size(F.filter(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda x: x))
    return F.when(F.size(a) == F.size(b), differ <= 1).when(F.size(a) == F.size(b) + 1, without(a, b)).when(F.size(b) == F.size(a) + 1, without(b, a)).otherwise(False)


def _asked(firsts: DataFrame) -> DataFrame:
    """doc_id, lines (pos, kind, before, after) of the lines that share a half with another line that may be near."""
    halves = firsts.select("doc_id", "pos", F.inline("halves"))
    longer = F.col("code").bitwiseAND(1) == 1
    shared = halves.groupBy("key").agg(F.count(F.when(longer, 1)).alias("longer"), F.count(F.when(~longer, 1)).alias("others")).where("longer + others > 1 AND others > 0")
    how = F.when(longer, F.lit(LONGER)).otherwise(F.when(F.col("others") > 1, F.lit(EVEN)).otherwise(F.lit(0)) + F.when(F.col("longer") > 0, F.lit(SHORTER)).otherwise(F.lit(0)))
    met = halves.join(shared, "key").select("doc_id", "pos", F.shiftright("code", 4).alias("kind"), F.shiftright("code", 3).bitwiseAND(1).alias("part"), how.alias("how"))
    mask = lambda part: F.coalesce(F.bit_or(F.when(F.col("part") == part, F.col("how"))), F.lit(0)).cast("byte").alias("after" if part else "before")
    by_line = met.groupBy("doc_id", "pos", "kind").agg(mask(0), mask(1))
    return by_line.groupBy("doc_id").agg(F.collect_list(F.struct("pos", F.col("kind").cast("byte").alias("kind"), "before", "after")).alias("asked"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_kept, n_near, clean_text; with ``carry``, these columns as a struct ``row``.

    Lines end at newlines. Blank lines are kept and compare with nothing. Null text: no lines, null clean_text; empty text:
    one blank line. Very long texts and lines are taken whole. Rows with a null id keep all their lines and drop no others. Rows
    that share an id count as one document whose line numbers coincide. n_near counts the lines that went for a line one edit
    away, copies of equal lines not included. Empty table: no rows. Other columns are ignored, whatever their names.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in carry or [id_col]))
    docs = docs.select(row.alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    known = docs.where("doc_id IS NOT NULL")
    lines = known.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", F.trim("line")).where("line <> ''").withColumn("words", _words(F.col("line")))

    spot = F.struct("doc_id", "pos")
    line, words = F.col("line"), F.col("words")
    no_halves = F.array().cast("array<struct<key:bigint,code:tinyint>>")
    halves = F.concat(*(F.when(has, F.array(*_half_keys(words if kind == WORD else _units(line, kind), kind))).otherwise(no_halves) for kind, has in _kinds(line, words)))
    firsts = written(
        lines.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"), spot.alias("spot"), halves.alias("halves"))
        .groupBy("h1", "h2")
        .agg(F.min("spot").alias("spot"), F.any_value("halves").alias("halves"))
        .select("spot.doc_id", "spot.pos", "halves")
    )

    asked = known.select("doc_id", "text").join(_asked(firsts), "doc_id").withColumn("lines", F.split("text", "\n"))
    with_line = lambda a: F.struct(a["pos"].alias("pos"), a["kind"].alias("kind"), a["before"].alias("before"), a["after"].alias("after"), F.trim(F.get("lines", a["pos"])).alias("line"))
    close = written(asked.select("doc_id", F.inline(F.transform("asked", with_line))).where("line IS NOT NULL"))

    units = lambda c: F.when(F.col("kind") == WORD, _units(c, WORD)).otherwise(_units(c, CHARACTER))
    keys = _variant_keys(close.withColumn("units", units("line")))
    earliest = lambda role: F.min(F.when(F.col("role") == role, spot))
    met = keys.groupBy("key").agg(F.count("*").alias("lines"), *(earliest(r).alias(f"first{r}") for r in range(3))).where("lines > 1").drop("lines")
    partner = F.when(F.col("role") == 0, F.col("first0")).when(F.col("role") == 1, F.col("first2")).otherwise(F.col("first1"))
    pairs = keys.join(met, "key").select("doc_id", "pos", "kind", partner.alias("partner")).where(F.col("partner") < spot).select("doc_id", "pos", "kind", F.col("partner.doc_id").alias("p_doc"), F.col("partner.pos").alias("p_pos")).distinct()
    own, other = close.select("doc_id", "pos", "kind", "line"), close.select(F.col("doc_id").alias("p_doc"), F.col("pos").alias("p_pos"), "kind", F.col("line").alias("p_line"))
    both = pairs.join(own, ["doc_id", "pos", "kind"]).join(other, ["p_doc", "p_pos", "kind"]).select("doc_id", "pos", units("line").alias("units"), units("p_line").alias("p_units"))
    near = written(both.where(_within_one_edit(F.col("units"), F.col("p_units"))).select("doc_id", "pos").distinct())
    removed(close)

    kept = firsts.select("doc_id", "pos").join(near.withColumn("near", F.lit(True)), ["doc_id", "pos"], "left").groupBy("doc_id").agg(F.collect_list(F.when(F.col("near").isNull(), F.col("pos"))).alias("at"), F.count("near").alias("n_near"))
    blank = lambda xs: F.filter(F.transform(xs, lambda x, i: F.when(F.trim(x) == "", i)), lambda i: i.isNotNull())
    # The text is shuffled as it came, and split thereafter.
    some = known.join(kept, "doc_id", "left").withColumn("lines", F.split("text", "\n")).select("row", "doc_id", "lines", F.array_sort(F.array_distinct(F.concat(F.coalesce("at", F.array().cast("array<int>")), blank(F.col("lines"))))).alias("at"), F.coalesce("n_near", F.lit(0)).alias("n_near"))
    some = some.select("row", "doc_id", F.size("lines").alias("size"), F.filter(F.transform("at", lambda p: F.get("lines", p)), lambda x: x.isNotNull()).alias("lines"), F.col("n_near"))
    some = some.select("row", "doc_id", F.greatest("size", F.lit(0)).cast("long").alias("n_lines"), F.greatest(F.size("lines"), F.lit(0)).cast("long").alias("n_kept"), F.col("n_near").cast("long").alias("n_near"), F.array_join("lines", "\n").alias("clean_text"))
    count = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    rest = docs.where("doc_id IS NULL").select("row", "doc_id", F.greatest(count, F.lit(0)).cast("long").alias("n_lines"), F.greatest(count, F.lit(0)).cast("long").alias("n_kept"), F.lit(0).cast("long").alias("n_near"), F.col("text").alias("clean_text"))
    out = some.unionByName(rest)
    return out if carry else out.drop("row")


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with the texts that line_dedup leaves, and their length in ``chars_col`` if there is such a column.

    A document with no line left but blank ones goes, if it had others. Other columns stay as they were; nulls, empty and
    long texts, repeated rows and empty tables are as line_dedup takes them.
    """
    rest = [c for c in docs.columns if c != text_col]
    cleaned = line_dedup(docs, id_col, text_col, carry=rest).where((F.col("n_kept") == F.col("n_lines")) | F.col("clean_text").rlike(r"\S"))
    new = {text_col: F.col("clean_text"), chars_col: F.length("clean_text").cast("long")}
    return cleaned.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``."""
    return line_dedup(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, u.pos AS pos, trim(u.line) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS xs FROM documents), LATERAL (SELECT unnest(xs) AS line, unnest(range(len(xs))) AS pos) u),
firsts AS (
  SELECT line, min({'d': doc_id, 'p': pos}) AS spot, list_filter(regexp_split_to_array(line, '\s+'), lambda w: w <> '') AS w
  FROM lines WHERE line <> '' GROUP BY line),
rows AS (
  SELECT spot, 'word' AS kind, w AS u, len(w) AS n FROM firsts WHERE len(w) >= 10
  UNION ALL SELECT spot, 'character', list_transform(range(1, length(line) + 1), lambda i: substr(line, i, 1)), length(line) FROM firsts WHERE len(w) <= 10 AND length(line) >= 10),
variants AS (
  SELECT spot, kind, n, i, array_to_string(u[:i] || u[i + 2:], chr(1)) AS v
  FROM rows, LATERAL (SELECT unnest(range(n)) AS i)),
wholes AS (SELECT spot, kind, n, array_to_string(u, chr(1)) AS v FROM rows),
replaced AS (SELECT kind, n, i, v, min(spot) AS first FROM variants GROUP BY kind, n, i, v),
near AS (
  SELECT a.spot FROM variants a JOIN replaced b ON a.kind = b.kind AND a.n = b.n AND a.i = b.i AND a.v = b.v WHERE b.first < a.spot
  UNION SELECT a.spot FROM variants a JOIN wholes b ON b.kind = a.kind AND b.n = a.n - 1 AND b.v = a.v WHERE b.spot < a.spot
  UNION SELECT b.spot FROM variants a JOIN wholes b ON b.kind = a.kind AND b.n = a.n - 1 AND b.v = a.v WHERE a.spot < b.spot),
marked AS (
  SELECT l.doc_id, l.pos, l.line = '' OR (f.spot IS NOT NULL AND x.spot IS NULL) AS stays, x.spot IS NOT NULL AS is_near
  FROM lines l LEFT JOIN firsts f ON f.line = l.line AND f.spot = {'d': l.doc_id, 'p': l.pos} LEFT JOIN near x ON x.spot = f.spot)
SELECT d.doc_id, count(m.pos) AS n_lines, count(*) FILTER (m.stays) AS n_kept, count(*) FILTER (m.is_near) AS n_near,
       CASE WHEN d.text IS NOT NULL THEN coalesce(string_agg(string_split(d.text, chr(10))[m.pos + 1], chr(10) ORDER BY m.pos) FILTER (m.stays), '') END AS clean_text
FROM documents d LEFT JOIN marked m ON m.doc_id = d.doc_id GROUP BY d.doc_id, d.text
"""
