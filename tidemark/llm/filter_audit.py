"""Filter interaction audit: what each filter of a chain removes, in every order, by potentials of the removal game.

The worth of a coalition of filters is the number of documents that fail at least one of them. Documents become one bit for each
filter that they fail; counts by part and bits, at most 2^k rows a part, hold all that any order can ask:

* the removal game v(S), and the same for documents with a label, are sums over the bits that meet S;
* a filter i after the filters S removes v(S + i) - v(S), whatever the order within S;
* the potential of Hart and Mas-Colell (1989), P(S) = (v(S) + sum of P(S - i) over i in S) / |S|, gives the Shapley value of i as
  P(all) - P(all - i). Times k! all potentials are whole numbers, and k! times the Shapley value is the sum over all orders.

Everything is a DataFrame function. Texts are read once; what is shuffled is a digest and a few numbers for each document, and
groups are summed within tasks before.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import written
from tidemark.sources import table

#: Fixed values of the query's contract: the five filters' limits.
LEAST_WORDS, DISTINCT_PER_CENT, CAPITALS_PER_CENT, MARKS = 200, 50, 2, "[#$%&*|]"
FILTERS = "ABCDE"


def text_failures(text: Column) -> dict[str, Column]:
    """Whether a text (not null) fails A: few words, B: few distinct words, C: many capitals, D: a mark."""
    words = F.array_remove(F.split(text, r"[ \t-\r]+"), "")
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < DISTINCT_PER_CENT * F.size(words).cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > CAPITALS_PER_CENT * F.char_length(text).cast("long"),
        "D": text.rlike(MARKS),
    }


def standard_failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: part, A to E (whether it fails), good, toxic.

    Null text counts as empty, null part as ''. E: some row of the table with a smaller id has the same text (by its SHA-256); rows
    that share an id are no copies of each other, and a null id is neither smaller nor larger than any. good and toxic: the
    id has a row in ``labels`` with quality 1, with toxic 1; ids without labels, and null ids, are neither.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    fails = text_failures(F.col("text"))
    own = own.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *(c.alias(name) for name, c in fails.items()))
    # Written once: the texts' facts are read by the search for the first of each text and by the joins.
    own = written(own)
    # The first of each text, by partial sums; it meets its own row by id and digest, so that no group of copies meets in a task.
    firsts = own.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    of_id = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = own.where("doc_id IS NOT NULL").join(firsts, ["doc_id", "digest"], "left").join(of_id, "doc_id", "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    known = known.select("part", "A", "B", "C", "D", (~flag(F.col("first"))).alias("E"), flag(F.col("good")).alias("good"), flag(F.col("toxic")).alias("toxic"))
    no = F.lit(False)
    return known.union(own.where("doc_id IS NULL").select("part", "A", "B", "C", "D", no, no, no))


def _potentials(worth: Column, k: int) -> Column:
    """k! times the potential of each coalition, by its bits; a coalition's parts have smaller numbers than itself."""

    def next_one(done: Column, s: Column) -> Column:
        inside = lambda i: s.bitwiseAND(F.lit(1 << i)) != 0
        parts = sum((F.when(inside(i), F.get(done, s - (1 << i))).otherwise(F.lit(0)) for i in range(k)), F.lit(0).cast("long"))
        size = sum((F.when(inside(i), 1).otherwise(0) for i in range(k)), F.lit(0))
        return F.concat(done, F.array(F.floor((math.factorial(k) * F.get(worth, s) + parts) / size).cast("long")))

    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << k) - 1)), F.array(F.lit(0).cast("long")), next_one)


def filter_audit(failures: DataFrame, filters: Sequence[str], losses: Mapping[str, str], part_col: str = "part") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, the ``losses``, shapley: a row per part, order and step.

    ``filters``: names, a letter each, of boolean columns of ``failures``; eight at most, as all orders are given. ``losses``: output
    column to the boolean column whose documents it counts among the removed. Null flags count as false. shapley is the sum over
    all orders of what the step's filter removes. A part without failures has zeros; an empty table gives no rows; repeated
    rows count each; other columns are ignored.
    """
    k, letters = len(filters), "".join(filters)
    if not 1 <= k <= 8 or len(letters) != k or len(set(letters)) != k:
        raise ValueError("one to eight filters of one letter each")
    everything = (1 << k) - 1
    bits = sum((F.when(F.col(f), 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0))
    counts = failures.groupBy(F.col(part_col).alias("part"), bits.alias("bits")).agg(F.count("*").alias("n"), *(F.count_if(F.col(c)).alias(f"_{i}") for i, c in enumerate(losses.values())))
    games = {"n": "n"} | {name: f"_{i}" for i, name in enumerate(losses)}
    # At most 2^k rows a part meet here.
    held = counts.groupBy("part").agg(F.collect_list(F.struct("bits", *games.values())).alias("held"), F.sum("n").alias("total"))

    def worth(column: str) -> Column:
        hit = lambda s: F.filter("held", lambda h: h["bits"].bitwiseAND(s) != 0)
        return F.transform(F.sequence(F.lit(0), F.lit(everything)), lambda s: F.aggregate(hit(s), F.lit(0).cast("long"), lambda a, h: a + h[column]))

    held = held.select("part", "total", *(worth(c).alias(c) for c in games.values()))
    held = held.select("*", _potentials(F.col("n"), k).alias("potential"))
    orders = F.array(*(F.lit("".join(o)) for o in itertools.permutations(letters)))
    rows = held.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    before = F.substring(F.col("filter_order"), F.lit(1), F.col("step") - 1)
    rows = rows.withColumn("before", sum((F.when(before.contains(f), 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0)))
    letter = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    rows = rows.withColumn("own", sum((F.when(letter == f, 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0)))
    at = lambda c, s: F.get(F.col(c), s)
    before, own = F.col("before"), F.col("own")
    removed = at("n", before + own) - at("n", before)
    return rows.select(
        "part", "filter_order", "step",
        (F.col("total") - at("n", before + own)).alias("kept"), removed.alias("removed"), (at("n", own) - removed).alias("redundant"),
        (at("n", F.lit(everything)) - at("n", everything - own)).alias("unique_fails"),
        *((at(c, before + own) - at(c, before)).alias(name) for name, c in games.items() if name != "n"),
        (at("potential", F.lit(everything)) - at("potential", everything - own)).alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five filters over all of ``documents``, by source."""
    failures = standard_failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return filter_audit(failures, list(FILTERS), {"good_lost": "good", "toxic_lost": "toxic"})


_ORDERS = ", ".join(f"('{''.join(o)}')" for o in itertools.permutations(FILTERS))
#: By the definition, without coalitions: each document against each order.
ORACLE_SQL = f"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
flags AS (
  SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
         100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM words),
marked AS (
  SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails,
         coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM flags LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)),
steps AS (
  SELECT o AS filter_order, s::INT AS step, substr(o, s, 1) AS letter, substr(o, 1, s - 1) AS before FROM (VALUES {_ORDERS}) AS t(o), range(1, 6) AS r(s)),
judged AS (
  SELECT part, filter_order, step, letter, good, toxic, fails, contains(fails, letter) AS own, translate(before, fails, '') <> before AS gone FROM marked, steps),
counted AS (
  SELECT part, filter_order, step, letter, count_if(NOT own AND NOT gone) AS kept, count_if(own AND NOT gone) AS removed, count_if(own AND gone) AS redundant,
         count_if(fails = letter) AS unique_fails, count_if(own AND NOT gone AND good) AS good_lost, count_if(own AND NOT gone AND toxic) AS toxic_lost
  FROM judged GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM counted
"""
