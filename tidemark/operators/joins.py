"""Joins that are more than an equality: resolution by rules, intervals, marks, merges with a source's priority, overlaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.text import substring_pairs

def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key by ``order``, which should end with something unique: keep-first, or with descending order keep-last."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def lookup(left: DataFrame, right: DataFrame, on: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Left join with the first right row of each key, so that no left row is repeated."""
    return left.join(keep_one(right, on, order), list(on), "left")


def mark(left: DataFrame, right: DataFrame, on: Sequence[str], name: str = "matched") -> DataFrame:
    """``left`` with a flag, true where ``right`` has the key; nulls never match."""
    return left.join(right.select(*on).distinct().withColumn(name, F.lit(True)), list(on), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def resolve_keys(rows: DataFrame, raw: str, known: DataFrame, key: str, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """``rows`` with resolved_key and resolved_rule of the first rule whose candidate is a key of ``known``; else null and 'unmatched'.

    Candidates are exploded and joined by equality, so that there is one join however many rules there are.
    """
    tried = F.array(*(F.struct(F.lit(i).alias("at"), F.lit(n).alias("rule"), c.cast("string").alias("key")) for i, (n, c) in enumerate(rules)))
    distinct = rows.select(raw).distinct().select(raw, F.explode(tried).alias("t")).select(raw, "t.*")
    hits = distinct.join(known.select(F.col(key).cast("string").alias("key")).distinct(), "key").groupBy(raw).agg(F.min_by(F.struct("key", "rule"), "at").alias("hit"))
    return rows.join(hits, raw, "left").select(*rows.columns, F.col("hit.key").alias("resolved_key"), F.coalesce(F.col("hit.rule"), F.lit("unmatched")).alias("resolved_rule"))


def points_in_spans(points: DataFrame, at: str, spans: DataFrame, start: str, end: str, on: Sequence[str], width: int = 64) -> DataFrame:
    """Left join of points with the spans [start, end] that hold them, per key.

    Spans are cut at multiples of ``width`` and joined by equality on the piece, then by the ends: no nested loop. A span makes
    (end - start) / width + 1 rows.
    """
    cut = spans.where(F.col(end) >= F.col(start)).withColumn("_piece", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    p, s = points.withColumn("_piece", F.floor(F.col(at) / width)).alias("p"), cut.alias("s")
    same = F.col("p._piece") == F.col("s._piece")
    for k in on:
        same = same & (F.col(f"p.{k}") == F.col(f"s.{k}"))
    inside = F.col(f"p.{at}").between(F.col(f"s.{start}"), F.col(f"s.{end}"))
    return p.join(s, same & inside, "left").select(*(F.col(f"p.{c}") for c in points.columns), *(F.col(f"s.{c}") for c in cut.columns if c not in (*on, "_piece")))


def upsert(base: DataFrame, patch: DataFrame, keys: Sequence[str], better: Column | None = None) -> DataFrame:
    """Key-wise merge: patch rows replace base rows (where ``better``, a condition on b. and p. columns, holds), others are added.

    Adds the column action: kept, updated, skipped or inserted. Both sides need unique keys and the same columns.
    """
    b, p = base.withColumn("_in", F.lit(True)).alias("b"), patch.withColumn("_in", F.lit(True)).alias("p")
    same = [F.col(f"b.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys]
    on = same[0]
    for c in same[1:]:
        on = on & c
    both = F.col("b._in").isNotNull() & F.col("p._in").isNotNull()
    take = F.col("b._in").isNull() | (both & (F.coalesce(better, F.lit(False)) if better is not None else F.lit(True)))
    action = F.when(F.col("b._in").isNull(), "inserted").when(F.col("p._in").isNull(), "kept").when(take, "updated").otherwise("skipped")
    return b.join(p, on, "full").select(*(F.when(take, F.col(f"p.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in base.columns), action.alias("action"))


def by_priority(base: DataFrame, sources: Sequence[tuple[str, DataFrame, str]], on: Sequence[str], name: str) -> DataFrame:
    """``base`` with ``name`` from the first source that has a value, and name_source, which one that was.

    ``sources``: label, table with unique keys, column.
    """
    out, columns = base, []
    for i, (_, table, column) in enumerate(sources):
        out = out.join(table.select(*on, F.col(column).alias(f"_s{i}")), list(on), "left")
        columns.append(F.col(f"_s{i}"))
    source = F.coalesce(*(F.when(c.isNotNull(), F.lit(label)) for c, (label, _, _) in zip(columns, sources, strict=True)), F.lit("missing"))
    return out.select(*base.columns, F.coalesce(*columns).alias(name), source.alias(f"{name}_source"))


def overlapping_pairs(sets: DataFrame, key: str, members: str, group: Sequence[str] = ()) -> DataFrame:
    """left_id < right_id of sets that share a member, with how many they share. Joined on members; one row per pair and shared member is made."""
    x = sets.select(*group, F.col(key).alias("id"), F.explode(F.array_distinct(members)).alias("member"))
    a, b = x.withColumnRenamed("id", "left_id"), x.withColumnRenamed("id", "right_id")
    return a.join(b, [*group, "member"]).where("left_id < right_id").groupBy(*group, "left_id", "right_id").agg(F.count("*").alias("shared"))


def ordered_pairs(rows: DataFrame, key: str, group: Sequence[str]) -> DataFrame:
    """All pairs of one group with the smaller key first; for small groups (rows of one analysis)."""
    a, b = rows.select(*group, F.col(key).alias("left_id")), rows.select(*group, F.col(key).alias("right_id"))
    return a.join(b, list(group)).where("left_id < right_id")


def contains_lookup(rows: DataFrame, text: str, terms: DataFrame, term: str, values: Sequence[str]) -> DataFrame:
    """Left join with the first term (by its text) that occurs in ``text``; of rows of one term the smallest values."""
    known = terms.select(F.col(term).alias("_term"), *values).where("_term <> ''")
    hit = substring_pairs(rows.select(F.col(text).alias("_in")), "_in", known, "_term").join(known, "_term").groupBy("_in").agg(F.min(F.struct("_term", *values)).alias("_hit"))
    return rows.join(hit, F.col(text) == F.col("_in"), "left").select(*(rows[c] for c in rows.columns), F.col("_hit._term").alias("matched_term"), *(F.col(f"_hit.{v}").alias(v) for v in values))


def orphans(rows: DataFrame, key: str, parent: str) -> DataFrame:
    """Rows whose parent is given but is no row's key."""
    return rows.where(F.col(parent).isNotNull()).join(rows.select(F.col(key).alias(parent)).distinct(), parent, "left_anti").select(*rows.columns)


def new_rows(rows: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What an incremental load still has to add: rows whose key the target lacks, once each."""
    return keep_one(rows.join(target.select(*keys).distinct(), list(keys), "left_anti"), keys, [c for c in rows.columns if c not in keys] or list(keys))


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "place") -> DataFrame:
    """Adds each row's place (from 0) within its keys, by which another table numbered alike is joined side by side."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def side_by_side(left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: Sequence[Column | str], right_order: Sequence[Column | str]) -> DataFrame:
    """The n-th row of each key of one table beside the n-th of the other, with its place; what has no counterpart stays, with nulls."""
    return numbered(left, keys, left_order).join(numbered(right, keys, right_order), [*keys, "place"], "full")


def first_of_groups(groups: Sequence[DataFrame], keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Rows of several tables of the same columns, once per key: that of the first table that has it, there the first in order."""
    tagged = None
    for i, g in enumerate(groups):
        part = g.withColumn("group", F.lit(i))
        tagged = part if tagged is None else tagged.unionByName(part)
    return keep_one(tagged, keys, ["group", *order])


def predictions_with_labels(predictions: DataFrame, labels: DataFrame, key: str, prediction: str, label: str) -> DataFrame:
    """One row: how many have both, only a prediction, only a label, and how many of the first agree."""
    p, y = predictions.select(key, F.col(prediction).alias("_p")), labels.select(key, F.col(label).alias("_y"))
    both = p.join(y, key, "full")
    known, labelled = F.col("_p").isNotNull(), F.col("_y").isNotNull()
    return both.agg(F.count_if(known & labelled).alias("matched"), F.count_if(known & ~labelled).alias("unlabelled"), F.count_if(~known & labelled).alias("unpredicted"), F.count_if(F.col("_p") == F.col("_y")).alias("agreeing"))
