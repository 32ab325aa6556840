"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

1. One pass over the texts gives each document's set of word shingles as 64-bit hashes, and its sketch. C-MinHash (Li and
   Li, 2022) needs two permutations, not one for each coordinate: the first scatters the shingles over the ring of 32-bit
   numbers; coordinate k is the smallest value of the second permutation, circularly shifted by k.
2. Documents with equal sets are one class (by a 128-bit digest), however many there are; the smallest id stands for it.
3. Classes with an equal band of coordinates meet in a bucket. They are never paired all with all at once: each class is
   verified against the smallest one it meets; the links give components; what then shares a bucket but no component is verified
   against the buckets' first and last component, and at last, in the small buckets still split, all that is apart. What then
   is apart in larger buckets meets by its rarest shingles (prefix filter): two similar sets have one of them in common, while
   a passage that many texts quote is among the rarest of none. Linked classes are thus found whole, copies cost one pair each,
   and no two classes of a bucket stay apart unless their sizes, bitmaps, rarest shingles or sets rule them out.
4. A pair is verified on its texts' full sets. Only classes that meet another are ever moved with their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.components import components
from tidemark.llm.shared import checkpointed, shuffles_removed, written
from tidemark.sources import table

WORDS, SIMILARITY = 5, 75
#: BANDS bands of ROWS coordinates: a pair at the threshold meets with a chance of 1 - (1 - 0.75^7)^60 > 0.9998, one that has a
#: fifth in common, as texts that quote one passage, with one of 0.0008.
BANDS, ROWS = 60, 7
#: Longs of a set's bitmap. Each place where two bitmaps differ stands for a shingle that only one of the sets has, which bounds
#: their similarity from above: pairs that cannot be similar enough are known before any text is moved.
BITMAP = 8
#: Buckets with at most so many classes may be verified all with all (what is apart); larger ones go on by their ends, and what
#: is then still apart by its rarest shingles.
WHOLE_BUCKET = 200

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ORDER = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165], np.uint64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for i, base in enumerate((_BASE, inverse)):
            x = np.full(2 * n, base, np.uint64)
            x[0] = 1
            _POWERS[i] = np.multiply.accumulate(x)
    return _POWERS


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; fewer words than a shingle has are one shingle; no words, none."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_LOWER), np.uint8)
    inside = ~_SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(b) + 1)
    sums = np.concatenate(([np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)], dtype=np.uint64)))
    w = _mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    if len(w) < words:
        return _mix64(np.array([np.sum(w * power[1 : len(w) + 1] if len(power) > len(w) else _powers(len(w) + 1)[0][1 : len(w) + 1], dtype=np.uint64) + np.uint64(len(w))]))
    order = _ORDER if words <= len(_ORDER) else _powers(words + 1)[0][1:]
    total = np.zeros(len(w) - words + 1, np.uint64)
    for k in range(words):
        total += w[k : len(w) - words + 1 + k] * order[k]
    return np.unique(_mix64(total))


def signature(hashes: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """C-MinHash coordinates. Both permutations are bijective mixers: of 64 bits (in the hashes), and below of the 32-bit ring."""
    shift = np.arange(coordinates, dtype=np.uint32)[:, None]
    least = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    ring = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(ring), 1024):
        y = ring[None, at : at + 1024] + shift
        y ^= y >> np.uint32(16)
        y *= np.uint32(0x85EBCA6B)
        y ^= y >> np.uint32(13)
        y *= np.uint32(0xC2B2AE35)
        y ^= y >> np.uint32(16)
        np.minimum(least, y.min(axis=1), out=least)
    return least


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """64 * BITMAP bits, each set if some hash falls on it."""
    bits = np.zeros(64 * BITMAP, np.uint8)
    bits[(hashes % np.uint64(64 * BITMAP)).astype(np.int64)] = 1
    return np.packbits(bits).view("<i8")


def _may_be_similar(n_a: str, bits_a: str, n_b: str, bits_b: str, similarity: int) -> Column:
    """False only where the sizes or the bitmaps rule the similarity out; an exact filter.

    With s per cent of the union in common, at most (100 - s) / (100 + s) of both sizes' sum is in one set only.
    """
    differ = sum((F.bit_count(F.get(bits_a, i).bitwiseXOR(F.get(bits_b, i))) for i in range(BITMAP)), F.lit(0))
    a, b = F.col(n_a), F.col(n_b)
    return (100 * F.least(a, b) >= similarity * F.greatest(a, b)) & ((100 + similarity) * differ <= (100 - similarity) * (a + b))


def _sketches(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    def sketch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc_id, text in zip(frame["doc_id"].astype("Int64").tolist(), frame["text"], strict=True):
                s = shingles(text, words)
                h1, h2 = (int(x) for x in np.array([np.sum(_mix64(s + np.uint64(1)), dtype=np.uint64), np.sum(_mix64(s ^ _BASE), dtype=np.uint64)]).view(np.int64))
                keys = []
                if len(s) and doc_id is not pd.NA:
                    by_band = signature(s, bands * rows).astype(np.uint64).reshape(bands, rows)
                    band = np.arange(bands, dtype=np.uint64)
                    for k in range(rows):
                        band = _mix64(band * _BASE + by_band[:, k])
                    keys = band.view(np.int64)
                out.append((doc_id, len(s), h1, h2, keys, bitmap(s)))
            yield pd.DataFrame(out, columns=["doc_id", "n", "h1", "h2", "bands", "bits"]).astype({"doc_id": "Int64"})

    return docs.mapInPandas(sketch, "doc_id long, n long, h1 long, h2 long, bands array<long>, bits array<long>")


def _verified(pairs: DataFrame, bodies: DataFrame, words: int, similarity: int) -> DataFrame:
    """a, b of the pairs whose sets have ``similarity`` per cent of their union in common."""

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, last_set = None, None
        for frame in frames:
            good = []
            for a, b, text_a, text_b in frame[["a", "b", "text_a", "text_b"]].itertuples(index=False):
                if text_b != last:
                    last, last_set = text_b, shingles(text_b, words)
                own = shingles(text_a, words)
                common = len(np.intersect1d(own, last_set, assume_unique=True))
                if 100 * common >= similarity * (len(own) + len(last_set) - common):
                    good.append((a, b))
            yield pd.DataFrame(good, columns=["a", "b"], dtype="int64")

    both = pairs.join(bodies.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(bodies.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInPandas(verify, "a long, b long")


def _rare_pairs(apart: DataFrame, bodies: DataFrame, words: int, similarity: int) -> DataFrame:
    """rep, rep_b of all sets of ``apart`` (rep, component) that may be similar and are of two components; an exact filter.

    Shingles are put in one order, those of the fewest sets first. Sets of n and m shingles that are similar have at least
    c = s / (100 + s) * (n + m) in common, and the first that they have in common, at i in one and j in the other, leaves room
    for them: min(n - i, m - j) >= c. It thus lies in the first n - c + 1 of each, which holds for the smaller of both with
    m = n, for the larger one with m at the least size that may be similar.
    """

    def ordered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for rep, component, text in frame[["rep", "component", "text"]].itertuples(index=False):
                s = shingles(text, words)
                out.append((rep, component, int(np.sum(_mix64(s + np.uint64(1)), dtype=np.uint64).view(np.int64)), len(s), s.view(np.int64)))
            yield pd.DataFrame(out, columns=["rep", "component", "digest", "n", "shingles"])

    sets = apart.join(bodies.withColumnRenamed("doc_id", "rep"), "rep").select("rep", "component", "text").mapInPandas(ordered, "rep long, component long, digest long, n long, shingles array<long>")
    sets = written(sets.groupBy("rep", "component", "digest", "n").agg(F.any_value("shingles").alias("shingles")))
    each = sets.select("rep", "component", "digest", "n", F.explode("shingles").alias("shingle"))
    order = Window.partitionBy("rep", "digest", "n").orderBy("held", "shingle")
    placed = each.join(each.groupBy("shingle").agg(F.count("*").alias("held")), "shingle").withColumn("at", F.row_number().over(order) - 1)
    first = written(placed.where(100 * (F.col("n") - F.col("at")) >= similarity * F.col("n")).select("shingle", "rep", "component", "n", "at"))
    # Sets of one component needn't meet. Of each shingle, the component with the most sets is only met by the sets of others, so that
    # rows follow those others, not the square of a large group; a shingle that one component holds alone is met by none.
    by_component = first.groupBy("shingle", "component").agg(F.count("*").alias("sets"))
    most = by_component.groupBy("shingle").agg(F.max(F.struct("sets", "component")).alias("most"), F.count("*").alias("components")).where("components > 1").select("shingle", F.col("most.component").alias("largest"))
    shared = written(first.join(most, "shingle"))
    other = shared.select("shingle", *(F.col(c).alias(f"{c}_b") for c in ("rep", "component", "n", "at")))
    smaller = F.struct("n", "rep") < F.struct("n_b", "rep_b")
    n, at = F.when(smaller, F.col("n")).otherwise(F.col("n_b")), F.when(smaller, F.col("at")).otherwise(F.col("at_b"))
    room = (100 + similarity) * F.least(F.col("n") - F.col("at"), F.col("n_b") - F.col("at_b")) >= similarity * (F.col("n") + F.col("n_b"))
    sized = (100 * F.least("n", "n_b") >= similarity * F.greatest("n", "n_b")) & ((100 + similarity) * (n - at) >= 2 * similarity * n)
    met = shared.where("component <> largest").join(other, "shingle").where((F.col("component") != F.col("component_b")) & sized & room)
    return met.select("rep", "rep_b").distinct()


def _labels(docs: DataFrame, known: DataFrame, words: int, similarity: int, whole_bucket: int) -> DataFrame:
    """id, component of each class's representative but the smallest of its component. ``known``: the sketches of sets that are not empty."""
    classes = known.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"), F.any_value("bits").alias("bits"))

    members = classes.select(F.explode("bands").alias("key"), "rep", "n")
    shared = members.groupBy("key").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first < last")
    met = written(members.join(shared.select("key", "first"), "key"))
    bodies = written(docs.join(met.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"))

    first_pairs = met.where("rep > first").groupBy("rep").agg(F.min("first").alias("b")).select(F.col("rep").alias("a"), "b")
    bits = written(classes.select("rep", "n", "bits").join(met.select("rep").distinct(), "rep", "left_semi"))
    tested = checkpointed(first_pairs)
    labels = components(_verified(tested, bodies, words, similarity))
    as_edges = lambda known: known.select(F.col("id").alias("a"), F.col("component").alias("b"))
    turn = 1
    while True:
        turn += 1
        placed = met.select("key", "rep", "n").join(bits, ["rep", "n"]).join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        end = F.struct("component", "rep", "n", "bits")
        split = placed.groupBy("key").agg(F.min(end).alias("lo"), F.max(end).alias("hi"), F.count("*").alias("size")).where("lo.component < hi.component")
        apart = placed.join(split, "key")
        to_end = lambda e: apart.where(F.col("component") != F.col(f"{e}.component")).select("rep", "n", "bits", F.col(f"{e}.rep").alias("rep_b"), F.col(f"{e}.n").alias("n_b"), F.col(f"{e}.bits").alias("bits_b"))
        possible = _may_be_similar("n", "bits", "n_b", "bits_b", similarity)
        ends = to_end("lo").union(to_end("hi")).where(possible).select("rep", "rep_b")
        if turn > 2:
            few = apart.where(F.col("size") <= whole_bucket).select("key", "rep", "n", "bits", "component")
            other = few.select("key", F.col("rep").alias("rep_b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"), F.col("component").alias("component_b"))
            ends = ends.union(few.join(other, "key").where(F.col("component") < F.col("component_b")).where(possible).select("rep", "rep_b"))
        pairs = ends.select(F.greatest("rep", "rep_b").alias("a"), F.least("rep", "rep_b").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
        pairs = checkpointed(pairs)
        if pairs.isEmpty():
            if turn > 2:
                break
            continue
        tested = tested.union(pairs)
        labels = components(as_edges(labels).union(_verified(pairs, bodies, words, similarity)))

    large = checkpointed(apart.where(F.col("size") > whole_bucket).select("rep", "component").distinct())
    if not large.isEmpty():
        rare = _rare_pairs(large, bodies, words, similarity).join(bits, "rep").join(bits.select(F.col("rep").alias("rep_b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b")), "rep_b").where(possible)
        pairs = checkpointed(rare.select(F.greatest("rep", "rep_b").alias("a"), F.least("rep", "rep_b").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"))
        if not pairs.isEmpty():
            labels = components(as_edges(labels).union(_verified(pairs, bodies, words, similarity)))
    return labels


def minhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: int = SIMILARITY, bands: int = BANDS, rows: int = ROWS, whole_bucket: int = WHOLE_BUCKET) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest id that links reach), kept.

    Documents are linked when at least ``similarity`` per cent of the union of their shingle sets is common to both. Null texts
    and texts without words have empty sets and no links. Rows with a null id are linked with nothing, have a null
    component_id and are kept. Rows that share an id count as one document, with the links of each. Empty table: no rows.
    Other columns are ignored, whatever their names.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sketches = written(_sketches(docs, words, bands, rows))
    with shuffles_removed(docs.sparkSession):
        labels = _labels(docs, sketches.where("n > 0 AND doc_id IS NOT NULL"), words, similarity, whole_bucket)
    known = sketches.where("n > 0 AND doc_id IS NOT NULL")

    # Joined by one column more than grouped by: the join then has exchanges of its own, whose large partitions Spark may split.
    several = known.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.any_value("n").alias("n")).where("rep < last").select("h1", "h2", "n", "rep")
    out = sketches.select("doc_id", "n", "h1", "h2").join(several, ["h1", "h2", "n"], "left").withColumn("rep", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")))
    out = out.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component_id", F.coalesce("component", "rep", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they were, whose id is the smallest of its group of near-duplicates."""
    gone = minhash_dedup(docs, id_col, text_col).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["_gone"], "left_anti")


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``."""
    return minhash_dedup(table(spark, sf_dir, "documents"))
