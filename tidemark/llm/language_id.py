"""Language identification by nearest centroids over normalised TF-IDF vectors of hashed byte n-grams.

A bounded sample of labelled texts is turned into vectors by Spark; per language these are clustered into several centroids
(spherical k-means), since texts of one language may be of unlike kinds. A text gets the language of the centroid with the
largest cosine. It is rejected when that centroid is farther away than nearly all sample texts of its length were from theirs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import table

#: Dimensions of a vector; n-grams of one to three bytes are hashed into them.
DIMENSIONS = 4096
#: The sample has at most so many texts of a language, and some so many in all; every language has LEAST at least if there are
#: as many. All labels are learned, so that the model grows with their number (ISO 639 has 8,000), not with the rows.
PER_LANGUAGE, SAMPLE, LEAST = 500, 4000, 5
CLUSTERS = 3
#: A centroid's reach: this quantile of its sample texts' distances, times this factor. Shorter texts lie farther away from
#: all centroids; their reach is measured on the beginnings of the sample texts, of so many characters, for texts of up to so many.
REACH_QUANTILE, REACH_FACTOR = 0.995, 1.15
BEGINNINGS = (20, 40, 80, 160, 320)
UNKNOWN = "und"

_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def counts(text: str) -> np.ndarray:
    """Hashed n-gram counts of a whole text; letters only, runs of anything else are one space."""
    kept = b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split())
    x = np.frombuffer(b" " + kept + b" ", dtype=np.uint8).astype(np.int32)
    two = x[:-1] * 257 + x[1:]
    three = two[:-1] * 263 + x[2:]
    return sum(np.bincount((grams * odd >> shift) & (DIMENSIONS - 1), minlength=DIMENSIONS) for grams, odd, shift in ((x, 1, 0), (two, 40503, 7), (three, 40507, 9)))


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    centroids: np.ndarray  # one row each, of length 1
    languages: list[str]  # of each centroid
    reach: np.ndarray  # largest distance at which a centroid still takes a text that is longer than the last beginning
    short_reach: np.ndarray  # largest distance for texts of up to each number of n-grams in short_sizes
    short_sizes: np.ndarray

    def vectors(self, counted: np.ndarray) -> np.ndarray:
        v = np.log1p(counted).astype(np.float32) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def nearest(self, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and cosine of each row's nearest centroid."""
        cosine = self.vectors(counted) @ self.centroids.T
        best = cosine.argmax(axis=1)
        return best, np.clip(cosine[np.arange(len(best)), best], 0, 1)

    def rejected(self, counted: np.ndarray, best: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        """Whether each row is farther from its nearest centroid than texts of its length are."""
        size = np.searchsorted(self.short_sizes, counted.sum(axis=1))
        short = np.append(self.short_reach, 0)[size]
        return 1 - cosine > np.where(size < len(self.short_sizes), np.maximum(short, self.reach[best]), self.reach[best])


def clusters(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """At most ``k`` centroids by spherical k-means; starts from the vectors farthest from those taken."""
    picked = [int((vectors @ vectors.sum(axis=0)).argmax())]
    while len(picked) < min(k, len(vectors)):
        picked.append(int((vectors @ vectors[picked].T).max(axis=1).argmin()))
    centroids = vectors[picked]
    for _ in range(rounds):
        own = (vectors @ centroids.T).argmax(axis=1)
        sums = np.stack([vectors[own == i].sum(axis=0) for i in range(len(centroids))])
        sizes = np.bincount(own, minlength=len(sums))
        centroids = sums[sizes >= min(sizes.max(), max(3, len(vectors) // 50))]  # a stray text is no kind of its own
        centroids = centroids / np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
    return centroids


def held_out(id_col: str) -> Column:
    """The fold that is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Learns from a sample of the labelled rows outside the held-out fold; None if there is none.

    The sample takes rows by the hash of their ids: of each of k languages at most PER_LANGUAGE, and no more than SAMPLE / k or
    LEAST, whichever is more. Rows with null id, null text or null language, and texts without a letter, are not learned from.
    """
    labelled = docs.where(~held_out(id_col)).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    each = min(PER_LANGUAGE, max(LEAST, SAMPLE // len(sizes)))
    # By their number alone, some more than needed, as some have no letter; ten more, as few may fall far short of the mean.
    below = labelled.sparkSession.createDataFrame([(lang, int(min(1.0, (1.3 * each + 10) / n) * (1 << 30))) for lang, n in sizes.items()], "lang string, below long")
    picked = labelled.withColumn("place", order).join(F.broadcast(below), "lang").where("place < below").where(F.col("text").rlike(r"\p{L}"))

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "lang": frame["lang"], "place": frame["place"], "counts": [np.minimum(counts(t), 65535).astype("<u2").tobytes() for t in frame["text"]], "beginning": [t.strip()[: BEGINNINGS[-1]] for t in frame["text"]]})

    sample = picked.select("doc_id", "lang", "place", "text").mapInPandas(counted, "doc_id long, lang string, place long, counts binary, beginning string").toPandas()
    if sample.empty:
        return None
    sample = sample.sort_values(["lang", "place", "doc_id"]).groupby("lang").head(each)
    matrix = np.stack([np.frombuffer(b, dtype="<u2") for b in sample["counts"]])
    idf = np.log((1 + len(matrix)) / (1 + (matrix > 0).sum(axis=0))).astype(np.float32) + 1
    blank = Model(idf, np.zeros((0, DIMENSIONS), np.float32), [], np.zeros(0), np.zeros(0), np.zeros(0))
    vectors, labels = blank.vectors(matrix), sample["lang"].to_numpy()
    parts = [(lang, clusters(vectors[labels == lang], CLUSTERS)) for lang in sorted(set(labels))]
    centroids = np.concatenate([c for _, c in parts])
    languages = [lang for lang, c in parts for _ in c]
    cosine = vectors @ centroids.T
    best = cosine.argmax(axis=1)
    distance = 1 - cosine[np.arange(len(best)), best]
    short_reach, short_sizes = [], []
    for length in BEGINNINGS:
        far, sizes_of = [], []
        for at in range(0, len(sample), 200):  # the driver holds few vectors of beginnings at a time
            cut = np.stack([counts(t[:length]) for t in sample["beginning"].iloc[at : at + 200]]).astype("<u2")
            far.append(1 - (blank.vectors(cut) @ centroids.T).max(axis=1))
            sizes_of.append(cut.sum(axis=1))
        far, sizes_of = np.concatenate(far), np.concatenate(sizes_of)
        if (known := sizes_of > 3).any():
            short_reach.append(np.quantile(far[known], REACH_QUANTILE))
            short_sizes.append(np.quantile(sizes_of[known], 0.5))
    by_size = np.argsort(short_sizes, kind="stable")
    long = matrix.sum(axis=1) > max(short_sizes, default=0)
    everywhere = np.quantile(distance[long] if long.any() else distance, REACH_QUANTILE)
    reach = np.array([np.quantile(d, REACH_QUANTILE) if len(d := distance[(best == i) & long]) >= 20 else everywhere for i in range(len(centroids))])
    # A shorter text's reach is no smaller than a longer one's.
    short_reach = np.maximum.accumulate(np.array(short_reach)[by_size][::-1])[::-1]
    return Model(idf, centroids, languages, np.minimum(1.0, REACH_FACTOR * reach), np.minimum(1.0, REACH_FACTOR * short_reach), np.array(short_sizes)[by_size])


def predicted(model: Model | None, text: Column) -> Column:
    """Struct of lang_pred, score, distance and rejected of the column ``text``; a vectorised function of whole texts.

    ``und``, score 0 and rejected false for null texts, texts without a letter, and all texts if nothing was learned.
    """

    @F.pandas_udf("lang_pred string, score double, distance double, rejected boolean")
    def of(texts: pd.Series) -> pd.DataFrame:
        n = len(texts)
        lang, score, rejected = np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n, bool)
        known = np.flatnonzero(texts.notna()) if model is not None else np.zeros(0, int)
        for at in range(0, len(known), 500):
            rows = known[at : at + 500]
            counted = np.stack([counts(t) for t in texts.iloc[rows]])
            best, cosine = model.nearest(counted)
            lang[rows] = np.array(model.languages, object)[best]
            score[rows] = cosine
            rejected[rows] = model.rejected(counted, best, cosine)
        return pd.DataFrame({"lang_pred": lang, "score": score, "distance": 1 - score, "rejected": rejected})

    return of(F.when(text.rlike(r"\p{L}"), text))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score (cosine of the nearest centroid), distance, rejected.

    Predictions see whole texts and nothing else. Null ids stay null and count as not held out, but are not learned from;
    repeated rows are each predicted; an empty table gives no rows; other columns are ignored, whatever their names. Of
    equally near centroids the first by language wins.
    """
    model = train(docs, id_col, text_col, lang_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), predicted(model, F.col(text_col)).alias("p")).select("doc_id", "held_out", "p.*")


def drop_rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns as they were, that a model of their own labels takes for a language that it knows.

    Rejected are texts far from every centroid, and null texts and texts without a letter. With nothing learned, none is.
    """
    model = train(docs, id_col, text_col, lang_col)
    if model is None:
        return docs
    p = predicted(model, F.col(text_col))
    return docs.where(~p["rejected"] & (p["lang_pred"] != UNKNOWN))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``."""
    return language_id(table(spark, sf_dir, "documents"))
