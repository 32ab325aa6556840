"""Evaluation metrics as expressions and aggregations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tolerance of relaxed accuracy, threshold of ANLS, answers that make a consensus.
TOLERANCE, ANLS_LEAST, CONSENSUS = 0.05, 0.5, 3.0
#: Characters of the texts whose n-grams are counted at once.
CHARACTERS = 4_000_000


def _normal(x: Column) -> Column:
    return F.lower(F.trim(x))


def exact(prediction: Column, gold: Column) -> Column:
    return _normal(prediction) == _normal(gold)


def relaxed(prediction: Column, gold: Column) -> Column:
    """Numbers (with or without %) within the tolerance, anything else equal without case."""
    number = lambda x: F.regexp_replace(x, "[%,]", "").try_cast("double")
    p, g = number(prediction), number(gold)
    return F.when(p.isNotNull() & g.isNotNull(), F.when(g == 0, p == 0).otherwise(F.abs(p - g) / F.abs(g) <= TOLERANCE)).otherwise(exact(prediction, gold))


def best_of(prediction: Column, golds: str, metric) -> Column:
    """The largest value of ``metric`` over an array of accepted answers."""
    return F.array_max(F.transform(golds, lambda g: metric(prediction, g)))


def anls(prediction: Column, gold: Column) -> Column:
    """1 - edit distance / longer length, 0 below a half; 1 for two empty texts."""
    a, b = _normal(prediction), _normal(gold)
    longer = F.greatest(F.length(a), F.length(b))
    near = 1 - F.levenshtein(a, b) / longer
    return F.when(longer == 0, 1.0).when(near >= ANLS_LEAST, near).otherwise(0.0)


def iou(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Intersection over union of boxes x1, y1, x2, y2; null if both are empty."""
    side = lambda lo, hi: F.greatest(F.lit(0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    inter = side(0, 2) * side(1, 3)
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return F.try_divide(inter, area(a) + area(b) - inter)


def binary(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, accuracy, yes_ratio; a rate without cases is null."""
    y, p = F.col(gold) == 1, F.col(predicted) == 1
    counts = rows.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rate = lambda a, b, name: F.round(F.try_divide(a, b), 6).alias(name)
    total = tp + fp + fn + tn
    return counts.select("*", rate(tp, tp + fp, "precision"), rate(tp, tp + fn, "recall"), rate(2 * tp, 2 * tp + fp + fn, "f1"), rate(tp + tn, total, "accuracy"), rate(tp + fp, total, "yes_ratio"))


def soft_answers(rows: DataFrame, question: str, answer: str) -> DataFrame:
    """question, answer, n, soft_score: for each answerer left out, min(1, equal answers among the others / 3), averaged."""
    n = rows.groupBy(question, answer).agg(F.count("*").alias("n"))
    total = n.groupBy(question).agg(F.sum("n").alias("total"))
    part = lambda c: F.least(F.lit(1.0), c / CONSENSUS)
    score = (F.col("n") * part(F.col("n") - 1) + (F.col("total") - F.col("n")) * part(F.col("n"))) / F.col("total")
    return n.join(total, question).withColumn("soft_score", score)


def paired(rows: DataFrame, image: str, right: str) -> DataFrame:
    """One row: accuracy over answers, and the share of images whose answers are all right."""
    by_image = rows.groupBy(image).agg(F.sum(F.col(right).cast("int")).alias("ok"), F.count("*").alias("n"))
    return by_image.agg(F.try_divide(F.sum("ok"), F.sum("n")).alias("accuracy"), F.avg((F.col("ok") == F.col("n")).cast("int")).alias("accuracy_plus"))


def bleu4(rows: DataFrame, key: str, candidate: str, reference: str) -> DataFrame:
    """One row: corpus BLEU-4 with brevity penalty over white-space tokens; 0 if some n-gram order has no match.

    Keys with one row are counted where the row is, and give eight numbers a batch; n-grams are shuffled for keys with several rows only.
    """
    words = rows.select(F.col(key).alias("k"), F.split(F.lower(candidate), r"\s+").alias("c"), F.split(F.lower(reference), r"\s+").alias("r"))
    several = rows.groupBy(F.col(key).alias("k")).count().where("count > 1 AND k IS NOT NULL").select("k")
    orders = None
    if several.isEmpty():
        alone = words
    else:
        alone, pooled = words.join(several, "k", "left_anti"), words.join(several, "k", "left_semi")
        orders = _pooled_orders(pooled)
    # A null key meets no reference. Tokens hold no space, so that texts joined by one are told apart again.
    plain = alone.select(F.array_join("c", " ").alias("c"), F.when(F.col("k").isNotNull(), F.array_join("r", " ")).alias("r")).where("c IS NOT NULL")
    own = plain.mapInPandas(_order_counts, "order int, hit long, all long")
    orders = own if orders is None else orders.unionByName(own)
    orders = orders.groupBy("order").agg(F.sum("hit").alias("hit"), F.sum("all").alias("all"))
    orders = F.broadcast(rows.sparkSession.range(1, 5).select(F.col("id").cast("int").alias("order"))).join(orders, "order", "left")
    sizes = words.agg(F.sum(F.size("c")).alias("c"), F.sum(F.size("r")).alias("r"))
    mean = orders.agg(F.avg(F.log(F.try_divide(F.col("hit"), F.col("all")))).alias("mean"), F.min("hit").alias("least"))
    penalty = F.when(F.col("c") >= F.col("r"), 1.0).otherwise(F.exp(1 - F.col("r") / F.col("c")))
    return mean.crossJoin(sizes).select(F.when(F.coalesce(F.col("least"), F.lit(0)) == 0, 0.0).otherwise(penalty * F.exp("mean")).alias("bleu4"))


def _order_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """order, hit, all of each batch of texts c and r: n-grams of c, and those that r has as well, as often as it has them."""
    for batch in batches:
        size = batch["c"].str.len() + batch["r"].str.len().fillna(0)
        for _, part in batch.groupby(size.cumsum() // CHARACTERS):
            yield pd.DataFrame(_hits(part["c"].tolist(), part["r"].tolist()), columns=["order", "hit", "all"])


def _hits(candidates: list[str], references: list[str | None]) -> list[tuple[int, int, int]]:
    """order, hit, all of pairs of texts. An n-gram is the number of the one that it lengthens, within its pair, and a word."""
    texts = [*candidates, *references]
    sizes = np.array([0 if t is None else t.count(" ") + 1 for t in texts])
    words = pd.factorize(np.array(" ".join(t for t in texts if t is not None).split(" "), dtype=object))[0]
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(words))  # words from here to the text's end
    of_candidate = np.arange(len(words)) < sizes[: len(candidates)].sum()
    before, out = np.repeat(np.tile(np.arange(len(candidates)), 2), sizes), []
    for n in range(1, 5):
        at = np.flatnonzero(left >= n)
        grams, found = pd.factorize(before[at] * (len(words) + 1) + words[at + n - 1])
        mine, theirs = (np.bincount(grams[side], minlength=len(found)) for side in (of_candidate[at], ~of_candidate[at]))
        out.append((n, int(np.minimum(mine, theirs).sum()), int(mine.sum())))
        before = np.zeros(len(words), dtype=np.int64)
        before[at] = grams
    return out


def _pooled_orders(words: DataFrame) -> DataFrame:
    """order, hit, all of ``words`` (k, c, r), n-grams counted over all rows of a key."""
    grams = lambda c, n: F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(1), F.size(c) - n + 1), lambda i: F.array_join(F.slice(c, i, n), " ")))
    orders = None
    for n in range(1, 5):
        c = words.select("k", F.explode(grams(F.col("c"), n)).alias("g")).groupBy("k", "g").agg(F.count("*").alias("n_c"))
        r = words.select("k", F.explode(grams(F.col("r"), n)).alias("g")).groupBy("k", "g").agg(F.count("*").alias("n_r"))
        one = c.join(r, ["k", "g"], "left").agg(F.lit(n).alias("order"), F.sum(F.least("n_c", F.coalesce("n_r", F.lit(0)))).alias("hit"), F.sum("n_c").alias("all"))
        orders = one if orders is None else orders.unionByName(one)
    return orders
