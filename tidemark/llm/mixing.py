"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

A source with the share p of all tokens gets the weight p^t, normalised: t = 1 leaves the corpus as it is, t = 0 makes all
sources equal. The exponent is found by bisection, as the flattest mixture within a repetition limit, or the one with a given
entropy. Each source is dealt into blocks by a hash of the document's id; an epoch is a permutation of a source's blocks. A
source is repeated for so many whole epochs as its budget of tokens allows; a last epoch takes blocks in its permuted
order while they fit, and of the first block that does not fit its sub-blocks likewise. What remains unspent is less than
the next sub-block, about a millionth of the source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.shared import checkpointed
from tidemark.sources import table

BLOCKS = 1024
#: Up to so many sources their table is broadcast (some hundred bytes a row); beyond, documents are shuffled to it.
BROADCAST_SOURCES = 10_000
#: Exponents tried in one pass over the sources, each cutting the range to a part.
TRIES, PASSES = 16, 9
REPETITION_LIMIT = 4.0


def tokens(text: Column) -> Column:
    """Words parted by white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def _hash(seed: int, *columns) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def _first_true(sources: DataFrame, holds) -> float:
    """The smallest exponent in 0 to 1 at which the aggregate ``holds(t)`` is true; 1 if it never is.

    ``holds`` is monotone. The range is cut into TRIES parts a pass; one pass is one aggregation of the table of sources.
    """
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        steps = [low + (high - low) * i / TRIES for i in range(TRIES + 1)]
        row = sources.agg(*(holds(t).alias(f"t{i}") for i, t in enumerate(steps))).first()
        true = [i for i in range(TRIES + 1) if row[f"t{i}"]]
        if not true:
            return high
        if true[0] == 0:
            return steps[0]
        low, high = steps[true[0] - 1], steps[true[0]]
    return high


def exponent_for_repetition(sources: DataFrame, limit: float, budget: float | None = None) -> float:
    """The flattest exponent at which no source is used more than ``limit`` times.

    ``sources``: column tokens. With no ``budget`` every document is used at least once: then the source used most counts
    against the one used least.
    """
    p = F.col("tokens").cast("double")

    def holds(t: float) -> Column:
        uses = F.pow(p, F.lit(t - 1))
        if budget is None:
            return F.max(uses) <= limit * F.min(uses) * (1 + 1e-12)
        return budget * F.max(uses) <= limit * F.sum(F.pow(p, F.lit(t))) * (1 + 1e-12)

    return _first_true(sources, holds)


def exponent_for_entropy(sources: DataFrame, nats: float) -> float:
    """The exponent at which the weights' entropy has come down to ``nats``; 0 if all-equal weights have no more, 1 if even
    the shares as they are have more."""
    logs = F.log(F.col("tokens").cast("double"))

    def holds(t: float) -> Column:
        w = F.exp(logs * t)
        return F.log(F.sum(w)) - F.sum(w * logs * t) / F.sum(w) <= nats

    return _first_true(sources, holds)


def plan(docs: DataFrame, repetition_limit: float | None = REPETITION_LIMIT, entropy: float | None = None, budget: float | None = None, seed: int = 0) -> DataFrame:
    """One row per source of ``docs`` (columns key, source, n_tokens): tokens, weight, uses, epochs, and where the last epoch ends.

    Without ``budget``, it is the least with which each document is used once; sources without tokens are used once.
    """
    block = F.pmod(_hash(seed, "key"), F.lit(BLOCKS)).cast("int")
    sub = F.pmod(_hash(seed + 1, "key"), F.lit(BLOCKS)).cast("int")
    by_block = checkpointed(docs.groupBy("source", block.alias("block")).agg(F.sum("n_tokens").alias("tokens")))
    sources = checkpointed(by_block.groupBy("source").agg(F.sum("tokens").alias("tokens")))
    full = sources.where("tokens > 0")
    t = exponent_for_entropy(full, entropy) if entropy is not None else exponent_for_repetition(full, repetition_limit or math.inf, budget)
    total = full.agg(F.sum(F.pow("tokens", F.lit(t))).alias("w"), F.min(F.pow("tokens", F.lit(t - 1))).alias("least")).first()
    scale = 1 / total["least"] if total["w"] and budget is None else (budget / total["w"] if total["w"] else 0.0)
    uses = F.when(F.col("tokens") > 0, F.pow("tokens", F.lit(t - 1)) * scale).otherwise(1.0)
    if repetition_limit is not None and entropy is not None:
        uses = F.least(uses, F.lit(float(repetition_limit)))
    # Rounding must not take the last document of a source that is used a whole number of times.
    uses = F.when(F.abs(uses - F.round(uses)) < 1e-9, F.round(uses)).otherwise(uses)
    weight = F.when(F.col("tokens") > 0, F.pow("tokens", F.lit(t)) / F.lit(total["w"])).otherwise(0.0)
    used = sources.select("source", "tokens", weight.alias("weight"), uses.alias("uses")).withColumn("epochs", F.floor("uses").cast("int")).withColumn("rest", F.floor((F.col("uses") - F.col("epochs")) * F.col("tokens")).cast("long"))

    place = lambda what, s: F.struct(_hash(seed + s, "source", "epochs", what).alias("o"), F.col(what).alias("n"))
    running = lambda by: F.sum("tokens").over(Window.partitionBy(*by).orderBy("place").rowsBetween(Window.unboundedPreceding, 0))

    # The windows hold at most BLOCKS rows each: sums of blocks, and of the sub-blocks of one block of a source.
    u = used.select("source", "epochs", "rest").alias("u")
    b = by_block.alias("b").join(u, F.col("b.source").eqNullSafe(F.col("u.source"))).select("b.source", "b.block", "b.tokens", "u.epochs", "u.rest").withColumn("place", place("block", 2))
    b = b.withColumn("until", running(["source"])).where("until > rest").groupBy("source").agg(F.min_by(F.struct("place", (F.col("rest") - F.col("until") + F.col("tokens")).alias("left"), "block", "epochs"), "place").alias("x"))
    edge = checkpointed(b.select("source", F.col("x.place").alias("edge"), F.col("x.left").alias("left"), F.col("x.block").alias("block"), F.col("x.epochs").alias("epochs")))
    within = docs.select("source", block.alias("block"), sub.alias("sub"), "n_tokens").alias("d").join(small(edge).alias("e"), F.col("d.source").eqNullSafe(F.col("e.source")) & (F.col("d.block") == F.col("e.block")))
    subs = within.groupBy("d.source", "sub", "left", "epochs").agg(F.sum("n_tokens").alias("tokens")).withColumn("place", place("sub", 3)).withColumn("until", running(["source"]))
    last = subs.where("until > left").groupBy("source").agg(F.min("place").alias("edge_sub"))
    out = used.alias("u").join(edge.alias("e"), F.col("u.source").eqNullSafe(F.col("e.source")), "left").join(last.alias("l"), F.col("u.source").eqNullSafe(F.col("l.source")), "left")
    return checkpointed(out.select("u.*", "e.edge", "l.edge_sub"))


def small(rows: DataFrame) -> DataFrame:
    """``rows`` with a broadcast hint if they are few enough for one; they are counted."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_SOURCES else rows


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", repetition_limit: float | None = REPETITION_LIMIT, entropy: float | None = None, budget: float | None = None, seed: int = 0) -> DataFrame:
    """All columns of ``docs``, each row as often as the mixture uses it, in ``mix_row``; with mix_epoch (from 0), mix_block (the place of its
    block in the epoch's permutation) and mix_tokens.

    Null sources are a source of their own; null texts have no tokens and go with their blocks. Rows with one id share a
    block, so that repeated rows and null ids go together. Empty table: no rows. The columns of ``docs`` come as one struct,
    so that their names cannot clash.
    """
    base = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("mix_row"), F.col(id_col).alias("key"), F.col(source_col).alias("source"), tokens(F.col(text_col)).alias("n_tokens"))
    uses = plan(base.select("key", "source", "n_tokens"), repetition_limit, entropy, budget, seed)
    d, p = base.withColumn("block", F.pmod(_hash(seed, "key"), F.lit(BLOCKS)).cast("int")).withColumn("sub", F.pmod(_hash(seed + 1, "key"), F.lit(BLOCKS)).cast("int")).alias("d"), small(uses).alias("p")
    both = d.join(p, F.col("d.source").eqNullSafe(F.col("p.source"))).select("d.*", "p.epochs", "p.rest", "p.edge", "p.edge_sub")
    here = F.struct(_hash(seed + 2, "source", "epochs", "block").alias("o"), F.col("block").alias("n"))
    here_sub = F.struct(_hash(seed + 3, "source", "epochs", "sub").alias("o"), F.col("sub").alias("n"))
    once_more = (F.col("rest") > 0) & F.coalesce((here < F.col("edge")) | ((here == F.col("edge")) & F.coalesce(here_sub < F.col("edge_sub"), F.lit(True))), F.lit(False))
    copies = F.col("epochs") + once_more.cast("int")
    rows = both.where(copies > 0).withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), copies - 1)))
    return rows.select("mix_row", "mix_epoch", _hash(seed + 2, "source", "mix_epoch", "block").alias("mix_block"), F.col("n_tokens").alias("mix_tokens"))


def mixed(docs: DataFrame, repetition_limit: float = REPETITION_LIMIT, **columns: str) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture uses it and at least once, all columns as they were."""
    return mix(docs, repetition_limit=repetition_limit, **columns).select("mix_row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, no source used more than REPETITION_LIMIT times as often as another, no document dropped."""
    docs = table(spark, sf_dir, "documents")
    return mix(docs).select("mix_row.doc_id", "mix_row.source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_epoch").alias("epoch"), F.col("mix_block").alias("block"))
