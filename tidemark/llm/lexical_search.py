"""Ranked lexical search over bit-sliced Bloom signatures, with exact rescoring of all that the bounds don't exclude.

1. Index: documents are cut into blocks of like length where they are read. A block is a row: its dictionary, its documents' terms and
   counts, and bit-sliced signatures: bit matrices with a row for each Bloom position and a column for each document, one matrix
   for the terms that occur at least once, twice, four times (LEVELS). Their height follows the block's longest document.
2. Statistics: documents, terms in all, and for the items' terms the documents that hold them, are summed over the blocks.
3. Search: an item's terms pick rows of the matrices; the documents that may hold a term are the bits set in all its rows.
   The sums of weights over these bits, for each level, times the most that a count of this level is worth in a document of this
   length, bound the score from above: a signature can show a term that isn't there, but never hides one. Every document whose
   bound reaches the k-th best score so far of its task is scored exactly on its terms and counts; no other can be among the best.
4. Each task passes on the k best of each item, which are ranked in two steps, so that no task gathers an item's documents.

Items meet blocks by an equality join on a number of their chunk; chunks are broadcast only where all of them together are small.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.shared import written
from tidemark.sources import table

#: Documents, and characters, of a block at most (or one document, if it is longer).
BLOCK_DOCS, BLOCK_CHARS = 256, 2_000_000
#: A signature is for the terms that occur so often in a document at least.
LEVELS = (1, 2, 4)
#: Bits of a signature for each term of a block's longest document, before the next power of two; each term sets two.
BITS_PER_TERM = 8
#: Terms of the items of a chunk, and of all chunks that may be broadcast: beyond, chunks and blocks are dealt over SLOTS.
CHUNK_TERMS, BROADCAST_TERMS, SLOTS = 100_000, 400_000, 64
#: Terms of items that are evaluated, and pairs of an item's term and a document that are looked up, at a time.
AT_ONCE, LOOKUPS = 8_000, 1_000_000
#: Slots over which an item's candidates are ranked before all are.
RANK_SLOTS = 64

_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_INDEX = pa.schema(
    [(c, pa.int64()) for c in ("block", "docs", "size")] + [("terms", pa.list_(pa.string())), ("df", pa.list_(pa.int64()))]
    + [(c, pa.binary()) for c in ("ids", "no_id", "n", "top", "held", "term", "tf")] + [("heights", pa.list_(pa.int64())), ("slices", pa.list_(pa.binary()))]
)
_SCHEMA = "block long, docs long, size long, terms array<string>, df array<long>, ids binary, no_id binary, n binary, top binary, held binary, term binary, tf binary, heights array<long>, slices array<binary>"


def terms(text: str) -> list[bytes]:
    """The terms of a text in order: runs of ASCII letters (lower-cased) and digits and of any characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def _positions(words: list[bytes]) -> np.ndarray:
    """Two 32-bit numbers of each word; their lowest bits are its Bloom positions."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64).view(np.uint32).reshape(-1, 2).astype(np.int64)


def _block(ids: list, texts: list[str]) -> dict | None:
    """The index row of some documents; those without terms are left out. Without any, none."""
    number: dict[bytes, int] = {}
    kept, sizes, held, term, tf = [], [], [], [], []
    for i, text in zip(ids, texts, strict=True):
        counts = Counter(terms(text))
        if counts:
            kept.append(i)
            sizes.append(counts.total())
            held.append(len(counts))
            term += [number.setdefault(w, len(number)) for w in counts]
            tf += counts.values()
    if not kept:
        return None
    held, term, tf = np.array(held), np.array(term), np.array(tf)
    doc = np.repeat(np.arange(len(kept)), held)
    order = np.lexsort((term, doc))
    term, tf = term[order], tf[order]
    at = _positions(list(number))
    heights, slices = [], []
    for level in LEVELS:
        often = tf >= level
        most = int(np.bincount(doc[often], minlength=1).max())
        height = 1 << max(3, (BITS_PER_TERM * most - 1).bit_length())
        bits = np.zeros((height, len(kept)), bool)
        for k in range(2):
            bits[at[term[often], k] & (height - 1), doc[often]] = True
        heights.append(height)
        slices.append(np.packbits(bits, axis=1).tobytes())
    starts = np.cumsum(held) - held
    return {
        "block": 0, "docs": len(kept), "size": sum(sizes), "terms": [w.decode("utf-8", "surrogatepass") for w in number], "df": np.bincount(term),
        "ids": np.array([0 if i is None else i for i in kept], "<i8").tobytes(), "no_id": np.array([i is None for i in kept]).tobytes(),
        "n": np.array(sizes, "<i8").tobytes(), "top": np.maximum.reduceat(tf, starts).astype("<i8").tobytes(), "held": held.astype("<i4").tobytes(),
        "term": term.astype("<i4").tobytes(), "tf": tf.astype("<i4").tobytes(), "heights": heights, "slices": slices,
    }


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The blocks of ``docs``, a row each. Null texts have no terms; null ids stay apart from all others."""

    def blocks(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            ids, texts = frame.column("doc_id").to_pylist(), frame.column("text")
            lengths = np.array([len(t) for t in texts.to_pylist()])
            order = np.argsort(lengths, kind="stable")
            at = 0
            while at < len(order):
                within = max(1, int(np.searchsorted(np.cumsum(lengths[order[at : at + BLOCK_DOCS]]), BLOCK_CHARS, side="right")))
                rows = order[at : at + within]
                at += within
                if row := _block([ids[i] for i in rows], texts.take(pa.array(rows)).to_pylist()):
                    yield pa.RecordBatch.from_pylist([row], _INDEX)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(blocks, _SCHEMA).withColumn("block", F.monotonically_increasing_id())


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, term, count; rows that share an id are one item."""

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, w.decode("utf-8", "surrogatepass"), c) for i, t in zip(frame["item_id"].astype("Int64"), frame["text"], strict=True) for w, c in Counter(terms(t)).items()]
            yield pd.DataFrame(rows, columns=["item_id", "term", "count"]).astype({"item_id": "Int64", "term": object})

    own = items.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return own.mapInPandas(split, "item_id long, term string, count long").groupBy("item_id", "term").agg(F.sum("count").alias("count"))


class _Items:
    """The items of a chunk: their terms' weights end to end, from ``starts`` on, and the distinct terms."""

    def __init__(self, row) -> None:
        words = row.q_terms.split("\n")
        self.ids, self.no_id, self.weights = np.asarray(row.q_ids, np.int64), np.asarray(row.q_no_id, bool), np.asarray(row.q_weights, np.int64)
        lengths = np.asarray(row.q_lengths, np.int64)
        self.starts, self.ends = np.cumsum(lengths) - lengths, np.cumsum(lengths)
        number: dict[str, int] = {}
        self.term = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        self.words = list(number)
        self.at = _positions([w.encode("utf-8", "surrogatepass") for w in self.words])
        #: The best so far: item (its place here), score, whether the id is null, id.
        self.best = np.zeros((0, 4), np.int64)

    def floors(self, k: int) -> np.ndarray:
        """The k-th best score of each item, or 1."""
        counts = np.bincount(self.best[:, 0], minlength=len(self.ids))
        out = np.ones(len(self.ids), np.int64)
        full = counts >= k
        out[full] = self.best[(np.cumsum(counts) - counts + k - 1)[full], 1]
        return out

    def add(self, found: np.ndarray, k: int) -> None:
        """Keeps the k best of each item: higher scores, then smaller ids, null ids last."""
        every = np.concatenate((self.best, found))
        every = every[np.lexsort((every[:, 3], every[:, 2], -every[:, 1], every[:, 0]))]
        counts = np.bincount(every[:, 0], minlength=len(self.ids))
        rank = np.arange(len(every)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.best = every[rank < k]


def _worth(tf, m):
    """What a count is worth in a document: the contract's division, rounded down."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _search(row, items: _Items, n_docs: int, n_terms: int, k: int) -> None:
    """Adds a block's documents to the items' best."""
    n, top, held = np.frombuffer(row.n, "<i8"), np.frombuffer(row.top, "<i8"), np.frombuffer(row.held, "<i4").astype(np.int64)
    ids, no_id = np.frombuffer(row.ids, "<i8"), np.frombuffer(row.no_id, bool)
    docs = len(n)
    m = 75 + (25 * n * n_docs) // n_terms
    # Levels 1, 2, 4: a count below the next level is worth what the largest such count is, or the document's largest.
    most = [np.minimum(b - 1, top) for b in LEVELS[1:]] + [top]
    worth = [_worth(t, m) for t in most]
    gains = [worth[0]] + [b - a for a, b in itertools.pairwise(worth)]
    masks = []
    for height, data in zip(row.heights, row.slices, strict=True):
        bits = np.frombuffer(data, np.uint8).reshape(int(height), -1)
        masks.append(bits[items.at[:, 0] & (int(height) - 1)] & bits[items.at[:, 1] & (int(height) - 1)])
    at = dict(zip(row.terms, range(len(row.terms)), strict=True))
    number = np.array([at.get(w, -1) for w in items.words], np.int64)
    keys = np.repeat(np.arange(docs), held) * len(at) + np.frombuffer(row.term, "<i4")
    tf = np.frombuffer(row.tf, "<i4").astype(np.int64)
    maybe = [bits.any(axis=1) for bits in masks]

    def exact(item: np.ndarray, doc: np.ndarray) -> None:
        lengths = (items.ends - items.starts)[item]
        entry = np.repeat(items.starts[item] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        on, word = np.repeat(doc, lengths), number[items.term[entry]]
        place = np.minimum(np.searchsorted(keys, on * len(at) + word), len(keys) - 1)
        there = (word >= 0) & (keys[place] == on * len(at) + word)
        count = np.where(there, tf[place], 0)
        parts = np.where(there, items.weights[entry] * _worth(count, m[on]), 0)
        score = np.add.reduceat(parts, np.cumsum(lengths) - lengths)
        good = score > 0
        items.add(np.stack((item, score, no_id[doc].astype(np.int64), ids[doc]), axis=1)[good], k)

    def in_slices(item: np.ndarray, doc: np.ndarray) -> None:
        step = max(1, LOOKUPS // max(1, int((items.ends - items.starts)[item].max(initial=1))))
        for i in range(0, len(item), step):
            exact(item[i : i + step], doc[i : i + step])

    first = 0
    while first < len(items.ids):
        last = max(first + 1, int(np.searchsorted(items.ends, items.starts[first] + AT_ONCE, side="right")))
        entries = np.arange(items.starts[first], items.ends[last - 1])
        bound = np.zeros((last - first, docs), np.int64)
        for bits, any_, gain in zip(masks, maybe, gains, strict=True):
            some = entries[any_[items.term[entries]]]
            if not len(some):
                continue
            of = np.searchsorted(items.ends, some, side="right") - first
            weighted = np.unpackbits(bits[items.term[some]], axis=1, count=docs) * items.weights[some][:, None]
            heads = np.flatnonzero(np.diff(of, prepend=-1))
            bound[of[heads]] += np.add.reduceat(weighted, heads, axis=0) * gain
        # The likeliest first: they lift the floor that the others have to reach.
        floor = items.floors(k)[first:last, None]
        lead = min(k, docs)
        ahead = np.zeros(bound.shape, bool)
        np.put_along_axis(ahead, np.argpartition(bound, docs - lead, axis=1)[:, docs - lead :], True, axis=1)
        item, doc = np.nonzero(ahead & (bound >= floor))
        in_slices(item + first, doc)
        item, doc = np.nonzero(~ahead & (bound >= items.floors(k)[first:last, None]))
        in_slices(item + first, doc)
        first = last


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's ``k`` best documents with a score above 0, ties by ascending doc_id.

    Terms, weights and scores: see the query's contract. Null and empty texts, and those without terms, take part in nothing;
    very long texts are scored whole. Rows of ``docs`` that share an id are documents of their own; null ids come after all others
    of an equal score. Rows of ``items`` that share an id, null ones too, are one item with the terms of all. Empty tables give no
    rows; other columns are ignored, whatever their names.
    """
    blocks = written(index(docs, id_col, text_col))
    facts = blocks.agg(F.sum("docs").alias("docs"), F.sum("size").alias("size")).first()
    n_docs, n_terms = facts["docs"] or 0, facts["size"] or 1

    asked = written(item_terms(items, item_col, item_text_col))
    words = asked.select("term").distinct()
    if asked.select("term").limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        words = F.broadcast(words)
    each = blocks.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.df").alias("df"))
    held = each.join(words, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = written(asked.join(held, "term").select("item_id", "term", (F.col("count") * weight).alias("weight")).where("weight > 0"))

    size = weighed.count()
    chunks = max(1, -(-size // CHUNK_TERMS))
    by_item = weighed.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("t"))
    by_item = by_item.select("item_id", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"), F.pmod(F.xxhash64("item_id"), F.lit(chunks)).alias("chunk"))
    parts = F.sort_array(F.collect_list(F.struct("item_id", "terms", "weights")))
    chunked = by_item.groupBy("chunk").agg(parts.alias("i")).select(
        "chunk", F.array_join(F.flatten("i.terms"), "\n").alias("q_terms"), F.flatten("i.weights").alias("q_weights"),
        F.transform("i.item_id", lambda x: F.coalesce(x, F.lit(0))).alias("q_ids"), F.transform("i.item_id", lambda x: x.isNull()).alias("q_no_id"), F.transform("i.terms", lambda t: F.size(t)).alias("q_lengths"),
    )
    dealt = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    if size <= BROADCAST_TERMS:
        pairs = dealt.join(F.broadcast(chunked), "chunk")
    else:
        pairs = dealt.withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(SLOTS)).cast("int")).join(chunked.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1)))), ["chunk", "slot"])

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, _Items] = {}
        for frame in frames:
            for row in frame.itertuples(index=False):
                if row.chunk not in held:
                    held[row.chunk] = _Items(row)
                _search(row, held[row.chunk], n_docs, n_terms, k)
        for items in held.values():
            item, score, no_id, doc_id = items.best.T
            yield pd.DataFrame({"item_id": pd.arrays.IntegerArray(items.ids[item], items.no_id[item]), "doc_id": pd.arrays.IntegerArray(doc_id.copy(), no_id == 1), "score": score})

    found = pairs.mapInPandas(search, "item_id long, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(RANK_SLOTS))
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", slot).orderBy(*order))).where(F.col("rank") <= k)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return best.select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of ``benchmark`` against all of ``documents``."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
#: All documents scored, without signatures or bounds.
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
sizes AS (SELECT r, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
facts AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM sizes),
asked AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, term),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, facts GROUP BY term, docs),
scored AS (
  SELECT item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN sizes USING (r), facts GROUP BY item_id, r, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
