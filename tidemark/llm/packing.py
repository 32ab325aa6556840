"""Best-fit packing of tokenised documents into fixed-length sequences, by matching of large items.

Documents become pieces of at most CAPACITY tokens where they are read. The pieces' few numbers are dealt over shards of some
thousand pieces and each shard is packed for itself: a shard can leave one sequence or two badly filled, which is nothing
against its thousands. In a shard, pieces above a third of the capacity can share a sequence two at a time only:
they are matched greedily, the largest with the largest that still fits. Smaller pieces, from large to small, then go to the
sequence with the smallest gap that takes them, or to a new one.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import written
from tidemark.sources import table

CAPACITY = 2048
#: Id that ends each document.
END_ID = 0
#: Pieces of a shard, which one task packs.
SHARD = 8000
#: Words whose ids a Python worker keeps; beyond that it forgets those that it met in one batch only.
KNOWN_WORDS = 400_000
#: Characters of text tokenised at a time.
AT_ONCE = 1_000_000

#: A stop or comma that ends a word, in lower-cased texts and in others; the letters are some of those that no normaliser changes.
_STOPS = {letters: [(re.compile(rf"\{c}(?<=[{letters}]\{c})(?=[ \n]|\Z)"), f" {c}") for c in ".,"] for letters in ("0-9a-zß-öø-ɏ", "0-9A-Za-z")}
_LOWERED, _AS_THEY_ARE = _STOPS.values()
_tokenizers: dict[str, Tokens] = {}


class Tokens:
    """Ids of texts by a tokenizer that lower-cases and never joins what white space parts, so that a word's ids can be kept.

    The ids of all known words lie in one array, each word's from its start. A text's words become their numbers (Arrow), and the
    ids of a batch of texts are gathered at once. Unknown words are encoded together: plain ones parted by spaces, where tokens
    that end a word show the seams, all others by the special token ``mark``, which the tokenizer cuts out before all else.
    """

    def __init__(self, path: str, mark: str = "<|startoftext|>", suffix: str = "</w>", most: int = KNOWN_WORDS) -> None:
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path)
        self.mark, self.mark_id = mark, self.encode.token_to_id(mark)
        vocabulary = self.encode.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {"": 0}
        self.words = [""]
        self.store, self.starts, self.lengths, self.batches = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _keep_common(self) -> None:
        """Forgets the words of one batch only; all, if the others are too many as well."""
        rows = np.flatnonzero(self.batches > 1)
        rows = rows[rows > 0]
        if 2 * len(rows) > self.most:
            rows = rows[:0]
        words, store, lengths, batches = [self.words[i] for i in rows], self._gathered(rows), self.lengths[rows], self.batches[rows]
        self._forget()
        self._add(words, store, lengths)
        self.batches[1:] = batches

    def _gathered(self, rows: np.ndarray) -> np.ndarray:
        """The ids of the words with these numbers, one after the other."""
        lengths = self.lengths[rows]
        shift = self.starts[rows] - (np.cumsum(lengths) - lengths)
        at = np.repeat(shift, lengths)
        at += np.arange(len(at))
        return self.store[at]

    def _add(self, words: list[str], ids: np.ndarray, lengths: np.ndarray, gap: int = 0) -> None:
        """Words whose ids lie one after the other in ``ids``, ``gap`` places apart."""
        self.number.update(zip(words, range(len(self.starts), len(self.starts) + len(words)), strict=True))
        self.words += words
        starts = len(self.store) + np.cumsum(lengths + gap) - (lengths + gap)
        self.store = np.concatenate((self.store, ids))
        self.starts, self.lengths = np.concatenate((self.starts, starts)), np.concatenate((self.lengths, lengths))
        self.batches = np.concatenate((self.batches, np.zeros(len(words), np.int64)))

    @staticmethod
    def of(path: str) -> Tokens:
        """The worker's own, kept between tasks."""
        if path not in _tokenizers:
            _tokenizers[path] = Tokens(path)
        return _tokenizers[path]

    @staticmethod
    def parted(text: str) -> str:
        """The text with spaces between parts whose ids, put together, are the text's: line ends are spaces, and single stops and commas part from their word.

        Where lower-casing here could differ from the tokenizer's, a text's letters are left as they are.
        """
        stops = _AS_THEY_ARE
        if "<|" not in text and (text.isascii() or "Σ" not in text and "İ" not in text and unicodedata.is_normalized("NFC", text)):
            text, stops = text.lower(), _LOWERED
        for pattern, apart in stops:
            text = pattern.sub(apart, text)
        return text.replace("\n", " ")

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.encode.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if w.isalpha() and (w.isascii() or w == w.lower() and unicodedata.is_normalized("NFC", w))]
        for at in range(0, len(plain), 20_000):
            part = plain[at : at + 20_000]
            ids = self._ids(" ".join(part))
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part):
                self._add(part, ids, np.diff(ends, prepend=0))
        rest = [w for w in words if w not in self.number]
        for w in rest:
            if "<|" in w:
                ids = self._ids(w)
                self._add([w], ids, np.array([len(ids)]))
        rest = [w for w in rest if "<|" not in w]
        for at in range(0, len(rest), 20_000):
            part = rest[at : at + 20_000]
            ids = self._ids(self.mark.join(part))
            seams = np.append(np.flatnonzero(ids == self.mark_id), len(ids))
            self._add(part, ids, np.diff(seams, prepend=-1) - 1, gap=1)

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        parts = pc.split_pattern(pa.array([self.parted(t) for t in texts], pa.large_string()), " ")
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        unknown = [w for w in words if w not in self.number]
        if len(self.number) + len(unknown) > self.most:
            self._keep_common()
            unknown = [w for w in words if w not in self.number]
        self._learn(unknown)
        rows = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        self.batches[rows] += 1
        rows = rows[coded.indices.to_numpy()]
        data = self._gathered(rows).tobytes()
        ends = 4 * np.concatenate(([0], np.cumsum(self.lengths[rows])))[parts.offsets.to_numpy()]
        return [data[a:b] for a, b in itertools.pairwise(ends.tolist())]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's pieces; the tokenizer's file must be on all machines."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens.of(tokenizer)
        end = np.array([END_ID], "<u4").tobytes()
        for frame in frames:
            ids, texts = frame["doc_id"].astype("Int64").tolist(), frame["text"].tolist()
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= AT_ONCE):
                    size += len(texts[to])
                    to += 1
                rows = []
                for doc_id, data in zip(ids[at:to], tokens.ids(texts[at:to]), strict=True):
                    data += end
                    for piece, start in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[start : start + 4 * capacity]
                        rows.append((doc_id, piece, start // 4, len(part) // 4, zlib.crc32(part)))
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})
                at = to

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int]]:
    """Sequence and offset of each item. Sets of sizes are bits of whole numbers: the nearest size is one step away."""
    by_size: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        by_size.setdefault(n, []).append(i)
    sequence, offset, gaps = [0] * len(lengths), [0] * len(lengths), []
    open_gaps: dict[int, list[int]] = {}
    gap_bits = 0

    def put(item: int, bin_: int) -> None:
        sequence[item], offset[item] = bin_, capacity - gaps[bin_]
        gaps[bin_] -= lengths[item]

    large = [n for n in by_size if 3 * n > capacity]
    bits = sum(1 << n for n in large)

    def take(size: int) -> int:
        nonlocal bits
        item = by_size[size].pop()
        if not by_size[size]:
            bits &= ~(1 << size)
        return item

    while bits:
        size = bits.bit_length() - 1
        gaps.append(capacity)
        put(take(size), len(gaps) - 1)
        fitting = bits & ((1 << (capacity - size + 1)) - 1)
        if fitting:
            put(take(fitting.bit_length() - 1), len(gaps) - 1)
    for bin_, gap in enumerate(gaps):
        open_gaps.setdefault(gap, []).append(bin_)
        gap_bits |= 1 << gap

    for size in sorted((n for n in by_size if 3 * n <= capacity), reverse=True):
        for item in by_size[size]:
            wide = gap_bits >> size
            if wide:
                gap = size + (wide & -wide).bit_length() - 1
                bin_ = open_gaps[gap].pop()
                if not open_gaps[gap]:
                    gap_bits &= ~(1 << gap)
            else:
                gaps.append(capacity)
                bin_ = len(gaps) - 1
            put(item, bin_)
            open_gaps.setdefault(gaps[bin_], []).append(bin_)
            gap_bits |= 1 << gaps[bin_]
    return sequence, offset


def best_fit_packing(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then id 0; only longer ones than ``capacity`` are cut, however long. Null text counts as empty: a
    single id 0. Null ids stay null; a repeated row is packed again, its pieces are rows of their own; an empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    cut = written(pieces(docs, tokenizer or default_tokenizer(), capacity, id_col, text_col))
    shards = max(1, -(-cut.count() // SHARD))
    # The place in the written table deals evenly, however often an id is repeated.
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True]).reset_index(drop=True)
        sequence, offset = pack(frame["length"].tolist(), capacity)
        return frame.drop(columns="shard").astype({"doc_id": "Int64"}).assign(sequence_id=np.array(sequence, np.int64) + (int(frame["shard"].iloc[0]) << 32), offset=np.array(offset, np.int64))

    return dealt.groupBy("shard").applyInPandas(fill, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``."""
    return best_fit_packing(table(spark, sf_dir, "documents"))
