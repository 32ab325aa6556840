"""Byte-level BPE by corpus-level merge replay: encoding and decoding with a given vocabulary of ranks.

Texts are cut into pieces by the vocabulary's pattern. The corpus of a replay are the distinct new pieces of a batch of texts, laid
end to end as bytes. An inverted index leads from each pair of neighbours that the vocabulary can merge to the places where it
stands; the merges are applied in rank order, each at all its places at once, and only the neighbours of a place touched get
new entries. A piece that comes up a thousand times is merged once, and a merge is looked up once, not once a piece.

Greedy encoding takes the lowest rank of a single piece, again and again. Replay is the same unless a merge makes a pair whose
rank is below its own (a vocabulary may hold a token that can be put together in several ways); the pieces where that happens
leave the replay and are merged alone.

Nothing is shuffled: texts are encoded where they are read, whatever their length, and a lost task is simply run again.
"""

from __future__ import annotations

import base64
import bisect
import heapq
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import table

#: Characters of text that one replay takes, or one text if it is longer.
AT_ONCE = 4_000_000
#: Characters of the words and pieces that a Python worker keeps with their ids; beyond that it starts anew.
KEPT = 16_000_000
#: Patterns that cut before each single space and around each line end, where no more white space stands beside it.
CUT_AT_SPACES = {r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"}
#: White space other than single spaces and line ends.
_OTHER_SPACE = re.compile(r"[^\S\n ]").search
_coders: dict[tuple[str, str], ByteBpe] = {}


class ByteBpe:
    """Ids of texts by a file of ranks (base64 of a token's bytes, its rank) and a pattern that cuts texts into pieces."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.by_words = pattern in CUT_AT_SPACES
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        #: Right ids of each left id, to the id of both joined, or -1; filled as pairs are met.
        self.joined: defaultdict[int, dict[int, int]] = defaultdict(dict)
        self._forget()

    def _forget(self) -> None:
        self.joined.clear()
        #: Ids of pieces, and of what stands between two places where the pattern is known to cut.
        self.known: dict[str, tuple[int, ...]] = {"": ()}
        self.kept = 0

    @staticmethod
    def of(path: str, pattern: str) -> ByteBpe:
        """The worker's own, kept between tasks."""
        if (path, pattern) not in _coders:
            _coders[path, pattern] = ByteBpe(path, pattern)
        return _coders[path, pattern]

    @staticmethod
    def is_plain(text: str) -> bool:
        """Whether white space is single spaces, line ends and single empty lines. Where more stands side by side, the pattern decides by what follows."""
        return not ("  " in text or " \n" in text or "\n " in text or "\n\n\n" in text or "\0" in text or text.endswith("\n\n") or _OTHER_SPACE(text))

    def words(self, text: str) -> list[str]:
        """The text in parts that the pattern never cuts across: words with the space before them, and line ends; or its pieces."""
        if self.by_words and self.is_plain(text):
            return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        return self.split(text)

    def _join(self, a: int, b: int) -> int:
        right = self.joined[a]
        if b not in right:
            right[b] = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], -1)
        return right[b]

    def alone(self, piece: bytes) -> list[int]:
        """One piece by the definition: the lowest rank first, of equal ones the leftmost, by a heap of places."""
        ids = [self.ranks[bytes([b])] for b in piece]
        after, before = [*range(1, len(ids)), -1], list(range(-1, len(ids) - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := self._join(ids[i], ids[i + 1])) >= 0]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (r := self._join(ids[left], ids[right])) >= 0:
                    heapq.heappush(heap, (r, left, ids[left], ids[right]))
        return [i for i in ids if i >= 0]

    def replay(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each piece (none is empty), all merged together."""
        corpus = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        # Pairs of single bytes are found by their numbers; no pair reaches over a piece's end.
        key = corpus[:-1].astype(np.int64) * 256 + corpus[1:]
        inside = np.ones(len(corpus), bool)
        inside[ends - 1] = False
        places = np.flatnonzero(inside)
        order = places[np.argsort(key[places], kind="stable")]
        firsts = np.flatnonzero(np.diff(key[order], prepend=-1)).tolist()
        index: dict[int, list[int]] = {}
        for at, to in zip(firsts, [*firsts[1:], len(order)], strict=True):
            a, b = divmod(int(key[order[at]]), 256)
            rank = self._join(int(self.single[a]), int(self.single[b]))
            if rank >= 0:
                index.setdefault(rank, []).extend(order[at:to].tolist())
        ids = self.single[corpus].tolist()
        after = np.where(inside, np.arange(1, len(ids) + 1), -1).tolist()
        before = np.concatenate(([-1], np.where(inside[:-1], np.arange(len(ids) - 1), -1))).tolist()
        ends = ends.tolist()
        queue = list(index)
        heapq.heapify(queue)
        joined, join = self.joined, self._join
        gone = set()

        def met(rank: int, left: int, places: list[int], k: int) -> None:
            """Enters a new pair. One below the merge's own rank would come before the merge's next place in the same piece."""
            if rank < merge and k + 1 < len(places) and places[k + 1] < ends[piece := bisect.bisect_right(ends, left)]:
                gone.add(piece)
            if rank in index:
                index[rank].append(left)
            else:
                index[rank] = [left]
                heapq.heappush(queue, rank)

        while queue:
            merge = heapq.heappop(queue)
            places = index.pop(merge)
            places.sort()
            for k, i in enumerate(places):
                j = after[i]
                a = ids[i]
                if j < 0 or a < 0:
                    continue
                b = ids[j]
                right = joined[a]
                # An entry may be stale: what stands there by now has to be this merge's pair.
                if (right[b] if b in right else join(a, b)) != merge:
                    continue
                n = after[j]
                ids[i], ids[j], after[i] = merge, -1, n
                if n >= 0:
                    before[n] = i
                    b = ids[n]
                    right = joined[merge]
                    rank = right[b] if b in right else join(merge, b)
                    if rank >= 0:
                        met(rank, i, places, k)
                p = before[i]
                if p >= 0:
                    a = ids[p]
                    right = joined[a]
                    rank = right[merge] if merge in right else join(a, merge)
                    if rank >= 0:
                        met(rank, p, places, k)
        out, at = [], 0
        for end in ends:
            out.append(tuple([x for x in ids[at:end] if x >= 0]))
            at = end
        for k in gone:
            out[k] = tuple(self.alone(pieces[k]))
        return out

    def _learn(self, words: set[str]) -> None:
        """Enters the words' ids; the pieces that are new are merged together."""
        cut = {w: self.split(w) for w in words}
        new = list(set(chain.from_iterable(cut.values())).difference(self.known))
        if new:
            self.known.update(zip(new, self.replay([p.encode("utf-8", "surrogatepass") for p in new]), strict=True))
        known = self.known
        for w, pieces in cut.items():
            if w not in known:
                known[w] = tuple(chain.from_iterable(map(known.__getitem__, pieces)))
        self.kept += sum(map(len, new)) + sum(map(len, words))

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        if self.kept > KEPT:
            self._forget()
        parts = [self.words(t) for t in texts]
        self._learn(set(chain.from_iterable(parts)).difference(self.known))
        known = self.known.__getitem__
        return [list(chain.from_iterable(map(known, p))) for p in parts]

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes of ids; an id that the vocabulary doesn't have is an error."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


def default_vocabulary() -> tuple[str, str]:
    """The file and the pattern of the query's contract."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _slices(sizes: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """From and to of runs of rows of ``most`` in all, or of one row."""
    at, held = 0, 0
    for to, n in enumerate(sizes):
        if to > at and held + n > most:
            yield at, to
            at, held = to, 0
        held += n
    if len(sizes):
        yield at, len(sizes)


def encode(docs: DataFrame, vocabulary: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (array of int), as greedy byte-pair encoding gives them, without special tokens.

    With ``decoded`` also text_bytes, the ids decoded as decode() does, in the same pass over the batches.

    Null text counts as empty and has no ids. Very long texts are encoded whole. Null ids of documents stay null, repeated
    rows are encoded each, an empty table gives no rows; other columns are ignored, whatever their names. The vocabulary (file,
    pattern) must be on all machines.
    """
    path, pattern = vocabulary or default_vocabulary()

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ByteBpe.of(path, pattern)
        for frame in frames:
            doc_ids, texts = frame.column("doc_id"), frame.column("text")
            lengths = np.diff(np.frombuffer(texts.buffers()[1], np.int32 if texts.type == pa.string() else np.int64)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else []
            for at, to in _slices(lengths, AT_ONCE):
                ids = coder.encode(texts.slice(at, to - at).to_pylist())
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
                back = [pa.array(map(coder.decode, ids), pa.binary())] if decoded else []
                yield pa.RecordBatch.from_arrays([doc_ids.slice(at, to - at), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), *back], ["doc_id", "ids", "text_bytes"][: 2 + len(back)])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(batches, "doc_id long, ids array<int>" + ", text_bytes binary" * decoded)


def decode(encoded: DataFrame, vocabulary: tuple[str, str] | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``encoded``: doc_id, ids, text_bytes. Null ids count as none; an id beyond the vocabulary is an error.

    Bytes, not text: ids that someone cut need not end at a character.
    """
    path, pattern = vocabulary or default_vocabulary()

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ByteBpe.of(path, pattern)
        for frame in frames:
            lists = frame.column("ids")
            for at, to in _slices(lists.value_lengths().to_pylist(), AT_ONCE):
                part = frame.slice(at, to - at)
                back = pa.array([coder.decode(ids) for ids in part.column("ids").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), back], ["doc_id", "ids", "text_bytes"])

    ids = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    return ids.mapInArrow(batches, "doc_id long, ids array<int>, text_bytes binary")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, encoded and decoded again."""
    back = encode(table(spark, sf_dir, "documents"), decoded=True)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("text_bytes", 256).alias("decoded_sha256"))
