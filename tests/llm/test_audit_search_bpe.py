"""op11 to op13: brute force, the tokenizer's own library, and odd rows. Their SQL is held in test_oracles."""

import base64
import hashlib
import itertools
import random

import pytest

from tests.conftest import SF, same_rows
from tidemark.llm import byte_bpe, filter_audit, lexical_search

LONG = " ".join(f"w{i % 5000}" for i in range(60_000))


# op11


def brute_audit(rows, filters, losses):
    """Each row against each order: rows are (part, failed letters, loss flags)."""
    out, shapley = {}, {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in itertools.permutations(filters):
            gone = set()
            for step, letter in enumerate(order, 1):
                fails = {i for i, r in enumerate(own) if letter in r[1]}
                now = fails - gone
                lost = tuple(sum(own[i][2][k] for i in now) for k in range(losses))
                out[part, "".join(order), step] = (len(own) - len(gone | fails), len(now), len(fails & gone), sum(r[1] == letter for r in own), *lost)
                shapley[part, letter] = shapley.get((part, letter), 0) + len(now)
                gone |= fails
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("filters", ["A", "AB", "XYZ", "ABCD"])
def test_audit_is_brute_force(spark, filters):
    rng = random.Random(len(filters))
    rows = [(rng.choice(["a", "b", "b", "b", ""]), "".join(f for f in filters if rng.random() < 0.3), (rng.random() < 0.2, rng.random() < 0.4)) for _ in range(300)]
    flat = [(p, *(f in fails for f in filters), *lost) for p, fails, lost in rows]
    df = spark.createDataFrame(flat, f"part string, {', '.join(f'{f} boolean' for f in filters)}, good boolean, toxic boolean")
    out = filter_audit.filter_audit(df, list(filters), {"good_lost": "good", "toxic_lost": "toxic"}).collect()
    assert {tuple(r[:3]): tuple(r[3:]) for r in out} == brute_audit(rows, filters, 2)


def test_audit_odd_rows(spark, duck):
    """Nulls, copies, ids that repeat, parts that are null or empty, labels given twice, clashing columns."""
    ok = " ".join(f"word{i}" for i in range(250))
    rows = [(1, ok, "a"), (2, ok, "a"), (2, ok, "b"), (1, ok, "b"), (None, ok, "a"), (3, None, None), (4, "", ""), (5, "A B C # d", "a"), (6, LONG, None), (7, "same " * 300, "a"), (7, "same " * 300, "a"), (8, f"{ok}\t\x0b{ok}", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS part", "true AS A", "2 AS digest", "3 AS first", "4 AS good")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (3, None, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    con = duck.cursor()
    con.register("d", docs.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}))
    con.register("l", labels.toPandas().astype("Int64"))
    sql = f"WITH documents AS (FROM d), labels AS (FROM l), {filter_audit.ORACLE_SQL.strip().removeprefix('WITH')}"
    run = lambda d: filter_audit.filter_audit(filter_audit.standard_failures(d, labels), list("ABCDE"), {"good_lost": "good", "toxic_lost": "toxic"})
    same_rows(run(docs), con, sql)
    assert run(docs.limit(0)).collect() == []
    flags = {(r.part, r.E): r["n"] for r in filter_audit.standard_failures(docs, labels).groupBy("part", "E").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert flags == {("a", False): 5, ("a", True): 1, ("b", True): 1, ("b", False): 1, ("", False): 2, ("", True): 1, ("c", False): 1}
    with pytest.raises(ValueError):
        filter_audit.filter_audit(docs, ["AB"], {})


# op12


def test_search_odd_rows(spark, duck, monkeypatch):
    """Nulls, texts without terms, ids that repeat, ties, items of several rows; also with tiny blocks and chunks, and without a broadcast."""
    rows = [(1, "alpha beta gamma"), (1, "alpha beta gamma"), (None, "Alpha BETA gamma"), (2, None), (3, ""), (4, "... !!"), (5, LONG), (6, "É é ß alpha alpha alpha alpha"), (7, "é漢字 x1")]
    docs = spark.createDataFrame([*rows, *((100 + i, f"alpha filler{i}") for i in range(40))], "doc_id long, text string").repartition(3).selectExpr("*", "1 AS block", "2 AS rank", "3 AS item_id", "4 AS score", "5 AS term")
    items = spark.createDataFrame([(1, "alpha beta"), (1, "alpha"), (None, "é w17 w17"), (2, None), (3, ""), (4, "nothing here")], "item_id long, text string").selectExpr("*", "1 AS chunk", "2 AS doc_id", "3 AS terms")
    con = duck.cursor()
    con.register("d", docs.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    con.register("b", items.select("item_id", "text").toPandas().astype({"item_id": "Int64"}))
    sql = f"WITH documents AS (FROM d), benchmark AS (FROM b), {lexical_search.ORACLE_SQL.strip().removeprefix('WITH')}"
    same_rows(lexical_search.ranked_search(docs, items), con, sql)
    assert lexical_search.ranked_search(docs.limit(0), items).collect() == lexical_search.ranked_search(docs, items.limit(0)).collect() == []
    for name, value in (("BROADCAST_TERMS", 1), ("CHUNK_TERMS", 2), ("AT_ONCE", 2), ("LOOKUPS", 3), ("BLOCK_DOCS", 4)):
        monkeypatch.setattr(lexical_search, name, value)
    same_rows(lexical_search.ranked_search(docs, items), con, sql)


def test_search_bounds_hold_and_exclude(spark, monkeypatch):
    """Rescored pairs are far fewer than all pairs, and none of the best is missing (same rows as SQL in test_oracles)."""
    blocks = lexical_search.index(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    assert sum(blocks.docs) <= 1000 and blocks.docs.max() <= lexical_search.BLOCK_DOCS
    row = next(blocks.itertuples())
    import numpy as np

    held = np.frombuffer(row.held, "<i4")
    doc = np.repeat(np.arange(row.docs), held)
    term, tf = np.frombuffer(row.term, "<i4"), np.frombuffer(row.tf, "<i4")
    at = lexical_search._positions([w.encode() for w in row.terms])
    for level, height, data in zip(lexical_search.LEVELS, row.heights, row.slices, strict=True):
        bits = np.unpackbits(np.frombuffer(data, np.uint8).reshape(height, -1), axis=1, count=row.docs)
        shown = bits[at[:, 0] & (height - 1)] & bits[at[:, 1] & (height - 1)]
        assert shown[term[tf >= level], doc[tf >= level]].all()  # nothing is hidden
        assert shown.mean() < 0.5


# op13


@pytest.fixture(scope="module")
def coders():
    import tiktoken

    path, pattern = byte_bpe.default_vocabulary()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return byte_bpe.ByteBpe(path, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), ranks


def test_bpe_is_the_library(coders):
    ours, theirs, ranks = coders
    rng = random.Random(5)
    alphabet = list("   \n\n\x1c\x85　᠎abcdehnostr  \n'éüßñ漢字仮名😀́‍1290#_-ABΣİ\t\r\x00")
    tokens = [t.decode("utf-8", "ignore") for t in ranks]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(5000)]
    texts += ["".join(rng.choice(tokens) for _ in range(rng.randrange(1, 12))) for _ in range(5000)]
    texts += ["a" * n for n in range(1, 300)] + ["ab" * n + "a" * k for n in range(40) for k in range(9)] + ["é" * 3001, "x" * 100_000, "<|endoftext|>", "", "\n", "\n\n", " ", "a\n\n", "a \n b", "it's We'll"]
    for at in range(0, len(texts), 3000):
        ids = ours.encode(texts[at : at + 3000])
        assert ids == theirs.encode_ordinary_batch(texts[at : at + 3000], num_threads=1)
        assert [ours.decode(i).decode() for i in ids] == texts[at : at + 3000]
    pieces = list({p.encode() for t in texts for p in ours.split(t)})
    assert ours.replay(pieces) == [tuple(ours.alone(p)) for p in pieces]


def test_bpe_forgets(coders, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT", 10)
    ours, theirs, _ = coders
    for text in ("one two three", "two three four", "three four five"):
        assert ours.encode([text, text]) == [theirs.encode_ordinary(text)] * 2


def test_bpe_query(spark, coders):
    from tidemark.llm import queries

    theirs = coders[1]
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = queries.QUERIES["op13_byte_bpe"](spark, SF).collect()
    assert len(out) == len(rows)
    for r in out:
        ids = theirs.encode_ordinary(rows[r.doc_id])
        assert tuple(r)[1:] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(rows[r.doc_id].encode()).hexdigest())


def test_bpe_odd_rows(spark):
    rows = [(1, None), (None, ""), (2, "x" * 5_000_000), (2, "hi there"), (2, "hi there")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS text_bytes")
    out = byte_bpe.decode(byte_bpe.encode(docs)).collect()
    assert sorted((r.doc_id or 0, bytes(r.text_bytes).decode()) for r in out) == sorted((i or 0, t or "") for i, t in rows)
    assert sorted(map(tuple, byte_bpe.encode(docs, decoded=True).collect()), key=str) == sorted(map(tuple, out), key=str)
    assert [r.ids for r in out if not r.text_bytes] == [[], []] and byte_bpe.encode(docs.limit(0)).collect() == []
    assert byte_bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first().text_bytes == b""
    with pytest.raises(Exception, match="KeyError"):
        byte_bpe.decode(spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>")).collect()
