"""Queries against their SQL on the smallest tables, and the others against brute force."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF, same_rows
from tidemark.llm import license_scan, line_dedup, minhash_dedup, mixing, packing, queries
from tidemark.llm.components import components

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.mark.parametrize("name", queries.ORACLE)
def test_matches_sql(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, SF), duck, queries.ORACLE[name])


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute_components(sets):
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(i for i in sets if sets[i])
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            common = len(sets[a] & sets[b])
            if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in sets}


def test_minhash_is_brute_force(spark, texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    truth = brute_components(sets)
    out = queries.QUERIES["op8_minhash_dedup"](spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out} == {i: (len(sets[i]), truth[i], truth[i] == i) for i in sets}


def test_minhash_chains_and_groups(spark):
    """A chain of texts of which only neighbours are linked, a star with many near copies, and texts that share one passage."""
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]
    rows = {}
    for i in range(12):  # each drops four words of the one before
        rows[100 + i] = " ".join(words[4 * i : 4 * i + 60])
    for i in range(60):
        w = list(words[100:180])
        w[int(rng.integers(80))] = f"x{i}"
        rows[200 + i] = " ".join(w)
    for i in range(60):
        rows[300 + i] = " ".join([*words[200:230], *(f"y{i}_{j}" for j in range(30))])
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    truth = brute_components({i: shingle_set(t) for i, t in rows.items()})
    for whole_bucket in (200, 5):  # the second exercises the way for large buckets
        out = minhash_dedup.minhash_dedup(df, whole_bucket=whole_bucket)
        assert {r.doc_id: r.component_id for r in out.collect()} == truth


def test_minhash_pairs_within_boilerplate(spark):
    """Texts that share a passage but too little to be linked, of which every two share a little more, and are."""
    passage = " ".join(f"w{i}" for i in range(122))
    rows = {2 * pair + i: " ".join([passage, *(f"p{pair}_{j}" for j in range(4)), *(f"x{pair}_{i}_{j}" for j in range(19))]) for pair in range(80) for i in range(2)}
    truth = brute_components({i: shingle_set(t) for i, t in rows.items()})
    assert truth == {i: i // 2 * 2 for i in rows}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    out = minhash_dedup.minhash_dedup(df, whole_bucket=20)
    missed = sum(r.component_id != truth[r.doc_id] for r in out.collect())
    assert missed == 0


def test_components_of_chains_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (101, 100), (100, 100), (7, 3)]
    out = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**dict.fromkeys(range(1, 41), 0), 101: 100, 102: 100}


def test_packing_is_the_tokenizer(spark, texts):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(packing.default_tokenizer())
    truth = {}
    for i, t in texts.items():
        ids = np.array([*encode.encode(t, add_special_tokens=False).ids, 0], "<u4")
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            truth[i, piece] = (start, len(part), zlib.crc32(part.tobytes()))
    out = queries.QUERIES["op7_best_fit_packing"](spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out} == truth
    by_sequence = collections.defaultdict(list)
    for r in out:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(length for _, length, _ in truth.values())
    assert len(by_sequence) <= 1.02 * -(-total // 2048) + 1


def test_tokens_by_word_are_whole_texts():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    encode, tokens = Tokenizer.from_file(path), packing.Tokens(path)
    odd = ["It's  a\ttab\nand\r\nline", "<|startoftext|> mark <|endoftext|>x", " nbsp em", "ÀÉÎ ΣΑΣ straße ﬁ", "é ́", "", " ", "1234 5-6 a.b,c", "\x1c\x1d x\x85y", "End. Two, three.\nFour), five.. six,.", "3. x²., y_. z", "İstanbul, ǅ. ßẞ, ÉÉ ﬀ", "<|STARTOFTEXT|> Up", "ΑΣ. Ab", "a\u0301. \u0301, x"]
    assert [np.frombuffer(b, "<u4").tolist() for b in tokens.ids(odd)] == [encode.encode(t, add_special_tokens=False).ids for t in odd]


@pytest.mark.parametrize("most", [packing.KNOWN_WORDS, 60])
def test_tokens_of_random_odd_strings(most):
    """Whatever characters meet, and while most words are forgotten time and again."""
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    encode, tokens = Tokenizer.from_file(path), packing.Tokens(path, most=most)
    rng = np.random.default_rng(7)
    parts = np.array([*"aB .,,.\n\t '’-<|>İΣσςéÉ\u0301\u0307\u093cßẞǅﬁ1²½٣中あ한ᄀ\u1161\r\xa0\u2003İKKªº_$😀क\x1c\x85", "<|startoftext|>", "<|endoftext|>", "'s", "'ll", "İ.", "Σ.", "word. ", "Two, "], object)
    odd = ["".join(rng.choice(parts, int(rng.integers(14)))) for _ in range(6000)]
    for at in range(0, len(odd), 300):
        batch = odd[at : at + 300]
        assert [np.frombuffer(b, "<u4").tolist() for b in tokens.ids(batch)] == [encode.encode(t, add_special_tokens=False).ids for t in batch]


def test_packing_over_several_shards(spark, monkeypatch):
    """What the cut into shards costs: against the packing of all pieces at once."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["the"] * int(n))) for i, n in enumerate(np.minimum(3000, rng.geometric(0.002, 3000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    used = {}
    for shard in (400, 100_000):
        monkeypatch.setattr(packing, "SHARD", shard)
        used[shard] = len({r.sequence_id for r in packing.best_fit_packing(df).select("sequence_id").collect()})
    assert used[400] <= used[100_000] + 8  # a shard leaves one sequence badly filled


def test_pack_uses_few_sequences():
    rng = np.random.default_rng(0)
    for lengths in (rng.integers(1, 2049, 3000), np.minimum(2048, rng.geometric(0.003, 3000)), np.full(10, 1024), np.array([2048, 1, 1])):
        sequence, offset = packing.pack(lengths.tolist())
        fill = np.bincount(sequence, weights=lengths)
        assert fill.max() <= 2048
        assert len(fill) <= 1.03 * max(lengths.sum() / 2048, (3 * lengths > 2048).sum() / 2) + 1 or len(fill) <= 1.05 * lengths.sum() / 2048 + (2 * lengths > 2048).sum()


def test_license_scan_is_brute_force(spark, texts):
    out = {r.doc_id: r for r in queries.QUERIES["op4_license_scan"](spark, SF).collect()}
    for i, t in texts.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
        hits = [(k, label) for p, label in license_scan.BASE.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = out[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(hits), ",".join(sorted({label for _, label in hits})))
        assert (r.first_word, r.last_word) == ((min(k for k, _ in hits), max(k for k, _ in hits)) if hits else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_language_id_on_texts_never_seen(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = queries.QUERIES["op1_language_id"](spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    unseen = [r for r in out if r.held_out]
    assert sum(langs[r.doc_id] == r.lang_pred for r in unseen) >= 0.95 * len(unseen)


def test_language_id_is_brute_force(spark):
    """Predictions again, from the model's centroids by plain dictionaries and loops; every label learned, long and short texts rejected alike."""
    from tidemark.llm import language_id

    rng = np.random.default_rng(5)
    alphabets = [["".join(map(chr, rng.integers(97, 123, 5))) for _ in range(6)] for _ in range(260)]
    rows = [(260 * i + k, " ".join(rng.choice(alphabets[k], int(rng.integers(3, 60)))), f"l{k}") for i in range(8) for k in range(260)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df)
    assert set(model.languages) == {f"l{k}" for k in range(260)}
    out = {r.doc_id: r for r in language_id.language_id(df).collect()}
    for doc_id, text, _ in rows[::40]:
        kept = text.lower().encode()
        x = b" " + kept + b" "
        grams = collections.Counter()
        for size, odd, shift in ((1, 1, 0), (2, 40503, 7), (3, 40507, 9)):
            for at in range(len(x) - size + 1):
                code = x[at] if size == 1 else x[at] * 257 + x[at + 1] if size == 2 else (x[at] * 257 + x[at + 1]) * 263 + x[at + 2]
                wrapped = (code * odd) & 0xFFFFFFFF
                grams[((wrapped - (1 << 32) if wrapped >> 31 else wrapped) >> shift) & 4095] += 1
        v = np.zeros(4096)
        for g, n in grams.items():
            v[g] = np.log1p(n) * model.idf[g]
        cosine = model.centroids @ (v / np.linalg.norm(v))
        assert out[doc_id].lang_pred == model.languages[int(cosine.argmax())] and out[doc_id].score == pytest.approx(float(cosine.max()), abs=1e-4)
    unseen = [(i, lang) for i, _, lang in rows if out[i].held_out]
    assert sum(out[i].lang_pred == lang for i, lang in unseen) >= 0.9 * len(unseen)
    far = spark.createDataFrame([(1, "!" + "éüñß " * n) for n in (3, 10, 100)], "doc_id long, text string")
    assert all(r.p.rejected for r in far.select(language_id.predicted(model, far["text"]).alias("p")).collect())


def test_language_id_rejects_what_is_far(spark):
    from tidemark.llm.language_id import drop_rejected

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10**9, "zq xj " * 400, "en", "s", 2400), (10**9 + 1, "1234", "en", "s", 4)], docs.schema)
    kept = {r.doc_id for r in drop_rejected(docs.union(odd)).select("doc_id").collect()}
    assert not kept & {10**9, 10**9 + 1} and len(kept) >= 0.97 * docs.count()


def test_mixing_budgets(spark):
    rows = [(s * 10_000 + i, "w " * (1 + i % 7), f"s{s}") for s, n in enumerate((2000, 400, 100, 20)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    tokens = collections.Counter()
    for _, t, s in rows:
        tokens[s] += len(t.split())
    for limit in (1.0, 3.0, 1000.0):
        p = {r.source: r for r in mixing.plan(df.selectExpr("doc_id as key", "source", "size(split(trim(text), ' ')) as n_tokens"), limit).collect()}
        used = collections.Counter()
        docs = collections.defaultdict(set)
        for r in mixing.mix(df, repetition_limit=limit).collect():
            used[r.mix_row.source] += r.mix_tokens
            docs[r.mix_row.source].add(r.mix_row.doc_id)
        uses = {s: p[s].uses for s in tokens}
        assert max(uses.values()) <= limit * min(uses.values()) * (1 + 1e-6) and min(uses.values()) == pytest.approx(1)
        for s, n in tokens.items():
            assert len(docs[s]) == sum(1 for r in rows if r[2] == s)  # every document at least once
            assert uses[s] * n - 8 <= used[s] <= uses[s] * n + 1e-6  # short by less than a document
    exact = {r.source: r.weight for r in mixing.plan(df.selectExpr("doc_id as key", "source", "1 as n_tokens"), None, entropy=1.2).collect()}
    assert -sum(w * np.log(w) for w in exact.values()) == pytest.approx(1.2, abs=1e-4)
    small = {r.source: r.uses for r in mixing.plan(df.selectExpr("doc_id as key", "source", "1 as n_tokens"), 2.0, budget=500.0).collect()}
    assert sum(small[s] * n for s, n in (("s0", 2000), ("s1", 400), ("s2", 100), ("s3", 20))) == pytest.approx(500, rel=1e-6) and max(small.values()) <= 2.0 + 1e-6


def mixture(rows, limit, budget):
    """Copies of each document, by loops: exponent by bisection on the definition, budgets, whole epochs, then blocks and sub-blocks in
    their order while they fit. ``rows``: source, tokens, block, sub, id; orders come as functions of source, epoch and block."""
    tokens = collections.Counter()
    for r in rows:
        tokens[r.source] += r.n_tokens
    full = {s: n for s, n in tokens.items() if n > 0}

    def uses(t):
        raw = {s: n ** (t - 1) for s, n in full.items()}
        scale = 1 / min(raw.values()) if budget is None else budget / sum(n**t for n in full.values())
        return {s: u * scale for s, u in raw.items()}

    def within(t):
        u = uses(t)
        return max(u.values()) <= limit * (min(u.values()) if budget is None else 1) * (1 + 1e-12)

    low, high = 0.0, 1.0
    if within(0.0):
        high = 0.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if within(mid) else (mid, high)
    return {s: 1.0 for s in tokens} | uses(high), tokens


def test_mixing_is_brute_force(spark):
    """Every copy of every document, with null sources and texts, a source without tokens, one of a third of all, with and without a budget."""
    rng = random.Random(3)
    rows = []
    for source, n in (("big", 900), ("mid", 300), ("few", 37), (None, 60), ("none", 4)):
        for _ in range(n):
            rows.append((len(rows), None if rng.random() < 0.05 else " ".join("w" * rng.randint(1, 40) for _ in range(0 if source == "none" else rng.randint(0, 60))), source))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    block = lambda k: F.pmod(mixing._hash(k, "doc_id"), F.lit(mixing.BLOCKS)).cast("int")
    keyed = df.select("doc_id", "source", block(0).alias("block"), block(1).alias("sub"), F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("n"))
    keyed = keyed.withColumn("n_tokens", F.greatest("n", F.lit(0))).collect()
    for limit, budget in ((3.0, None), (1.0, None), (1000.0, None), (6.0, 90_000.0)):
        uses, tokens = mixture(keyed, limit, budget)
        epochs = {s: int(u + 1e-9) for s, u in uses.items()}
        places = spark.createDataFrame([(r.doc_id, r.source, epochs[r.source], r.block, r.sub) for r in keyed], "doc_id long, source string, epochs int, block int, sub int")
        order = {r.doc_id: ((r.b, r.block), (r.s, r.sub)) for r in places.select("doc_id", "block", "sub", mixing._hash(2, "source", "epochs", "block").alias("b"), mixing._hash(3, "source", "epochs", "sub").alias("s")).collect()}
        want = collections.Counter()
        for s, u in uses.items():
            mine = [r for r in keyed if r.source == s]
            rest = int(round((u - epochs[s]) * tokens[s], 6))
            spent, by_block = 0, collections.defaultdict(list)
            for r in mine:
                want[r.doc_id] += epochs[s]
                by_block[order[r.doc_id][0]].append(r)
            for place in sorted(by_block) if rest > 0 else ():
                here = by_block[place]
                if spent + sum(r.n_tokens for r in here) <= rest:
                    spent += sum(r.n_tokens for r in here)
                    want.update(r.doc_id for r in here)
                    continue
                by_sub = collections.defaultdict(list)
                for r in here:
                    by_sub[order[r.doc_id][1]].append(r)
                for sub in sorted(by_sub):
                    if spent + sum(r.n_tokens for r in by_sub[sub]) > rest:
                        break
                    spent += sum(r.n_tokens for r in by_sub[sub])
                    want.update(r.doc_id for r in by_sub[sub])
                break
        got = collections.Counter(r.mix_row.doc_id for r in mixing.mix(df, repetition_limit=limit, budget=budget).collect())
        assert got == +want
    one = df.where("source = 'few'")
    assert mixing.mix(one).count() == 37  # a single source is used once
    assert mixing.mix(df.limit(0)).isEmpty()


def edits(a, b):
    """Levenshtein distance of two rows of units."""
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def near_lines(a, b):
    """One edit of words where both lines have ten or more, else of characters, for lines of ten characters or more."""
    v, w = a.split(), b.split()
    if len(v) >= 10 and len(w) >= 10:
        return abs(len(v) - len(w)) <= 1 and edits(v, w) <= 1
    return min(len(a), len(b)) >= 10 and abs(len(a) - len(b)) <= 1 and edits(a, b) <= 1


def without_near_lines(rows):
    first = {}
    for d, t in rows:
        for p, line in enumerate(t.split("\n")):
            first.setdefault(line, (d, p))
    near = {a for a in first if any(first[b] < first[a] and near_lines(a, b) for b in first)}
    return {d: "\n".join(line for p, line in enumerate(t.split("\n")) if first[line] == (d, p) and line not in near) for d, t in rows}, near


@pytest.mark.parametrize("least", [10, 2])
def test_line_dedup_is_brute_force(spark, least):
    """Lines around the least number of words, and short ones, whose edits are of characters."""
    rng = np.random.default_rng(least)
    words = [f"w{i}" for i in range(12)]
    base = [[str(x) for x in rng.choice(words, int(rng.integers(least, least + 4)))] for _ in range(12)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(4):
            w = list(base[int(rng.integers(12))])
            kind, at = int(rng.integers(6)), int(rng.integers(len(w)))
            if kind == 1:
                w[at] = "z" + str(rng.integers(3))
            elif kind == 2:
                w.insert(at, str(rng.choice(words)))
            elif kind == 3:
                del w[at]
            elif kind == 4:
                w[at] += ","
            elif kind == 5:
                w[at] = w[at][:1] + " " + w[at][1:]
            lines.append(" ".join(w))
        rows.append((d, "\n".join(lines)))
    truth, near = without_near_lines(rows)
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.clean_text for r in out} == truth and near


def test_line_dedup_tells_orders_apart(spark):
    """Lines that have the same pairs of neighbouring words in another order, and lines near to just one of them."""
    one, two = "s a p1 p2 p3 p4 a q1 q2 q3 q4 a e", "s a q1 q2 q3 q4 a p1 p2 p3 p4 a e"
    rows = list(enumerate([one, two, two + " zz", one + " yy", one.replace("p2", "p9"), "😀 ab cd ef gh", "😁 ab cd ef gh", "😀 ab cd ef ghi", "a" * 9, "a" * 10, "a" * 11]))
    truth, near = without_near_lines(rows)
    assert {two + " zz", one + " yy"} <= near
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.clean_text for r in out} == truth


def test_pipeline_stages(spark, texts):
    """Each stage against what it must do to its own input, and the last against the tokens that came in."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "minhash_dedup", "mixing", "packing"]
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen[-1], SF)
        assert out.columns == docs.columns
        seen.append(corpus_pipeline.written(out))
    rows = [{r.doc_id: r.text for r in d.collect()} for d in seen]
    assert set(rows[1]) <= set(rows[0]) and len(rows[1]) >= 0.95 * len(rows[0]) and all(rows[1][i] == rows[0][i] for i in rows[1])
    lines = [line.strip() for t in rows[2].values() for line in t.split("\n") if line.strip()]
    assert len(lines) == len(set(lines)) and {line.strip() for t in rows[2].values() for line in t.split("\n")} <= {line.strip() for t in rows[1].values() for line in t.split("\n")}
    truth = brute_components({i: shingle_set(t) for i, t in rows[2].items()})
    assert set(rows[3]) == {i for i in truth if truth[i] == i}
    assert set(rows[4]) == set(rows[3])
    packed = corpus_pipeline.STAGES[-1][1](spark, seen[4], SF).collect()
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed)
    assert collections.Counter(r.doc_id for r in packed if r.piece == 0) == collections.Counter(r.doc_id for r in seen[4].collect())
