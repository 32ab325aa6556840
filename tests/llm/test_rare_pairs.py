"""What the prefix filter of op8 compares within and between components."""

import random

from pyspark.sql import functions as F

from tidemark.llm import minhash_dedup
from tests.llm.test_oracles import shingle_set


def _group(n, seed, words=80, changed=4):
    rng = random.Random(seed)
    base = [f"g{seed}_{i}" for i in range(words)]
    return [" ".join(f"x{seed}_{i}_{k}" if k in spots else w for k, w in enumerate(base)) for i in range(n) for spots in [set(rng.sample(range(words), changed))]]


def test_rare_pairs_leave_a_component_alone(spark):
    """Rows of one large component meet nothing, those of others meet it: no more pairs than sets outside times all."""
    large = _group(150, 1)
    outside = [*_group(3, 2), large[0].replace("g1_79", "y1").replace("g1_78", "y2")]
    rows = [(i, t, 0 if i < len(large) else i) for i, t in enumerate([*large, *outside])]
    df = spark.createDataFrame(rows, "rep long, text string, component long")
    out = minhash_dedup._rare_pairs(df.select("rep", "component"), df.select(F.col("rep").alias("doc_id"), "text"), 5, 75).collect()
    pairs = {(min(r.rep, r.rep_b), max(r.rep, r.rep_b)) for r in out}
    sets, component = {i: shingle_set(t) for i, t, _ in rows}, {i: c for i, _, c in rows}
    linked = {(a, b) for a in sets for b in sets if a < b and component[a] != component[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert linked <= pairs and linked
    assert all(component[a] != component[b] for a, b in pairs) and len(pairs) <= len(outside) * len(rows)


def test_rare_pairs_between_many_components(spark):
    rows = [(i, t, i) for i, t in enumerate([*_group(40, 3), *_group(40, 4, changed=2)])]
    df = spark.createDataFrame(rows, "rep long, text string, component long")
    out = minhash_dedup._rare_pairs(df.select("rep", "component"), df.select(F.col("rep").alias("doc_id"), "text"), 5, 75).collect()
    sets = {i: shingle_set(t) for i, t, _ in rows}
    linked = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert linked and linked <= {(min(r.rep, r.rep_b), max(r.rep, r.rep_b)) for r in out}
