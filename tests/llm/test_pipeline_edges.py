"""The pipeline on empty, odd and clashing tables: what each stage does, and that a run ends with pieces of what was kept."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ", key int, rep int, block int, mix_row int, digest string, piece int, shard int, row string"
GOOD = {
    "en": "the quick brown fox jumps over the lazy dog and then it runs away from here number {} of the long old story about foxes",
    "de": "der schnelle braune fuchs springt ueber den faulen hund und dann laeuft er weg von hier nummer {} der langen alten geschichte",
}


def odd_documents(spark):
    rows = [(10 * i + k, GOOD[lang].format(i) + "\n" + " ".join(f"{lang}{i}w{j}" for j in range(30)), lang, lang) for i in range(20) for k, lang in enumerate(GOOD)]
    rows += [(1000, rows[0][1], "en", "en"), (1001, None, "en", "en"), (1002, "", None, None), (1003, "12345 !!!", "en", "en"), (None, GOOD["en"].format("none") + " extra", "en", None), (1004, "\n \n", "de", "de")]
    rows += [(1005, GOOD["de"].format(77) + " " + "wort um wort geht es weiter und weiter " * 5000, "de", None)] * 2
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], COLUMNS)
    return df.select("*", *(F.lit(str(k)).cast(c.split()[1]).alias(c.split()[0]) for k, c in enumerate(CLASHING.strip(", ").split(", ")))).repartition(3)


def test_stages_on_odd_rows(spark, tmp_path):
    docs = odd_documents(spark)
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    ids = {n: [r.doc_id for r in rows] for n, rows in kept.items()}
    assert not {1001, 1002, 1003, 1004} & set(ids["language_id"])  # no language
    assert 1000 not in ids["minhash_dedup"] and {0, None} <= set(ids["language_id"])
    assert set(ids["minhash_dedup"]) <= set(ids["line_dedup"]) <= set(ids["language_id"]) and set(ids["mixing"]) == set(ids["minhash_dedup"])
    assert all(r.text is not None for n in ("line_dedup", "minhash_dedup", "mixing") for r in kept[n])
    pieces = kept["packing"]
    assert {r.doc_id for r in pieces} == set(ids["mixing"]) and max(r.length for r in pieces) <= 2048
    ends = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, 0)]])
def test_run_on_hardly_any_rows(spark, tmp_path, rows):
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) == len(rows) and [r.length for r in out] == [1] * len(rows)
