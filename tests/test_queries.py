"""Every query with SQL against DuckDB on the smallest tables."""

import pytest

from tests.conftest import SF, same_rows
from tidemark.plans import catalogue


@pytest.mark.parametrize("name", catalogue.ORACLE)
def test_matches_sql(spark, duck, name):
    same_rows(catalogue.QUERIES[name](spark, SF), duck, catalogue.ORACLE[name])


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalogue.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_packed_chunks_fold(spark):
    """The fold against a loop."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()
    truth = []
    for r in rows:
        done, held = [], ""
        for p in (x.strip(" ") for x in r.text.split("\n")):
            if len(p) <= 20:
                continue
            if held == "" or len(held) + 1 + len(p) <= 512:
                held = p if held == "" else f"{held}\n{p}"
            else:
                done.append(held)
                held = f"{held[-128:]}\n{p}"
        truth += [(r.doc_id, i, c) for i, c in enumerate([*done, held] if held else done)]
    from tidemark.operators.text import packed_chunks

    df = spark.createDataFrame(rows)
    assert sorted(map(tuple, packed_chunks(df, "doc_id", "text", separator="\n").collect())) == sorted(truth)
