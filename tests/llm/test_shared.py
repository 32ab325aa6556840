"""Scratch tables lie in the session's own scratch folder and can be cleaned away."""

from tidemark.llm import shared


def test_scratch_tables(spark):
    folder = shared.scratch_dir(spark)
    assert folder == shared.scratch_dir(spark)
    kept = shared.written(spark.range(5))
    assert kept.count() == 5 and all(f"{folder.split(':')[-1]}/tables/" in f for f in kept.inputFiles())
    assert shared.checkpointed(spark.range(3)).count() == 3
    shared.clean(spark)
    assert shared.written(spark.range(2)).count() == 2
