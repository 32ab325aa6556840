"""A corpus pipeline of five operators: from documents to packed sequences.

Every stage takes the columns of documents (others pass through, whatever their names) and does the same at every size. Texts are
worked on whole, however long. An empty table goes through every stage and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.language_id import drop_rejected
from tidemark.llm.line_dedup import without_repeated_lines
from tidemark.llm.minhash_dedup import one_of_each_group
from tidemark.llm.mixing import mixed
from tidemark.llm.packing import best_fit_packing
from tidemark.llm.shared import written
from tidemark.sources import table

#: No source is used more than so many times as often as another, and every document at least once.
REPETITION_LIMIT = 1.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model rejects go.

    Null and empty texts, and those without a letter, have no language and go. Null ids and labels do no harm; repeated rows are
    judged alike. Without any labelled text nothing can be learned, and all stay.
    """
    return drop_rejected(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents that had no others.

    Of equal lines the one in the smallest id, and there the first, stays; a repeated row loses its lines to the first. Blank lines are
    kept where they are. Null and empty texts have no lines that were seen before, and stay.
    """
    return without_repeated_lines(docs)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id.

    Texts without words are near to nothing and stay, as do rows with a null id; rows that share the id that stays are all kept.
    """
    return one_of_each_group(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of small sources are repeated, as flat a mixture as the repetition limit allows.

    Null sources are one source of their own. A single source is used once. Null and empty texts count no words.
    """
    return mixed(docs, REPETITION_LIMIT)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens. Null and empty texts are their end mark alone; repeated rows are packed each."""
    return best_fit_packing(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("minhash_dedup", minhash_dedup), ("mixing", mixing), ("packing", packing)]
#: SQL can express neither k-means nor tokenizers; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's are written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
