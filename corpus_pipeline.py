"""The training-data pipeline: quality rules, language, near-duplicates, source mix, packing.

Null, empty and wordless texts go with the quality rules, as do texts under 50 words; so do not reach later stages of a
run. Each stage by itself states what becomes of them, of ties, repeated rows and a null doc_id (see the operator that
it calls). Columns besides doc_id, text, lang and source travel along, whatever they are called; an empty table of
documents gives empty stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxmend.llm.common import table, written
from voxmend.llm.langid import keep_identified
from voxmend.llm.mixing import repeated_as_mixed
from voxmend.llm.packing import packed
from voxmend.llm.quality import keep_good
from voxmend.llm.queries import PACKING_END_ID, vocabulary_path
from voxmend.llm.similar import one_of_similar


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_good(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the byte network, fitted on docs, cannot tell go; if no document has a lang, all stay."""
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose sets of 5-word shingles are similar by 0.8 or more, found by SimHash prints and decided
    on the sets, the one with the smallest doc_id stays."""
    return one_of_similar(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or dropped as the source mix takes them."""
    return repeated_as_mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces with their places in sequences of at most 4096 tokens."""
    return packed(docs, vocabulary_path(), PACKING_END_ID)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("pack", pack),
]

#: Rolling coverage of n-grams, a trained network and the order of packing have no SQL form; tests hold the stages
#: against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's result written to the shared folder and read back for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
