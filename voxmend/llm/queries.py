"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table.

What becomes of nulls, empty and very long texts, ties, repeated rows, empty tables and columns with clashing names is
stated by the operator that a query applies; a query adds nothing to it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxmend.llm import oracles
from voxmend.llm.codes import encode_documents
from voxmend.llm.common import table
from voxmend.llm.htmltext import extract
from voxmend.llm.langid import fit, identify
from voxmend.llm.lm import scores
from voxmend.llm.mixing import mix
from voxmend.llm.packing import packed
from voxmend.llm.quality import quality_rules
from voxmend.llm.simhash import near_duplicates
from voxmend.llm.urls import judge
from voxmend.llm.winnow import edited_likeness

#: The vocabulary file of the queries that count tokens, and the ids that end a document in them.
VOCABULARY = "word_bpe_49k.json"
CODES_END_ID = 2
PACKING_END_ID = 1


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_addressable_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """encode_documents over documents: ids are written as segments and read back."""
    return encode_documents(table(spark, sf_dir, "documents"), vocabulary_path(), CODES_END_ID)


def op2_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quality_rules over documents."""
    return quality_rules(table(spark, sf_dir, "documents"))


def op3_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """packed over documents, 4096 tokens a sequence."""
    return packed(table(spark, sf_dir, "documents"), vocabulary_path(), PACKING_END_ID)


def op4_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identify over documents, by a network fitted on a sample of those not held out."""
    documents = table(spark, sf_dir, "documents")
    return identify(documents, fit(documents))


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edited_likeness over documents."""
    return edited_likeness(table(spark, sf_dir, "documents"))


def op6_recurrent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scores over documents."""
    return scores(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates over documents, at 4 words and 4 bits."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_boosted_dom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """extract over pages."""
    return extract(table(spark, sf_dir, "pages"))


def op9_redirect_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judge over pages, by the production rules."""
    return judge(table(spark, sf_dir, "pages"))


def op10_golden_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix over documents, columns of the digest only."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline over documents, the last one's rows."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_addressable_codes, op2_repetition_rules, op3_best_fit, op4_byte_cnn, op5_winnowing, op6_recurrent_scores, op7_simhash, op8_boosted_dom, op9_redirect_rules, op10_golden_mix, pipeline)}
#: Other operators have no SQL form (hashes and vocabularies that SQL lacks, trained models, packing): tests hold them
#: against plain versions.
ORACLES: dict[str, str] = dict(oracles.SQL)
