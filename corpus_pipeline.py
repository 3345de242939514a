"""From raw documents to packed training sequences, in five stages.

Each stage works on what the one before kept: documents whose language is unknown go, the
others get the language that was found; then those that the quality classifier rejects go,
then all but one of each group of near copies; the rest are sampled towards target weights
of domains and packed into windows.

Defined cases, for every stage: an empty table gives no rows; extra columns of ``documents``,
whatever their names, are carried to the last stage; null and repeated doc_ids are carried
row by row, and what is decided of a row never removes another row with its id; texts of
any length are read whole.  A null text or one without a letter has no language and goes.
Ties: the language first in order; of near copies the least doc_id, null ids last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from provloom.llm import classifier, language
from provloom.llm.mixing import resample
from provloom.llm.ngram_join import keep_firsts
from provloom.llm.packing import pack_documents
from provloom.llm.queries import MIX_WEIGHTS, domain_model, language_model, quality_model, tokenizer_file
from provloom.storage import Scratch, load


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with a language, and that language as their ``lang``."""
    return language.keep_rows(docs, language_model(docs), column="lang")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of good quality; a null text, were there one, scores as the empty text does."""
    return classifier.keep_rows(docs, quality_model(spark, docs, sf_dir))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked texts; texts without words all stay."""
    return keep_firsts(docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its rate says, 0 times included; the fraction is drawn by doc_id."""
    return resample(docs, domain_model(spark, docs, sf_dir), MIX_WEIGHTS, anchor="clean")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a packed window; a null text is its end id alone."""
    return pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), remembered=150_000)


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard", near_copies),
    ("mixing", mix_to_weights),
    ("packing", packing),
]

#: The learned models have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
