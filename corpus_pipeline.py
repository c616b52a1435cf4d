"""A corpus pipeline: quality rules, quality classifier, line dedup, near-duplicate join, packing.

Every stage takes the documents (doc_id, text, lang, source, n_chars, and any other columns) that its predecessor kept,
and all but the last return them with the same columns. Null texts fail the quality rules and so go at once; rows that
repeat an id and its text leave the near-duplicate stage once; rows with a null id pass all stages; empty tables give
empty results. Texts of any length are taken whole, and ties go to the smaller id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cohortrank.llm import jaccard_join, line_templates, packing, quality_model, quality_rules
from cohortrank.llm.common import materialise, read_table
from cohortrank.llm.queries import END_ID, SEQUENCE


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or that the removal of their host's frequent lines depletes, go; the others
    lose those lines."""
    return quality_rules.apply_rules(docs, length_col="n_chars")


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The classifier learns from the whole labelled table; documents that it predicts to be bad go."""
    return quality_model.keep_good(docs, quality_model.learn(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur stay in the document of smallest id only. Documents that had words and have none left,
    such as copies, go with them."""
    return line_templates.drop_recurring_lines(docs, length_col="n_chars", short=True, emptied=False)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of smallest id stays; documents without words link with nothing."""
    return jaccard_join.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places; a document without words is the end token alone."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), SEQUENCE, END_ID)


STAGES = [
    ("quality_rules", quality_stage),
    ("quality_classifier", classifier_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

#: The tokenizer, the classifier and the template tree are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder and read back."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
