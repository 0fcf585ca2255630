"""The corpus pipeline: stages over documents, each written as Parquet and read again for the next.

Rejected documents go, recurring lines go and with them the documents that they
leave hardly anything of, one document of each group of near duplicates stays,
the rest is put in the order of the mixture and packed: the sequences follow the
mixture. All stages but the last keep the columns of documents, and those of
other names besides; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from forumlake.llm import line_dedup, mixing, near_dedup, packing, quality
from forumlake.llm.common import cut, table
from forumlake.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules. Null and empty texts fail; repeated rows are judged each; a null doc_id has no label."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their recurring lines. Null texts stay null; rows of equal doc_id and text lose the same lines; ties go to the smaller doc_id, null first."""
    return line_dedup.without_recurring_lines(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates by five-word shingles. Texts without words and rows with a null doc_id stay; repeated rows stay once."""
    return near_dedup.keep_one(docs, width=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture, by size ** 0.5 of their source; a null source is one of its own; repeated rows stay."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens, in the mixture's order; null and empty texts hold the end id alone; repeated rows are packed each."""
    # Rows of a table have no order, so the places in the mixture, which follow from the rows alone, are worked out again.
    return packing.pack_in_order(spark, mixing.mix(docs), tokenizer_path(), end_id=0, capacity=2048)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: The stages hash, sketch and tokenize; SQL cannot state them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
