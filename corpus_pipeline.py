"""A corpus from raw documents to packed sequences: each stage works on what the one before it kept.

Defined cases, of every stage but the last: all columns come back as they were, whatever their names, but for text and
n_chars where lines were dropped. A null or empty text fails the quality rules (fewer than 50 words), and a stage that
gets one all the same takes it as empty. Rows that repeat a doc_id or a text are judged alike; of near copies, exact
copies and repeated rows the one of the least doc_id stays; null doc_ids count after all others. Ties are decided by
doc_id and line. Texts of any length are worked on whole. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import decontaminate, line_dedup, packing, quality_rules, simhash
from textloom.llm.common import cut, scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose n-grams are likelier in trusted text."""
    return quality_rules.keep(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document, or an earlier line, has already."""
    return line_dedup.dedup(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of 13 benchmark words (nor a whole shorter item); op6's share is for its report alone."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences of 2,048 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is a table before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark, name) as remove:
            kept = stage(spark, docs, sf_dir)
        docs = cut(kept, name)
        remove()
    return STAGES[-1][1](spark, docs, sf_dir)
