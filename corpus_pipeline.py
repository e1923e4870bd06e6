"""Documents to packed training sequences, in five stages.

Each stage is written as Parquet and read again by the next, and keeps all
columns of documents, extra ones of any name included; an empty table gives no
sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from furlong.llm import decontaminate, lines, minhash, packing, quality, tokens
from furlong.llm.store import drop, load, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rules or lie outside the compression bands.

    Null and empty texts go; texts of any length are judged whole; rows without an
    id and repeated rows are judged each by itself; an empty table stays empty.
    """
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that an earlier document has, and documents of such lines only; n_chars follows the text.

    Null and empty texts and rows without an id stay as they are; rows of one id
    with different texts are different documents.
    """
    return lines.dedup_lines(docs, counts=False, length_col="n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each near-duplicate group, that of the smallest id.

    Rows without a word or an id stay; rows of one id with different texts are
    different documents, of equal rows one stays.
    """
    return minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a test item.

    Null and empty texts hold none; texts of any length are searched whole; each
    row is judged by itself, repeated ones too; an item at the threshold counts.
    """
    return decontaminate.keep_clean(docs, load(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut what is left into sequences of power-of-two lengths, with their token ids.

    A null or empty text is the end id alone; texts of any length are cut whole;
    each row is packed by itself, repeated ones too; an empty table gives no rows.
    """
    return packing.pack(docs, tokens.vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packed),
]
ORACLE_SQL = None
"""No SQL: compression ratios, sketches and token ids have no form there."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; the table between two stages is deleted once the next one is written."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
