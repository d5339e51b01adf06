"""A corpus from raw documents to packed sequences: each stage reads what the one before it wrote.

Stages keep the columns of documents, but for the last, which gives one row a packed piece. A document whose text a
stage removes wholly goes with it; n_chars follows the text. Every stage gives no rows for an empty table and keeps other
columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import langid, lines, minhash, packing, suffixes
from quillon.llm.common import Scratch, bounded_batches, columns_of, read_table


def _shortened(docs: DataFrame, new: DataFrame) -> DataFrame:
    """new in the columns of docs, n_chars counted anew, without the rows that were emptied."""
    counted = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return new.filter(F.col("text").isNull() | (F.col("text") != "")).withColumns(counted).select(*columns_of(docs))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by a clear margin. Null texts, and those without a letter, go; repeated rows share their fate."""
    bounded_batches(spark)
    return langid.told(docs, langid.fit_on_unheld(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of recurring templates. Null and empty texts pass; repeated rows count as one text, and lose alike."""
    bounded_batches(spark)
    return _shortened(docs, lines.dedup(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id. Texts without words are in no group; of rows equal in doc_id and text one stays."""
    bounded_batches(spark)
    return minhash.dedup(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of over 50 words (240 bytes) that stand elsewhere too. Null texts pass; rows that repeat lose their whole text."""
    bounded_batches(spark)
    return _shortened(docs, suffixes.cut(docs, suffixes.PASSAGE))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in packed sequences. A null or empty text is the closing id alone; repeated rows are packed each."""
    import public_tokenizers as P

    bounded_batches(spark)
    return packing.pack(docs, P.path("byte_bpe_50k.json"), P.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("packing", sequences),
]

#: SQL can express neither compression nor tokenizers. tests/llm holds near_dedup, passage_dedup, packing and line_dedup
#: against brute force and language_id against held-out rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = read_table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.table(docs)
    return docs
