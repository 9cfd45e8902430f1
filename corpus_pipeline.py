"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.llm import line_dedup, packing, quality, simhash, suffix_dedup
from talkweave.llm.common import discard, saved, table


def _measured(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars as their texts now are."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier, trained on labelled ones of this stage's input, rejects."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out every line that is similar to an earlier one; a document all of whose lines go stays, empty."""
    return _measured(line_dedup.drop_repeated_lines(docs))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies, the one with the smallest id; null and empty texts are copies of each other."""
    return simhash.keep_one(docs)


def remove_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated strings of 400 bytes out of the texts; a character that is cut through goes as a whole."""
    return _measured(suffix_dedup.remove_repeats(docs).withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept_text"))).select(*docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents left, empty ones too, into sequences of 4,096 tokens; rows are pieces."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_good_documents),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", keep_one_of_near_duplicates),
    ("suffix-array dedup", remove_repeated_strings),
    ("best-fit packing", pack_sequences),
]

#: No stage can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        after = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            after = saved(after, "stage")
            if n:
                discard(docs)
        docs = after
    return docs
