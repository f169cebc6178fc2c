"""From documents to token shards: the stages of the training-data pipeline.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept and returns a
DataFrame, which is written and read again for the next. All but the last return the columns of ``documents``, whatever
their names. Rows may have nulls in any column and may repeat; an empty table goes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm import decontaminate, mixing, neardup, quality, tokenfiles
from folioflow.llm.common import cut


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: what they reject goes, null and blank texts among it. Rows are judged alone, so repeated ones alike."""
    return quality.good_documents(docs)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicates by five-word shingles at 0.8: the least doc_id of each group stays, and one of rows that are equal in doc_id
    and text. Rows without doc_id or words are in no group and stay."""
    return neardup.drop_near(docs, neardup.Near(shingle=5))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; items need no id. Null and blank texts hold none, and null or blank items are none."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, up to twice. A null source is a source; texts without a word are
    taken never; repeated rows and rows without doc_id are documents of their own."""
    return mixing.mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards; (doc_id, start, n_tokens, ids_crc32) as read back from them. Null texts are the end id alone; null
    doc_ids come first; rows with one doc_id are stored each."""
    import public_tokenizers

    return tokenfiles.token_tables(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_group),
    ("decontaminate", keep_clean),
    ("mix", mix),
    ("tokens", tokens),
]
#: Rounding after Newton iterations and a byte-pair encoding are beyond SQL; tests/llm/test_pipeline.py holds each stage
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, one after another."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
