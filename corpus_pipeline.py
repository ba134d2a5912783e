"""From documents to token files, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm import decontamination, mixing, ngram_join, quality, token_file
from ebbtide.llm.common import bounded_batches, fresh, if_small
from ebbtide.llm.queries import table, vocabulary
from ebbtide.session import work_folder


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    bounded_batches(spark)
    return ngram_join.one_of_each(docs, size=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Rows are told apart by a hash of
    id and text, so those without an id are searched, and another text with
    the id of a row that goes stays."""
    key = F.xxhash64("doc_id", "text")
    found = decontamination.leaks(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    name = fresh("_gone", docs.columns)
    gone = if_small(found.select(F.col("doc_id").alias(name)).distinct())
    return docs.join(gone, key == F.col(name), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights; texts may be repeated or cut."""
    bounded_batches(spark)
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and what they hold per document."""
    bounded_batches(spark)
    return token_file.token_files(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_good),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mix", mix_sources),
    ("token_ids", write_tokens),
]

#: A trained classifier and a tokenizer have no SQL form; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = work_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
