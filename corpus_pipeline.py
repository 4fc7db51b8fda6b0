"""A corpus pipeline: quality, near duplicates, benchmark leaks, source mix, shards.

Rows are judged by their texts and ids: null and empty texts are scored as the empty text, and all of them are one group
of near duplicates. Rows without an id pass the first three stages. Rows that share an id go together where one of them
is rejected or holds a benchmark item; of rows that repeat the id that stays in a group, one stays. Columns of documents
are kept whatever their names, but for those that the last stage adds (size, text_crc32, law, shard, slot, grown_shard),
which replace columns so named. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gapline.llm.common import delete, job, new_path
from gapline.llm.decontaminate import decontaminate
from gapline.llm.mixing import mixed_documents
from gapline.llm.quality import keep_good
from gapline.llm.sharding import shard_documents
from gapline.llm.simhash import keep_one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that the quality classifier accepts."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingle sets with a similarity of 0.8 or more."""
    return keep_one(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that contain a benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs as the mix of sources takes them, repeated where it takes them twice."""
    return mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with size, checksum, law, shard and slot."""
    return shard_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("quality", quality), ("near_duplicates", near_duplicates), ("leaks", leaks), ("mix", mix), ("shards", shards)]

#: A trained classifier and seeded MinHash bands have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again, and what only earlier stages needed is deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_path(spark, name)
        with job(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
