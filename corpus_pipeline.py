"""A pipeline over documents: quality, exact copies, near copies, benchmark passages, mixing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; its result is written as Parquet and read
again as the docs of the next. All but the last return the columns of documents; the last returns them
once for each copy that the mix takes, with the number of the copy.

Stages take any rows: null and empty texts (kept by all but the stages that find them to be copies, of which one
stays, and mixing, which takes documents without words 0 times), null ids (near copies without an id stay),
very long texts (read whole), repeated rows and ties (as the operators' docstrings say: one of equal rows
stays), extra columns, whatever their names (kept), and empty tables (no rows, the same columns).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from spoor.llm import decontaminate, exact_dedup, mixing, quality, simhash
from spoor.llm.common import shared_dir, table
from spoor.llm.queries import WEIGHTS


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs, stored=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, stored=True)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), stored=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.copies(docs, WEIGHTS)


STAGES = [
    ("quality", keep_good_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_passages),
    ("mixing", mix_sources),
]

#: A learned classifier and hashed rounding have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each read from what the one before it wrote in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
