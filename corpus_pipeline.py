"""A corpus pipeline of five stages over ``documents``, each written as Parquet and read again by the next.

Toxic documents go, then documents of low quality, then all but the least document of every near-duplicate group,
then contaminated documents; what is left is encoded.  Every stage but the last returns the columns of its input.

Decisions are joined back by doc_id.  A null doc_id has no key to join by, so such rows pass the filters.  Rows that
repeat a doc_id share its fate if any of them is rejected; of rows that repeat a kept doc_id with near-equal text,
all stay.  Empty input passes through; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, new_dir, read_table
from graphloom.llm.op4_bpe import digests, round_trip
from graphloom.llm.op6_minhash import near_duplicate_groups
from graphloom.llm.op7_decontamination import contamination
from graphloom.llm.op9_toxicity import toxicity
from graphloom.llm.op10_quality import quality


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``rejected`` holds doc_id; it is written first, so that models are applied once."""
    gone = materialize(rejected.select(F.col("doc_id").alias("_gone")).filter("_gone is not null").distinct(), "rejected")
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, toxicity(docs, read_table(spark, sf_dir, "labels")).filter("predicted = 1"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, quality(docs, read_table(spark, sf_dir, "labels")).filter("predicted = 0"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, near_duplicate_groups(docs).filter("doc_id <> class_id"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, contamination(docs, read_table(spark, sf_dir, "benchmark")).filter("contaminated"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids, and the digests of ids and decoded text."""
    coded = round_trip(docs)
    return digests(coded, "ids")


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

#: Trained models can't be expressed in SQL; every stage is tested against the rows that its operator rejects.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
