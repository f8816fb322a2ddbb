"""The corpus pipeline: documents in the languages that were asked for, without copies and benchmark passages, mixed and laid out for training.

Each stage takes (spark, docs, folder) and returns a DataFrame that is written as Parquet and read again as the
next one's docs. Null, empty and wordless texts are rejected by the first stage; rows with a null doc_id pass
the others, since nothing can name them. Extra columns are carried along up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablecraft.llm.common import saved
from tablecraft.llm.decontaminate import contaminated
from tablecraft.llm.language import fit_language_model, predict_languages
from tablecraft.llm.mixture import mix_sources
from tablecraft.llm.near_text import near_duplicates
from tablecraft.llm.queries import TARGETS, tier_of
from tablecraft.llm.training_order import in_training_order


def known_languages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that language ID does not reject."""
    judged = predict_languages(docs, fit_language_model(docs), prefix="_language_")
    return judged.filter("NOT _language_rejected").select(*[F.col(f"`{c}`") for c in docs.columns])


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id is not among ``ids`` (column gone); extra columns may have any name."""
    return docs.join(ids, docs["doc_id"] == ids["gone"], "left_anti")


def one_of_each(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    return without(docs, saved(near_duplicates(docs).filter("NOT kept").select(F.col("doc_id").alias("gone")), "copies"))


def uncontaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a benchmark item."""
    found = contaminated(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))
    return without(docs, saved(found.select(F.col("doc_id").alias("gone")).distinct(), "leaks"))


def mixed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents by the target weights; one that is used twice is there twice."""
    return mix_sources(docs, TARGETS, tier_of(F.col("source"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def training_order(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token records in training order, read back from the shards."""
    return in_training_order(spark, docs)


STAGES = [
    ("language_id", known_languages),
    ("near_dedup", one_of_each),
    ("decontamination", uncontaminated),
    ("mixing", mixed),
    ("training_order", training_order),
]

#: The stages are learned models, hashing and files, which SQL cannot express; tests/llm checks them by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
