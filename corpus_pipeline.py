"""From raw documents to packed sequences, stage by stage; each stage's rows are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import decontaminate, langid, minhash, packing, pii
from tallyloom.llm.common import keep
from tallyloom.llm.queries import table, vocabulary


def language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose language can be told (2); texts without letters go."""
    return langid.with_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The first document of each group of near duplicates (7)."""
    kept = minhash.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("_kept"))
    return docs.join(kept.distinct(), F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no item of ``benchmark`` (8)."""
    return decontaminate.clean(docs, table(spark, folder, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents with personal data masked in the text (4)."""
    return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of all remaining documents with their place in the sequences (1)."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``; no SQL can express tokens, so the tests compare with brute force."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, folder), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, folder)
