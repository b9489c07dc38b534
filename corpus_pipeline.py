"""The corpus pipeline: toxicity, exact dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; every stage but the last returns the
columns of ``documents``. A stage's result is written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from admeridian.llm import exact_dedup, mixing, near_copies, packing, toxicity
from admeridian.llm.common import documents, own_tables, staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Learned scores, fingerprints and token ids are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage has written for itself goes when its result stands."""
    docs = documents(spark, sf_dir)
    with own_tables(spark) as drop:
        for name, stage in STAGES[:-1]:
            docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            drop(docs)
        return STAGES[-1][1](spark, docs, sf_dir)
