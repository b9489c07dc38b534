"""Materialised intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: list[str] = []
PARTIAL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else the warehouse; a session on one machine (a local master) may take a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="spark-admeridian-"))
    return _own[0]


def materialised(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` and reads it back: later passes scan a table instead of repeating the plan, and survive lost executors."""
    path = f"{shared_dir(df.sparkSession)}/admeridian/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_keys(df: DataFrame, *keys: str | Column) -> DataFrame:
    """``df`` dealt by ``keys``; what lies so already is not moved. Groups that have them among their keys and joins by them move nothing."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def by_account(df: DataFrame) -> DataFrame:
    """``df`` dealt by account; what lies so already is not moved. Joins and groups that have the account among their keys move nothing."""
    return by_keys(df, "account_id")


@contextmanager
def as_it_lies(spark: SparkSession) -> Iterator[None]:
    """What runs meanwhile joins rows that lie by account as they lie, also where a join has further keys. As a rule Spark would deal
    both sides anew by all keys."""
    usual = spark.conf.get(PARTIAL_KEYS)
    spark.conf.set(PARTIAL_KEYS, "false")
    try:
        yield
    finally:
        spark.conf.set(PARTIAL_KEYS, usual)


def dealt(df: DataFrame, label: str, *order: str) -> DataFrame:
    """``materialised``, in buckets by account: what is read lies as ``by_account`` deals, in order of account and ``order``."""
    spark = df.sparkSession
    name = f"dealt_{uuid.uuid4().hex}"
    keys = ["account_id", *order]
    rows = by_account(df).sortWithinPartitions(*keys).write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "account_id").sortBy(*keys)
    with as_it_lies(spark):
        rows.option("path", f"{shared_dir(spark)}/admeridian/{label}-{name}").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # of the catalogue alone, the files stay
    return out


# --- upserts ---


def upsert_replace(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row of each key by ``order``; among equals the new one. ``old`` and ``new`` have the same columns."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("_new"))
    return rows.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_new", "_rank")


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` whose key is unknown; of several such rows of one key the first by all columns."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c) for c in new.columns if c not in keys] or [F.lit(1)])
    fresh = new.join(old.select(*keys), keys, "left_anti").withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")
    return old.unionByName(fresh.select(*old.columns))


def upsert_columns(old: DataFrame, new: DataFrame, keys: list[str], updated: list[str]) -> DataFrame:
    """Updates only ``updated`` columns of known keys, where the new value is not null; unknown keys are inserted whole."""
    a, b = old.alias("a"), new.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    pick = lambda c: F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")) if c in updated else F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}"))
    return a.join(b, on, "full_outer").select(*[pick(c).alias(c) for c in old.columns])
