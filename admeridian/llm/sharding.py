"""Sharding by a keyed permutation of global row numbers.

Rows are numbered 0 to N-1 in key order by a range-partitioned sort and per-partition offsets. A four-round Feistel network
permutes the numbers below the next power of four; numbers that leave 0 to N-1 walk on round their cycle until they are back
in it. The permuted number p gives shard ``p % shards`` and slot ``p // shards``: both are computable from the row number and
the seed alone, shard sizes differ by one at most, and a rerun gives the same shuffle.

Defined results: rows are numbered by (key, size, checksum), nulls first, so rows that agree in all three may change places
without any visible effect; a null text has size 8 and the checksum of the empty string; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from admeridian.llm.common import fresh_name, staged

SHARDS, SEED, ROUNDS = 24, 20240607, 4


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser as round function."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def permute(numbers: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """The bijection of 0..n-1 that ``seed`` stands for, applied to each of ``numbers``."""
    if n < 2:
        return numbers.astype(np.int64)
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & low
        for r in range(ROUNDS):
            left, right = right, left ^ (_mixed(right, (seed * ROUNDS + r) & (2**63 - 1)) & low)
        return (left << np.uint64(half)) | right

    out = once(numbers.astype(np.uint64))
    while (outside := out >= n).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def numbered(df: DataFrame, order: list[str], name: str = "row_number", partitions: int | None = None) -> DataFrame:
    """``df`` with the global number of each row in the order of ``order``; the table is written once, so numbers are fixed."""
    part, place, ahead, n = (fresh_name(df, x) for x in ("part", "place", "before", "n"))
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    schema = T.StructType([*df.schema.fields, T.StructField(part, T.IntegerType()), T.StructField(place, T.LongType())])

    def count(batches):
        from pyspark import TaskContext

        at, own = 0, TaskContext.get().partitionId()
        for batch in batches:
            n = batch.num_rows
            columns = [*batch.columns, pa.array(np.full(n, own, np.int32)), pa.array(np.arange(at, at + n, dtype=np.int64))]
            at += n
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    placed = staged(ranged.sortWithinPartitions(*order).mapInArrow(count, schema), "numbered")
    sizes = placed.groupBy(part).agg(F.count("*").alias(n))  # one row per partition
    before = Window.partitionBy(F.lit(0)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(ahead))
    return placed.join(F.broadcast(offsets), part).withColumn(name, F.col(ahead) + F.col(place)).drop(part, place, ahead)


def shards_of(rows: DataFrame, order: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``rows`` with ``shard`` and ``slot`` (with underscores in front where ``rows`` has such columns) by the permutation of their
    numbers in the order of ``order``."""
    at, to = fresh_name(rows, "row_number"), fresh_name(rows, "permuted")
    table = numbered(rows, order, at)
    n = table.count()

    @F.pandas_udf("long")
    def permuted(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), n, seed))

    table = table.withColumn(to, permuted(F.col(at)))
    return table.withColumns({fresh_name(rows, "shard"): (F.col(to) % shards).cast("int"), fresh_name(rows, "slot"): F.floor(F.col(to) / shards).cast("long")}).drop(at, to)


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``."""
    text = F.col(text_col)
    slim = docs.select(F.col(id_col).alias("doc_id"), size_of(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    out = shards_of(slim, ["doc_id", "size", "text_crc32"], shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
