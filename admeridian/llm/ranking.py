"""Distributed numbering of rows: within small-valued integer keys, and within any keys by an order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from admeridian.llm.common import fresh_name, staged


def ranked(df: DataFrame, key: str, most: int, name: str, label: str) -> DataFrame:
    """``df`` with ``name``: a gapless number from 0 among the rows of the same ``key`` (an integer from 0 to ``most``).

    Each task counts its own rows of each key; counts of earlier tasks are added from a table with one row per task and key,
    so no key, however frequent, is ever brought together. The table is written once, which fixes the numbers.
    """
    part, place = fresh_name(df, "part"), fresh_name(df, "place")
    schema = T.StructType([*df.schema.fields, T.StructField(part, T.IntegerType()), T.StructField(place, T.LongType())])

    def count(batches):
        from pyspark import TaskContext

        own, seen = TaskContext.get().partitionId(), np.zeros(most + 1, np.int64)
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(keys, kind="stable")
            values, first, n = np.unique(keys[order], return_index=True, return_counts=True)
            at = np.empty(len(keys), np.int64)
            at[order] = np.arange(len(keys)) - np.repeat(first, n) + np.repeat(seen[values], n)
            seen[values] += n
            columns = [*batch.columns, pa.array(np.full(len(keys), own, np.int32)), pa.array(at)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    placed = staged(df.mapInArrow(count, schema), label)
    sizes = placed.groupBy(key, part).agg(F.count("*").alias("n"))
    before = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(key, part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(name))
    joined = placed.join(offsets, [key, part])
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col(name) + F.col(place)).alias(name))


#: Rows of a key up to which one window numbers them.
MOST = 100_000


def in_order(rows: DataFrame, keys: list[str], order: list[str], place: str, sums: dict[str, str] | None = None, most: int = MOST) -> DataFrame:
    """``rows`` with ``place``, the number from 0 of a row among those of its ``keys`` by ``order`` (nulls first), and for each of
    ``sums`` (new name: column) the total over the rows before it.

    Keys of at most ``most`` rows take a window each. Rows of longer ones are dealt by ranges of keys and order and written; each
    range is numbered on its own, and the counts and totals of earlier ranges of the key, one small row each, are added. So no key
    is ever brought together. ``rows`` must give the same rows whenever it is read; rows alike in keys and order share a range.
    """
    sums = sums or {}
    fresh = {c: fresh_name(rows, c) for c in ("at", "range", "n", "before")} | {k: fresh_name(rows, f"long_{k}") for k in keys}
    over = Window.partitionBy(*keys).orderBy(*order)
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c, w: F.coalesce(F.sum(c).over(earlier(w)), F.lit(0))
    long = rows.groupBy(*keys).agg(F.count("*").alias(fresh["n"])).filter(F.col(fresh["n"]) > most).select(*[F.col(k).alias(fresh[k]) for k in keys])
    long = staged(long, "long-keys")
    numbered = lambda df: df.withColumns({place: (F.row_number().over(over) - 1).cast("long")} | {name: total(c, over) for name, c in sums.items()})
    if not long.head(1):
        return numbered(rows)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(fresh[k]))
    usual = numbered(rows.join(long, same, "left_anti"))
    split = rows.join(long, same, "left_semi").repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    split = staged(split.withColumn(fresh["at"], F.monotonically_increasing_id()), "ranges").withColumn(fresh["range"], F.shiftright(fresh["at"], 33))
    own = Window.partitionBy(*keys, fresh["range"]).orderBy(fresh["at"])
    ranges = Window.partitionBy(*keys).orderBy(fresh["range"])
    counts = split.groupBy(*keys, fresh["range"]).agg(F.count("*").alias(fresh["n"]), *[F.sum(c).alias(name) for name, c in sums.items()])
    names = {place: fresh["n"]} | {name: name for name in sums}
    offsets = counts.select(*[F.col(k).alias(fresh[k]) for k in keys], F.col(fresh["range"]).alias(fresh["before"]), *[total(c, ranges).alias(f"{name} before") for name, c in names.items()])
    local = split.withColumns({place: (F.row_number().over(own) - 1).cast("long")} | {name: total(c, own) for name, c in sums.items()})
    joined = local.join(offsets, same & (F.col(fresh["range"]) == F.col(fresh["before"])))
    return usual.unionByName(joined.select(*[F.col(f"`{c}`") for c in rows.columns], *[(F.col(name) + F.col(f"`{name} before`")).alias(name) for name in names]))
