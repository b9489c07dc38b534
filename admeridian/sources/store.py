"""Stored fact tables: a folder a day, and in each day a fixed number of buckets by key.

Loads touch the days they bring and no others: the stored rows of these days are read by their folders, merged, and the folders are
replaced; all other folders keep their files. Buckets by key mean that a merge, an insert-ignore or a join on the key reads the
stored side as it lies, without an exchange, as long as the other side is dealt to as many buckets. A load that is repeated, or that
breaks off and is run again, leaves the same table.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from admeridian.sources.tables import insert_ignore, materialised, shared_dir, upsert_replace

MODE = "spark.sql.sources.partitionOverwriteMode"


@dataclass(frozen=True)
class Stored:
    """A table of the session's catalogue. ``keys`` identify a row together with ``day``; ``bucketed`` are those of the buckets."""

    spark: SparkSession
    name: str
    keys: tuple[str, ...]
    day: str
    bucketed: tuple[str, ...]
    buckets: int

    @property
    def columns(self) -> list[str]:
        return self.spark.table(self.name).columns

    def read(self, first=None, last=None) -> DataFrame:
        """The rows, or those from ``first`` to ``last`` day; only the folders of these days are listed and read."""
        rows = self.spark.table(self.name)
        if first is not None:
            rows = rows.filter(F.col(self.day) >= F.lit(first).cast("date"))
        return rows if last is None else rows.filter(F.col(self.day) <= F.lit(last).cast("date"))

    def days_of(self, rows: DataFrame) -> list:
        """The days that a load touches: calendar days, so few however many rows there are."""
        return [r[0] for r in rows.select(self.day).distinct().collect()]

    def read_days(self, days: list) -> DataFrame:
        """The rows of some days; a null day is one."""
        some = [d for d in days if d is not None]
        wanted = F.col(self.day).isin(some) if some else F.lit(False)
        return self.spark.table(self.name).filter(wanted | F.col(self.day).isNull() if None in days else wanted)

    def replace(self, new: DataFrame, order: str) -> None:
        """Of each key the latest row by ``order``, the new one among equals; the touched days are written anew."""
        new = materialised(new.select(*self.columns), "load")
        old = self.read_days(self.days_of(new))
        self._overwrite(upsert_replace(old, new, [*self.keys, self.day], order))

    def add(self, new: DataFrame) -> int:
        """Adds rows whose key its day does not hold yet; returns how many. A load that adds nothing writes nothing."""
        new = materialised(new.select(*self.columns), "load")
        old = self.read_days(self.days_of(new))
        both = [*self.keys, self.day]
        fresh = materialised(insert_ignore(new.limit(0), self.unknown(new, old, both), both), "fresh")
        n = fresh.count()
        if n:
            # days with nothing new are not written
            self._overwrite(self.read_days(self.days_of(fresh)).unionByName(fresh))
        return n

    def unknown(self, new: DataFrame, old: DataFrame, both: list[str]) -> DataFrame:
        """The rows of ``new`` whose key is not in ``old``; ``new`` is dealt as the stored side lies."""
        dealt = new.repartition(self.buckets, *[F.col(c) for c in self.bucketed]).alias("n")
        held = old.select(*[F.col(c).alias(f"held_{c}") for c in both])
        # only the buckets' keys are keys of the join, so that both sides are taken as they lie; the day is compared within them
        on = F.coalesce(F.datediff(f"n.{self.day}", f"held_{self.day}"), F.when(F.col(f"n.{self.day}").isNull() & F.col(f"held_{self.day}").isNull(), 0)) == 0
        for c in self.keys:
            on = on & (F.col(f"n.{c}") == F.col(f"held_{c}") if c in self.bucketed else ~(F.col(f"n.{c}") != F.col(f"held_{c}")))
        return dealt.join(held.hint("merge"), on, "left_anti")

    def _overwrite(self, rows: DataFrame) -> None:
        rows = materialised(rows.select(*self.columns), "merged")  # what is read is not overwritten before it has been written
        usual = self.spark.conf.get(MODE)
        self.spark.conf.set(MODE, "dynamic")
        try:
            # one file a bucket and day, however many tasks there are
            rows.repartition(self.buckets, *[F.col(c) for c in self.bucketed]).write.mode("overwrite").insertInto(self.name)
        finally:
            self.spark.conf.set(MODE, usual)


def create(spark: SparkSession, schema: StructType, keys: tuple[str, ...], day: str = "date", bucketed: tuple[str, ...] | None = None, buckets: int = 16, name: str | None = None, path: str | None = None) -> Stored:
    """An empty stored table; ``path`` defaults to a new folder of the shared one."""
    name = name or f"stored_{uuid.uuid4().hex}"
    bucketed = bucketed or keys
    fields = [f for f in schema.fields if f.name != day] + [f for f in schema.fields if f.name == day]
    empty = spark.createDataFrame([], StructType(fields))
    path = path or f"{shared_dir(spark)}/admeridian/{name}"
    empty.write.format("parquet").partitionBy(day).bucketBy(buckets, *bucketed).sortBy(*bucketed).option("path", path).saveAsTable(name)
    return Stored(spark, name, keys, day, bucketed, buckets)
