"""Incremental feeds: what is new in a folder goes through the same batch operators, once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from admeridian.sources.store import Stored
from admeridian.sources.tables import insert_ignore


def change_event_feed(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, keys: tuple[str, ...] = ("account_id", "change_id")) -> None:
    """Reads all files of ``source`` that an earlier run has not seen and adds their events to the Parquet table ``target``.

    Each micro-batch is an insert-ignore by key against the table, so a batch that is repeated after a failure adds nothing.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(target)
        exists = path.getFileSystem(session._jsc.hadoopConfiguration()).exists(path)
        old = session.read.schema(schema).parquet(target) if exists else session.createDataFrame([], schema)
        known = old.select(*keys)
        fresh = insert_ignore(session.createDataFrame([], schema), batch, list(keys)).join(known, list(keys), "left_anti")
        fresh.select(*schema.fieldNames()).write.mode("append").parquet(target)

    query = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def stored_feed(table: Stored, source: str, checkpoint: str) -> None:
    """Adds the rows of all files of ``source`` that an earlier run has not seen to a stored table. A batch reads and writes the days it
    brings, no others; one that is repeated adds nothing."""
    spark = table.spark
    schema = spark.table(table.name).schema
    query = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(lambda batch, batch_id: table.add(batch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
