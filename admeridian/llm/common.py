"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of bytes other than space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows and bytes of a batch that goes to a Python worker, and what Spark has by itself: whole texts and sets of hashes are large, and
#: a batch is held several times over.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("1000", "10000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("8m", "67108864b")}

_own_dir: list[str] = []
_run: ContextVar[list[str] | None] = ContextVar("run", default=None)

#: What gives back the tables that a worker keeps from task to task.
kept_tables: list[Callable[[], None]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; where none is set, a folder of the warehouse, which a cluster
    shares too. Only a session on one machine (a local master, as in tests) takes a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="spark-admeridian-"))
    return _own_dir[0]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/admeridian/{label}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Lets the session send small batches to Python workers, unless it has been given sizes of its own. Every operator here that
    runs Python comes by this; the sizes bound memory and change no result."""
    for key, (small, usual) in BATCHES.items():
        if spark.conf.get(key) == usual:
            spark.conf.set(key, small)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: lineage ends there, any executor may be lost."""
    spark = df.sparkSession
    small_batches(spark)
    path = fresh_path(spark, label)
    if _run.get() is not None:
        _run.get().append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def drop_staged(df: DataFrame) -> None:
    """Removes a table made by ``staged`` that nothing reads any more."""
    _delete(df.sparkSession, df.staged_at)


@contextmanager
def own_tables(spark: SparkSession):
    """Inside, a function that removes all tables which ``staged`` has made inside so far, but for those it is given to keep.
    Tables made outside, such as those behind another operator's result, are never touched."""
    made: list[str] = []
    before = _run.set(made)

    def drop(*keep: DataFrame) -> None:
        kept = [df.staged_at for df in keep]
        for path in [p for p in made if p not in kept]:
            _delete(spark, path)
        made[:] = kept

    try:
        yield drop
    finally:
        _run.reset(before)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fresh_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores in front until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Texts of one byte a character take the faster ``lower``, which does the same on them."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def one_by_one(column: pa.Array) -> Iterator:
    """The values of a batch, each made only when its turn comes: whole texts of a batch are never held twice."""
    return (x.as_py() for x in column)


def tidy() -> None:
    """Gives memory that a worker has freed back to the system: workers outlive their stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other systems have no such call
        pass


def tidy_all() -> None:
    """The same, and the tables that the worker has kept for an earlier operator's tasks: for tasks that have no use for them."""
    for clear in kept_tables:
        clear()
    tidy()
