"""The prediction ledger: a Merkle tree a day, the day roots chained.

A prediction is a leaf: its key is the hash of its id, its content the hash of its canonical JSON. The leaves of a day hang from a
tree over the first ``DEPTH`` hex digits of their keys, 16 children a node; a node with one child passes that child's hash on. So
the tree depends on the set of its leaves alone: entries that come in several runs give the tree of one run, and a new leaf changes
only the nodes on its own path, all others are taken over as they are stored. A day's head is the hash of the head of the day before
and the day's root.

All hashes of a level are worked out at once, a node from its few children; no day is gathered or sorted. An inclusion proof lists
the siblings on the path from a leaf to the root of its day, about 16 for each level at which the tree branches.

Defined results: of several rows with one id in a run the one of the earliest day counts, then the smallest hash; an id that the
ledger holds is not entered again, whatever its day or content; a null id is an id; a null day is a day, the first; null fields
are part of the JSON; an empty run changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from admeridian.sources.tables import materialised

DEPTH = 5
ENTRIES = "day date, prediction_id string, key string, payload_hash string, leaf string"
NODES = "day date, level int, prefix string, n long, hash string"
HEADS = "day date, n long, root string, head string"
#: The head before the first day.
GENESIS = "genesis"


@dataclass(frozen=True)
class Ledger:
    """``entries``: one row per prediction; ``nodes``: of all trees, level 0 the roots; ``heads``: one row per day."""

    entries: DataFrame
    nodes: DataFrame
    heads: DataFrame


def empty(spark: SparkSession) -> Ledger:
    """No rows that Spark knows to be none: nothing is joined with them."""
    none = lambda fields: spark.sql("SELECT " + ", ".join("CAST(NULL AS {1}) AS {0}".format(*f.split()) for f in fields.split(",")) + " WHERE false")
    return Ledger(*[none(x) for x in (ENTRIES, NODES, HEADS)])


def canonical(columns: list[str]) -> Column:
    """The JSON of a row: fields in order of their names, nulls included."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def leaf(key: Column, payload_hash: Column) -> Column:
    return F.sha2(F.concat(F.lit("leaf"), key, payload_hash), 256)


def entries_of(predictions: DataFrame, day: str = "registered_at") -> DataFrame:
    rows = predictions.select(F.col(day).cast("date").alias("day"), F.col("prediction_id").cast("string").alias("prediction_id"), F.sha2(canonical(predictions.columns), 256).alias("payload_hash"))
    rows = rows.groupBy("prediction_id").agg(F.min(F.struct("day", "payload_hash")).alias("_first")).select("_first.day", "prediction_id", "_first.payload_hash")
    key = F.sha2(F.coalesce("prediction_id", F.lit("")), 256).alias("key")
    return rows.select("day", "prediction_id", key, "payload_hash").withColumn("leaf", leaf(F.col("key"), F.col("payload_hash")))


def _joined(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join in which null keys are equal; the keys of ``b`` are named ``other_``."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"other_{k}"))
    return a.join(b.withColumnsRenamed({k: f"other_{k}" for k in keys}), on, how)


def _folded(children: DataFrame, level: int, keys: list[str]) -> DataFrame:
    """The nodes of a level from their children: ``keys``, prefix, n, hash. A node has 16 children at most, and at the lowest level
    its leaves, one in 16 ** DEPTH of a day's."""
    own = F.array_sort(F.collect_list(F.struct("prefix", "hash")))
    rows = children.groupBy(*keys, F.substring("prefix", 1, level).alias("up")).agg(own.alias("own"), F.sum("n").alias("n"))
    joined = F.array_join(F.transform("own", lambda x: F.concat(x["prefix"], x["hash"])), ",")
    value = F.when(F.size("own") == 1, F.element_at("own", 1)["hash"]).otherwise(F.sha2(F.concat(F.lit("node"), joined), 256))
    return rows.select(*keys, F.col("up").alias("prefix"), "n", value.alias("hash"))


def _as_children(entries: DataFrame) -> DataFrame:
    return entries.select("day", F.col("key").alias("prefix"), F.lit(1).cast("long").alias("n"), F.col("leaf").alias("hash"))


def _level(ledger: Ledger, level: int) -> DataFrame:
    """What hangs from the nodes of the level above: nodes, or leaves below the lowest level."""
    return _as_children(ledger.entries) if level > DEPTH else ledger.nodes.filter(F.col("level") == level).drop("level")


def append(predictions: DataFrame, known: Ledger | None = None, day: str = "registered_at") -> Ledger:
    """The ledger with the predictions that it does not hold yet."""
    known = known or empty(predictions.sparkSession)
    fresh = entries_of(predictions, day)
    fresh = materialised(_joined(fresh, known.entries.select("prediction_id"), ["prediction_id"], "left_anti"), "ledger-entries")
    changed, nodes = _as_children(fresh), known.nodes
    new = []
    for level in range(DEPTH, -1, -1):
        touched = changed.select("day", F.substring("prefix", 1, level).alias("up")).distinct()
        # siblings of what has changed, as they are stored
        old = _level(known, level + 1).withColumn("up", F.substring("prefix", 1, level))
        beside = _joined(_joined(old, touched, ["day", "up"], "left_semi").drop("up"), changed.select("day", "prefix"), ["day", "prefix"], "left_anti")
        changed = materialised(_folded(changed.unionByName(beside), level, ["day"]), "ledger-nodes")
        new.append(changed.select("day", F.lit(level).alias("level"), "prefix", "n", "hash"))
    for level in new:
        nodes = _joined(nodes, level.select("day", "level", "prefix"), ["day", "level", "prefix"], "left_anti")
    for level in new:
        nodes = nodes.unionByName(level)
    entries, nodes = known.entries.unionByName(fresh), materialised(nodes, "ledger")
    return Ledger(materialised(entries, "ledger"), nodes, materialised(chained(nodes), "ledger"))


def chained(nodes: DataFrame) -> DataFrame:
    """(day, n, root, head) of the roots among the nodes, in order of the days: one small row a day goes through one task."""
    import hashlib

    roots = nodes.filter("level = 0").select("day", "n", F.col("hash").alias("root")).repartition(1).sortWithinPartitions("day")

    def of(batches):
        last = GENESIS
        for batch in batches:
            heads = []
            for root in batch.column(2).to_pylist():
                last = hashlib.sha256((last + root).encode()).hexdigest()
                heads.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.string())], names=["day", "n", "root", "head"])

    return roots.mapInArrow(of, HEADS)


def broken(ledger: Ledger, predictions: DataFrame | None = None) -> DataFrame:
    """(day, place, reason) of all that does not fit: leaves that are not the hash of their entry, nodes that are not the hash of
    their children or have none or are missing, heads that do not follow from the roots; with ``predictions``, entries whose
    prediction has changed or gone. An untampered ledger has no rows."""
    e = ledger.entries
    wrong = (F.col("leaf") != leaf(F.col("key"), F.col("payload_hash"))) | (F.col("key") != F.sha2(F.coalesce("prediction_id", F.lit("")), 256))
    out = e.filter(wrong).select("day", F.coalesce("prediction_id", F.lit("")).alias("place"), F.lit("leaf").alias("reason"))
    for level in range(DEPTH, -1, -1):
        want = _folded(_level(ledger, level + 1), level, ["day"]).select("day", "prefix", F.col("n").alias("want_n"), F.col("hash").alias("want"))
        both = _joined(_level(ledger, level), want, ["day", "prefix"], "full_outer").filter(~(F.col("hash").eqNullSafe(F.col("want")) & F.col("n").eqNullSafe(F.col("want_n"))))
        place = F.concat(F.lit(f"{level}:"), F.coalesce("prefix", "other_prefix"))
        out = out.unionByName(both.select(F.coalesce("day", "other_day").alias("day"), place.alias("place"), F.lit("node").alias("reason")))
    want = chained(ledger.nodes).select("day", F.col("root").alias("want_root"), F.col("head").alias("want"))
    both = _joined(ledger.heads, want, ["day"], "full_outer").filter(~(F.col("head").eqNullSafe(F.col("want")) & F.col("root").eqNullSafe(F.col("want_root"))))
    out = out.unionByName(both.select(F.coalesce("day", "other_day").alias("day"), F.lit("").alias("place"), F.lit("head").alias("reason")))
    if predictions is not None:
        now = predictions.select(F.col("prediction_id").cast("string").alias("id"), F.sha2(canonical(predictions.columns), 256).alias("now"))
        now = now.groupBy("id").agg(F.collect_set("now").alias("now"))
        found = e.join(now, F.col("prediction_id").eqNullSafe(F.col("id")), "left").filter(F.col("now").isNull() | ~F.array_contains("now", F.col("payload_hash")))
        reason = F.when(F.col("now").isNull(), "gone").otherwise("payload")
        out = out.unionByName(found.select("day", F.coalesce("prediction_id", F.lit("")).alias("place"), reason.alias("reason")))
    return out


def proof(ledger: Ledger, ids: DataFrame) -> DataFrame:
    """(prediction_id, day, level, prefix, n, hash): for each of the ``ids`` that the ledger holds, the siblings of its path; level -1
    has the head of the day before."""
    asked = ids.select(F.col("prediction_id").cast("string").alias("id")).distinct()
    own = ledger.entries.join(asked, F.col("prediction_id").eqNullSafe(F.col("id"))).select("prediction_id", F.col("day").alias("own_day"), F.col("key").alias("own_key"))
    out = None
    for level in range(DEPTH, -1, -1):
        below = _level(ledger, level + 1)
        width = 64 if level == DEPTH else level + 1
        on = F.col("day").eqNullSafe(F.col("own_day")) & (F.substring("prefix", 1, level) == F.substring("own_key", 1, level)) & (F.col("prefix") != F.substring("own_key", 1, width))
        rows = own.join(below, on).select("prediction_id", "day", F.lit(level).alias("level"), "prefix", "n", "hash")
        out = rows if out is None else out.unionByName(rows)
    before = ledger.heads.select("day", F.lag("head", 1, GENESIS).over(Window.orderBy("day")).alias("before"))
    last = own.join(before, F.col("own_day").eqNullSafe(F.col("day"))).select("prediction_id", "day", F.lit(-1).alias("level"), F.lit("").alias("prefix"), F.lit(0).cast("long").alias("n"), F.col("before").alias("hash"))
    return out.unionByName(last)


def proven(predictions: DataFrame, proofs: DataFrame, heads: DataFrame, day: str = "registered_at") -> DataFrame:
    """(prediction_id, proven): whether a prediction as it now reads, its proof and the published heads fit. Neither entries nor
    nodes are read."""
    keys = ["prediction_id", "day"]
    entries = entries_of(predictions, day)
    now = entries.select(*keys, F.col("key").alias("prefix"), F.lit(1).cast("long").alias("n"), F.col("leaf").alias("hash"))
    for level in range(DEPTH, -1, -1):
        beside = proofs.filter(F.col("level") == level).select(*keys, "prefix", "n", "hash")
        now = _folded(now.unionByName(beside), level, keys)
    now = now.select(F.col("prediction_id").alias("id"), F.col("day").alias("at"), F.col("hash").alias("root"))
    before = proofs.filter("level = -1").select(*keys, F.col("hash").alias("before"))
    published = heads.select(F.col("day").alias("published"), "head")
    found = entries.select(*keys).join(now, F.col("prediction_id").eqNullSafe(F.col("id")) & F.col("day").eqNullSafe(F.col("at")))
    found = found.drop("id", "at").join(before.toDF("id", "at", "before"), F.col("prediction_id").eqNullSafe(F.col("id")) & F.col("day").eqNullSafe(F.col("at")), "left")
    found = found.join(published, F.col("day").eqNullSafe(F.col("published")), "left")
    return found.select("prediction_id", F.coalesce(F.sha2(F.concat("before", "root"), 256) == F.col("head"), F.lit(False)).alias("proven"))
