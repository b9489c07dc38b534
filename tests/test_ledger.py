"""The ledger: growth in runs, tampering of every kind, inclusion proofs."""

import datetime as dt
import hashlib
import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from admeridian.operators import ledger

SCHEMA = "prediction_id string, registered_at date, x int, note string"


@pytest.fixture(scope="module")
def rows(spark):
    data = [(f"p{i}" if i else None, dt.date(2024, 1, 1 + i % 3) if i != 5 else None, i, "n" if i % 4 else None) for i in range(90)]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def whole(rows):
    return ledger.append(rows)


def table(df):
    return sorted(map(tuple, df.collect()), key=repr)


def reasons(book, predictions=None):
    return {r.reason for r in ledger.broken(book, predictions).collect()}


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute_heads(rows):
    """The same tree, by recursion."""

    def node(leaves, depth):
        if depth > ledger.DEPTH:
            (only,) = leaves
            return leaves[only]
        parts = {}
        for k, h in leaves.items():
            parts.setdefault(k[: depth + 1] if depth < ledger.DEPTH else k, {})[k] = h
        below = {k: node(v, depth + 1) for k, v in parts.items()}
        return next(iter(below.values())) if len(below) == 1 else sha("node" + ",".join(k + below[k] for k in sorted(below)))

    days = {}
    for r in rows:
        body = json.dumps({c: r[c].isoformat() if isinstance(r[c], dt.date) else r[c] for c in sorted(r.asDict())}, separators=(",", ":"))
        key = sha(r["prediction_id"] or "")
        days.setdefault(r["registered_at"], {})[key] = sha("leaf" + key + sha(body))
    last, out = ledger.GENESIS, []
    for day in sorted(days, key=lambda d: (d is not None, d or 0)):
        root = node(days[day], 0)
        last = sha(last + root)
        out.append((day, len(days[day]), root, last))
    return sorted(out, key=repr)


def test_tree_by_its_definition(rows, whole):
    assert table(whole.heads) == brute_heads(rows.collect())
    assert table(ledger.broken(whole, rows)) == []


def test_growing_in_runs_gives_the_tree_of_one_run(spark, rows, whole):
    book = ledger.append(rows.filter("x % 7 = 0"))
    assert reasons(book, rows) == set()
    for part in ("x % 7 = 3 AND x < 50", "x % 2 = 0", "x < 0"):
        book = ledger.append(rows.filter(part), book)
        assert reasons(book, rows) == set()
    # ids that are held stay as they were entered, whatever comes now
    book = ledger.append(rows.withColumns({"note": F.when(F.col("x") % 2 == 0, F.lit("other")).otherwise(F.col("note")), "registered_at": F.when(F.col("x") == 4, F.lit(dt.date(2030, 1, 1))).otherwise(F.col("registered_at"))}), book)
    for own, one in zip((book.entries, book.nodes, book.heads), (whole.entries, whole.nodes, whole.heads), strict=True):
        assert table(own) == table(one)
    again = ledger.append(rows.unionByName(rows), book)
    assert table(again.heads) == table(whole.heads) and again.entries.count() == 90


def test_only_touched_paths_are_made_anew(rows, whole):
    first = ledger.append(rows.filter("x <> 30"))
    assert len(set(table(whole.nodes)) - set(table(first.nodes))) <= ledger.DEPTH + 1


def test_every_kind_of_tampering_is_found(rows, whole):
    one = F.col("prediction_id") == "p7"
    edited = whole.entries.withColumn("payload_hash", F.when(one, F.lit("0")).otherwise(F.col("payload_hash")))
    assert reasons(replace(whole, entries=edited)) == {"leaf"}
    remade = edited.withColumn("leaf", ledger.leaf(F.col("key"), F.col("payload_hash")))
    assert reasons(replace(whole, entries=remade)) == {"node"}
    assert reasons(replace(whole, entries=whole.entries.filter(~one))) == {"node"}
    moved = whole.entries.withColumn("day", F.when(one, F.lit(dt.date(2024, 1, 3))).otherwise(F.col("day")))
    assert reasons(replace(whole, entries=moved)) == {"node"}
    renamed = whole.entries.withColumn("prediction_id", F.when(one, F.lit("p700")).otherwise(F.col("prediction_id")))
    assert reasons(replace(whole, entries=renamed)) == {"leaf"}
    for level in range(ledger.DEPTH + 1):
        gone = whole.nodes.filter(f"NOT (level = {level} AND day = DATE '2024-01-02')")
        assert "node" in reasons(replace(whole, nodes=gone))
    # a day made anew as a whole no longer fits its head, nor do the heads made anew fit those that were published
    forged = ledger.append(rows.withColumn("note", F.when(one, F.lit("forged")).otherwise(F.col("note"))))
    assert reasons(replace(forged, heads=whole.heads)) == {"head"}
    assert reasons(replace(whole, heads=whole.heads.filter("day <> DATE '2024-01-01'"))) == {"head"}
    assert reasons(whole, rows.filter("x <> 8").withColumn("note", F.when(one, F.lit("new")).otherwise(F.col("note")))) == {"gone", "payload"}


def test_proofs(spark, rows, whole):
    asked = rows.filter("x IN (0, 3, 5, 77)").unionByName(spark.createDataFrame([("absent", None, 1, None)], SCHEMA))
    proofs = ledger.proof(whole, asked)
    assert {r.prediction_id for r in proofs.collect()} == {None, "p3", "p5", "p77"}
    assert max(r["count"] for r in proofs.groupBy("prediction_id").count().collect()) < 25
    told = lambda p, q=proofs, h=whole.heads: {r.prediction_id: r.proven for r in ledger.proven(p, q, h).collect()}
    assert told(asked) == {None: True, "p3": True, "p5": True, "p77": True, "absent": False}
    assert told(asked.withColumn("x", F.col("x") + 1)) == dict.fromkeys([None, "p3", "p5", "p77", "absent"], False)
    cut = proofs.filter("NOT (prediction_id = 'p3' AND level = 1)").withColumn("hash", F.when(F.col("prediction_id") == "p77", F.sha2("hash", 256)).otherwise(F.col("hash")))
    assert [told(asked, cut)[k] for k in ("p3", "p77", "p5")] == [False, False, True]


def test_empty(spark, rows):
    none = ledger.append(rows.filter("x < 0"))
    assert [x.count() for x in (none.entries, none.nodes, none.heads)] == [0, 0, 0] and reasons(none, rows) == set()


def test_a_first_run_is_joined_with_nothing(spark, rows):
    none = ledger.empty(spark)
    assert [x.columns for x in (none.entries, none.nodes, none.heads)] == [[f.split()[0] for f in x.split(", ")] for x in (ledger.ENTRIES, ledger.NODES, ledger.HEADS)]
    assert [x.count() for x in (none.entries, none.nodes, none.heads)] == [0, 0, 0]
    fresh = ledger._joined(ledger.entries_of(rows), none.entries.select("prediction_id"), ["prediction_id"], "left_anti")
    assert "Join" not in fresh._jdf.queryExecution().optimizedPlan().toString()
