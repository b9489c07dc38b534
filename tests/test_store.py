"""Stored tables: only touched days are read and written, the stored side of a join is not moved."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from admeridian.sources import store
from admeridian.streaming import feeds

SCHEMA = "account_id string, campaign_id string, date date, clicks long, loaded int"


def rows(spark, days, clicks=1, loaded=1, accounts=range(5)):
    return spark.createDataFrame([(f"a{a}", f"c{a % 2}", dt.date(2024, 1, d), clicks + a, loaded) for d in days for a in accounts], SCHEMA)


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/date=*/*.parquet")}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def table(spark, tmp_path):
    made = store.create(spark, rows(spark, [1]).schema, ("account_id", "campaign_id"), bucketed=("account_id", "campaign_id"), buckets=4, path=str(tmp_path / "t"))
    made.replace(rows(spark, [1, 2, 3]), "loaded")
    yield made
    spark.sql(f"DROP TABLE {made.name}")


def content(table):
    return sorted((r.account_id, r.date.day, r.clicks, r.loaded) for r in table.read().collect())


def test_untouched_days_keep_their_files(spark, table, tmp_path):
    before = files(tmp_path / "t")
    assert len(before) <= 3 * 4
    table.replace(rows(spark, [2], clicks=10, loaded=2, accounts=[0, 7]).unionByName(rows(spark, [3], clicks=50, loaded=0, accounts=[1])), "loaded")
    after = files(tmp_path / "t")
    kept = lambda fs, day: {f: t for f, t in fs.items() if f"date=2024-01-0{day}" in f}
    assert kept(before, 1) == kept(after, 1) and not set(kept(before, 2)) & set(kept(after, 2))
    want = {(f"a{a}", d): (1 + a, 1) for d in (1, 2, 3) for a in range(5)} | {("a0", 2): (10, 2), ("a7", 2): (17, 2)}
    assert content(table) == sorted((a, d, *v) for (a, d), v in want.items())  # an older row does not replace a newer one
    table.replace(rows(spark, [2], clicks=10, loaded=2, accounts=[0, 7]), "loaded")
    assert content(table) == sorted((a, d, *v) for (a, d), v in want.items())


def test_insert_ignore_writes_days_with_something_new(spark, table, tmp_path):
    before = files(tmp_path / "t")
    load = rows(spark, [1, 2], clicks=100).unionByName(rows(spark, [2, 4], clicks=100, accounts=[8, 8]))
    assert table.add(load) == 2
    after = files(tmp_path / "t")
    assert {f: t for f, t in before.items() if "01-02" not in f}.items() <= after.items()
    assert ("a8", 2, 108, 1) in content(table) and ("a0", 1, 1, 1) in content(table) and len(content(table)) == 17
    again = files(tmp_path / "t")
    assert table.add(load) == 0 and files(tmp_path / "t") == again


def test_plans_prune_days_and_move_only_the_load(spark, table):
    assert "PartitionFilters: [isnotnull(date" in plan(table.read("2024-01-02", "2024-01-03"))
    old = table.read_days([dt.date(2024, 1, 2)])
    made = plan(table.unknown(rows(spark, [2]), old, ["account_id", "campaign_id", "date"]))
    assert "SortMergeJoin" in made and made.count("Exchange") == 1 and made.index("Exchange") < made.index("FileScan"), made
    assert "Bucketed: true" in made and "(date#" in made[made.index("PartitionFilters") :], made
    # a join with another table on the key, as of episodes with facts, leaves both as they lie
    other = table.read().groupBy("account_id", "campaign_id").agg(F.count("*").alias("n"))
    assert "Exchange" not in plan(table.read().hint("merge").join(other, ["account_id", "campaign_id"]))


def test_feed_into_a_stored_table(spark, table, tmp_path):
    source, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    for part in ([4, 5], [5, 6], [4]):
        rows(spark, part, clicks=part[0]).write.mode("append").parquet(source)
        feeds.stored_feed(table, source, mark)
    got = content(table)
    assert len(got) == 6 * 5 and {(d, c) for a, d, c, _ in got if a == "a0" and d > 3} == {(4, 4), (5, 4), (6, 5)}
    before = files(tmp_path / "t")
    feeds.stored_feed(table, source, str(tmp_path / "other-mark"))  # all batches once more
    assert files(tmp_path / "t") == before


def test_null_days_and_empty_loads(spark, table):
    n = len(content(table))
    assert table.add(rows(spark, [1]).limit(0)) == 0
    table.replace(rows(spark, [1]).limit(0), "loaded")
    assert len(content(table)) == n
    assert table.add(rows(spark, [1]).withColumn("date", F.lit(None).cast("date"))) == 5
    assert table.read().filter("date IS NULL").count() == 5
