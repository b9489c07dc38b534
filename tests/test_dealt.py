"""What is stored by account is not moved by the steps on it, and gives the rows of plain tables."""

import datetime as dt
import re
import statistics
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from admeridian.operators import episodes, observe, operate, refinement, templates
from admeridian.plans.learn_queries import Learned
from admeridian.sources.tables import PARTIAL_KEYS, as_it_lies, dealt

D0 = dt.date(2024, 3, 1)


def made(spark):
    days = [(f"a{a}", f"a{a}-c{c}", D0 + dt.timedelta(i), 100 + i, 10 + c, 1000000 * (1 + (i * c + a) % 7), float(1 + i % 3), 2.0) for a in range(5) for c in range(3) for i in range(60) if (i + a) % 5]
    daily = spark.createDataFrame(days, "account_id string, campaign_id string, date date, impressions long, clicks long, cost_micros long, conversions double, conversion_value double")
    keys = spark.createDataFrame([(f"e{a}{c}{i}", f"a{a}", "" if c == 3 else f"a{a}-c{c}", D0 + dt.timedelta(i)) for a in range(6) for c in range(4) for i in (3, 20, 31)], "episode_id string, account_id string, campaign_id string, change_date date")
    told = keys.select(F.col("episode_id").alias("prediction_id"), "account_id", "campaign_id", F.col("change_date").alias("registered_at"), F.lit("t").alias("template_id"), F.lit("ACT").alias("recommendation"), F.lit("improved").alias("prediction_direction"), F.lit(0.1).alias("prediction_magnitude"), F.lit(0.1).alias("natural_magnitude"))
    return daily, keys, told


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]


def test_stored_days_and_changes_meet_as_they_lie(spark):
    daily, keys, told = made(spark)
    days, stored, asked = episodes.laid(daily), dealt(keys, "keys", "campaign_id"), dealt(told, "told", "campaign_id")
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with as_it_lies(spark):
            for df in (operate.resolve(asked, days), stored.join(days.facts, ["account_id", "campaign_id"]).groupBy("account_id", "campaign_id", "episode_id").count()):
                assert "SortMergeJoin" in plan(df) and "hashpartitioning" not in plan(df)
            # finished rows of two kinds may be dealt once more, by account alone
            assert set(re.findall(r"hashpartitioning\((\w+)[^)]*\)", plan(episodes.window_metrics(stored, days)))) <= {"account_id"} and "campaign_id#" not in "".join(re.findall(r"hashpartitioning\(.*?\)", plan(episodes.window_metrics(stored, days))))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert spark.conf.get(PARTIAL_KEYS) == "true"


def test_stored_days_give_the_rows_of_plain_ones(spark):
    daily, keys, told = made(spark)
    lines = lambda df: sorted(map(repr, df.collect()))
    twice = daily.unionByName(daily.withColumn("clicks", F.lit(5).cast("long")))
    for rows in (daily, twice):
        days = episodes.laid(rows)
        got, want = episodes.window_metrics(dealt(keys, "keys"), days), episodes.window_metrics(keys, rows)
        assert lines(got) == lines(want) and len(lines(want)) > 20
        assert lines(operate.resolve(dealt(told, "told"), days)) == lines(operate.resolve(told, rows))
    assert lines(episodes.laid(daily, summed=True).facts) == lines(episodes.laid(daily).facts)
    assert dealt(keys.limit(0), "none").count() == 0


def test_folds_are_read_off_one_order(spark):
    rng = np.random.default_rng(3)
    sizes = {"a": 1, "b": 2, "c": 3, "d": 4, "e": 11, "f": 57}
    rows = [(f"e{t}{i:03d}", f"a{i % 4}", t, str(rng.choice(["improved", "degraded", "neutral"])), float(rng.integers(-8, 9)) / 8 if rng.random() < 0.7 else float(rng.normal())) for t, n in sizes.items() for i in range(n)]
    members = spark.createDataFrame(rows, "episode_id string, account_id string, template_id string, direction string, signed double")
    found = templates.fold_predictions(members)
    # moved once, and not repeated for the folds
    assert plan(found).count("Exchange hashpartitioning") == 1 and "Generate" not in plan(found)
    want = {}
    for t in sizes:
        own = sorted(r for r in rows if r[2] == t)
        k = min(5, len(own))
        for i, r in enumerate(own):
            others = [x for j, x in enumerate(own) if j % k != i % k]
            if others:
                counts = Counter(x[3] for x in others)
                want[r[0]] = (min(counts, key=lambda d: (-counts[d], d)), statistics.median(x[4] for x in others))
    got = {r["episode_id"]: (r["predicted_direction"], r["predicted_magnitude"]) for r in found.collect()}
    assert got.keys() == want.keys()
    assert all(got[e][0] == want[e][0] and abs(got[e][1] - want[e][1]) < 1e-12 for e in want)


def test_members_are_resolved_where_they_lie(spark):
    values = [c for m in refinement.METRICS if m != "ctr" for c in (f"pre_{m}", f"post_{m}")]
    rows = [(f"e{i}", f"a{i % 3}", f"t{i % 4}", D0, "ACT", *[float((i * k) % 5) for k in range(len(values))]) for i in range(40)]
    members = spark.createDataFrame(rows, "episode_id string, account_id string, template_id string, change_date date, recommendation string, " + ", ".join(f"{c} double" for c in values))
    forecasts = spark.createDataFrame([(f"t{i}", m, 0.1 * i, -0.2, 0.5, 0.3, 12) for i in range(3) for m in refinement.METRICS[i:]], "template_id string, metric string, median_delta double, iqr_low double, iqr_high double, mae double, n long")
    got = refinement.resolved_members(members, forecasts, "recommendation")
    assert "hashpartitioning" not in plan(got)
    want = refinement.resolved_hypotheses(refinement.metric_hypotheses(members, forecasts), members)
    lines = lambda df: sorted(map(repr, df.select(*want.columns).collect()))
    assert lines(got) == lines(want) and len(lines(want)) > 100
    calls = members.select("episode_id", "recommendation", F.lit("s").alias("state"), F.lit("improved").alias("prediction_direction"))
    carried = got.withColumns({"state": F.lit("s"), "prediction_direction": F.lit("improved")})
    assert sorted(map(repr, observe.audit_export(carried).collect())) == sorted(map(repr, observe.audit_export(want, calls).collect()))


def test_the_daily_cycle_moves_no_days(spark, sf_dir):
    from admeridian.plans.operate_queries import Operated

    t = Operated(spark, sf_dir)
    found = operate.daily_cycle(t, F.lit("2024-03-01").cast("date"))["resolutions"]
    assert "hashpartitioning" not in plan(found)
    plain = operate.resolve(t.predictions.filter("registered_at <= DATE '2024-03-01'"), t.facts, None, F.lit("2024-03-01").cast("date"))
    assert sorted(map(repr, found.select("prediction_id", "window_days", "actual_direction").collect())) == sorted(map(repr, plain.select("prediction_id", "window_days", "actual_direction").collect()))


def test_facts_are_summed_in_as_many_parts_as_stated(spark, sf_dir):
    facts = Learned(spark, sf_dir).facts
    # parts of these few days that Spark may merge are one; a part without an account has no file
    assert 1 < len(facts.inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    lying = facts.select("account_id", F.input_file_name().alias("file")).distinct()
    assert lying.groupBy("account_id").count().filter("count > 1").count() == 0
    assert facts.groupBy("account_id", "campaign_id", "date").count().filter("count > 1").count() == 0
