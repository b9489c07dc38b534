"""The stream of resolutions against the batch, however its loads are split, repeated or late."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from admeridian.operators import operate
from admeridian.streaming import resolver

D0 = dt.date(2024, 1, 1)
FACTS = "account_id string, campaign_id string, date date, cost_micros long, conversions double, known_on date"
PREDICTED = "prediction_id string, account_id string, campaign_id string, registered_at date, template_id string, recommendation string, prediction_direction string, prediction_magnitude double, natural_magnitude double"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    facts, made = [], []
    for c in range(4):
        for d in range(60):
            if rng.random() < 0.9 and not (c == 3 and d > 30):  # one campaign falls silent before its windows end
                late = 9 if rng.random() < 0.05 else 0
                facts.append((f"a{c % 2}", f"c{c}", D0 + dt.timedelta(d), rng.randrange(1, 9) * 10**6, float(rng.randrange(4)), D0 + dt.timedelta(min(d + late, 59))))
        made += [(f"p{c}{d}", f"a{c % 2}", f"c{c}", D0 + dt.timedelta(d), "t", rng.choice(["ACT", "WAIT", "DO_NOT_ACT", "EITHER"]), rng.choice(["improved", "degraded"]), 0.2, 0.1) for d in (3, 10, 20, 27, 40, 55)]
    made.append(("whole", "a0", "", D0 + dt.timedelta(20), "t", "ACT", "improved", 0.1, 0.1))
    return spark.createDataFrame(facts, FACTS), spark.createDataFrame(made, PREDICTED)


def lines(df):
    return sorted((r.prediction_id, r.window_days, round(r.actual_magnitude, 9), r.actual_direction, r.direction_correct, r.magnitude_score, r.recommendation_correct) for r in df.collect())


def stream(spark, feed, cuts, folder, predictions, files=None):
    target = resolver.table(spark, f"{folder}/sums")
    edges = [D0 - dt.timedelta(9), *[D0 + dt.timedelta(c) for c in cuts], D0 + dt.timedelta(999)]
    for a, b in zip(edges, edges[1:]):
        feed.filter((F.col("as_of") >= F.lit(a)) & (F.col("as_of") < F.lit(b))).coalesce(1).write.mode("append").parquet(f"{folder}/loads")
        if files is None:
            resolver.run(spark, f"{folder}/loads", target, f"{folder}/state")
    if files:
        resolver.run(spark, f"{folder}/loads", target, f"{folder}/state", files)
    return target


@pytest.mark.parametrize("cuts, files", [([], None), ([13, 41], None), ([5, 21, 22, 58], 1)])
def test_equals_the_batch_however_it_is_split(spark, tables, tmp_path, cuts, files):
    facts, made = tables
    feed = resolver.events(made, facts, "known_on")
    target = stream(spark, feed, cuts, str(tmp_path), made, files)
    assert lines(resolver.resolutions(target, made)) == lines(operate.resolve(made, facts))
    rows = target.read()
    assert rows.filter("prediction_id = 'p327' AND window_days = 30").count() >= 1  # by a timer: its campaign is silent by then
    if cuts:
        assert rows.filter("revision > 0").count() > 0
    n = rows.count()
    resolver.run(spark, f"{tmp_path}/loads", target, f"{tmp_path}/again")  # everything once more, as after a lost checkpoint
    assert target.read().count() >= n and lines(resolver.resolutions(target, made)) == lines(operate.resolve(made, facts))
    resolver.run(spark, f"{tmp_path}/loads", target, f"{tmp_path}/state")
    assert lines(resolver.resolutions(target, made)) == lines(operate.resolve(made, facts))
    spark.sql(f"DROP TABLE {target.name}")


def test_a_correction_is_a_further_revision(spark, tables, tmp_path):
    facts, made = tables
    one = facts.filter("campaign_id = 'c1'").withColumn("known_on", F.col("date"))
    own = made.filter("campaign_id = 'c1'")
    target = stream(spark, resolver.events(own, one, "known_on"), [], str(tmp_path), own)
    assert target.read().filter("revision > 0").count() == 0
    fixed = one.withColumn("cost_micros", F.when(F.col("date") == F.lit(D0 + dt.timedelta(24)), F.col("cost_micros") * 5).otherwise(F.col("cost_micros")))
    load = resolver.events(own.limit(0), fixed.filter(F.col("date") == F.lit(D0 + dt.timedelta(24))).withColumn("known_on", F.lit(D0 + dt.timedelta(60))), "known_on")
    load.coalesce(1).write.mode("append").parquet(f"{tmp_path}/loads")
    resolver.run(spark, f"{tmp_path}/loads", target, f"{tmp_path}/state")
    again = {(r.prediction_id, r.window_days) for r in target.read().filter("revision = 1").collect()}
    assert {("p120", 7), ("p120", 14), ("p127", 7), ("p110", 30)} <= again
    assert lines(resolver.resolutions(target, own)) == lines(operate.resolve(own, fixed.unionByName(facts.filter("campaign_id = 'c0' AND date = DATE '2024-02-29'")), as_of=F.lit(D0 + dt.timedelta(60))))
    spark.sql(f"DROP TABLE {target.name}")


def test_a_step_takes_an_account_and_sums_only_what_a_load_touches(spark, tables, tmp_path, monkeypatch):
    facts = {d: [d, 1.0] for d in range(100)}
    made = {"p": {"at": 50, "told": {}}, "q": {"at": 20, "told": {}}}
    rows, due = resolver._told(facts, made, 58, [99])
    assert [(r[0], r[1], r[2]) for r in rows] == [("p", 7, 0), ("q", 7, 0), ("q", 14, 0), ("q", 30, 0)] and sorted(due) == [64, 80]
    asked, whole = [], resolver._sums
    monkeypatch.setattr(resolver, "_sums", lambda f, at, w: asked.append((at, w)) or whole(f, at, w))
    facts[30] = [7, 7.0]
    assert [(r[0], r[1], r[2]) for r in resolver._told(facts, made, 58, [30])[0]] == [("q", 14, 1), ("q", 30, 1)] and asked == [(20, 14), (20, 30)]
