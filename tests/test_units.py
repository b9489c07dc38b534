"""Edge cases and numeric references of single operators."""

import datetime as dt
import json
import math
import random
import re
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from admeridian.functions import stats
from admeridian.functions.guidance import GUIDANCE
from admeridian.operators import changes, detectors, episodes, normalise, observe, operate, refinement, templates, trends, web
from admeridian.operators.reads import template_conditions
from admeridian.operators.simulate import account_samples
from admeridian.sources.tables import insert_ignore, upsert_replace
from admeridian.streaming.feeds import change_event_feed

D0 = dt.date(2024, 3, 1)
DAILY = "account_id string, campaign_id string, campaign_name string, campaign_type string, date date, impressions long, clicks long, cost_micros long, conversions double, conversion_value double, search_impression_share double, search_budget_lost_is double, search_rank_lost_is double, bidding_strategy string, status string"


def day(i, cost=100.0, conv=1.0, clicks=50, name="X", campaign="c1", account="a1", lost=None, value=0.0):
    return (account, campaign, name, "SEARCH", D0 + dt.timedelta(days=i), clicks * 40, clicks, int(cost * 1e6), conv, value, None, lost, None, "MANUAL_CPC", "ENABLED")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DAILY)


def test_empty_facts_give_no_signals(empty):
    for find in (detectors.tracking_break, detectors.cpa_spike, detectors.budget_limited_is, detectors.cvr_drop, detectors.budget_capped, detectors.campaign_type_gaps, detectors.over_segmentation, changes.cpa_change, changes.cvr_change, changes.run_all):
        assert find(empty).collect() == []


def test_windows_of_both_conventions(spark):
    # cost per conversion doubles exactly at the border of the change windows: seven days each
    rows = [day(i, 100.0, 1.0) for i in range(0, 7)] + [day(i, 200.0, 1.0) for i in range(7, 14)]
    hit = changes.cpa_change(spark.createDataFrame(rows, DAILY)).collect()
    assert [(r.value, r.threshold, r.data["direction"]) for r in hit] == [(200.0, 100.0, "worsening")]
    # exactly at the threshold of 25 %
    rows = [day(i, 100.0, 1.0) for i in range(0, 7)] + [day(i, 125.0, 1.0) for i in range(7, 14)]
    assert changes.cpa_change(spark.createDataFrame(rows, DAILY)).count() == 1


def test_renamed_campaign_splits(spark):
    rows = [day(i, 100.0, 2.0) for i in range(0, 7)] + [day(i, 300.0, 2.0, name="Y" if i > 9 else "X") for i in range(7, 14)]
    found = changes.cpa_change(spark.createDataFrame(rows, DAILY)).collect()
    assert len(found) == 2 and len({r.signal_id for r in found}) == 2 and {r.threshold for r in found} == {50.0}


def test_shares_that_are_null_do_not_count(spark):
    rows = [day(i, 100.0, 2.0, lost=0.5 if i % 2 else None) for i in range(8)]
    assert [r.value for r in detectors.budget_limited_is(spark.createDataFrame(rows, DAILY), total_cost_micros_min=1).collect()] == [0.5]


def test_moving_all_dates_changes_nothing_else(spark):
    rows = [day(i, 100.0 + 40 * (i > 20), 1.0 + (i % 3)) for i in range(40)]
    a = spark.createDataFrame(rows, DAILY)
    b = a.withColumn("date", F.date_add("date", 100))
    key = lambda d: sorted((r.signal_type, r.value, r.threshold) for r in changes.run_all(d).unionByName(detectors.cpa_spike(d, recent_cpa_multiplier=1.1)).collect())
    assert key(a) == key(b) != []


def test_t_tail(spark):
    # two-sided 10 % and 5 % points of Student's t
    points = [(1, 6.31375, 0.10), (2, 2.91999, 0.10), (3, 2.35336, 0.10), (5, 2.01505, 0.10), (10, 1.81246, 0.10), (12, 2.17881, 0.05), (27, 2.05183, 0.05), (28, 2.04841, 0.05)]
    df = spark.createDataFrame(points, "dof int, t double, p double").withColumn("got", stats.t_two_sided(F.col("t"), F.col("dof")))
    assert all(abs(r.got - r.p) < 1e-5 for r in df.collect())


def test_fisher_and_normal(spark):
    df = spark.createDataFrame([(3, 1, 1, 3, 1.959964)], "a int, b int, c int, d int, z double")
    r = df.select(stats.fisher_greater(*map(F.col, "abcd")).alias("f"), stats.normal_two_sided(F.col("z")).alias("p")).first()
    assert abs(r.f - 17 / 70) < 1e-9 and abs(r.p - 0.05) < 1e-6


def test_trends_of_constant_and_perfect_series(spark):
    rows = [("flat", D0 + dt.timedelta(days=i), 5.0) for i in range(8)] + [("line", D0 + dt.timedelta(days=i), 100.0 + i) for i in range(8)] + [("short", D0 + dt.timedelta(days=i), 1.0 + i) for i in range(6)]
    got = {r.k: r for r in stats.trend(spark.createDataFrame(rows, "k string, date date, value double"), ["k"], F.lit("cpa")).collect()}
    assert set(got) == {"flat", "line"}
    assert got["flat"].classification == "stable" and got["line"].classification == "declining" and got["line"].p_value < 1e-6 and abs(got["line"].projected_7d - 114) < 1e-9


def brute_segments(y, size, penalty):
    y = (y - y.mean()) / y.std()
    cost = lambda a, b: float(((y[a:b] - y[a:b].mean()) ** 2).sum())
    best = {0: (-penalty, [])}
    for e in range(size, len(y) + 1):
        options = [(best[s][0] + cost(s, e) + penalty, best[s][1] + [s]) for s in best if e - s >= size]
        if options:
            best[e] = min(options)
    return best[len(y)][0], [s for s in best[len(y)][1] if s]


def test_change_points_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(20):
        y = np.concatenate([rng.normal(m, 1, int(n)) for m, n in zip(rng.integers(0, 6, 3), rng.integers(6, 15, 3))])
        assert trends.change_points(y, 4, 3.0) == brute_segments(y, 4, 3.0)[1]
    assert trends.change_points(np.array([1.0] * 20 + [9.0] * 20)) == [20]
    assert trends.change_points(np.ones(10)) == []


def test_change_points_of_many_series_are_those_of_each():
    rng = np.random.default_rng(1)
    for n in (7, 8, 29, 60, 84):
        series = rng.normal(0, 1, (50, n)) + np.where(np.arange(n) < rng.integers(4, n - 2, (50, 1)), 0.0, 3.0)
        series[0] = 5.0
        got = trends.change_points_of(series, 4, 3.0)
        assert [np.flatnonzero(m).tolist() for m in got] == [trends.change_points(y, 4, 3.0) for y in series]


def test_regimes_search_batches_of_campaigns(spark):
    rng = np.random.default_rng(2)
    rows = [day(i, cost=float(rng.integers(80, 120)) * (3 if i >= 20 + c else 1), conv=float(rng.integers(1, 4)) if i % (c + 3) else 0.0, campaign=f"c{c}") for c in range(5) for i in range(44)]
    found = trends.regimes(spark.createDataFrame(rows, DAILY).repartition(4)).collect()
    costs = {c: [(r[4], r[7] / 1e6, r[8]) for r in rows if r[1] == f"c{c}"] for c in range(5)}
    want = {(f"c{c}", m, days[at][0]) for c, own in costs.items() for m, days in (("cost", [(d, x) for d, x, _ in own]), ("cpa", [(d, x / v) for d, x, v in own if v])) for at in trends.change_points(np.array([x for _, x in days]))}
    assert {(r.campaign_id, r.metric, r.change_date) for r in found if r.metric in ("cost", "cpa")} == want and len(want) >= 5
    r = next(r for r in found if r.campaign_id == "c0" and r.metric == "cost")
    own = [x for _, x, _ in costs[0]]
    assert (r.days_before, r.days_after, r.shift_direction) == (20, 24, "up") and r.pre_mean == pytest.approx(statistics.mean(own[:20])) and r.post_mean == pytest.approx(statistics.mean(own[20:]))
    # campaigns are rows of few batches, no group of their own
    assert "FlatMapGroups" not in trends.regimes(spark.createDataFrame(rows, DAILY))._jdf.queryExecution().toString()


def exchanges(df):
    """What the exchanges of a plan deal by."""
    return re.findall(r"hashpartitioning\(([^)]*?), \d+\)", df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1])


def test_days_beside_a_change_are_not_moved_again(spark):
    daily = spark.createDataFrame([day(i, cost=100.0 + i, conv=2.0) for i in range(60)], DAILY)
    at = D0 + dt.timedelta(days=30)
    keys = spark.createDataFrame([("k1", "a1", "c1", at), ("k2", "a1", "", at)], "episode_id string, account_id string, campaign_id string, change_date date")
    states = templates.context(keys.withColumnsRenamed({"episode_id": "key", "change_date": "at"}), daily)
    made = keys.select(F.col("episode_id").alias("prediction_id"), "account_id", "campaign_id", F.col("change_date").alias("registered_at"), F.lit("t").alias("template_id"), F.lit("ACT").alias("recommendation"), F.lit("improved").alias("prediction_direction"), F.lit(0.1).alias("prediction_magnitude"), F.lit(0.1).alias("natural_magnitude"))
    for found, key in ((episodes.window_metrics(keys, daily).drop("episode_id"), "episode_id"), (states, "key"), (operate.resolve(made, daily), "prediction_id")):
        dealt = exchanges(found)
        assert dealt
        # pairs of a change and a day stay where the days lie; only finished rows may be dealt by the change
        wide = [x for x in dealt if x.split("#")[0] in (key, "account_id") and key in x and "," in x]
        assert not wide, wide
    assert {r.key: round(r.avg_cpa, 6) for r in states.collect()} == {"k1": 57.25, "k2": 57.25}
    assert [(r.window_days, r.prediction_id) for r in operate.resolve(made, daily).orderBy("window_days").collect()] == [(7, "k1"), (14, "k1")]


CHANGES = "account_id string, change_id string, change_timestamp timestamp, resource_type string, campaign_id string, actor string, old_value string, new_value string"


def event(i, n, resource="CAMPAIGN_BUDGET", actor="human", campaign="c1"):
    return ("a1", f"e{n}", dt.datetime(2024, 3, 1) + dt.timedelta(days=i), resource, campaign, actor, "amount_micros: 100", "amount_micros: 150")


def test_bundles_confounders_and_scopes(spark):
    daily = spark.createDataFrame([day(i, 100.0 - 30 * (i >= 15), 2.0, campaign=c) for i in range(31) for c in ("c1", "c2")], DAILY)
    log = [event(15, 1), event(17, 2), event(15, 3, "AD", "human", "c2"), event(16, 4, "CAMPAIGN", "auto_applied", "c2"), event(15, 5, campaign=""), event(2, 6), event(29, 7), event(20, 8, "WEIRD", "x", "c2")]
    got = {(r.campaign_id, r.change_date.day, r.actor): r for r in episodes.build(spark.createDataFrame(log, CHANGES), daily).collect()}
    assert ("c1", 3, "human") not in got and ("c1", 30, "human") not in got  # too near the ends of the data
    assert not got["c1", 16, "human"].confounded  # a repeat of one lever does not confound
    assert got["c2", 16, "human"].confounded and got["c2", 16, "human"].outcome == "confounded"
    assert got["", 16, "human"].pre_cost == 1400.0 and got["", 16, "human"].pre_days == 7
    assert got["c1", 16, "human"].outcome == "improved" and got["c2", 21, "x"].change_category == "other"


def test_confounders_of_a_busy_campaign(spark):
    rng = random.Random(8)
    kinds = ["budget", "bidding", "asset", "structure"]
    rows = [(f"e{i}", "a", "c" if i % 3 else "d", D0 + dt.timedelta(rng.randrange(40)), sorted(rng.sample(kinds, rng.choice([1, 1, 2])))) for i in range(60)]
    rows += [(f"q{i}", "a", "quiet", D0 + dt.timedelta(3 * i), ["budget"]) for i in range(20)] + [("far", "a", "quiet", D0 + dt.timedelta(90), ["asset"])]
    want = {a for a, k, c, d, own in rows for b, k2, c2, d2, other in rows if a != b and (k, c) == (k2, c2) and 0 <= (d2 - d).days < 7 and set(other) - set(own)}
    table = spark.createDataFrame(rows, "episode_id string, account_id string, campaign_id string, change_date date, categories array<string>")
    assert {r.episode_id for r in episodes.confounded(table).collect()} == want and 0 < len(want) < len(rows) - 20
    plan = episodes.confounded(table)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "array_except" not in plan
    many = spark.range(100_000).selectExpr("concat('e', id) AS episode_id", "'a' AS account_id", "'hot' AS campaign_id", "date_add(DATE '2024-01-01', CAST(id % 300 AS INT)) AS change_date", "IF(id % 2 = 0, array('budget'), array('asset')) AS categories")
    assert episodes.confounded(many).count() == 100_000 - 333  # nothing follows the last day


def test_property_map_by_shared_words(spark):
    rng = random.Random(9)
    words = ["north", *[f"word{i}" for i in range(12)]]
    name = lambda: " ".join(["north", *rng.sample(words[1:], rng.randrange(4))])
    a = [(f"a{i}", name(), "shop%d.example.com" % i if i % 4 == 0 else None) for i in range(40)]
    p = [(f"p{i}", name(), "https://www.shop%d.example.com/x" % i if i % 8 == 0 else "") for i in range(40)]
    p.append(("p99", None, None))
    hosts, want = {u.split("//www.")[1].split("/")[0]: k for k, _, u in p if u}, {}
    for k, n, u in a:
        if u in hosts:
            want[k] = (hosts[u], "domain")
            continue
        scored = sorted((-len(set(n.split()) & set((m or "").split())), q) for q, m, _ in p)
        want[k] = (scored[0][1], "name") if scored[0][0] <= -2 else (None, "unmatched")
    got = normalise.property_map(spark.createDataFrame(a, "account_id string, account_name string, website_url string"), spark.createDataFrame(p, "ga4_property string, name string, url string"))
    assert {r.account_id: (r.ga4_property, r.match_method) for r in got.collect()} == want


def test_equal_names_meet_once(spark):
    a = [(f"a{i:03}", f"north gate {'legal' if i % 2 else 'beauty'}", "") for i in range(300)]
    p = [(f"p{i:03}", "north gate legal" if i % 3 else "gate north", "") for i in range(300)]
    got = normalise.property_map(spark.createDataFrame(a, "account_id string, account_name string, website_url string"), spark.createDataFrame(p, "ga4_property string, name string, url string"))
    assert {(r.account_id, r.ga4_property) for r in got.collect()} == {(f"a{i:03}", "p001" if i % 2 else "p000") for i in range(300)}
    read = "-".join(f.split("/")[-2].rsplit("-", 1)[0] for f in sorted(got.inputFiles()))
    sets = [spark.read.parquet(f).count() for f in got.inputFiles() if "words-" in f]
    assert "account-words" in read and "property-words" in read and sum(sets) == 4


def test_clicks_that_hold_are_whole_numbers(spark):
    # 90 * 0.7 is 62.99999999999999 as a double
    rows = lambda clicks: spark.createDataFrame([day(0, conv=10.0, clicks=90), day(1, conv=1.0, clicks=clicks)], DAILY)
    assert [detectors.tracking_break(rows(c)).count() for c in (62, 63, 64)] == [0, 0, 1]


def test_bundle_pages_hold_every_signal(spark):
    accounts = spark.createDataFrame([("a", "x"), ("b", "y")], "account_id string, vertical string")
    summary = spark.createDataFrame([("a", 5)], "account_id string, clicks long")
    found = spark.range(1000).selectExpr("concat('s', id) AS signal_id", "'a' AS account_id", "'k' AS signal_type", "'info' AS severity", "'m' AS message")
    rows = observe.account_bundles(accounts, summary, found).collect()
    own = [json.loads(r.bundle) for r in rows if r.account_id == "a"]
    assert sorted(x["signal_id"] for b in own for x in b["signals"]) == sorted(f"s{i}" for i in range(1000)) and len(own) == 5
    assert [(r.part, r.n_signals) for r in rows if r.account_id == "b"] == [(0, 0)]


def test_guidance_covers_every_known_kind():
    assert set(detectors.TIERS) <= set(GUIDANCE)


def test_cascade_counts_what_is_left(spark):
    def row(i, account, vertical, tier):
        return (f"e{i:03}", account, "budget", False, "saas", vertical, tier, "stable", -0.2, "improved")

    rows = [row(i, f"a{i % 3}", "v1", "t1") for i in range(10)] + [row(10 + i, f"a{i % 2}", "v2", "t1") for i in range(10)] + [row(20 + i, f"b{i % 3}", "v3", "t1") for i in range(9)]
    df = spark.createDataFrame(rows, "episode_id string, account_id string, change_category string, is_multi_action boolean, business_type string, vertical string, spend_tier string, pre_state string, signed double, direction string")
    got = {r.episode_id: (r.level, r.template_id) for r in templates.cascade(df).collect()}
    assert got["e000"] == (0, "budget__single__saas__v1__t1__stable")
    assert got["e010"] == (2, "budget__single__saas__stable") and got["e020"] == (2, "budget__single__saas__stable")
    summary = {r.template_id: r for r in templates.summary(templates.cascade(df)).collect()}
    assert summary["budget__single__saas__stable"].n_episodes == 19


def test_decisions_at_their_thresholds(spark):
    df = spark.createDataFrame([(x,) for x in (0.2, 0.1, 0.0999, -0.1, None)], "x double")
    assert [r[0] for r in df.select(refinement.decision(F.col("x"))).collect()] == ["DO_NOT_ACT", "WAIT", "EITHER", "ACT", "WAIT"]


def test_upserts(spark):
    old, new = (spark.createDataFrame(r, "k int, v string, at int") for r in ([(1, "a", 1), (2, "b", 5)], [(1, "c", 2), (2, "d", 4), (3, "e", 1), (3, "f", 2)]))
    assert sorted(map(tuple, upsert_replace(old, new, ["k"], "at").collect())) == [(1, "c", 2), (2, "b", 5), (3, "f", 2)]
    again = upsert_replace(upsert_replace(old, new, ["k"], "at"), new, ["k"], "at")
    assert sorted(map(tuple, again.collect())) == [(1, "c", 2), (2, "b", 5), (3, "f", 2)]
    assert sorted(map(tuple, insert_ignore(old, new, ["k"]).collect())) == [(1, "a", 1), (2, "b", 5), (3, "e", 1)]


def test_feed_adds_each_event_once(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    frame = spark.createDataFrame([("a", "1", 5), ("a", "2", 6)], "account_id string, change_id string, n int")
    for extra in ([], [("a", "2", 9), ("b", "3", 7)]):
        (spark.createDataFrame(extra, frame.schema) if extra else frame).write.mode("append").parquet(source)
        change_event_feed(spark, source, frame.schema, target, mark)
    assert sorted(map(tuple, spark.read.parquet(target).collect())) == [("a", "1", 5), ("a", "2", 6), ("b", "3", 7)]


def test_paths(spark):
    cases = {"https://x.com/A/b/?q=1": "/a/b", "/Shop/": "/shop", "": "/", None: "/", "http://x.com": "/", "/?a": "/"}
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    assert {r.u: r.p for r in df.withColumn("p", web.normalised_path(F.col("u"))).collect()} == cases


def test_wilson(spark):
    low, high = spark.range(1).select(*stats.wilson(F.lit(8), F.lit(10))).first()
    assert abs(low - 0.4901625) < 1e-6 and abs(high - 0.9433178) < 1e-6 and not math.isnan(low)


@pytest.mark.parametrize("block", [7, 256])
def test_convergence_equals_a_plain_loop(spark, block):
    rng = random.Random(3)
    rows = [(f"t{k % 2}", f"e{k:04d}", dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(80)), rng.uniform(-1, 3), rng.choice(["improved", "degraded"])) for k in range(300)]
    members = spark.createDataFrame(rows, "template_id string, episode_id string, change_date date, signed double, direction string")
    usual = {"t0": "improved", "t1": "degraded"}
    found = spark.createDataFrame([(t, "ACTIVE", d, 150) for t, d in usual.items()], "template_id string, status string, prediction_direction string, n_episodes int")
    got = {(r.template_id, r.observation): r for r in refinement.convergence(members, found, block=block).collect()}
    for t, d in usual.items():
        seen = sorted((x[2], x[1], x[3], x[4]) for x in rows if x[0] == t)
        estimate, total = statistics.median(x[2] for x in seen[:3]), 0.0
        for i, (_, _, value, direction) in enumerate(seen, 1):
            total += abs(estimate - value)
            r = got[t, i]
            assert abs(r.running_estimate - estimate) < 1e-9 and r.actual == value and abs(r.running_mae - total / i) < 1e-9
            if direction == d:
                estimate = 0.9 * estimate + 0.1 * value
    assert len(got) == 300


def test_template_ids_spell_out_their_conditions(spark):
    ids = ["mag:budget__mag=medium_increase__single__ecommerce__apparel__25k-100k__stable", "mag:bidding__mag=na__multi__volatile", "budget__single__local__crisis"]
    got = [tuple(r[0]) for r in spark.createDataFrame([(i,) for i in ids], "id string").select(template_conditions(F.col("id"))).collect()]
    assert got == [("budget", "medium_increase", False, "ecommerce", "apparel", "25k-100k", "stable"), ("bidding", "na", True, None, None, None, "volatile"), ("budget", None, False, "local", None, None, "crisis")]


def test_account_samples_rotate_within_types(spark):
    accounts = spark.createDataFrame([(f"a{i}", "shop" if i < 6 else "local") for i in range(9)], "account_id string, business_type string")
    got = {}
    for r in account_samples(accounts, (3, 20), 2).collect():
        got.setdefault((r.tier, r.rep), set()).add(r.account_id)
    assert got == {(3, 0): {"a1", "a2", "a7"}, (3, 1): {"a2", "a3", "a8"}, (20, 0): {f"a{i}" for i in range(9)}}
