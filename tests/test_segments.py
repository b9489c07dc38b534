"""Segment signals read their features once, and lines of a campaign are moved once, before they are repeated for the dimensions."""

import re

from pyspark.sql import functions as F

from admeridian.functions.signals import COLUMNS
from admeridian.operators import web
from admeridian.plans.web_queries import QUERIES

NAMES = ("mobile_traffic_share", "mobile_cvr_gap", "search_partners_spend_share", "partners_cpa_ratio", "hour_dead_zone_spend_share", "dow_dead_zone_spend_share", "geo_cpa_variance", "poor_ad_share")
SCHEMA = "account_id string, campaign_id string, " + ", ".join(f"{c} double" for c in NAMES) + ", n_rsa long, has_dead_zones boolean"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]


def test_features_are_read_once_for_all_kinds(spark, sf_dir):
    for name in ("seg01_features", "seg03_07_signals"):
        found = plan(QUERIES[name](spark, sf_dir))
        # lines for the segments, lines and parts for the ads
        assert found.count("FileScan") == 3
        # segments are summed, ranked against their dimension and folded where the lines of their campaign lie
        assert "dimension" not in "".join(re.findall(r"hashpartitioning\(.*", found))


def test_plain_segments_are_moved_once(spark):
    rows = [("a1", f"a1-c{c}", d, v, 10, 5, 100 * (1 + i), float(i % 2)) for c in range(4) for d in ("device", "network", "hour", "geo") for i, v in enumerate(("MOBILE", "SEARCH", "x"))]
    segments = spark.createDataFrame(rows, "account_id string, campaign_id string, dimension string, segment_value string, impressions long, clicks long, cost_micros long, conversions double")
    strength = spark.createDataFrame([("a1", "a1-c0", "k1", "POOR"), ("a1", "a1-c9", "k2", "GOOD")], "account_id string, campaign_id string, ad_id string, ad_strength string")
    found = web.segment_features(segments, strength)
    assert plan(found).count("Exchange hashpartitioning") == 2
    got = {r.campaign_id: r for r in found.collect()}
    assert got.keys() == {"a1-c0", "a1-c1", "a1-c2", "a1-c3", "a1-c9"}
    # of costs 100, 200, 300 the first and the last bring no conversion
    assert all(abs(got[f"a1-c{c}"].hour_dead_zone_spend_share - 4 / 6) < 1e-12 and got[f"a1-c{c}"].has_dead_zones for c in range(4))
    assert got["a1-c0"].poor_ad_share == 1.0 and got["a1-c1"].n_rsa is None and got["a1-c9"].mobile_traffic_share is None


def test_each_kind_is_told_as_by_itself(spark):
    nothing = (None,) * len(NAMES)
    rows = [
        ("a1", "all", 0.7, 2.0, 0.2, 1.5, 0.3, None, 1.1, 0.6, 3, True),
        ("a1", "edges", 0.6, 2.0, 0.15, 1.5, None, 0.4, 1.0, 0.5, 3, True),
        ("a2", "few ads", *nothing[:-1], 0.9, 2, False),
        ("a2", "unknown", *nothing, None, False),
        (None, "", *nothing, None, None),
        ("a3", None, 0.9, 3.0, *nothing[2:], 9, False),
    ]
    found = web.segment_signals(spark.createDataFrame(rows, SCHEMA))
    assert found.columns == COLUMNS
    got = sorted((r.campaign_id or "-", r.signal_type, r.domain, r.severity, r.value, r.threshold, r.data["value"], r.message) for r in found.collect())
    told = lambda c, kind, domain, severity, value, limit: (c or "-", kind, domain, severity, value, limit, str(value), f"{kind} in campaign {c or 'null'}")
    assert got == sorted([
        told("all", "device_mobile_drag", "bidding_strategy", "warning", 2.0, 2.0), told("all", "search_partners_waste", "bidding_strategy", "warning", 1.5, 1.5), told("all", "dead_zone_spend", "bidding_strategy", "info", 0.3, 0.1),
        told("all", "geo_cpa_outlier", "bidding_strategy", "info", 1.1, 1.0), told("all", "weak_ad_strength", web.CREATIVE, "warning", 0.6, 0.5), told("edges", "dead_zone_spend", "bidding_strategy", "info", 0.4, 0.1),
        told(None, "device_mobile_drag", "bidding_strategy", "warning", 3.0, 2.0),
    ])
    assert found.select(F.countDistinct("signal_id")).first()[0] == len(got)
    assert plan(found).count("Scan") == 1
