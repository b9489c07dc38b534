"""Queries and DuckDB oracles of the audits. Every campaign, account or page makes a claim, so that each verdict occurs; the facts
are the daily facts with changes of strategy, budget, names and age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admeridian.operators import audit, detectors, harnesses, trends, trust
from admeridian.operators.detectors import BRANDED, GEO, MICRO_CATEGORIES, TYPED
from admeridian.plans.learn_queries import _TRENDS, rounded
from admeridian.sources.adapters import Tables, ctes


def _claims(rows: DataFrame, key: str, data: dict[str, Column] | None = None) -> DataFrame:
    items = [x for k, v in (data or {"none": F.lit("")}).items() for x in (F.lit(k), v.cast("string"))]
    campaign = F.col("campaign_id") if "campaign_id" in rows.columns else F.lit("")
    return rows.select(F.col(key).alias("signal_id"), "account_id", campaign.alias("campaign_id"), F.create_map(*items).alias("data"))


def _campaigns(daily: DataFrame, only: str = "true", **data: Column) -> DataFrame:
    return _claims(daily.filter(only).groupBy("account_id", "campaign_id").agg(*[v.alias(k) for k, v in data.items()] or [F.lit(0).alias("none")]), "campaign_id", {k: F.col(k) for k in data})


def _accounts(daily: DataFrame, **data: Column) -> DataFrame:
    return _claims(daily.groupBy("account_id").agg(*[v.alias(k) for k, v in data.items()] or [F.lit(0).alias("none")]), "account_id", {k: F.col(k) for k in data})


def _pages(t: Tables) -> DataFrame:
    rows = t.shifted_pages.select("account_id", "landing_page").distinct().withColumn("page", F.concat("account_id", "landing_page"))
    return _claims(rows, "page", {"landing_page": F.col("landing_page")})


def _q(make):
    return lambda spark, sf_dir: make(Tables(spark, sf_dir)).select("signal_id", "test", "verdict")


_PMAX = "campaign_type = 'PERFORMANCE_MAX'"


def _waste(t: Tables) -> DataFrame:
    """Claims of campaigns with what their terms without conversions took."""
    none = F.col("conversions") == 0
    return _campaigns(t.search_terms, waste_clicks=F.sum(F.when(none, F.col("clicks")).otherwise(0)), waste_share=F.sum(F.when(none, F.col("cost_micros")).otherwise(0)) / F.sum("cost_micros"))


def _branded(t: Tables) -> DataFrame:
    """Claims of accounts with a return of their brand campaigns."""
    of = lambda c: F.sum(F.when(F.lower("campaign_name").contains("brand"), F.col(c)).otherwise(0))
    return _accounts(t.shifted_metrics, brand_roas=F.try_divide(of("conversion_value") * 16, of("cost_micros") / 1e6))


def _valued(found: DataFrame, facts: DataFrame) -> DataFrame:
    """Claims with the value and threshold of the change detectors: this week's ratio against last week's."""
    c = F.col
    return found.join(facts.select("account_id", "campaign_id", (c("c7_conv") / c("c7_clicks")).alias("value"), (c("p7_conv") / c("p7_clicks")).alias("threshold")), ["account_id", "campaign_id"])


def _first_six(t: Tables) -> DataFrame:
    """The harnesses of ``audit`` over all campaigns."""
    facts = audit.campaign_facts(t.shifted_metrics)
    found = _valued(_campaigns(t.shifted_metrics), facts)
    tracking = audit.tracking_changes(t.shifted_changes, t.shifted_metrics)
    parts = [make(found, facts) for make in (audit.cpa_change, audit.cpa_spike, audit.budget_capped, audit.budget_limited)] + [make(found, facts, tracking) for make in (audit.cvr_drop, audit.cvr_change)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("test", F.concat_ws(" ", "detector", "test"))


def _widened(t: Tables) -> DataFrame:
    """What a threshold widened by volatility changes among the cost spikes, judged by their harness."""
    wide = trends.with_volatility(trends.campaign_trends(t.daily_metrics)).filter("metric = 'cpa'")
    found = detectors.cpa_spike(t.daily_metrics, recent_cpa_multiplier=1.2)
    return audit.widened_spikes(found, wide, audit.cpa_spike(found, audit.campaign_facts(t.daily_metrics)))


def _votes(t: Tables) -> DataFrame:
    return trust.verdicts(_first_six(t).withColumn("test", F.split_part("test", F.lit(" "), F.lit(2))))


_SIX = ["cpa_change", "cpa_spike", "budget_capped", "budget_limited", "cvr_drop", "cvr_change"]

QUERIES = {
    "aud00_verdicts": lambda spark, sf_dir: _votes(Tables(spark, sf_dir)),
    "aud01_tests": lambda spark, sf_dir: trust.test_table(_first_six(Tables(spark, sf_dir)).withColumn("test", F.split_part("test", F.lit(" "), F.lit(2)))),
    "aud02_detector_calls": lambda spark, sf_dir: trust.detector_calls(_votes(Tables(spark, sf_dir)), [*_SIX, "tracking_break"]),
    "aud03_scorecard": lambda spark, sf_dir: rounded(trust.scorecard(_votes(Tables(spark, sf_dir)), [*_SIX, "tracking_break"])),
    "aud04_false_positives": lambda spark, sf_dir: rounded(_widened(Tables(spark, sf_dir))),
    "aud11_13_17_campaigns": _q(_first_six),
    "aud10_brand_nonbrand": _q(lambda t: harnesses.brand_nonbrand(_branded(t), t.accounts.withColumn("account_name", F.lit("Small Blue")), t.keyword_metrics, t.keyword_counts, t.shifted_changes, t.shifted_metrics)),
    "aud12_budget_limited_is_change": _q(lambda t: harnesses.budget_limited_is_change(_campaigns(t.shifted_metrics), t.shifted_metrics)),
    "aud18_budget_capped_change": _q(lambda t: harnesses.budget_capped_change(_campaigns(t.shifted_metrics), t.shifted_metrics)),
    "aud19_auto_applied": _q(lambda t: harnesses.auto_applied(_claims(t.shifted_changes.groupBy("account_id").agg((F.count("*") / 10).cast("int").alias("count")), "account_id", {"count": F.col("count")}), t.shifted_changes, t.shifted_metrics)),
    "aud20_duplicate_conversions": _q(lambda t: harnesses.duplicate_conversions(_accounts(t.shifted_metrics), t.conversion_actions, t.shifted_metrics)),
    "aud21_over_segmentation": _q(lambda t: harnesses.over_segmentation(_accounts(t.shifted_metrics), t.shifted_metrics)),
    "aud22_insufficient_conv": _q(lambda t: harnesses.insufficient_conversions(_campaigns(t.shifted_metrics, strategy=F.max("bidding_strategy")), t.shifted_metrics)),
    "aud23_pmax_low_volume": _q(lambda t: harnesses.pmax_low_volume(_campaigns(t.shifted_metrics, _PMAX), t.shifted_metrics)),
    "aud24_pmax_low_conv_volume_change": _q(lambda t: harnesses.pmax_low_conv_volume_change(_campaigns(t.shifted_metrics), t.shifted_metrics)),
    "aud25_pmax_conversion_inflation": _q(lambda t: harnesses.pmax_conversion_inflation(_accounts(t.shifted_metrics), t.conversion_actions, t.shifted_metrics)),
    "aud26_search_terms_waste": _q(lambda t: harnesses.search_terms_waste(_waste(t), t.shifted_metrics)),
    "aud27_cross_account_outlier": _q(lambda t: harnesses.cross_account_outlier(_accounts(t.shifted_metrics, segment=F.expr("CASE WHEN max(account_id) LIKE '%1' THEN 'vertical' WHEN max(account_id) LIKE '%2' THEN 'spend_tier' WHEN max(account_id) LIKE '%3' THEN NULL ELSE 'global' END")), t.shifted_metrics)),
    "aud28_vertical_cpa_benchmark": _q(lambda t: harnesses.vertical_cpa_benchmark(_accounts(t.shifted_metrics, ratio=F.try_divide(F.sum("cost_micros") / 1e6, F.sum("conversions")) / 128), t.shifted_metrics)),
    "aud29_ga4_engagement_drop": _q(lambda t: harnesses.ga4_engagement_drop(_pages(t), harnesses.with_other_pages(harnesses.page_windows(t.shifted_pages)))),
    "aud30_ga4_session_duration_collapse": _q(lambda t: harnesses.ga4_session_duration_collapse(_pages(t), harnesses.with_other_pages(harnesses.page_windows(t.shifted_pages)))),
    "aud31_ga4_mobile_engagement_gap": _q(lambda t: harnesses.ga4_mobile_engagement_gap(_pages(t), harnesses.page_windows(t.shifted_pages))),
    "aud32_ga4_mobile_bounce_regression": _q(lambda t: harnesses.ga4_mobile_bounce_regression(_pages(t), harnesses.page_windows(t.shifted_pages))),
}


# --- oracles ---


def _v(disconfirm: str, confirm: str, unknown: str = "FALSE") -> str:
    return f"CASE WHEN {unknown} THEN 'inconclusive' WHEN {disconfirm} THEN 'disconfirm' WHEN {confirm} THEN 'confirm' ELSE 'inconclusive' END"


def _tests(key: str, source: str, *verdicts: str, prefix: str = "") -> str:
    names = ", ".join(f"'{prefix}T{i + 1}'" for i in range(len(verdicts)))
    return f"SELECT {key} AS signal_id, unnest([{names}]) AS test, unnest([{', '.join(verdicts)}]) AS verdict FROM {source}"


_D = "WITH {}, a AS (SELECT max(date) AS d FROM shifted_metrics)"
_M = "shifted_metrics"


def _sql(tables: str, body: str) -> str:
    return f"WITH {ctes(*tables.split())}, a AS (SELECT max(date) AS d FROM {'shifted_pages' if 'shifted_pages' in tables else _M}), {body}"


def _windows(n: int) -> str:
    of = {"c": f"(date > d - {n} AND date <= d)", "p": f"(date > d - {2 * n} AND date <= d - {n})"}
    sums = ", ".join(
        f"count(search_budget_lost_is) FILTER {w} AS {p}n, coalesce(avg(search_budget_lost_is) FILTER {w}, 0) AS {p}l, coalesce(avg(search_rank_lost_is) FILTER {w}, 0) AS {p}r, coalesce(sum(cost_micros) FILTER {w}, 0) AS {p}c, coalesce(sum(conversions) FILTER {w}, 0) AS {p}v, "
        f"max(conversions) FILTER {w} AS {p}m, count(*) FILTER ({w} AND status = 'ENABLED') AS {p}on, count(*) FILTER ({w} AND status <> 'ENABLED') AS {p}off".replace("FILTER (date", "FILTER (WHERE date").replace("FILTER ((date", "FILTER (WHERE (date") for p, w in of.items())
    both = f"date > d - {2 * n} AND date <= d"
    return f"w AS (SELECT campaign_id, {sums}, count(DISTINCT campaign_type || '|' || bidding_strategy) FILTER (WHERE {both}) AS cfg, count(DISTINCT daily_budget_micros) FILTER (WHERE {both} AND daily_budget_micros > 0) AS nb, min(daily_budget_micros) FILTER (WHERE {both} AND daily_budget_micros > 0) AS lb, max(daily_budget_micros) FILTER (WHERE {both} AND daily_budget_micros > 0) AS hb, max(date) - min(date) + 1 AS age FROM {_M}, a GROUP BY account_id, campaign_id)"


_RANK = _v("abs(cr - pr) > abs(cl - pl) + 0.05", "TRUE")
_MONTH = f"""m AS (SELECT account_id, campaign_id, count(*) FILTER (date >= d - 30 AND status = 'ENABLED') AS o, count(*) FILTER (date >= d - 30 AND status <> 'ENABLED') AS x, count(DISTINCT bidding_strategy) FILTER (date >= d - 30) AS st, sum(conversion_value) FILTER (date >= d - 30) AS val, sum(conversions) FILTER (date >= d - 30) AS conv,
  sum(clicks) FILTER (date >= d - 30) AS clk, sum(cost_micros) FILTER (date >= d - 30) AS cost, max(date) - min(date) + 1 AS age, max(bidding_strategy) AS strat, bool_or(campaign_type = 'PERFORMANCE_MAX') AS pm FROM {_M}, a GROUP BY ALL),
mm AS (SELECT *, sum(cost) OVER (PARTITION BY account_id) AS acost FROM m)"""
_ACTIVE = _v("o = 0 OR x > o", "TRUE")


def _month_sums() -> str:
    month = "date >= d - 30"
    parts = {"": month, "p_": f"{month} AND campaign_type = 'PERFORMANCE_MAX'", "s_": f"{month} AND campaign_type = 'SEARCH'"}
    return ", ".join(f"sum({c}) FILTER ({w}) AS {p}{n}" for p, w in parts.items() for n, c in (("val", "conversion_value"), ("conv", "conversions"), ("clk", "clicks"), ("cost", "cost_micros")))


_ACC = f"""ac AS (SELECT account_id, {_month_sums()}, sum(conversions) FILTER (date >= d - 30 AND lower(campaign_name) LIKE '%brand%') AS bconv, sum(conversions) FILTER (date >= d - 30 AND lower(campaign_name) NOT LIKE '%brand%') AS oconv, max(date) - min(date) + 1 AS age,
  coalesce(sum(conversion_value) FILTER (lower(campaign_name) LIKE '%brand%'), 0) * 16 / nullif(coalesce(sum(cost_micros) FILTER (lower(campaign_name) LIKE '%brand%'), 0) / 1e6, 0) AS broas, sum(cost_micros) / 1e6 / nullif(sum(conversions), 0) / 128 AS ratio FROM {_M}, a GROUP BY account_id)"""
_ROAS = _v("coalesce(val / nullif(cost / 1e6, 0), 0) >= 3", "coalesce(val / nullif(cost / 1e6, 0), 0) < 1", "coalesce(val, 0) <= 0")
_SUB = ", ".join(f"'{x}'" for x in harnesses.SUBSTANTIVE)
_CHANGES = f"""ch AS (SELECT account_id, count(*) FILTER (change_timestamp >= CAST(d - 30 AS TIMESTAMP)) AS n, count(*) FILTER (change_timestamp >= CAST(d - 30 AS TIMESTAMP) AND actor = 'auto_applied') AS na,
  count(*) FILTER (change_timestamp >= CAST(d - 30 AS TIMESTAMP) AND actor = 'auto_applied' AND resource_type IN ({_SUB})) AS ns, count(*) FILTER (change_timestamp >= CAST(d - 60 AS TIMESTAMP) AND (contains(resource_type, 'CONVERSION') OR contains(change_type, 'CONVERSION'))) AS nt, CAST(floor(count(*) / 10) AS INT) AS claimed FROM shifted_changes, a GROUP BY account_id)"""
_MICRO = ", ".join(f"'{x}'" for x in MICRO_CATEGORIES)
_PRIMARY = f"""pr AS (SELECT account_id, count(*) AS ncat, max(n) AS most, bool_or(mech) AS mech FROM (SELECT account_id, category, count(*) AS n, bool_or(category IN ({_MICRO}) OR counting_type = 'MANY_PER_CLICK') AS mech FROM conversion_actions WHERE primary_for_goal AND status = 'ENABLED' GROUP BY ALL) GROUP BY account_id)"""
_PW = """pw AS (SELECT account_id, landing_page, sum(sessions) FILTER (date > d - 28) AS s, sum(sessions) FILTER (date > d - 7) AS rs, sum(sessions) FILTER (date > d - 28 AND date <= d - 7) AS bs, sum(engaged_sessions) FILTER (date > d - 7) / nullif(sum(sessions) FILTER (date > d - 7), 0) AS re,
  sum(engaged_sessions) FILTER (date > d - 28 AND date <= d - 7) / nullif(sum(sessions) FILTER (date > d - 28 AND date <= d - 7), 0) AS be, sum(sessions) FILTER (device = 'mobile') AS ms, sum(sessions) FILTER (device = 'desktop') AS ds,
  sum(engaged_sessions) FILTER (device = 'mobile') / nullif(sum(sessions) FILTER (device = 'mobile'), 0) AS me, sum(engaged_sessions) FILTER (device = 'desktop') / nullif(sum(sessions) FILTER (device = 'desktop'), 0) AS de,
  """ + ", ".join(f"sum(sessions - engaged_sessions) FILTER (device = '{d}' AND {w}) / nullif(sum(sessions) FILTER (device = '{d}' AND {w}), 0) AS {d[0]}{n}" for d in ("mobile", "desktop") for n, w in (("r", "date > d - 7"), ("b", "date > d - 28 AND date <= d - 7"))) + """,
  sum(sessions) FILTER (device = 'mobile' AND date > d - 7) AS mrs FROM shifted_pages, a GROUP BY ALL),
sh AS (SELECT x.account_id, x.landing_page, median(y.re - y.be) AS shift FROM pw x LEFT JOIN pw y ON y.account_id = x.account_id AND y.landing_page <> x.landing_page AND y.s >= 50 AND y.landing_page NOT IN ('(not set)', '(other)', '') GROUP BY ALL),
pg AS (SELECT pw.*, shift, account_id || landing_page AS page FROM pw JOIN sh USING (account_id, landing_page))"""
_VOLUME, _SITE = _v("coalesce(rs, 0) < 50", "TRUE"), _v("shift <= -0.1", "TRUE")


def _six() -> tuple[str, str]:
    wins = {"s7": "date >= d - 7", "s14": "date >= d - 14", "s30": "date >= d - 30", "b30": "date >= d - 30 AND date < d - 7", "c7": "date > d - 7", "p7": "date > d - 14 AND date <= d - 7", "q7": "date >= d - 14 AND date < d - 7", "s3": "date >= d - 21 AND date < d - 14", "s4": "date >= d - 28 AND date < d - 21", "c3": "date > d - 21 AND date <= d - 14", "c4": "date > d - 28 AND date <= d - 21"}
    sums = ", ".join(f"sum(conversions) FILTER ({w}) AS {n}_v, sum(clicks) FILTER ({w}) AS {n}_k, sum(cost_micros) FILTER ({w}) AS {n}_c, sum(conversion_value) FILTER ({w}) AS {n}_w, max(cost_micros) FILTER ({w}) AS {n}_mc, max(clicks) FILTER ({w}) AS {n}_mk, count(DISTINCT CASE WHEN {w} AND cost_micros > 0 THEN date END) AS {n}_a, count(DISTINCT CASE WHEN {w} THEN bidding_strategy END) AS {n}_s, count(DISTINCT CASE WHEN {w} THEN campaign_type || '|' || bidding_strategy END) AS {n}_g, avg(search_budget_lost_is) FILTER ({w}) AS {n}_l, avg(search_rank_lost_is) FILTER ({w}) AS {n}_r" for n, w in wins.items())
    both = "date > d - 14"
    facts = f"""g AS (SELECT account_id, campaign_id, {sums}, count(DISTINCT CASE WHEN {both} THEN bidding_strategy END) AS bs, count(DISTINCT CASE WHEN {both} THEN campaign_type || '|' || bidding_strategy END) AS bg, avg(cost_micros / daily_budget_micros) FILTER (date >= d - 14 AND daily_budget_micros > 0) AS util, avg(daily_budget_micros) FILTER (date >= d - 7) AS bud FROM {_M}, a GROUP BY account_id, campaign_id),
h AS (SELECT *, median(bud) OVER (PARTITION BY account_id) AS mbud, {", ".join(f"nullif(coalesce({w}_v / nullif({w}_k, 0), 0), 0) AS {w}_e" for w in ("s3", "s4", "c3", "c4"))} FROM g),
tk AS (SELECT account_id, bool_or(change_timestamp >= CAST(d - 14 AS TIMESTAMP)) AS ts, bool_or(change_timestamp > CAST(d - 14 AS TIMESTAMP) AND change_timestamp <= CAST(d AS TIMESTAMP)) AS tc FROM shifted_changes, a WHERE contains(resource_type, 'CONVERSION') OR contains(change_type, 'CONVERSION') GROUP BY account_id),
k AS (SELECT h.*, ts, tc, c7_v / nullif(c7_k, 0) AS val, p7_v / nullif(p7_k, 0) AS thr, CASE WHEN s3_e IS NULL THEN s4_e WHEN s4_e IS NULL THEN s3_e ELSE (s3_e + s4_e) / 2 END AS sb, CASE WHEN c3_e IS NULL THEN c4_e WHEN c4_e IS NULL THEN c3_e ELSE (c3_e + c4_e) / 2 END AS cb,
  coalesce(q7_v / nullif(q7_k, 0), 0) AS qcvr, coalesce(p7_v / nullif(p7_k, 0), 0) AS pcvr, (c7_w / nullif(c7_v, 0)) / nullif(p7_w / nullif(p7_v, 0), 0) AS lift, (s7_w / nullif(s7_v, 0)) / nullif(b30_w / nullif(b30_v, 0), 0) AS lift30 FROM h LEFT JOIN tk USING (account_id))"""
    parts = [
        _tests("campaign_id", "k", _v("coalesce(p7_v, 0) < 5 OR p7_a < 3", "p7_v >= 15 AND p7_a >= 5"), _v("bs > 1", "bs <= 1"), _v("(val > thr AND lift >= 1.5) OR (NOT (val > thr) AND lift <= 0.67)", "TRUE", "NOT coalesce(c7_v > 0 AND p7_v > 0 AND p7_w > 0, FALSE)"), _v("p7_mc / nullif(p7_c, 0) > 0.5", "p7_mc / nullif(p7_c, 0) <= 0.5"), prefix="cpa_change "),
        _tests("campaign_id", "k", _v("coalesce(s7_v, 0) < 5", "s7_v >= 15"), _v("s7_mc / nullif(s7_c, 0) > 0.5", "s7_mc / nullif(s7_c, 0) <= 0.5"), _v("s30_s > 1", "s30_s <= 1"), _v("lift30 >= 2", "TRUE", "NOT coalesce(s7_v > 0 AND b30_v > 0 AND b30_w > 0, FALSE)"), prefix="cpa_spike "),
        _tests("campaign_id", "k", _v("util < 0.5", "util >= 0.85", "util IS NULL"), _v("coalesce(s14_r, 0) > coalesce(s14_l, 0) + 0.1", "TRUE"), _v("coalesce(s14_v, 0) < 5", "coalesce(s14_v, 0) >= 15"), prefix="budget_capped "),
        _tests("campaign_id", "k", _v("coalesce(s7_r, 0) > coalesce(s7_l, 0) + 0.05", "coalesce(s7_l, 0) > coalesce(s7_r, 0) + 0.1"), _v("s30_c / 1e6 / nullif(s30_v, 0) > 500", "s30_c / 1e6 / nullif(s30_v, 0) <= 200", "coalesce(s30_v, 0) < 1"), _v("coalesce(s7_v, 0) < 5", "coalesce(s7_v, 0) >= 20"), _v("bud / nullif(mbud, 0) < 0.4", "bud / nullif(mbud, 0) >= 0.7", "bud / nullif(mbud, 0) IS NULL"), prefix="budget_limited "),
        _tests("campaign_id", "k", _v("ts", "TRUE"), _v("s14_g > 1", "TRUE"), "'inconclusive'", _v("qcvr > sb * 1.4", "TRUE", "sb IS NULL"), prefix="cvr_drop "),
        _tests("campaign_id", "k", _v("tc", "TRUE"), _v("bg > 1", "TRUE"), _v("(val < thr AND pcvr > cb * 1.4) OR (NOT (val < thr) AND pcvr > 0 AND pcvr < cb * 0.7)", "TRUE", "cb IS NULL"), _v("greatest(c7_mk / nullif(c7_k, 0), p7_mk / nullif(p7_k, 0)) > 0.5", "TRUE"), prefix="cvr_change "),
    ]
    return facts, " UNION ALL ".join(parts)


def _six_facts() -> str:
    return _six()[0]


def _six_tests() -> str:
    return _six()[1]


_VOTES = f"""vt AS ({_six_tests()}), vo AS (SELECT split_part(test, ' ', 1) AS detector, signal_id, count(*) FILTER (verdict = 'confirm') AS confirm, count(*) FILTER (verdict = 'disconfirm') AS disconfirm, count(*) FILTER (verdict = 'inconclusive') AS inconclusive FROM vt GROUP BY ALL),
vv AS (SELECT *, CASE WHEN disconfirm >= 2 THEN 'likely_false_positive' WHEN disconfirm = 1 AND confirm >= 2 THEN 'confirmed_with_caveat' WHEN disconfirm = 0 AND confirm >= 3 THEN 'well_supported' WHEN disconfirm = 0 AND confirm >= 2 THEN 'supported' ELSE 'weak_evidence' END AS overall FROM vo)"""
_KNOWN = "kn AS (SELECT unnest([" + ", ".join(f"'{x}'" for x in [*_SIX, "tracking_break"]) + "]) AS detector)"
ORACLES = {
    "aud00_verdicts": _sql("shifted_metrics shifted_changes", f"{_six_facts()}, {_VOTES} SELECT * FROM vv"),
    "aud01_tests": _sql("shifted_metrics shifted_changes", f"""{_six_facts()}, {_VOTES}, n AS (SELECT split_part(test, ' ', 1) AS detector, split_part(test, ' ', 2) AS test, count(*) FILTER (verdict = 'confirm') AS confirm, count(*) FILTER (verdict = 'disconfirm') AS disconfirm, count(*) FILTER (verdict = 'inconclusive') AS inconclusive, count(*) AS all_ FROM vt GROUP BY ALL)
SELECT detector, test, confirm, disconfirm, inconclusive, CASE WHEN disconfirm > confirm THEN 'unreliable' WHEN disconfirm > 0 AND confirm > 0 THEN 'mixed' WHEN confirm = all_ THEN 'holds' WHEN inconclusive = all_ THEN 'needs data' ELSE 'partial' END AS recommendation FROM n"""),
    "aud02_detector_calls": _sql("shifted_metrics shifted_changes", f"""{_six_facts()}, {_VOTES}, {_KNOWN}, c AS (SELECT detector, count(*) AS n, count(*) FILTER (overall = 'likely_false_positive') AS false_positive, count(*) FILTER (overall IN ('likely_false_positive', 'weak_evidence')) AS bad, count(*) FILTER (overall IN ('supported', 'well_supported')) AS good FROM vv GROUP BY ALL)
SELECT detector, coalesce(n, 0) AS n, coalesce(false_positive, 0) AS false_positive, coalesce(bad, 0) AS bad, coalesce(good, 0) AS good, CASE WHEN n IS NULL THEN 'NO_SIGNALS' WHEN bad > good THEN 'REVISE' WHEN false_positive > 0 THEN 'TIGHTEN' WHEN good = n THEN 'KEEP' ELSE 'MONITOR' END AS call FROM kn LEFT JOIN c USING (detector)"""),
    "aud03_scorecard": _sql("shifted_metrics shifted_changes", f"""{_six_facts()}, {_VOTES}, {_KNOWN}, c AS (SELECT detector, count(*) AS n, avg((overall = 'likely_false_positive')::INT) AS r FROM vv GROUP BY ALL)
SELECT detector, coalesce(n, 0) AS n, round(r, 6) AS false_positive_rate, CASE WHEN n IS NULL THEN 'NO_SIGNALS' WHEN r = 0 THEN 'KEEP' WHEN r < 0.15 THEN 'MONITOR' ELSE 'REVISE' END AS call FROM kn LEFT JOIN c USING (detector)"""),
    "aud04_false_positives": f"""WITH {ctes('daily_metrics')}, {_TRENDS}, w AS (SELECT account_id, campaign_id, CASE WHEN cv > 0.4 THEN 1.5 WHEN cv > 0.15 THEN 1.0 ELSE 0.7 END AS mult FROM tr WHERE window_days = 30 AND metric = 'cpa'),
x AS (SELECT account_id, campaign_id, {', '.join(f"sum({c}) FILTER ({w}) AS {p}{n}, max({c}) FILTER ({w}) AS {p}m{n}" for p, w in (('s', 'date >= d - 7'), ('b', 'date >= d - 30 AND date < d - 7')) for n, c in (('c', 'cost_micros'), ('v', 'conversions'), ('w', 'conversion_value')))}, count(DISTINCT CASE WHEN date >= d - 7 AND cost_micros > 0 THEN date END) AS act, count(DISTINCT CASE WHEN date >= d - 30 THEN bidding_strategy END) AS st FROM daily_metrics, a GROUP BY ALL),
f AS (SELECT x.*, coalesce(mult, 1) AS mult FROM x LEFT JOIN w USING (account_id, campaign_id) WHERE sv >= 5 AND act >= 3 AND smc / sc <= 0.5 AND bv > 3 AND sc / sv > bc / bv * 1.2 AND NOT coalesce(bw > 0 AND sw / sv >= 2 * (bw / bv), FALSE)),
j AS (SELECT *, (sv < 5)::INT + (smc / sc > 0.5)::INT + (st > 1)::INT + coalesce((bv > 0 AND bw > 0 AND (sw / sv) / nullif(bw / bv, 0) >= 2), FALSE)::INT AS wrong, sc / sv > bc / bv * 1.2 * mult AS kept FROM f),
p AS (SELECT 'flat' AS threshold, wrong FROM j UNION ALL SELECT 'widened', wrong FROM j WHERE kept UNION ALL SELECT 'dropped', wrong FROM j WHERE NOT kept)
SELECT threshold, count(*) AS n, count(*) FILTER (wrong > 0) AS false_positives, round(count(*) FILTER (wrong > 0) / count(*), 6) AS false_positive_rate, CAST(sum(wrong) AS BIGINT) AS disconfirming_tests FROM p GROUP BY 1""",
    "aud11_13_17_campaigns": _sql("shifted_metrics shifted_changes", f"{_six_facts()} {_six_tests()}"),
    "aud10_brand_nonbrand": _sql("accounts shifted_metrics shifted_changes keyword_metrics keyword_counts", f"""{_ACC}, {_CHANGES}, lb AS (SELECT DISTINCT account_id, campaign_id, lower(campaign_name) LIKE '%brand%' AS b FROM {_M}, a WHERE date >= d - 30),
kw AS (SELECT account_id, campaign_id, count(DISTINCT keyword_id) AS n, count(DISTINCT keyword_id) FILTER (lower(keyword_text) LIKE '%small%' OR lower(keyword_text) LIKE '%blue%') / count(DISTINCT keyword_id) AS sh FROM keyword_metrics GROUP BY ALL HAVING count(DISTINCT keyword_id) >= 3),
t1 AS (SELECT account_id, bool_or((b AND sh < 0.3) OR (NOT b AND sh > 0.3)) AS w1, bool_or((b AND sh >= 0.5) OR (NOT b AND sh <= 0.15)) AS r1 FROM kw JOIN lb USING (account_id, campaign_id) GROUP BY account_id),
t2 AS (SELECT account_id, bool_or((b AND broad_count / keyword_count > 0.5) OR (NOT b AND (exact_count + phrase_count) / keyword_count > 0.7)) AS w2, bool_or(b AND (exact_count + phrase_count) / keyword_count >= 0.7) AS r2 FROM keyword_counts JOIN lb USING (account_id, campaign_id) WHERE keyword_count >= 3 GROUP BY account_id)
{_tests("account_id", "ac LEFT JOIN t1 USING (account_id) LEFT JOIN t2 USING (account_id) LEFT JOIN ch USING (account_id)", _v("w1", "r1"), _v("w2", "r2"), _v("coalesce(oconv, 0) < 10", "oconv >= 30 AND coalesce(bconv, 0) >= 30"), _v("coalesce(nt, 0) > 0", "TRUE"), _v("coalesce(broas, 0) > 25", "coalesce(broas, 0) <= 15"))}"""),
    "aud12_budget_limited_is_change": _sql(_M, f"{_windows(7)} " + _tests("campaign_id", "w", _v("least(cn, pn) < 5", "least(cn, pn) >= 6"), _v("cfg > 1", "TRUE"), _RANK, _v("least(cc, pc) / 1e6 < 50 OR (greatest(cc, pc) / 1e6) / greatest(least(cc, pc) / 1e6, 1) >= 4", "TRUE"))),
    "aud18_budget_capped_change": _sql(_M, f"{_windows(14)} " + _tests("campaign_id", "w", _v("least(cn, pn) < 7", "least(cn, pn) >= 10"), _v("cfg > 1", "TRUE"), _RANK, _v("nb >= 2 AND hb / greatest(lb, 1) >= 1.25", "TRUE", "nb = 0"))),
    "aud24_pmax_low_conv_volume_change": _sql(_M, f"{_windows(14)} " + _tests("campaign_id", "w", _v("coff > con OR poff > pon", "con >= 12 AND pon >= 12"), _v("abs(cc / pc - cv / pv) <= 0.15 AND abs(cc / pc - 1) >= 0.2", "TRUE", "pc = 0 OR pv = 0"), _v("greatest(coalesce(cm / nullif(cv, 0), 0), coalesce(pm / nullif(pv, 0), 0)) > 0.5", "TRUE"), _v("FALSE", "age >= 42"))),
    "aud19_auto_applied": _sql("shifted_metrics shifted_changes", f"{_CHANGES} " + _tests("account_id", "ch", _v("claimed < 5", "claimed >= 10"), _v("ns / nullif(na, 0) < 0.2", "ns / nullif(na, 0) >= 0.5", "na = 0"), _v("FALSE", "na / nullif(n, 0) >= 0.5"))),
    "aud20_duplicate_conversions": _sql("shifted_metrics conversion_actions", f"{_ACC}, {_PRIMARY} " + _tests("account_id", "ac LEFT JOIN pr USING (account_id)", _v("ncat >= 3 AND most < 2", "most >= 2", "most IS NULL"), _v("conv / nullif(clk, 0) < 0.2", "conv / nullif(clk, 0) > 0.5", "conv / nullif(clk, 0) IS NULL"), _v("FALSE", "val / nullif(conv, 0) < 1", "val / nullif(conv, 0) IS NULL OR coalesce(val, 0) = 0"))),
    "aud21_over_segmentation": _sql(_M, f"""r AS (SELECT * FROM {_M}, a WHERE date >= d - 30 AND status = 'ENABLED'), st AS (SELECT account_id, campaign_name FROM r GROUP BY account_id, campaign_id, campaign_name HAVING sum(conversions) < 30 AND sum(conversions) > 0),
nm AS (SELECT account_id, avg(regexp_matches(campaign_name, '{GEO}')::INT) AS geo, avg((regexp_matches(campaign_name, '{TYPED}') OR regexp_matches(campaign_name, '{BRANDED}'))::INT) AS split FROM st GROUP BY account_id),
sp AS (SELECT account_id, coalesce(sum(c) FILTER (v < 30), 0) / nullif(sum(c), 0) AS sh FROM (SELECT account_id, sum(cost_micros) AS c, sum(conversions) AS v FROM r GROUP BY account_id, campaign_id) GROUP BY account_id)
{_tests("account_id", f"(SELECT DISTINCT account_id FROM {_M}) LEFT JOIN nm USING (account_id) LEFT JOIN sp USING (account_id)", _v("geo >= 0.5", "TRUE", "geo IS NULL"), _v("split >= 0.6", "TRUE", "split IS NULL"), _v("sh < 0.1", "sh >= 0.3", "sh IS NULL"))}"""),
    "aud22_insufficient_conv": _sql(_M, f"{_MONTH} " + _tests("campaign_id", "mm", _ACTIVE, _v("st > 1", "TRUE"), _v("coalesce(val, 0) >= 5000 AND coalesce(conv, 0) >= 8", "coalesce(val, 0) < 500", "strat <> 'TARGET_ROAS'"), _v("age < 14", "TRUE"))),
    "aud23_pmax_low_volume": _sql(_M, f"{_MONTH} " + _tests("campaign_id", "mm WHERE pm", _ACTIVE, _v("val / nullif(conv, 0) >= 500 AND conv >= 10", "TRUE", "coalesce(conv, 0) = 0"), _v("coalesce(cost / nullif(acost, 0), 0) < 0.05", "TRUE", "coalesce(acost, 0) = 0"), _v("age < 21", "TRUE"))),
    "aud25_pmax_conversion_inflation": _sql("shifted_metrics conversion_actions", f"{_ACC}, {_PRIMARY}, z AS (SELECT *, p_val / nullif(p_conv, 0) AS pw, s_val / nullif(s_conv, 0) AS sw, coalesce(p_conv / nullif(p_clk, 0), 0) AS pc, coalesce(s_conv / nullif(s_clk, 0), 0) AS scv FROM ac LEFT JOIN pr USING (account_id)) " + _tests("account_id", "z", _v("coalesce(p_conv, 0) < 15 OR coalesce(s_conv, 0) < 5", "TRUE"), _v("NOT mech", "mech", "mech IS NULL"), _v("pw / sw >= 0.8", "pw / sw < 0.5", "coalesce(pw, 0) = 0 OR coalesce(sw, 0) = 0"), _v("pc < 0.1 AND scv < 0.03", "pc > 0.5"))),
    "aud26_search_terms_waste": _sql("shifted_metrics search_terms", f"{_MONTH}, wt AS (SELECT account_id, campaign_id, coalesce(sum(clicks) FILTER (conversions = 0), 0) AS wc, coalesce(sum(cost_micros) FILTER (conversions = 0), 0) / sum(cost_micros) AS ws FROM search_terms GROUP BY ALL) " + _tests("campaign_id", "wt JOIN mm USING (account_id, campaign_id)", _v("wc < 20", "wc >= 50"), _v("ws < 0.15", "ws >= 0.3"), "CASE WHEN coalesce(conv, 0) < 5 THEN 'confirm' WHEN coalesce(conv / nullif(clk, 0), 0) >= 0.05 THEN 'disconfirm' ELSE 'inconclusive' END")),
    "aud27_cross_account_outlier": _sql(_M, f"{_ACC} " + _tests("account_id", "ac", _ROAS, "CASE WHEN account_id LIKE '%1' THEN 'confirm' WHEN account_id LIKE '%2' THEN 'inconclusive' ELSE 'disconfirm' END", _v("age < 30", "TRUE"), _v("FALSE", "coalesce(conv, 0) >= 100"))),
    "aud28_vertical_cpa_benchmark": _sql(_M, f"{_ACC} " + _tests("account_id", "ac", _ROAS, _v("FALSE", "coalesce(ratio, 0) >= 5"), _v("age < 30", "TRUE"))),
    "aud29_ga4_engagement_drop": _sql("shifted_pages", f"{_PW} " + _tests("page", "pg", _VOLUME, _SITE, _v("re >= 0.55", "re < 0.526"))),
    "aud30_ga4_session_duration_collapse": _sql("shifted_pages", f"{_PW} " + _tests("page", "pg", _VOLUME, _v("(rs / 7) / (bs / 21) >= 1.5", "TRUE", "coalesce(rs, 0) = 0 OR coalesce(bs, 0) = 0"), _SITE)),
    "aud31_ga4_mobile_engagement_gap": _sql("shifted_pages", f"{_PW} " + _tests("page", "pg", _v("least(coalesce(ms, 0), coalesce(ds, 0)) < 100", "TRUE"), _v("coalesce(de - me, 0) < 0.25", "coalesce(de - me, 0) >= 0.3"), _v("FALSE", "me < 0.4"))),
    "aud32_ga4_mobile_bounce_regression": _sql("shifted_pages", f"{_PW} " + _tests("page", "pg", _v("coalesce(mrs, 0) < 50", "TRUE"), _v("NOT coalesce(abs(dr - db) <= 0.05, FALSE)", "TRUE"), _v("FALSE", "mr - mb >= 0.15"))),
}
