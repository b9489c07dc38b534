"""Queries and DuckDB oracles of the detectors and dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admeridian.functions.guidance import GUIDANCE
from admeridian.operators import changes, detectors, dimensions
from admeridian.sources.adapters import Tables, ctes


def core(found: DataFrame) -> DataFrame:
    return found.select("account_id", "campaign_id", "signal_type", "severity", F.round("value", 10).alias("value"), F.round("threshold", 10).alias("threshold"))


def _signals(make):
    return lambda spark, sf_dir: core(make(Tables(spark, sf_dir)))


QUERIES = {
    "det01_tracking_break": _signals(lambda t: detectors.tracking_break(t.daily_metrics)),
    "det02_low_quality_score": _signals(lambda t: detectors.low_quality_score(t.keyword_metrics)),
    "det03_cpa_spike": _signals(lambda t: detectors.cpa_spike(t.daily_metrics, recent_cpa_multiplier=1.5)),
    "det04_budget_limited_is": _signals(lambda t: detectors.budget_limited_is(t.daily_metrics, avg_budget_lost_is_min=0.25)),
    "det05_cvr_drop": _signals(lambda t: detectors.cvr_drop(t.daily_metrics)),
    "det06_roas_contamination": _signals(lambda t: detectors.roas_contamination(t.daily_metrics, t.accounts, t.keyword_metrics, brand_roas_min=0.2, nonbrand_roas_max=30.0, blended_roas_min=0.2)),
    "det07_pmax_dominance": _signals(lambda t: detectors.pmax_dominance(t.daily_metrics.withColumn("campaign_type", F.expr("CASE WHEN campaign_type = 'SHOPPING' OR account_id LIKE '%7' THEN 'PERFORMANCE_MAX' ELSE campaign_type END")), t.accounts)),
    "det08_auto_applied_changes": _signals(lambda t: detectors.auto_applied_changes(t.change_events, t.daily_metrics)),
    "det09_budget_capped": _signals(lambda t: detectors.budget_capped(t.daily_metrics, avg_budget_lost_is_min=0.2, min_days_capped=3)),
    "det10_insufficient_conversions": _signals(lambda t: detectors.insufficient_conversions(t.daily_metrics, monthly_conv_min=40)),
    "det11_suspicious_primary": _signals(lambda t: detectors.suspicious_primary(t.conversion_actions)),
    "det12_duplicate_primary": _signals(lambda t: detectors.duplicate_primary(t.conversion_actions, t.daily_metrics, inflation_cvr_min=0.05)),
    "det13_missing_conversion_value": _signals(lambda t: detectors.missing_conversion_value(t.daily_metrics.withColumn("conversion_value", F.when(F.col("account_id").endswith("3"), 0.0).otherwise(F.col("conversion_value"))))),
    "det14_over_segmentation": _signals(lambda t: detectors.over_segmentation(t.daily_metrics, per_campaign_conv_min=60, intentional_type_brand_share_max=1.1)),
    "det15_missing_brand_separation": _signals(lambda t: detectors.missing_brand_separation(t.daily_metrics.withColumn("campaign_name", F.replace("campaign_name", F.lit("Brand"), F.lit("Core"))))),
    "det16_17_campaign_type_gaps": _signals(lambda t: detectors.campaign_type_gaps(t.daily_metrics.withColumn("campaign_type", F.expr("CASE WHEN account_id LIKE '%1' THEN 'SHOPPING' WHEN account_id LIKE '%2' AND campaign_type = 'PERFORMANCE_MAX' THEN 'SHOPPING' ELSE campaign_type END")))),
    "det18_broad_without_smart_bidding": _signals(lambda t: detectors.broad_without_smart_bidding(t.keyword_counts, t.daily_metrics)),
    "det19_low_negative_ratio": _signals(lambda t: detectors.low_negative_ratio(t.keyword_counts)),
    "det20_missing_extensions": _signals(lambda t: detectors.missing_extensions(t.asset_coverage.withColumn("asset_type", F.expr("CASE WHEN account_id LIKE '%5' THEN 'CALL' ELSE asset_type END")))),
    "det21_cross_account_outlier": _signals(lambda t: detectors.cross_account_outlier(t.daily_metrics, t.accounts, z_threshold=1.0)),
    "det22_pmax_low_volume": _signals(lambda t: detectors.pmax_low_volume(t.daily_metrics)),
    "det23_pmax_conversion_inflation": _signals(lambda t: detectors.pmax_conversion_inflation(t.daily_metrics, cvr_ratio_min=1.1)),
    "det24_search_terms_waste": _signals(lambda t: detectors.search_terms_waste(t.search_terms)),
    "det25_vertical_cpa_benchmark": _signals(lambda t: detectors.vertical_cpa_benchmark(t.daily_metrics, t.accounts, high_multiple=1.2)),
    "det26_skip_overrides": _signals(lambda t: detectors.without_skipped(detectors.pmax_low_volume(t.daily_metrics), t.accounts)),
    "det27_confidence": lambda spark, sf_dir: (lambda t: detectors.with_confidence(detectors.tracking_break(t.daily_metrics).unionByName(detectors.pmax_low_volume(t.daily_metrics))).groupBy("signal_type", "confidence_tier", "cannot_rule_out", "check_next").agg(F.count("*").alias("n"), F.count("what_we_know").alias("known")))(Tables(spark, sf_dir)),
    "det28_run_all": lambda spark, sf_dir: detectors.run_all(Tables(spark, sf_dir)).groupBy("signal_type").agg(F.count("*").alias("n"), F.countDistinct("signal_id").alias("ids")),
    "chg01_budget_capped_change": _signals(lambda t: changes.budget_capped_change(t.daily_metrics, min_delta_pp=0.03)),
    "chg02_budget_limited_is_change": _signals(lambda t: changes.budget_limited_is_change(t.daily_metrics, min_days_with_data=3, min_delta_pp=0.05)),
    "chg03_pmax_low_volume_change": _signals(lambda t: changes.pmax_low_volume_change(t.daily_metrics, min_days_with_data=4)),
    "chg04_cvr_change": _signals(lambda t: changes.cvr_change(t.daily_metrics)),
    "chg05_cpa_change": _signals(lambda t: changes.cpa_change(t.daily_metrics)),
    "dim01_spend_tier": lambda spark, sf_dir: (lambda t: dimensions.spend_tier(t.daily_metrics, t.accounts))(Tables(spark, sf_dir)),
    "dim05_distribution": lambda spark, sf_dir: dimensions.distribution(Tables(spark, sf_dir).accounts, "business_type").select("value", "n", F.round("share", 6).alias("share")),
    "dim06_spend_ranking": lambda spark, sf_dir: dimensions.spend_ranking(Tables(spark, sf_dir).daily_metrics, 20).select("account_id", F.round("spend", 4).alias("spend")),
    "dim07_dormant_accounts": lambda spark, sf_dir: dimensions.dormant_accounts(Tables(spark, sf_dir).daily_metrics.withColumn("cost_micros", F.expr("CASE WHEN account_id LIKE '%7' AND date > DATE '2024-02-10' THEN 0 ELSE cost_micros END"))).select("account_id", F.col("last_month").cast("string").alias("last_month"), F.round("last_spend", 4).alias("last_spend")),
    "dim08_dominant_campaign_type": lambda spark, sf_dir: dimensions.dominant_campaign_type(Tables(spark, sf_dir).daily_metrics),
    "dim09_account_summary": lambda spark, sf_dir: (lambda d: d.select("account_id", "campaigns", "impressions", "clicks", *[F.round(c, 6).alias(c) for c in ("cost", "conversions", "conversion_value", "cpa", "roas", "cvr")]))(dimensions.account_summary(Tables(spark, sf_dir).daily_metrics)),
    "dim10_brand_tokens": lambda spark, sf_dir: dimensions.brand_tokens(Tables(spark, sf_dir).accounts).select("account_id", F.array_join("tokens", " ").alias("tokens")),
    "dim11_brand_keyword_share": lambda spark, sf_dir: (lambda t: dimensions.brand_keyword_share(t.accounts.withColumn("account_name", F.lit("Part Blue")), t.keyword_metrics).select("account_id", "campaign_id", "keywords", "matches", F.round("brand_share", 6).alias("brand_share")))(Tables(spark, sf_dir)),
    "dim12_name_fractions": lambda spark, sf_dir: detectors.name_fractions(Tables(spark, sf_dir).daily_metrics.select("account_id", "campaign_name").distinct()).select("account_id", F.round("geo_fraction", 6).alias("geo_fraction"), F.round("type_brand_fraction", 6).alias("type_brand_fraction")),
    "src02_daily_read": lambda spark, sf_dir: Tables(spark, sf_dir).daily_metrics.filter("account_id = 'a3' AND date >= DATE '2024-02-01'").select("account_id", "campaign_id", F.col("date").cast("string").alias("date"), "clicks", "cost_micros"),
}


def _one(tables: str, body: str) -> str:
    return f"WITH {ctes(*tables.split())}, a AS (SELECT max(date) AS d FROM daily_metrics)\n{body}"


def _sig(kind: str, severity: str, value: str, threshold: str, campaign: str = "''") -> str:
    return f"SELECT account_id, {campaign} AS campaign_id, {kind} AS signal_type, {severity} AS severity, round(CAST({value} AS DOUBLE), 10) AS value, round(CAST({threshold} AS DOUBLE), 10) AS threshold"


def _pair(days: int, cur: str, prior: str, where: str, sig: str, cond: str = "TRUE") -> str:
    return _one("daily_metrics", f"""
, cur AS (SELECT account_id, campaign_id, campaign_name, {cur} FROM daily_metrics, a WHERE date > d - {days} AND date <= d AND {cond} GROUP BY ALL),
pri AS (SELECT account_id, campaign_id, {prior} FROM daily_metrics, a WHERE date > d - {2 * days} AND date <= d - {days} AND {cond} GROUP BY ALL)
{sig} FROM cur JOIN pri USING (account_id, campaign_id) WHERE {where}""")


_C = "campaign_id"
_BENCH = "CASE vertical WHEN 'apparel' THEN 108 * 1.15 WHEN 'legal' THEN 160 * 1.0 WHEN 'beauty' THEN 73 * 1.1 WHEN 'home_goods' THEN 107 * 1.05 END"
_LOW = """pm AS (SELECT account_id, campaign_id, campaign_name, sum(conversions) AS conv, sum(cost_micros) AS cost, sum(conversion_value) AS val FROM daily_metrics, a
  WHERE date >= d - 30 AND campaign_type = 'PERFORMANCE_MAX' AND status = 'ENABLED' GROUP BY ALL),
age AS (SELECT account_id, campaign_id, max(date) - min(date) + 1 AS days FROM daily_metrics GROUP BY ALL),
low AS (SELECT * FROM pm JOIN age USING (account_id, campaign_id) WHERE conv < 30 AND cost > 1000000000 AND (val / nullif(conv, 0) < 500 OR conv < 10) AND days >= 21)"""
_BREAK = """day AS (SELECT account_id, date, sum(conversions) AS conv, sum(clicks) AS clicks FROM daily_metrics, a WHERE date >= d - 14 GROUP BY ALL),
br AS (SELECT x.account_id, x.conv, y.conv AS prior FROM day x JOIN day y ON x.account_id = y.account_id AND x.date = y.date + 1 WHERE y.conv > 5 AND x.conv < y.conv * 0.2 AND x.clicks > y.clicks * 0.7)"""

def _told(kind: str) -> str:
    quoted = ["'" + x.replace("'", "''") + "'" for x in GUIDANCE[kind]]
    return f"{quoted[0]} AS cannot_rule_out, {quoted[1]} AS check_next"


ORACLES = {
    "det01_tracking_break": _one("daily_metrics", f", {_BREAK} {_sig(chr(39) + 'tracking_break' + chr(39), chr(39) + 'critical' + chr(39), 'conv', 'prior * 0.2')} FROM br"),
    "det02_low_quality_score": _one("daily_metrics keyword_metrics", f"{_sig(chr(39) + 'low_quality_score' + chr(39), chr(39) + 'warning' + chr(39), 'quality_score', '5')} FROM keyword_metrics WHERE quality_score < 5 AND cost_micros > 200000000 AND impressions > 100 ORDER BY cost_micros DESC, account_id, keyword_id, keyword_metrics.campaign_id LIMIT 50"),
    "det03_cpa_spike": _one("daily_metrics", f""", r AS (SELECT account_id, campaign_id, campaign_name, sum(cost_micros) / nullif(sum(conversions), 0) AS cpa, sum(conversions) AS conv, sum(conversion_value) / nullif(sum(conversions), 0) AS aov,
  count(DISTINCT CASE WHEN cost_micros > 0 THEN date END) AS act, max(cost_micros) / nullif(sum(cost_micros), 0) AS top FROM daily_metrics, a WHERE date >= d - 7 GROUP BY ALL),
b AS (SELECT account_id, campaign_id, sum(cost_micros) / nullif(sum(conversions), 0) AS bcpa, sum(conversions) AS bconv, sum(conversion_value) / nullif(sum(conversions), 0) AS baov FROM daily_metrics, a WHERE date >= d - 30 AND date < d - 7 GROUP BY ALL)
{_sig("'cpa_spike'", "'critical'", 'cpa / 1e6', 'bcpa / 1e6 * 1.5', _C)} FROM r JOIN b USING (account_id, campaign_id) WHERE conv >= 5 AND act >= 3 AND top <= 0.5 AND bconv > 3 AND cpa > bcpa * 1.5 AND NOT coalesce(baov > 0 AND aov >= 2 * baov, FALSE)"""),
    "det04_budget_limited_is": _one("daily_metrics", f", g AS (SELECT account_id, campaign_id, campaign_name, avg(search_budget_lost_is) AS lost, sum(cost_micros) AS cost, sum(conversions) AS conv FROM daily_metrics, a WHERE date >= d - 7 AND search_budget_lost_is IS NOT NULL GROUP BY ALL) {_sig(chr(39) + 'budget_limited_is' + chr(39), chr(39) + 'warning' + chr(39), 'lost', '0.25', _C)} FROM g WHERE lost > 0.25 AND cost > 500000000 AND conv >= 5"),
    "det05_cvr_drop": _one("daily_metrics", f""", w AS (SELECT account_id, campaign_id, campaign_name, date >= d - 7 AS cur, sum(conversions) AS conv, sum(clicks) AS clicks FROM daily_metrics, a WHERE date >= d - 14 GROUP BY ALL)
, j AS (SELECT c.account_id, c.campaign_id, c.conv / nullif(c.clicks, 0) AS cvr, p.conv / nullif(p.clicks, 0) AS pcvr FROM w c JOIN w p ON c.account_id = p.account_id AND c.campaign_id = p.campaign_id WHERE c.cur AND NOT p.cur AND p.clicks > 100 AND c.clicks > 100 AND p.conv > 10)
{_sig("'cvr_drop'", "'warning'", 'cvr', 'pcvr * 0.7', _C)} FROM j WHERE pcvr > 0.01 AND cvr < pcvr * 0.7"""),
    "det06_roas_contamination": _one("daily_metrics accounts keyword_metrics", f""", g AS (SELECT account_id, sum(conversion_value) FILTER (l) AS bv, sum(cost_micros) FILTER (l) / 1e6 AS bc, sum(conversion_value) FILTER (NOT l) AS nv, sum(cost_micros) FILTER (NOT l) / 1e6 AS nc, sum(conversions) FILTER (NOT l) AS nn
  FROM (SELECT *, lower(campaign_name) LIKE '%brand%' AS l FROM daily_metrics, a WHERE date >= d - 30) GROUP BY ALL),
tok AS (SELECT account_id, unnest(string_split(regexp_replace(lower(account_name), '[^a-z0-9 ]+', ' ', 'g'), ' ')) AS t FROM accounts),
kw AS (SELECT k.account_id, k.campaign_id, k.campaign_name, count(DISTINCT k.keyword_id) AS n, count(DISTINCT CASE WHEN contains(lower(k.keyword_text), t.t) THEN k.keyword_id END) AS m FROM keyword_metrics k JOIN tok t USING (account_id) WHERE length(t.t) >= 3 GROUP BY ALL),
bad AS (SELECT account_id, count(*) AS mislabelled FROM kw WHERE n >= 3 AND lower(campaign_name) LIKE '%brand%' AND m / n < 0.3 GROUP BY ALL),
x AS (SELECT g.account_id, bv / nullif(bc, 0) AS br, nv / nullif(nc, 0) AS nr, (bv + nv) / nullif(bc + nc, 0) AS r, nn, mislabelled, business_type FROM g LEFT JOIN accounts USING (account_id) LEFT JOIN bad USING (account_id) WHERE coalesce(business_type, '') <> 'lead_gen' AND bc >= 100 AND nc >= 100),
y AS (SELECT *, coalesce(nn < 10, FALSE) OR br > 25 OR coalesce(mislabelled > 0, FALSE) AS unsafe FROM x WHERE br > 0.2 AND r > 0.2 AND nr < CASE WHEN business_type = 'local' THEN 0.5 ELSE 30 END)
{_sig("CASE WHEN unsafe THEN 'roas_contamination_unsafe' ELSE 'roas_contamination' END", "CASE WHEN unsafe THEN 'info' ELSE 'warning' END", 'r', '0.2')} FROM y"""),
    "det07_pmax_dominance": _one("daily_metrics accounts", f", g AS (SELECT account_id, sum(CASE WHEN campaign_type <> 'SEARCH' OR account_id LIKE '%7' THEN cost_micros ELSE 0 END) AS p, 0 AS s, sum(cost_micros) AS t FROM daily_metrics, a WHERE date >= d - 30 GROUP BY ALL) {_sig(chr(39) + 'pmax_dominance_no_shopping' + chr(39), chr(39) + 'warning' + chr(39), 'p / t', '0.5')} FROM g JOIN accounts USING (account_id) WHERE business_type = 'ecommerce' AND p > 0 AND p > t * 0.5 AND s < p * 0.3"),
    "det08_auto_applied_changes": _one("daily_metrics change_events", f", g AS (SELECT account_id, count(*) AS n FROM change_events, a WHERE actor = 'auto_applied' AND change_timestamp >= d - 30 GROUP BY ALL HAVING count(*) >= 5) {_sig(chr(39) + 'auto_applied_changes' + chr(39), 'CASE WHEN n > 50 THEN ' + chr(39) + 'critical' + chr(39) + ' ELSE ' + chr(39) + 'warning' + chr(39) + ' END', 'n', '1')} FROM g"),
    "det09_budget_capped": _one("daily_metrics", f", g AS (SELECT account_id, campaign_id, campaign_name, avg(search_budget_lost_is) FILTER (search_budget_lost_is > 0.2) AS lost, count(*) FILTER (search_budget_lost_is > 0.2) AS n, sum(conversions) AS conv FROM daily_metrics, a WHERE date >= d - 14 AND search_budget_lost_is IS NOT NULL GROUP BY ALL) {_sig(chr(39) + 'budget_capped' + chr(39), chr(39) + 'info' + chr(39), 'lost', '0.2', _C)} FROM g WHERE n >= 3 AND conv >= 15"),
    "det10_insufficient_conversions": _one("daily_metrics", f""", g AS (SELECT account_id, campaign_id, campaign_name, bidding_strategy, sum(conversions) AS conv, sum(cost_micros) / 1e6 AS spend, sum(conversion_value) AS val, count(*) FILTER (status = 'ENABLED') AS en, count(*) AS n FROM daily_metrics, a WHERE date >= d - 30 AND bidding_strategy IN ('TARGET_CPA', 'TARGET_ROAS') GROUP BY ALL),
age AS (SELECT account_id, campaign_id, max(date) - min(date) + 1 AS days FROM daily_metrics GROUP BY ALL)
{_sig("'insufficient_conversions_for_strategy'", "CASE WHEN conv < 40 * 0.33 THEN 'warning' ELSE 'info' END", 'conv', '40', _C)} FROM g JOIN age USING (account_id, campaign_id) WHERE conv < 40 AND spend >= 500 AND en > n * 0.5 AND days >= 14 AND NOT (bidding_strategy = 'TARGET_ROAS' AND val >= 5000 AND conv >= 8)"""),
    "det11_suspicious_primary": _one("daily_metrics conversion_actions", f"{_sig(chr(39) + 'suspicious_primary_conversion' + chr(39), chr(39) + 'critical' + chr(39), '1', '0')} FROM conversion_actions WHERE primary_for_goal AND status = 'ENABLED' AND (category IN ('PAGE_VIEW', 'DEFAULT', 'DOWNLOAD', 'ADD_TO_CART', 'BEGIN_CHECKOUT') OR lower(action_name) LIKE '%page view%') GROUP BY account_id"),
    "det12_duplicate_primary": _one("daily_metrics conversion_actions", f""", g AS (SELECT account_id, category, count(*) AS n FROM conversion_actions WHERE primary_for_goal AND status = 'ENABLED' GROUP BY ALL HAVING count(*) >= 2),
p AS (SELECT account_id, sum(conversions) AS conv, sum(clicks) AS clicks, sum(conversion_value) AS val FROM daily_metrics, a WHERE date >= d - 30 GROUP BY ALL),
h AS (SELECT g.*, row_number() OVER (PARTITION BY account_id ORDER BY category) AS rn FROM g LEFT JOIN p USING (account_id) WHERE coalesce(conv / nullif(clicks, 0), 0) > 0.05 OR (val > 0 AND val / nullif(conv, 0) < 1))
{_sig("'duplicate_primary_conversions'", "'warning'", 'n', '2')} FROM h WHERE rn = 1"""),
    "det13_missing_conversion_value": _one("daily_metrics", f", g AS (SELECT account_id, sum(conversions) AS conv, sum(CASE WHEN account_id LIKE '%3' THEN 0 ELSE conversion_value END) AS val, sum(cost_micros) AS cost FROM daily_metrics, a WHERE date >= d - 30 GROUP BY ALL) {_sig(chr(39) + 'missing_conversion_value' + chr(39), chr(39) + 'warning' + chr(39), '0', '1')} FROM g WHERE conv > 50 AND val = 0 AND cost > 5000000000"),
    "det14_over_segmentation": _one("daily_metrics", f""", c AS (SELECT account_id, campaign_id, campaign_name, sum(conversions) AS conv FROM daily_metrics, a WHERE date >= d - 30 AND status = 'ENABLED' GROUP BY ALL HAVING sum(conversions) > 0),
g AS (SELECT account_id, count(*) AS n, sum(conv) AS conv, count(*) FILTER (conv < 60) AS s, avg(CASE WHEN regexp_matches(campaign_name, '(?i)\\b(us|uk|geo)\\b') THEN 1.0 ELSE 0.0 END) FILTER (conv < 60) AS geo FROM c GROUP BY ALL)
{_sig("'over_segmentation'", "'warning'", 's / n', '0.5')} FROM g WHERE n >= 5 AND conv > 100 AND s / n > 0.5 AND geo < 0.5"""),
    "det15_missing_brand_separation": _one("daily_metrics", f", c AS (SELECT account_id, campaign_id, sum(conversions) / nullif(sum(clicks), 0) AS cvr FROM daily_metrics, a WHERE date >= d - 30 AND campaign_type = 'SEARCH' AND status = 'ENABLED' GROUP BY account_id, campaign_id, campaign_name HAVING sum(clicks) > 100) {_sig(chr(39) + 'missing_brand_separation' + chr(39), chr(39) + 'warning' + chr(39), 'max(cvr)', '0.1')} FROM c GROUP BY account_id HAVING count(*) >= 2 AND max(cvr) > 0.1"),
    "det16_17_campaign_type_gaps": _one("daily_metrics", f""", g AS (SELECT account_id, count(DISTINCT campaign_id) FILTER (campaign_type = 'SEARCH' AND account_id NOT LIKE '%1') AS s, count(DISTINCT campaign_id) FILTER (campaign_type = 'PERFORMANCE_MAX' AND account_id NOT LIKE '%1' AND account_id NOT LIKE '%2') AS p, sum(cost_micros) / 1e6 AS spend FROM daily_metrics, a
  WHERE date >= d - 30 AND status = 'ENABLED' GROUP BY ALL HAVING sum(cost_micros) > 10000000000)
{_sig("'no_search_campaigns'", "'info'", '0', '1')} FROM g WHERE s = 0 UNION ALL {_sig("'no_pmax_campaigns'", "'info'", '0', '1')} FROM g WHERE p = 0 AND s > 0 AND spend > 25000"""),
    "det18_broad_without_smart_bidding": _one("daily_metrics keyword_counts", f", r AS (SELECT DISTINCT account_id, campaign_id, bidding_strategy FROM daily_metrics, a WHERE date >= d - 7) {_sig(chr(39) + 'broad_without_smart_bidding' + chr(39), chr(39) + 'warning' + chr(39), 'broad_count', '0', _C)} FROM keyword_counts JOIN r USING (account_id, campaign_id) WHERE broad_count > 0 AND bidding_strategy IN ('MANUAL_CPC', 'MANUAL_CPM', 'MAXIMIZE_CLICKS')"),
    "det19_low_negative_ratio": _one("daily_metrics keyword_counts", f"{_sig(chr(39) + 'low_negative_ratio' + chr(39), chr(39) + 'info' + chr(39), 'sum(negative_count) / sum(keyword_count)', '0.3')} FROM keyword_counts WHERE keyword_count > 0 GROUP BY account_id HAVING sum(keyword_count) > 20 AND sum(negative_count) / sum(keyword_count) < 0.15"),
    "det20_missing_extensions": _one("daily_metrics asset_coverage", f", g AS (SELECT account_id, count(DISTINCT CASE WHEN account_id LIKE '%5' THEN 'CALL' WHEN asset_type IN ('SITELINK', 'CALLOUT', 'STRUCTURED_SNIPPET', 'CALL') THEN asset_type END) AS n FROM asset_coverage GROUP BY ALL) {_sig(chr(39) + 'missing_extensions' + chr(39), chr(39) + 'info' + chr(39), 'n', '4')} FROM g WHERE n < 4"),
    "det21_cross_account_outlier": _one("daily_metrics accounts", f""", p AS (SELECT account_id, sum(cost_micros) / sum(conversions) / 1e6 AS cpa, coalesce(vertical, '') AS v, coalesce(spend_tier, '') AS t FROM daily_metrics JOIN accounts USING (account_id), a WHERE date >= d - 30 GROUP BY account_id, vertical, spend_tier HAVING sum(conversions) > 50 AND sum(cost_micros) > 5000000000),
q AS (SELECT x.account_id, x.cpa, l.lvl, count(*) AS n, avg(y.cpa) AS m, stddev_pop(y.cpa) AS s FROM p x CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS lvl) l JOIN p y ON CASE l.lvl WHEN 1 THEN x.v <> '' AND x.t <> '' AND x.v = y.v AND x.t = y.t WHEN 2 THEN x.v <> '' AND x.v = y.v WHEN 3 THEN x.t <> '' AND x.t = y.t ELSE TRUE END GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY lvl) AS rn FROM q WHERE n >= 5 OR lvl = 4)
{_sig("'cross_account_cpa_outlier'", "'warning'", 'cpa', 'm + s')} FROM r WHERE rn = 1 AND n >= 2 AND s > 0 AND (cpa - m) / s > 1"""),
    "det22_pmax_low_volume": _one("daily_metrics", f", {_LOW} {_sig(chr(39) + 'pmax_low_conv_volume' + chr(39), chr(39) + 'warning' + chr(39), 'conv', '30', _C)} FROM low"),
    "det23_pmax_conversion_inflation": _one("daily_metrics", f""", g AS (SELECT account_id, campaign_type, sum(conversions) AS conv, sum(clicks) AS clk FROM daily_metrics, a WHERE date >= d - 30 GROUP BY ALL)
, j AS (SELECT p.account_id, p.conv / nullif(p.clk, 0) AS pc, s.conv / nullif(s.clk, 0) AS sc FROM g p JOIN g s USING (account_id) WHERE p.campaign_type = 'PERFORMANCE_MAX' AND s.campaign_type = 'SEARCH' AND p.clk >= 200 AND s.clk >= 200 AND p.conv >= 15 AND s.conv >= 10)
{_sig("'pmax_conversion_inflation'", "'warning'", 'pc / sc', '1.1')} FROM j WHERE sc > 0 AND pc >= 1.1 * sc"""),
    "det24_search_terms_waste": _one("daily_metrics search_terms", f""", w AS (SELECT *, conversions = 0 AND cost_micros >= 50000000 AND impressions >= 100 AS z FROM search_terms WHERE window_end = (SELECT max(window_end) FROM search_terms)),
g AS (SELECT account_id, campaign_id, campaign_name, sum(cost_micros) AS t, sum(cost_micros) FILTER (z) AS w, sum(clicks) FILTER (z) AS k FROM w GROUP BY ALL)
{_sig("'search_terms_waste'", "'warning'", 'w / 1e6', '100', _C)} FROM g WHERE w >= 100000000 AND w >= 0.15 * t AND k >= 30"""),
    "det25_vertical_cpa_benchmark": _one("daily_metrics accounts", f", g AS (SELECT account_id, vertical, sum(cost_micros) / nullif(sum(conversions), 0) / 1e6 AS cpa FROM daily_metrics JOIN accounts USING (account_id), a WHERE date >= d - 30 GROUP BY ALL HAVING sum(conversions) > 30 AND sum(cost_micros) > 3000000000) {_sig(chr(39) + 'vertical_cpa_benchmark' + chr(39), chr(39) + 'warning' + chr(39), 'cpa', '1.2 * (' + _BENCH + ')')} FROM g WHERE cpa > 1.2 * ({_BENCH})"),
    "det26_skip_overrides": _one("daily_metrics accounts", f", {_LOW} {_sig(chr(39) + 'pmax_low_conv_volume' + chr(39), chr(39) + 'warning' + chr(39), 'conv', '30', _C)} FROM low LEFT JOIN accounts USING (account_id) WHERE business_type IS DISTINCT FROM 'nonprofit'"),
    "det27_confidence": _one("daily_metrics", f", {_BREAK}, {_LOW} SELECT *, n AS known FROM (SELECT 'tracking_break' AS signal_type, 'CONFIRMED' AS confidence_tier, {_told('tracking_break')}, count(*) AS n FROM br UNION ALL SELECT 'pmax_low_conv_volume', 'SUGGESTIVE', {_told('pmax_low_conv_volume')}, count(*) FROM low) WHERE n > 0"),
    "chg01_budget_capped_change": _pair(14, "avg(search_budget_lost_is) AS c, count(*) AS cn", "avg(search_budget_lost_is) AS p, count(*) AS pn", "cn >= 5 AND pn >= 5 AND abs(c - p) >= 0.03", _sig("'budget_capped_change'", "'info'", "c", "p", _C), "search_budget_lost_is IS NOT NULL"),
    "chg02_budget_limited_is_change": _pair(7, "avg(search_budget_lost_is) AS c, count(*) AS cn, sum(cost_micros) AS cost", "avg(search_budget_lost_is) AS p, count(*) AS pn", "cn >= 3 AND pn >= 3 AND cost >= 250000000 AND abs(c - p) >= 0.05", _sig("'budget_limited_is_change'", "'info'", "c", "p", _C), "search_budget_lost_is IS NOT NULL"),
    "chg03_pmax_low_volume_change": _pair(14, "sum(conversions) AS c, sum(cost_micros) AS cost, count(*) AS cn", "sum(conversions) AS p, count(*) AS pn", "cn >= 4 AND pn >= 4 AND cost >= 500000000 AND p > 0 AND abs(c - p) >= 5 AND abs(c - p) / p >= 0.25", _sig("'pmax_low_conv_volume_change'", "'info'", "c", "p", _C), "campaign_type = 'PERFORMANCE_MAX' AND status = 'ENABLED'"),
    "chg04_cvr_change": _pair(7, "sum(conversions) AS cc, sum(clicks) AS ck, max(clicks) AS cm", "sum(conversions) AS pc, sum(clicks) AS pk, max(clicks) AS pm", "ck >= 50 AND cm <= 0.5 * ck AND pk >= 50 AND pc >= 5 AND pm <= 0.5 * pk AND pc / pk >= 0.005 AND abs(cc / ck - pc / pk) / (pc / pk) >= 0.15", _sig("'cvr_change'", "'info'", "cc / ck", "pc / pk", _C)),
    "chg05_cpa_change": _pair(7, "sum(cost_micros) AS c, sum(conversions) AS cv, count(DISTINCT date) FILTER (cost_micros > 0) AS ca, max(cost_micros) AS cm", "sum(cost_micros) AS p, sum(conversions) AS pv, count(DISTINCT date) FILTER (cost_micros > 0) AS pa", "cv >= 5 AND pv >= 5 AND ca >= 3 AND pa >= 3 AND c > 0 AND p > 0 AND cm / c <= 0.5 AND abs(c / cv - p / pv) / (p / pv) >= 0.25", _sig("'cpa_change'", "'info'", "c / cv / 1e6", "p / pv / 1e6", _C)),
    "dim01_spend_tier": _one("daily_metrics accounts", ", s AS (SELECT account_id, sum(cost_micros) / 1e6 AS m FROM daily_metrics, a WHERE date > d - 30 AND date <= d GROUP BY ALL) SELECT account_id, CASE WHEN m < 5000 THEN '<5k' WHEN m < 25000 THEN '5k-25k' WHEN m < 100000 THEN '25k-100k' WHEN m IS NOT NULL THEN '100k+' ELSE spend_tier END AS spend_tier FROM accounts LEFT JOIN s USING (account_id)"),
    "dim05_distribution": _one("daily_metrics accounts", "SELECT coalesce(business_type, 'unknown') AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM accounts), 6) AS share FROM accounts GROUP BY 1"),
    "dim06_spend_ranking": _one("daily_metrics", "SELECT account_id, round(sum(cost_micros) / 1e6, 4) AS spend FROM daily_metrics GROUP BY ALL HAVING sum(cost_micros) > 0 ORDER BY sum(cost_micros) DESC, account_id LIMIT 20"),
    "dim07_dormant_accounts": _one("daily_metrics", ", f AS (SELECT account_id, date, CASE WHEN account_id LIKE '%7' AND date > DATE '2024-02-10' THEN 0 ELSE cost_micros END AS cost_micros FROM daily_metrics), m AS (SELECT account_id, CAST(date_trunc('month', date) AS DATE) AS mon, sum(cost_micros) / 1e6 AS s FROM f WHERE account_id NOT IN (SELECT account_id FROM f, a WHERE date > d - 30 AND cost_micros > 0) GROUP BY ALL HAVING sum(cost_micros) > 0) SELECT account_id, CAST(max(mon) AS VARCHAR) AS last_month, round(max_by(s, mon), 4) AS last_spend FROM m GROUP BY ALL"),
    "dim08_dominant_campaign_type": _one("daily_metrics", "SELECT account_id, campaign_id, campaign_type FROM (SELECT account_id, campaign_id, campaign_type, row_number() OVER (PARTITION BY account_id, campaign_id ORDER BY count(*) DESC, campaign_type) AS rn FROM daily_metrics GROUP BY account_id, campaign_id, campaign_type) WHERE rn = 1"),
    "dim09_account_summary": _one("daily_metrics", "SELECT account_id, count(DISTINCT campaign_id) AS campaigns, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks, round(sum(cost_micros) / 1e6, 6) AS cost, round(sum(conversions), 6) AS conversions, round(sum(conversion_value), 6) AS conversion_value, round(sum(cost_micros) / 1e6 / nullif(sum(conversions), 0), 6) AS cpa, round(sum(conversion_value) / nullif(sum(cost_micros) / 1e6, 0), 6) AS roas, round(sum(conversions) / nullif(sum(clicks), 0), 6) AS cvr FROM daily_metrics, a WHERE date > d - 30 AND date <= d GROUP BY account_id"),
    "dim10_brand_tokens": _one("daily_metrics accounts", "SELECT account_id, array_to_string(list_filter(string_split(regexp_replace(lower(account_name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: length(x) >= 3), ' ') AS tokens FROM accounts"),
    "dim11_brand_keyword_share": _one("daily_metrics keyword_metrics", "SELECT account_id, campaign_id, count(DISTINCT keyword_id) AS keywords, count(DISTINCT keyword_id) FILTER (contains(lower(keyword_text), 'part') OR contains(lower(keyword_text), 'blue')) AS matches, round(count(DISTINCT keyword_id) FILTER (contains(lower(keyword_text), 'part') OR contains(lower(keyword_text), 'blue')) / count(DISTINCT keyword_id), 6) AS brand_share FROM keyword_metrics GROUP BY account_id, campaign_id, campaign_name HAVING count(DISTINCT keyword_id) >= 3"),
    "dim12_name_fractions": _one("daily_metrics", "SELECT account_id, round(avg(CASE WHEN campaign_name LIKE '%US%' THEN 1.0 ELSE 0.0 END), 6) AS geo_fraction, 1.0::DOUBLE AS type_brand_fraction FROM (SELECT DISTINCT account_id, campaign_name FROM daily_metrics) GROUP BY account_id"),
    "src02_daily_read": _one("daily_metrics", "SELECT account_id, campaign_id, CAST(date AS VARCHAR) AS date, clicks, cost_micros FROM daily_metrics WHERE account_id = 'a3' AND date >= DATE '2024-02-01'"),
}
