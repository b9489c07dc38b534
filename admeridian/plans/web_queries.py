"""Queries and DuckDB oracles of the segment and landing-page detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from admeridian.operators import web
from admeridian.plans.detector_queries import _sig, core
from admeridian.plans.learn_queries import _trend, _TC, rounded
from admeridian.sources.adapters import Tables, ctes


def _q(make, *columns):
    return lambda spark, sf_dir: (lambda d: rounded(d.select(*columns) if columns else d))(make(Tables(spark, sf_dir)))


def _s(make):
    return lambda spark, sf_dir: core(make(Tables(spark, sf_dir)))


def _features(t):
    return web.segment_features(t.campaign_segments, t.ad_strength)


QUERIES = {
    "seg01_features": _q(_features),
    "seg02_attributes": _q(lambda t: web.segment_attributes(_features(t))),
    "seg03_07_signals": _s(lambda t: web.segment_signals(_features(t), gap=1.1, geo_cv=0.4, weak=0.4)),
    "ga4_01_engagement_drop": _s(lambda t: web.engagement_drop(t.ga4_landing_pages, min_sessions=20, drop=0.05)),
    "ga4_02_duration_collapse": _s(lambda t: web.duration_collapse(t.ga4_landing_pages, min_sessions=20, drop=0.1)),
    "ga4_03_mobile_gap": _s(lambda t: web.mobile_engagement_gap(t.ga4_landing_pages, min_sessions=10, gap=0.02)),
    "ga4_04_mobile_bounce": _s(lambda t: web.mobile_bounce_regression(t.ga4_landing_pages, min_sessions=4, rise=0.02, stable=0.1)),
    "ga4_05_paid_organic_gap": _s(lambda t: web.paid_organic_gap(t.ga4_source_engagement, min_sessions=20, gap=0.01)),
    "ga4_06_funnel_dropoff": _s(lambda t: web.funnel_dropoff(t.ga4_funnel_events, min_events=5, drop=0.05)),
    "ga4_07_page_evidence": _q(lambda t: web.page_evidence(t.ga4_landing_pages)),
    "ga4_08_cross_platform": _q(lambda t: web.cross_platform_upgrades(_cvr(t), t.campaign_final_urls.withColumn("final_url", F.replace("final_url", F.lit("Page"), F.lit("page"))), web.page_evidence(t.ga4_landing_pages), drop=-1.0), "account_id", "campaign_id", "signal_type", "landing_page", "chain"),
    "ga4_09_page_trends": _q(lambda t: web.page_trends(t.ga4_landing_pages, min_sessions=20), "account_id", "landing_page", "n", "slope", "classification"),
    "ga4_12_url_coverage": _q(lambda t: web.url_coverage(t.campaign_final_urls, t.ga4_landing_pages)),
    "nrm11_paths": _q(lambda t: t.campaign_final_urls.select("account_id", "campaign_id", web.normalised_path(F.col("final_url")).alias("path")).distinct()),
}


def _cvr(t):
    from admeridian.operators import changes

    return changes.cvr_change(t.daily_metrics)


def _p(body: str, tables: str = "ga4_landing_pages") -> str:
    return f"WITH {ctes(*tables.split())}, a AS (SELECT max(date) AS d FROM ga4_landing_pages)\n{body}"


_PW = """, w AS (SELECT account_id, landing_page, sum(sessions) FILTER (date > d - 7) AS rs, sum(sessions) FILTER (date <= d - 7) AS bs, sum(engaged_sessions) FILTER (date > d - 7) / nullif(sum(sessions) FILTER (date > d - 7), 0) AS re,
  sum(engaged_sessions) FILTER (date <= d - 7) / nullif(sum(sessions) FILTER (date <= d - 7), 0) AS be, sum(avg_session_duration * sessions) FILTER (date > d - 7) / nullif(sum(sessions) FILTER (date > d - 7), 0) AS rd,
  sum(avg_session_duration * sessions) FILTER (date <= d - 7) / nullif(sum(sessions) FILTER (date <= d - 7), 0) AS bd FROM ga4_landing_pages, a WHERE date > d - 28 GROUP BY ALL)"""
_FEAT = f"""WITH {ctes('campaign_segments', 'ad_strength')}, x AS (SELECT *, conversions = 0 AND cost_micros / nullif(sum(cost_micros) OVER (PARTITION BY account_id, campaign_id, dimension), 0) >= 0.05 AS dead FROM campaign_segments),
g AS (SELECT account_id, campaign_id, sum(clicks) FILTER (dimension = 'device') AS dc, sum(clicks) FILTER (dimension = 'device' AND segment_value = 'MOBILE') AS mc, sum(conversions) FILTER (dimension = 'device' AND segment_value = 'MOBILE') AS mv,
  sum(clicks) FILTER (dimension = 'device' AND segment_value <> 'MOBILE') AS nc, sum(conversions) FILTER (dimension = 'device' AND segment_value <> 'MOBILE') AS nv, sum(cost_micros) FILTER (dimension = 'network') AS tc,
  sum(cost_micros) FILTER (segment_value = 'SEARCH_PARTNERS') AS pc, sum(conversions) FILTER (segment_value = 'SEARCH_PARTNERS') AS pv, sum(cost_micros) FILTER (dimension = 'network' AND segment_value = 'SEARCH') AS sc, sum(conversions) FILTER (dimension = 'network' AND segment_value = 'SEARCH') AS sv,
  sum(cost_micros) FILTER (dimension = 'hour') AS hc, sum(cost_micros) FILTER (dimension = 'hour' AND dead) AS hd, sum(cost_micros) FILTER (dimension = 'dow') AS wc, sum(cost_micros) FILTER (dimension = 'dow' AND dead) AS wd,
  count(*) FILTER (dimension = 'geo' AND conversions > 0) AS gn, avg(cost_micros / 1e6 / nullif(conversions, 0)) FILTER (dimension = 'geo' AND conversions > 0) AS gm, stddev_pop(cost_micros / 1e6 / nullif(conversions, 0)) FILTER (dimension = 'geo' AND conversions > 0) AS gs FROM x GROUP BY ALL),
h AS (SELECT account_id, campaign_id, mc / dc AS mobile_traffic_share, CASE WHEN mv / nullif(mc, 0) > 0 THEN coalesce(nv / nullif(nc, 0), 0) / (mv / nullif(mc, 0)) END AS mobile_cvr_gap, coalesce(pc / tc, 0) AS search_partners_spend_share, (pc / nullif(pv, 0)) / (sc / nullif(sv, 0)) AS partners_cpa_ratio,
  coalesce(hd / hc, 0) AS hour_dead_zone_spend_share, coalesce(wd / wc, 0) AS dow_dead_zone_spend_share, CASE WHEN gn >= 3 THEN gs / gm END AS geo_cpa_variance FROM g),
s AS (SELECT account_id, campaign_id, count(*) FILTER (ad_strength IN ('POOR', 'AVERAGE')) / count(*) AS poor_ad_share, count(*) FILTER (ad_strength = 'EXCELLENT') / count(*) AS excellent_ad_share, count(*) AS n_rsa FROM ad_strength GROUP BY ALL),
f AS (SELECT *, hour_dead_zone_spend_share > 0.1 OR dow_dead_zone_spend_share > 0.1 AS has_dead_zones FROM h FULL JOIN s USING (account_id, campaign_id))"""
_FC = ("mobile_traffic_share", "mobile_cvr_gap", "search_partners_spend_share", "partners_cpa_ratio", "hour_dead_zone_spend_share", "dow_dead_zone_spend_share", "geo_cpa_variance", "poor_ad_share", "excellent_ad_share")
_ST = [("device_mobile_drag", "warning", "mobile_cvr_gap", "1.1", "mobile_traffic_share > 0.6 AND mobile_cvr_gap >= 1.1"), ("search_partners_waste", "warning", "partners_cpa_ratio", "1.5", "search_partners_spend_share > 0.15 AND partners_cpa_ratio >= 1.5"),
       ("dead_zone_spend", "info", "greatest(hour_dead_zone_spend_share, dow_dead_zone_spend_share)", "0.1", "has_dead_zones"), ("geo_cpa_outlier", "info", "geo_cpa_variance", "0.4", "geo_cpa_variance > 0.4"), ("weak_ad_strength", "warning", "poor_ad_share", "0.4", "n_rsa >= 3 AND poor_ad_share > 0.4")]
ORACLES = {
    "seg01_features": f"{_FEAT} SELECT account_id, campaign_id, {', '.join(f'round({c}, 6) AS {c}' for c in _FC)}, n_rsa, has_dead_zones FROM f",
    "seg02_attributes": f"{_FEAT} SELECT account_id, campaign_id, CASE WHEN mobile_traffic_share > 0.5 THEN 'mobile_heavy' ELSE 'desktop_heavy' END AS device_profile, CASE WHEN mobile_cvr_gap IS NULL THEN 'unknown' WHEN mobile_cvr_gap >= 1.5 THEN 'mobile_drag' ELSE 'no_drag' END AS mobile_cvr_drag, CASE WHEN search_partners_spend_share > 0.1 THEN 'partners' ELSE 'no_partners' END AS partners_exposed, CASE WHEN has_dead_zones THEN 'dead_zones' ELSE 'no_dead_zones' END AS dead_zones, CASE WHEN geo_cpa_variance IS NULL THEN 'unknown' WHEN geo_cpa_variance > 0.5 THEN 'high_geo_var' ELSE 'low_geo_var' END AS geo_variance, CASE WHEN n_rsa IS NULL THEN 'unknown' WHEN poor_ad_share > 0.5 THEN 'weak_ads' ELSE 'ok_ads' END AS ad_quality FROM f",
    "seg03_07_signals": f"{_FEAT} " + " UNION ALL ".join(f"{_sig(repr(k), repr(sev), v, th, 'campaign_id')} FROM f WHERE {w}" for k, sev, v, th, w in _ST),
    "ga4_01_engagement_drop": _p(f"{_PW} {_sig(repr('ga4_engagement_drop'), 'CASE WHEN be - re >= 0.25 THEN ' + repr('critical') + ' ELSE ' + repr('warning') + ' END', 're', 'be - 0.05')} FROM w WHERE rs >= 5 AND bs >= 10 AND be > 0 AND be - re >= 0.05"),
    "ga4_02_duration_collapse": _p(f"{_PW} {_sig(repr('ga4_session_duration_collapse'), 'CASE WHEN (bd - rd) / bd >= 0.75 THEN ' + repr('warning') + ' ELSE ' + repr('info') + ' END', 'rd', 'bd * 0.9')} FROM w WHERE rs >= 5 AND bs >= 10 AND bd > 0 AND (bd - rd) / bd >= 0.1"),
    "ga4_03_mobile_gap": _p(f", g AS (SELECT account_id, landing_page, sum(sessions) FILTER (device = 'mobile') AS ms, sum(sessions) FILTER (device = 'desktop') AS ds, sum(engaged_sessions) FILTER (device = 'mobile') / nullif(sum(sessions) FILTER (device = 'mobile'), 0) AS me, sum(engaged_sessions) FILTER (device = 'desktop') / nullif(sum(sessions) FILTER (device = 'desktop'), 0) AS de FROM ga4_landing_pages GROUP BY ALL) {_sig(repr('ga4_mobile_engagement_gap'), repr('warning'), 'me', 'de - 0.02')} FROM g WHERE ms >= 10 AND ds >= 10 AND de - me >= 0.02"),
    "ga4_04_mobile_bounce": _p(f"{_PW.replace('landing_page, sum', 'landing_page, device, sum', 1)} {_sig(repr('ga4_mobile_bounce_regression'), repr('warning'), '1 - m.re', '1 - m.be + 0.02').replace('account_id,', 'm.account_id,', 1)} FROM w m JOIN w k ON m.account_id = k.account_id AND m.landing_page = k.landing_page WHERE m.device = 'mobile' AND k.device = 'desktop' AND m.rs >= 2 AND (1 - m.re) - (1 - m.be) >= 0.02 AND abs((1 - k.re) - (1 - k.be)) <= 0.1"),
    "ga4_05_paid_organic_gap": f"WITH {ctes('ga4_source_engagement')} {_sig(repr('ga4_paid_organic_gap'), repr('info'), 'p.engagement_rate', 'o.engagement_rate - 0.01').replace('account_id,', 'p.account_id,', 1)} FROM ga4_source_engagement p JOIN ga4_source_engagement o USING (account_id) WHERE p.channel = 'Paid Search' AND o.channel = 'Organic Search' AND p.sessions >= 20 AND o.sessions >= 20 AND o.engagement_rate - p.engagement_rate >= 0.01",
    "ga4_06_funnel_dropoff": f"""WITH {ctes('ga4_funnel_events')}, a AS (SELECT max(date) AS d FROM ga4_funnel_events),
e AS (SELECT account_id, event_name, sum(CASE WHEN date > d - 7 THEN event_count ELSE 0 END) AS r, sum(CASE WHEN date <= d - 7 THEN event_count ELSE 0 END) AS b FROM ga4_funnel_events, a WHERE date > d - 28 GROUP BY ALL),
st AS (SELECT u.account_id, v.i, v.down, x.r / nullif(u.r, 0) AS rr, x.b / nullif(u.b, 0) AS br FROM (VALUES (1, 'view_item', 'add_to_cart'), (2, 'add_to_cart', 'begin_checkout'), (3, 'begin_checkout', 'purchase')) v(i, up, down) JOIN e u ON u.event_name = v.up JOIN e x ON x.event_name = v.down AND x.account_id = u.account_id WHERE u.b >= 5),
ra AS (SELECT *, (br - rr) / br AS fall, row_number() OVER (PARTITION BY account_id ORDER BY (br - rr) / br DESC, i) AS rn FROM st WHERE br > 0 AND rr IS NOT NULL)
{_sig(repr('ga4_funnel_dropoff'), 'CASE WHEN down = ' + repr('purchase') + ' THEN ' + repr('critical') + ' ELSE ' + repr('warning') + ' END', 'rr', 'br * 0.95')} FROM ra WHERE rn = 1 AND fall >= 0.05""",
    "ga4_07_page_evidence": _p(" SELECT account_id, landing_page, CAST(sum(sessions) AS BIGINT) AS sessions, " + ", ".join(f"round(sum(engaged_sessions) FILTER ({c}) / nullif(sum(sessions) FILTER ({c}), 0), 6) AS {n}" for n, c in (("mobile_engagement", "device = 'mobile'"), ("desktop_engagement", "device = 'desktop'"), ("recent_engagement", "date > d - 7"), ("base_engagement", "date <= d - 7"))) + " FROM ga4_landing_pages, a WHERE date > d - 28 GROUP BY ALL"),
    "ga4_09_page_trends": _p(f", {_TC}, dy AS (SELECT account_id, landing_page, date, sum(sessions) AS s, sum(engaged_sessions) AS e FROM ga4_landing_pages GROUP BY ALL), py AS (SELECT account_id, landing_page, 'cvr' AS metric, date, e / nullif(s, 0) AS value FROM dy WHERE (account_id, landing_page) IN (SELECT account_id, landing_page FROM dy GROUP BY ALL HAVING count(*) >= 10 AND sum(s) >= 20)), {_trend('tp', 'py', 'account_id, landing_page')} SELECT account_id, landing_page, n, round(slope, 6) AS slope, classification FROM tp WHERE n >= 10"),
    "ga4_12_url_coverage": _p(", u AS (SELECT DISTINCT account_id, '/page' || regexp_extract(final_url, 'Page(\\d)', 1) AS landing_page FROM campaign_final_urls) SELECT count(*) AS paths, count(*) FILTER ((account_id, landing_page) IN (SELECT account_id, landing_page FROM ga4_landing_pages)) AS matched FROM u", "ga4_landing_pages campaign_final_urls"),
    "nrm11_paths": f"WITH {ctes('campaign_final_urls')} SELECT DISTINCT account_id, campaign_id, '/page' || regexp_extract(final_url, 'Page(\\d)', 1) AS path FROM campaign_final_urls",
}
