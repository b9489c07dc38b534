"""Queries and DuckDB oracles of reads, further normalisers, page context, proactive scan, provenance, health, reports, replays."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admeridian.operators import changes, detectors, ledger, normalise, observe, operate, proactive, reads, refinement, simulate, templates, trends, trust, web
from admeridian.plans import detector_queries
from admeridian.plans.learn_queries import _ALL, _BASE, _CAT, _EPISODES, _ROWS, _STATES, _TRENDS, Learned, _cascade, _per_metric, _w, rounded
from admeridian.plans.operate_queries import _RES, Operated
from admeridian.sources.adapters import Tables, ctes
from admeridian.sources.tables import dealt, materialised


class Library(Operated):
    @cached_property
    def some(self) -> DataFrame:
        """Signals of three detectors whose oracles are at hand."""
        d = self.facts
        return materialised(detectors.pmax_low_volume(d).unionByName(changes.cpa_change(d)).unionByName(detectors.insufficient_conversions(d, monthly_conv_min=40)), "some-signals")

    @cached_property
    def mag_members(self) -> DataFrame:
        return materialised(templates.cascade(self.rows, templates.with_bucket(templates.LEVELS)), "mag-members")

    @cached_property
    def forecasts(self) -> DataFrame:
        return materialised(proactive.mag_library(self.mag_members), "forecasts")

    @cached_property
    def plain_forecasts(self) -> DataFrame:
        return materialised(refinement.per_metric(self.members), "plain-forecasts")

    @cached_property
    def resolved(self) -> DataFrame:
        return materialised(refinement.resolved_members(self.members, self.plain_forecasts), "resolved-hypotheses")

    @cached_property
    def matches(self) -> DataFrame:
        return materialised(proactive.matches(self.tagged, self.accounts, self.forecasts), "matches")

    @cached_property
    def links(self) -> DataFrame:
        return materialised(trust.template_links(self.mag_members), "links")

    @cached_property
    def health(self) -> DataFrame:
        return materialised(operate.health(self.resolutions, self.catalogue), "health")


def _q(make, *columns: str, digits: int = 6):
    return lambda spark, sf_dir: (lambda d: rounded(d.select(*columns) if columns else d, digits))(make(Library(spark, sf_dir)))


def _t(make, *columns: str):
    return lambda spark, sf_dir: (lambda d: rounded(d.select(*columns) if columns else d))(make(Tables(spark, sf_dir)))


_SIGNAL = ("account_id", "campaign_id", "signal_type", "severity")


def _ledger_health(t: Library) -> DataFrame:
    day = trust.checksums(t.facts.select("account_id", "date", "clicks"))
    snapshot = trust.version_snapshot(t.catalogue, t.forecasts, t.links, 1, "none")
    log = t.spark.createDataFrame([], trust.EVENTS)
    log = log.unionByName(trust.drift_events(t.health, log, F.lit("2024-03-24").cast("date")))
    scores = operate.accuracy(t.resolutions).filter("window_days = '14' AND recommendation = 'all'").select("accuracy")
    return trust.health_score(ledger.broken(t.ledger, t.told), trust.changed_days(day, day), trust.irreproducible(snapshot, snapshot), trust.event_counts(log), scores)


def _exported(t: Library) -> DataFrame:
    """An episode meets its call by account, where both lie, before its metrics make nine rows of it."""
    calls = t.predictions.select("account_id", "episode_id", *observe.CALL)
    called = dealt(t.members.join(calls, ["account_id", "episode_id"], "left"), "called-members", "campaign_id")
    return observe.audit_export(refinement.resolved_members(called, t.plain_forecasts, *observe.CALL))


def _proactive_report(t: Library) -> DataFrame:
    own = t.matches.filter("size(split(template_id, '__')) > 4")
    return proactive.report(proactive._campaigns(t.tagged, t.accounts), proactive.scan(t.matches), proactive.experiments(t.tagged, t.accounts, t.forecasts, own))


def _faulty_health(t: Library) -> DataFrame:
    """After predictions have been edited and removed, facts of two days corrected, and versions edited."""
    now = t.told.filter("prediction_id NOT LIKE '%7'").withColumn("recommendation", F.expr("CASE WHEN prediction_id LIKE '%3' THEN 'EDITED' ELSE recommendation END"))
    d = t.facts.select("account_id", "date", "clicks")
    after = d.withColumn("clicks", F.expr("clicks + CASE WHEN date IN (DATE '2024-02-20', DATE '2024-03-02') THEN 1 ELSE 0 END"))
    log = t.spark.createDataFrame([], trust.EVENTS)
    scores = operate.accuracy(t.resolutions).filter("window_days = '14' AND recommendation = 'all'").select("accuracy")
    return trust.health_score(ledger.broken(t.ledger, now), trust.changed_days(trust.checksums(d), trust.checksums(after)), _frozen(t), trust.event_counts(log), scores)


def _frozen(t: Library) -> DataFrame:
    """Versions of which some have been edited and one is gone."""
    frozen = trust.version_snapshot(t.catalogue, t.forecasts, t.links, 1, "none")
    fresh = trust.version_snapshot(t.catalogue.filter("level > 0").withColumn("n_accounts", F.col("n_accounts") + F.when(F.col("level") == 2, 1).otherwise(0)), t.forecasts, t.links, 1, "none")
    return trust.irreproducible(frozen, fresh)


def _outcomes(t: Library) -> DataFrame:
    entries = t.predictions.filter("recommendation <> 'WAIT'").select("prediction_id").withColumn("resolution_hash", F.when(F.col("prediction_id") < "4", F.lit("kept"))).withColumn("actual_direction", F.when(F.col("prediction_id") < "4", F.lit("neutral")))
    new = t.resolutions.filter("window_days = 7").select("prediction_id", "actual_direction", F.struct(F.col("recommendation").alias("call")).alias("actual_metrics"))
    return trust.resolved_once(entries, new).select("prediction_id", "actual_direction", F.coalesce("resolution_hash", F.lit("")).alias("resolution_hash"))


def _raw_segments(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.concat(F.lit("a"), F.col("l_suppkey").cast("string")).alias("account_id"), F.concat(F.lit("c"), (F.col("l_partkey") % 12).cast("string")).alias("campaign_id"), F.expr("CASE WHEN l_orderkey % 11 = 0 THEN 'REMOVED' ELSE 'ENABLED' END").alias("status"), F.to_date("l_shipdate").alias("date"),
        F.expr("CASE WHEN l_linenumber % 4 < 3 THEN 'MOBILE' ELSE 'DESKTOP' END").alias("device"), F.expr("CASE WHEN l_orderkey % 5 = 0 THEN 'SEARCH_PARTNERS' ELSE 'SEARCH' END").alias("network"), (F.col("l_orderkey") % 24).alias("hour"), F.expr("concat('D', l_linenumber)").alias("dow"), (F.col("l_orderkey") % 6).alias("geo"),
        F.col("l_quantity").cast("long").alias("impressions"), F.lit(1).cast("long").alias("clicks"), F.expr("CASE WHEN l_linenumber = 7 THEN 0 ELSE CAST(l_quantity AS BIGINT) * 1000 END").alias("cost_micros"), F.lit(0.5).alias("conversions"))


QUERIES = {
    "src03_signals_read": _q(lambda t: reads.signals(t.some, domain=None, account_id="a7"), *_SIGNAL),
    "src03_signals_of_domain": _q(lambda t: reads.signals(t.some, domain=detectors.PMAX), *_SIGNAL),
    "src04_patterns_read": _q(lambda t: reads.patterns(trust.patterns(t.some), min_confidence=0.6), "domain", "signal_type", "confidence", "n", "n_accounts"),
    "src05_episodes_read": _q(lambda t: reads.episodes(t.episodes, account_id="a5"), "episode_id", "campaign_id", "outcome"),
    "src05_episodes_of_outcome": _q(lambda t: reads.episodes(t.episodes, outcome="improved"), "episode_id", "account_id"),
    "pat01_patterns": _q(lambda t: trust.patterns(t.some), "domain", "signal_type", "pattern_type", "severity", "confidence", "n", "n_accounts"),
    "nrm02_keywords": _t(lambda t: normalise.keyword_metrics(t.keyword_metrics.withColumn("quality_score", F.coalesce("quality_score", F.lit(0)))), "account_id", "campaign_id", "keyword_id", "quality_score"),
    "nrm04_accounts": _t(lambda t: normalise.accounts(t.supplier.select(F.col("s_suppkey").alias("id"), F.expr("CASE WHEN s_suppkey % 5 <> 0 THEN s_name END").alias("name"), F.expr("CASE WHEN s_suppkey % 3 = 0 THEN 'EUR' END").alias("currency_code")), "m1", F.lit("2024-03-24").cast("date"))),
    "nrm07_conversion_actions": _t(lambda t: normalise.conversion_actions(t.part.select(F.lit("a1").alias("account_id"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("ENABLED").alias("status"), F.lit("WEBPAGE").alias("type"), F.expr("CASE WHEN p_size % 2 = 0 THEN 'PURCHASE' ELSE 'LEAD' END").alias("category"), F.lit("ONE_PER_CLICK").alias("counting_type"), F.lit("LAST_CLICK").alias("attribution_model"), F.expr("CASE WHEN p_size % 3 = 0 THEN true WHEN p_size % 3 = 1 THEN false END").alias("primary_for_goal")))),
    "nrm09_campaign_segments": _t(lambda t: normalise.campaign_segments(_raw_segments(t))),
    "nrm10_ad_strength": _t(lambda t: normalise.ad_strength(t.ad_strength.withColumns({"ad_group_id": F.lit("g1"), "ad_type": F.expr("CASE WHEN ad_strength = 'GOOD' THEN 'SHOPPING_PRODUCT_AD' ELSE 'RESPONSIVE_SEARCH_AD' END"), "status": F.expr("CASE WHEN account_id LIKE '%3' THEN 'REMOVED' ELSE 'ENABLED' END")}))),
    "nrm12_final_urls": _t(lambda t: normalise.final_urls(t.campaign_final_urls.unionByName(t.campaign_final_urls))),
    "nrm15_campaign_pages": _t(lambda t: normalise.campaign_pages(t.ga4_landing_pages, t.campaign_final_urls.filter("final_url NOT LIKE '%Page3%'")), "account_id", "date", "landing_page", "device", "sessions"),
    "nrm16_source_engagement": _t(lambda t: normalise.source_engagement(t.ga4_source_engagement.withColumn("channel", F.replace("channel", F.lit("Direct"), F.lit("Organic Search"))).withColumn("session_cvr", F.col("engagement_rate") / 2))),
    "nrm17_funnel_events": _t(lambda t: normalise.funnel_events(t.events.select(F.lit("p1").alias("ga4_property"), F.concat(F.lit("a"), (F.col("user_id") % 10).cast("string")).alias("account_id"), F.date_format("ts", "yyyyMMdd").alias("day"), F.expr("CASE event_type WHEN 'view' THEN 'view_item' WHEN 'click' THEN 'add_to_cart' ELSE event_type END").alias("event_name"), F.lit(1).alias("event_count")))),
    "dim13_linkage_coverage": _t(lambda t: web.linkage_coverage(t.daily_metrics, t.accounts.withColumn("website_url", F.expr("CASE WHEN account_id LIKE '%4' THEN '' ELSE website_url END")), t.conversion_actions.withColumn("category", F.expr("CASE WHEN action_id LIKE '%1' THEN 'ADD_TO_CART' WHEN action_id LIKE '%2' THEN 'BEGIN_CHECKOUT' ELSE category END")))),
    "ga4_10_trajectory": _t(lambda t: web.with_trajectory(web.engagement_drop(t.ga4_landing_pages, min_sessions=20, drop=0.05), web.page_trends(t.ga4_landing_pages, min_sessions=20)).withColumn("landing_page", F.col("data")["landing_page"]), "account_id", "landing_page", "signal_type", "note"),
    "ga4_11_audit_targets": _t(lambda t: web.audit_targets(t.ga4_landing_pages, normalise.final_urls(t.campaign_final_urls.withColumn("final_url", F.regexp_replace("final_url", "Page", "page"))).filter("account_id NOT LIKE '%3'"), t.ga4_landing_pages.select("account_id", F.concat("ga4_property", F.lit(".example.org")).alias("ga4_url")))),
    "ga4_13_addressable": _q(lambda t: web.addressable(t.some)),
    "mag04_per_metric": _q(lambda t: t.forecasts),
    "mag06_budget_cost_error": _q(lambda t: proactive.budget_cost_error(t.rows)),
    "pmt06_metric_forecast": _q(lambda t: proactive.metric_forecast(t.tagged, t.accounts, t.plain_forecasts), "account_id", "campaign_id", "change_category", "is_multi_action", "template_id", "metric", "median_delta", "mae", "n"),
    "pro01_scan": _q(lambda t: proactive.scan(t.matches)),
    "pro02_experiments": _q(lambda t: proactive.experiments(t.tagged, t.accounts, t.forecasts, t.matches.filter("size(split(template_id, '__')) > 4"))),  # gaps are actions that the campaign's own kind of business has not tried
    "snk05_proactive_report": _q(_proactive_report, "section", "place", "what", "n", "campaign_id", "pre_state", "cpa_median"),
    "ver10_health_faults": _q(_faulty_health, "broken_links", "changed_days", "status"),
    "pro03_library": _q(lambda t: proactive.library_conditions(t.forecasts)),
    "ver03_resolved_once": _q(_outcomes),
    "ver04_template_links": _q(lambda t: t.links),
    "ver05_provenance": _q(lambda t: trust.provenance(t.predictions.withColumn("template_id", F.concat(F.lit("mag:"), "template_id")), trust.template_links(t.members), t.baseline), "prediction_id", "episode_count", "baseline_n", "provenance_hash"),
    "ver08_irreproducible": _q(_frozen),
    "ver09_drift_events": _q(lambda t: trust.drift_events(t.health, t.spark.createDataFrame([("x", "drift_alert", "warning", "none", None, None)], trust.EVENTS), F.lit("2024-03-24").cast("date"))),
    "ver10_health_score": _q(_ledger_health),
    "snk04_audit_export": _q(_exported, "episode_id", "template_id", "metric", "predicted_median", "actual_delta", "abs_error", "within_iqr", "recommendation", "state", "prediction_direction"),
    "snk05_template_report": _q(lambda t: observe.best_and_worst(t.catalogue), "section", "template_id", "direction_accuracy", "n_episodes"),
    "ops05_live_state": _q(lambda t: observe.live_state(t.facts, t.episodes, t.predictions, t.resolutions, t.health)),
    "ops05_strongest_calls": _q(lambda t: observe.strongest_calls(t.predictions, t.resolutions)),
    "ops05_top_drift": _q(lambda t: observe.top_drift(t.health)),
    "obs01_trace": _q(lambda t: observe.trace(t.tagged, t.some, t.change_events, t.members, t.plain_forecasts, t.baseline, refinement.matched_controls(t.rows, t.baseline), refinement.should_act(t.tagged, t.accounts, t.catalogue, t.baseline, refinement.matched_controls(t.rows, t.baseline)), t.resolved), "account_id", "campaign_id", "episode_id", "state", "n_signals", "resource_type", "change_category", "template_id", "metrics_forecast", "do_nothing_forecast", "decided_by", "metrics_resolved", "outcome"),
    "obs02_scorecard": _q(lambda t: observe.scorecard(t.facts, t.ga4_landing_pages, detectors.with_confidence(t.some), t.tagged, t.catalogue, t.predictions, t.resolutions, t.resolved, web.page_trends(t.ga4_landing_pages, min_sessions=20))),
    "obs03_status": _q(lambda t: observe.status(t.daily_metrics, accounts=t.accounts, change_events=t.change_events, episodes=t.episodes, signals=t.some)),
    "obs04_account_bundles": _q(lambda t: observe.account_bundles(t.accounts.select("account_id", "account_name", "vertical"), t.facts.groupBy("account_id").agg(F.sum("clicks").alias("clicks")), t.some).select("account_id", "part", "n_signals", F.get_json_object("bundle", "$.account.vertical").alias("vertical"), F.get_json_object("bundle", "$.performance_30d.clicks").cast("long").alias("clicks"), F.coalesce(F.json_array_length(F.get_json_object("bundle", "$.signals")), F.lit(0)).alias("listed"))),
    "bkt02_learning_curve": _q(lambda t: simulate.learning_curve(t.rows, t.accounts, (20, 50, 100), 3)),
    "bkt02_samples": _t(lambda t: simulate.account_samples(t.accounts, (20, 50), 3)),
    "bkt03_disruption": _q(lambda t: simulate.disruption(t.rows, trends.disrupted_weeks(trends.regimes(t.facts)).select("week"))),
}

_DQ = detector_queries.ORACLES


def _with(name: str) -> str:
    return f"({_DQ[name]})"


_SOME = f"so AS (SELECT * EXCLUDE (value, threshold) FROM {_with('det22_pmax_low_volume')} UNION ALL SELECT * EXCLUDE (value, threshold) FROM {_with('chg05_cpa_change')} UNION ALL SELECT * EXCLUDE (value, threshold) FROM {_with('det10_insufficient_conversions')})"
_DOMAINED = f"{_SOME}, sd AS (SELECT *, CASE WHEN signal_type LIKE 'pmax%' THEN '{detectors.PMAX}' ELSE '{detectors.BIDDING}' END AS domain FROM so)"
_PATTERNS = f"{_DOMAINED}, pa AS (SELECT domain, signal_type, count(*) AS n, count(DISTINCT account_id) AS n_accounts, max(CASE severity WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) AS r FROM sd GROUP BY ALL), pb AS (SELECT *, CASE WHEN n >= 5 THEN 0.9 WHEN n >= 3 THEN 0.75 WHEN n >= 2 THEN 0.6 ELSE 0.5 END::DOUBLE AS confidence FROM pa)"
_SEG = """ls AS (SELECT 'a' || l_suppkey AS account_id, 'c' || l_partkey % 12 AS campaign_id, CAST(l_shipdate AS DATE) AS date, CASE WHEN l_linenumber % 4 < 3 THEN 'MOBILE' ELSE 'DESKTOP' END AS device, CASE WHEN l_orderkey % 5 = 0 THEN 'SEARCH_PARTNERS' ELSE 'SEARCH' END AS network, CAST(l_orderkey % 24 AS VARCHAR) AS hour, 'D' || l_linenumber AS dow, CAST(l_orderkey % 6 AS VARCHAR) AS geo,
  CAST(l_quantity AS BIGINT) AS q, CASE WHEN l_linenumber = 7 THEN 0 ELSE CAST(l_quantity AS BIGINT) * 1000 END AS cost FROM lineitem WHERE l_orderkey % 11 <> 0),
un AS (""" + " UNION ALL ".join(f"SELECT account_id, campaign_id, '{d}' AS dimension, {d} AS segment_value, q, cost, date FROM ls" + (" WHERE cost > 0" if d == "geo" else "") for d in normalise.SEGMENT_DIMENSIONS) + ")"
_MAGLIB = f"{_per_metric(True)}, fo AS (SELECT 'mag:' || tid AS template_id, metric, median(delta) AS median_delta, quantile_cont(delta, 0.25) AS iqr_low, quantile_cont(delta, 0.75) AS iqr_high, count(*) AS n FROM dl GROUP BY ALL), fe AS (SELECT 'mag:' || tid AS template_id, metric, avg(err) AS mae FROM de GROUP BY ALL)"
_CURRENT = "cu AS (SELECT account_id, campaign_id, max_by(state, (change_date, episode_id)) AS st FROM (SELECT ep.*, s.state FROM ep JOIN (SELECT key, state FROM st) s ON s.key = ep.episode_id WHERE campaign_id <> '') GROUP BY ALL), cp AS (SELECT cu.*, coalesce(nullif(business_type, ''), 'unknown') AS bt, coalesce(nullif(vertical, ''), 'unknown') AS ve, coalesce(nullif(spend_tier, ''), 'unknown') AS ti FROM cu LEFT JOIN accounts USING (account_id))"
_PARSED = """pz AS (SELECT DISTINCT template_id, string_split(substr(template_id, 5), '__') AS p FROM fo), li AS (SELECT template_id, p[1] AS change_category, substr(p[2], 5) AS magnitude_bucket, p[3] = 'multi' AS is_multi_action, CASE WHEN len(p) > 4 THEN p[4] END AS business_type, CASE WHEN len(p) > 5 THEN p[5] END AS vertical, CASE WHEN len(p) > 6 THEN p[6] END AS spend_tier, p[-1] AS pre_state FROM pz)"""
_MATCH = f"""{_MAGLIB}, {_CURRENT}, {_PARSED}, lb AS (SELECT template_id, max(median_delta) FILTER (metric = 'cpa') AS cpa, max(n) AS n FROM fo GROUP BY ALL),
ac AS (SELECT DISTINCT change_category AS cc, magnitude_bucket AS mb FROM li), q0 AS (SELECT *, unnest([FALSE, TRUE]) AS mu FROM cp, ac), q1 AS (SELECT *, 'mag:' || cc || '__mag=' || mb || '__' || CASE WHEN mu THEN 'multi' ELSE 'single' END AS pre FROM q0),
q2 AS (SELECT *, unnest([1, 2, 3, 4]) AS lv, unnest([concat_ws('__', pre, bt, ve, ti, st), concat_ws('__', pre, bt, ve, st), concat_ws('__', pre, bt, st), concat_ws('__', pre, st)]) AS template_id FROM q1),
ma AS (SELECT * FROM (SELECT q2.*, cpa, n, row_number() OVER (PARTITION BY account_id, campaign_id, cc, mb, mu ORDER BY lv) AS rn FROM q2 JOIN lb USING (template_id)) WHERE rn = 1)"""
ORACLES = {
    "src03_signals_read": f"WITH {_SOME} SELECT * FROM so WHERE account_id = 'a7'",
    "src03_signals_of_domain": f"WITH {_SOME} SELECT * FROM so WHERE signal_type LIKE 'pmax%'",
    "src04_patterns_read": f"WITH {_PATTERNS} SELECT domain, signal_type, confidence, n, n_accounts FROM pb WHERE confidence >= 0.6",
    "pat01_patterns": f"WITH {_PATTERNS} SELECT domain, signal_type, CASE WHEN n_accounts > 1 THEN 'cross_account' ELSE 'threshold_violation' END AS pattern_type, CASE r WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END AS severity, confidence, n, n_accounts FROM pb",
    "src05_episodes_read": _w(_ALL, f"{_EPISODES} SELECT episode_id, campaign_id, outcome FROM ep WHERE account_id = 'a5'"),
    "src05_episodes_of_outcome": _w(_ALL, f"{_EPISODES} SELECT episode_id, account_id FROM ep WHERE outcome = 'improved'"),
    "nrm02_keywords": f"WITH {ctes('keyword_metrics')} SELECT account_id, campaign_id, keyword_id, quality_score FROM keyword_metrics",
    "nrm04_accounts": "SELECT CAST(s_suppkey AS VARCHAR) AS account_id, CASE WHEN s_suppkey % 5 <> 0 THEN s_name ELSE '' END AS account_name, 'm1' AS mcc_id, CASE WHEN s_suppkey % 3 = 0 THEN 'EUR' ELSE 'USD' END AS currency_code, '2024-03-24' AS first_seen, '2024-03-24' AS last_updated FROM supplier",
    "nrm07_conversion_actions": "SELECT 'a1' AS account_id, CAST(p_partkey AS VARCHAR) AS action_id, p_name AS action_name, 'ENABLED' AS status, 'WEBPAGE' AS action_type, CASE WHEN p_size % 2 = 0 THEN 'PURCHASE' ELSE 'LEAD' END AS category, 'ONE_PER_CLICK' AS counting_type, 'LAST_CLICK' AS attribution_model, p_size % 3 = 0 AS primary_for_goal FROM part",
    "nrm09_campaign_segments": f"WITH {_SEG} SELECT account_id, campaign_id, dimension, segment_value, CAST(sum(q) AS BIGINT) AS impressions, count(*) AS clicks, CAST(sum(cost) AS BIGINT) AS cost_micros, count(*) * 0.5::DOUBLE AS conversions, CAST(min(date) AS VARCHAR) AS window_start, CAST(max(date) AS VARCHAR) AS window_end FROM un GROUP BY ALL",
    "nrm10_ad_strength": f"WITH {ctes('ad_strength')} SELECT account_id, campaign_id, 'g1' AS ad_group_id, ad_id, ad_strength FROM ad_strength WHERE ad_strength <> 'GOOD' AND account_id NOT LIKE '%3'",
    "nrm12_final_urls": f"WITH {ctes('campaign_final_urls')} SELECT DISTINCT account_id, campaign_id, final_url, lower(regexp_extract(final_url, 'com(/[^/?]*)', 1)) AS norm_path, 'shop.example.com' AS domain FROM campaign_final_urls",
    "nrm15_campaign_pages": f"WITH {ctes('ga4_landing_pages', 'campaign_final_urls')}, pt AS (SELECT DISTINCT account_id, lower(regexp_extract(final_url, 'com(/[^/?]*)', 1)) AS landing_page FROM campaign_final_urls WHERE final_url NOT LIKE '%Page3%') SELECT account_id, CAST(date AS VARCHAR) AS date, landing_page, device, sessions FROM ga4_landing_pages SEMI JOIN pt USING (account_id, landing_page)",
    "nrm16_source_engagement": f"WITH {ctes('ga4_source_engagement')} SELECT ga4_property, account_id, replace(channel, 'Direct', 'Organic Search') AS channel, CAST(sum(sessions) AS BIGINT) AS sessions, round(sum(engagement_rate * sessions) / sum(sessions), 6) AS engagement_rate, round(sum(engagement_rate / 2 * sessions) / sum(sessions), 6) AS session_cvr, round(1 - sum(engagement_rate * sessions) / sum(sessions), 6) AS bounce_rate FROM ga4_source_engagement GROUP BY ALL",
    "nrm17_funnel_events": "SELECT 'p1' AS ga4_property, 'a' || user_id % 10 AS account_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, CASE event_type WHEN 'view' THEN 'view_item' WHEN 'click' THEN 'add_to_cart' ELSE event_type END AS event_name, count(*) AS event_count FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY ALL",
    "dim13_linkage_coverage": f"""WITH {ctes('daily_metrics', 'accounts', 'conversion_actions')}, ca AS (SELECT account_id, action_name, action_type, CASE WHEN action_id LIKE '%1' THEN 'ADD_TO_CART' WHEN action_id LIKE '%2' THEN 'BEGIN_CHECKOUT' ELSE category END AS category FROM conversion_actions), dm AS (SELECT DISTINCT account_id FROM daily_metrics)
SELECT (SELECT count(*) FROM dm) AS active_accounts, (SELECT count(*) FROM accounts SEMI JOIN dm USING (account_id) WHERE account_id NOT LIKE '%4') AS with_website_url, (SELECT count(DISTINCT account_id) FROM ca WHERE contains(category, 'IMPORT') OR contains(upper(action_type), 'ANALYT') OR contains(upper(action_name), 'GA4') OR contains(upper(action_name), 'ANALYTICS')) AS imported_goals,
(SELECT count(DISTINCT account_id) FROM ca WHERE category IN ('ADD_TO_CART', 'BEGIN_CHECKOUT', 'PURCHASE')) AS any_funnel_step, (SELECT count(*) FROM (SELECT account_id FROM ca WHERE category IN ('ADD_TO_CART', 'BEGIN_CHECKOUT', 'PURCHASE') GROUP BY account_id HAVING count(DISTINCT category) = 3)) AS whole_funnel""",
    "ga4_11_audit_targets": f"""WITH {ctes('ga4_landing_pages', 'campaign_final_urls')}, pg AS (SELECT DISTINCT account_id, landing_page, ga4_property FROM ga4_landing_pages), fu AS (SELECT DISTINCT account_id, lower(regexp_extract(final_url, 'com(/[^/?]*)', 1)) AS landing_page FROM campaign_final_urls WHERE account_id NOT LIKE '%3')
SELECT 'https://' || CASE WHEN fu.account_id IS NULL THEN ga4_property || '.example.org' ELSE 'shop.example.com' END || pg.landing_page AS url, min(pg.account_id) AS account_id FROM pg LEFT JOIN fu USING (account_id, landing_page) GROUP BY 1""",
    "ga4_13_addressable": f"WITH {_SOME} SELECT count(*) FILTER (signal_type IN ('cvr_drop', 'cvr_change')) AS cvr_signals, count(*) FILTER (signal_type IN ('cpa_spike', 'cpa_change')) AS cpa_signals, 0::BIGINT AS device_mobile_drag, 0::BIGINT AS weak_ad_strength, count(*) FILTER (signal_type LIKE 'cvr%' OR signal_type LIKE 'cpa%') AS total_addressable FROM so",
    "mag04_per_metric": _w(_ALL, f"{_MAGLIB} SELECT template_id, metric, round(median_delta, 6) AS median_delta, round(iqr_low, 6) AS iqr_low, round(iqr_high, 6) AS iqr_high, round(mae, 6) AS mae, n FROM fo JOIN fe USING (template_id, metric)"),
    "mag06_budget_cost_error": _w(_ALL, f"""{_ROWS}, bu_rows AS (SELECT * FROM tr WHERE change_category = 'budget'), {_cascade(True, 'bu_rows', 'bm')}, c0 AS (SELECT 'm' AS kind, tid AS cell, episode_id, pre_cost, post_cost FROM bm UNION ALL SELECT 'c', pre_state, episode_id, pre_cost, post_cost FROM bu_rows),
c1 AS (SELECT *, greatest(-1, least(3, (post_cost - pre_cost) / pre_cost)) AS delta, count(*) OVER (PARTITION BY kind, cell) AS n FROM c0 WHERE coalesce(pre_cost, 0) <> 0), c2 AS (SELECT *, (row_number() OVER (PARTITION BY kind, cell ORDER BY episode_id) - 1) % 5 AS fold FROM c1 WHERE n >= 10),
c3 AS (SELECT x.kind, x.cell, g.f, median(x.delta) AS med FROM c2 x, (SELECT unnest([0, 1, 2, 3, 4]) AS f) g WHERE g.f <> x.fold GROUP BY ALL), c4 AS (SELECT c2.kind, abs(med - delta) AS e FROM c2 JOIN c3 ON c2.kind = c3.kind AND c2.cell = c3.cell AND c2.fold = c3.f)
SELECT round(avg(e) FILTER (kind = 'm'), 6) AS magnitude_cost_mae, count(*) FILTER (kind = 'm') AS magnitude_n, round(avg(e) FILTER (kind = 'c'), 6) AS category_cost_mae, count(*) FILTER (kind = 'c') AS category_n, coalesce(avg(e) FILTER (kind = 'm') < 0.15, FALSE) AS passes FROM c4"""),
    "pro01_scan": _w(_ALL, f"{_MATCH} SELECT CASE WHEN cpa <= -0.1 THEN 'recommendation' ELSE 'warning' END AS call, account_id, campaign_id, st AS pre_state, cc AS change_category, mb AS magnitude_bucket, mu AS is_multi_action, round(cpa, 6) AS cpa_median, n, template_id FROM ma WHERE cpa <= -0.1 OR cpa >= 0.1"),
    "pro02_experiments": _w(_ALL, f"""{_MATCH}, kn AS (SELECT * FROM (SELECT pre_state, change_category, magnitude_bucket, row_number() OVER (PARTITION BY pre_state, change_category ORDER BY n DESC, magnitude_bucket) AS rn FROM (SELECT pre_state, change_category, magnitude_bucket, count(*) AS n FROM li GROUP BY ALL)) WHERE rn = 1)
SELECT pre_state, change_category AS proposed_action, magnitude_bucket AS suggested_magnitude, count(*) AS campaigns_in_gap FROM cp JOIN kn ON pre_state = st WHERE NOT EXISTS (SELECT 1 FROM ma WHERE ma.account_id = cp.account_id AND ma.campaign_id = cp.campaign_id AND ma.cc = change_category AND len(string_split(ma.template_id, '__')) > 4) GROUP BY ALL"""),
    "snk05_proactive_report": _w(_ALL, f"""{_MATCH}, kn AS (SELECT * FROM (SELECT pre_state, change_category, magnitude_bucket, row_number() OVER (PARTITION BY pre_state, change_category ORDER BY n DESC, magnitude_bucket) AS rn FROM (SELECT pre_state, change_category, magnitude_bucket, count(*) AS n FROM li GROUP BY ALL)) WHERE rn = 1), gp AS (SELECT pre_state, change_category AS proposed_action, magnitude_bucket AS suggested_magnitude, count(*) AS campaigns_in_gap FROM cp JOIN kn ON pre_state = st WHERE NOT EXISTS (SELECT 1 FROM ma WHERE ma.account_id = cp.account_id AND ma.campaign_id = cp.campaign_id AND ma.cc = change_category AND len(string_split(ma.template_id, '__')) > 4) GROUP BY ALL),
sc AS (SELECT CASE WHEN cpa <= -0.1 THEN 'recommendation' ELSE 'warning' END AS section, *, concat_ws(' ', mb, cc, CASE WHEN mu THEN 'with others' END) AS what FROM ma WHERE cpa <= -0.1 OR cpa >= 0.1),
al AS (SELECT 'coverage' AS section, 1 AS p, 'campaigns scanned' AS what, (SELECT count(*) FROM cp) AS n, NULL AS account_id, NULL AS campaign_id, NULL AS pre_state, NULL AS cpa, NULL AS cc, NULL AS mb
  UNION ALL SELECT 'coverage', 2, 'with a recommendation', (SELECT count(DISTINCT (account_id, campaign_id)) FROM sc WHERE section = 'recommendation'), NULL, NULL, NULL, NULL, NULL, NULL
  UNION ALL SELECT 'coverage', 3, 'with a warning', (SELECT count(DISTINCT (account_id, campaign_id)) FROM sc WHERE section = 'warning'), NULL, NULL, NULL, NULL, NULL, NULL
  UNION ALL SELECT 'coverage', 4, 'experiments', (SELECT count(*) FROM gp), NULL, NULL, NULL, NULL, NULL, NULL
  UNION ALL SELECT section, 0, what, n, account_id, campaign_id, st, cpa, cc, mb FROM sc QUALIFY row_number() OVER (PARTITION BY section ORDER BY CASE section WHEN 'warning' THEN -cpa ELSE cpa END, n DESC, account_id, campaign_id, cc, mb, mu) <= 10
  UNION ALL SELECT 'experiment', 0, concat_ws(' ', suggested_magnitude, proposed_action), campaigns_in_gap, NULL, NULL, pre_state, NULL, proposed_action, suggested_magnitude FROM gp QUALIFY row_number() OVER (ORDER BY campaigns_in_gap DESC, pre_state, proposed_action) <= 10)
SELECT section, CAST(row_number() OVER (PARTITION BY section ORDER BY p, CASE section WHEN 'warning' THEN -cpa ELSE cpa END, n DESC, account_id, campaign_id, pre_state, cc, mb, what) AS INT) AS place, what, n, campaign_id, pre_state, round(cpa, 6) AS cpa_median FROM al"""),
    "ver10_health_faults": _w(_ALL, f"{_RES} SELECT (SELECT count(*) FROM pred WHERE prediction_id LIKE '%7' OR prediction_id LIKE '%3') AS broken_links, (SELECT count(DISTINCT date) FROM daily_metrics WHERE date IN (DATE '2024-02-20', DATE '2024-03-02')) AS changed_days, 'critical' AS status"),
    "pro03_library": _w(_ALL, f"{_MAGLIB}, {_PARSED} SELECT * FROM li"),
    "pmt06_metric_forecast": _w(_ALL, f"""{_per_metric(False)}, {_CURRENT}, fo AS (SELECT tid AS template_id, metric, median(delta) AS md, count(*) AS n FROM dl GROUP BY ALL), fe AS (SELECT tid AS template_id, metric, avg(err) AS mae FROM de GROUP BY ALL), lb AS (SELECT DISTINCT template_id FROM fo), ac AS (SELECT DISTINCT split_part(template_id, '__', 1) AS cc FROM lb),
q0 AS (SELECT *, unnest([FALSE, TRUE]) AS mu FROM cp, ac), q1 AS (SELECT *, cc || '__' || CASE WHEN mu THEN 'multi' ELSE 'single' END AS pre FROM q0), q2 AS (SELECT *, unnest([1, 2, 3, 4]) AS lv, unnest([concat_ws('__', pre, bt, ve, ti, st), concat_ws('__', pre, bt, ve, st), concat_ws('__', pre, bt, st), concat_ws('__', pre, st)]) AS template_id FROM q1),
ma AS (SELECT * FROM (SELECT q2.*, row_number() OVER (PARTITION BY account_id, campaign_id, cc, mu ORDER BY lv) AS rn FROM q2 JOIN lb USING (template_id)) WHERE rn = 1)
SELECT account_id, campaign_id, cc AS change_category, mu AS is_multi_action, template_id, metric, round(md, 6) AS median_delta, round(mae, 6) AS mae, n FROM ma JOIN fo USING (template_id) JOIN fe USING (template_id, metric)"""),
    "ver04_template_links": _w(_ALL, f"{_ROWS}, {_cascade(True)} SELECT 'mag:' || tid AS template_id, 1 AS template_version, episode_id FROM mem"),
    "ver03_resolved_once": _w(_ALL, f"""{_RES}, en AS (SELECT prediction_id FROM pred WHERE rec <> 'WAIT'), r7 AS (SELECT prediction_id, adir, rec FROM rsv WHERE w = 7)
SELECT prediction_id, CASE WHEN prediction_id < '4' THEN 'neutral' ELSE adir END AS actual_direction, CASE WHEN prediction_id < '4' THEN 'kept' WHEN adir IS NULL THEN '' ELSE sha256('{{"actual_direction":"' || adir || '","actual_metrics":{{"call":"' || rec || '"}}}}') END AS resolution_hash FROM en LEFT JOIN r7 USING (prediction_id)"""),
    "ver09_drift_events": _w(_ALL, f"{_RES}, h AS (SELECT tid, count(*) AS n, avg(dok::INT) AS live FROM rsv WHERE w = 14 GROUP BY tid) SELECT substr(sha256('drift_alert|' || tid || '|2024-03-24'), 1, 12) AS event_id, 'drift_alert' AS event_type, 'warning' AS severity, tid AS related_entity, '2024-03-24' AS created_at, NULL AS resolved_at FROM h JOIN cat USING (tid) WHERE h.n >= 10 AND live < acc - 0.15"),
    "snk05_template_report": _w(_ALL, f"{_CAT}, tw AS (SELECT tid, acc, n, row_number() OVER (ORDER BY acc DESC, n DESC, tid) AS b, row_number() OVER (ORDER BY acc, n DESC, tid) AS w FROM cat WHERE status = 'ACTIVE') SELECT 'best' AS section, tid AS template_id, round(acc, 6) AS direction_accuracy, n AS n_episodes FROM tw WHERE b <= 10 UNION ALL SELECT 'worst', tid, round(acc, 6), n FROM tw WHERE w <= 10"),
    "ops05_top_drift": _w(_ALL, f"{_RES}, h AS (SELECT tid, count(*) AS n, avg(dok::INT) AS live FROM rsv WHERE w = 14 GROUP BY tid) SELECT tid AS template_id, round(live, 6) AS live, round(acc, 6) AS backtest FROM h JOIN cat USING (tid) WHERE h.n >= 10 AND live < acc - 0.15 ORDER BY live, tid LIMIT 10"),
    "ops05_strongest_calls": _w(_ALL, f"{_RES} SELECT prediction_id, rec AS recommendation, tid AS template_id, campaign_id, round(cost, 6) AS action_cost, rok AS recommendation_correct FROM rsv WHERE w = 14 AND rec IN ('DO_NOT_ACT', 'ACT') ORDER BY abs(cost) DESC, prediction_id LIMIT 8"),
    "ops05_live_state": _w(_ALL, f"""{_RES}, h AS (SELECT tid, count(*) AS n, avg(dok::INT) AS live FROM rsv WHERE w = 14 GROUP BY tid), hs AS (SELECT CASE WHEN n >= 10 AND live > 0.55 THEN 'ACTIVE' WHEN n < 10 OR live BETWEEN 0.45 AND 0.55 THEN 'SHADOW_ONLY' ELSE 'RETIRED' END AS s FROM h), c AS (SELECT coalesce(rec, 'all') AS r, count(*) AS n, avg(rok::INT) AS acc FROM rsv WHERE w = 14 GROUP BY CUBE (rec))
SELECT 'monitored' AS section, 'accounts' AS key, (SELECT count(DISTINCT account_id) FROM daily_metrics)::DOUBLE AS value UNION ALL SELECT 'monitored', 'episodes', (SELECT count(*) FROM ep) UNION ALL SELECT 'monitored', 'predictions', (SELECT count(*) FROM pred) UNION ALL SELECT 'resolved', CAST(w AS VARCHAR), count(*) FROM rsv GROUP BY w
UNION ALL SELECT 'templates', s, count(*) FROM hs GROUP BY s UNION ALL SELECT 'calls', r, n FROM c UNION ALL SELECT 'accuracy', r, round(acc, 6) FROM c"""),
    "obs03_status": _w(_ALL, f"{_EPISODES} SELECT 'daily_metrics' AS table_name, count(*) AS n_rows, CAST(min(date) AS VARCHAR) AS first, CAST(max(date) AS VARCHAR) AS last FROM daily_metrics UNION ALL SELECT 'accounts', count(*), NULL, NULL FROM accounts UNION ALL SELECT 'change_events', count(*), NULL, NULL FROM change_events UNION ALL SELECT 'episodes', count(*), NULL, NULL FROM ep UNION ALL SELECT 'signals', (SELECT count(*) FROM (WITH {_SOME} SELECT * FROM so)), NULL, NULL"),
    "obs04_account_bundles": f"WITH {ctes('accounts', 'daily_metrics')}, sg AS (WITH {_SOME} SELECT account_id, count(*) AS n FROM so GROUP BY ALL), cl AS (SELECT account_id, CAST(sum(clicks) AS BIGINT) AS clicks FROM daily_metrics GROUP BY ALL) SELECT account_id, CAST(part AS INT) AS part, n_signals, vertical, clicks, CAST(least(n_signals - 200 * part, 200) AS INT) AS listed FROM (SELECT account_id, coalesce(n, 0) AS n_signals, vertical, clicks, unnest(range(greatest(1, (coalesce(n, 0) + 199) // 200))) AS part FROM accounts LEFT JOIN sg USING (account_id) LEFT JOIN cl USING (account_id))",
}


# --- oracles of queries that other modules register ---

from admeridian.plans import learn_queries as _L  # noqa: E402
from admeridian.plans.operate_queries import _PRED  # noqa: E402

_LO = _L.ORACLES
_KEYS = "dimension, value, change_category, actor"
_CELLS = f"FROM ({_LO['sgl05_patterns']}) p {{}} JOIN ({_LO['sgl06_comparisons']}) c USING ({_KEYS})"
_HELD = _CAT.replace(_cascade(), f"ct AS (SELECT max(change_date) - 14 AS c FROM tr), trw AS (SELECT tr.* FROM tr, ct WHERE change_date <= c), {_cascade(False, 'trw')}")
_LEVELED = "unnest([1, 2, 3, 4]) AS lv, unnest([concat_ws('__', {0}, business_type, vertical, spend_tier, {1}), concat_ws('__', {0}, business_type, vertical, {1}), concat_ws('__', {0}, business_type, {1}), concat_ws('__', {0}, {1})]) AS tid"
_ACTIVE_CAT = "act AS (SELECT * FROM cat WHERE status IN ('ACTIVE', 'PROVISIONAL'))"
ORACLES |= {
    "sgl07_cards": f"SELECT {_KEYS}, CASE WHEN degraded > improved THEN 'degrades' ELSE 'improves' END AS tilt, confidence, significant, direction {_CELLS.format('LEFT')} WHERE confidence <> 'LOW'",
    "sgl08_promotions": f"SELECT {_KEYS}, direction, degraded_low > 0.5 OR degraded_high < 0.5 AS decisive_majority {_CELLS.format('')} WHERE confidence = 'RELIABLE' AND significant",
    "tpl10_catalogue": _w(_ALL, f"{_CAT} SELECT tid AS template_id, CASE WHEN level = 3 THEN 5 ELSE 1 END AS version, '2024-03-24, version ' || CASE WHEN level = 3 THEN 5 ELSE 1 END || ': ' || lower(status) || ', learned from ' || n || ' episodes in ' || na || ' accounts' AS changelog FROM cat"),
    "tpl11_shadow": _w(_ALL, f"""{_HELD}, {_ACTIVE_CAT}, ca AS (SELECT tr.*, {_LEVELED.format("change_category, m", "pre_state")} FROM tr, ct WHERE change_date > c), be AS (SELECT ca.*, mode, med, row_number() OVER (PARTITION BY episode_id ORDER BY lv) AS rn FROM ca JOIN act USING (tid))
SELECT episode_id, tid AS template_id, mode AS prediction_direction, direction = mode AS direction_correct, CASE WHEN abs(med - signed) <= 0.05 THEN 'exact' WHEN abs(med - signed) <= 0.1 THEN 'close' WHEN abs(med - signed) <= 0.2 THEN 'ballpark' ELSE 'miss' END AS magnitude_score FROM be WHERE rn = 1"""),
    "tpl12_recommend": _w(_ALL, f"""{_CAT}, {_ACTIVE_CAT}, cu AS (SELECT account_id, campaign_id, max_by(state, (change_date, episode_id)) AS s FROM (SELECT ep.*, x.state FROM ep JOIN (SELECT key, state FROM st) x ON x.key = ep.episode_id) GROUP BY ALL),
cp AS (SELECT cu.*, coalesce(nullif(business_type, ''), 'unknown') AS business_type, coalesce(nullif(vertical, ''), 'unknown') AS vertical, coalesce(nullif(spend_tier, ''), 'unknown') AS spend_tier FROM cu JOIN accounts USING (account_id)), cc AS (SELECT DISTINCT split_part(tid, '__', 1) AS change_category FROM cat),
q0 AS (SELECT *, unnest([FALSE, TRUE]) AS mu FROM cp, cc), q1 AS (SELECT *, CASE WHEN mu THEN 'multi' ELSE 'single' END AS m FROM q0), q2 AS (SELECT *, {_LEVELED.format("change_category, m", "s")} FROM q1), be AS (SELECT q2.*, mode, med, row_number() OVER (PARTITION BY account_id, campaign_id, change_category, mu ORDER BY lv) AS rn FROM q2 JOIN act USING (tid))
SELECT account_id, campaign_id, change_category, mu AS is_multi_action, tid AS template_id, mode AS prediction_direction, round(med, 6) AS prediction_magnitude FROM be WHERE rn = 1"""),
    "pmt05_hypotheses": _w(_ALL, f"{_per_metric(False)}, fo AS (SELECT tid, metric, median(delta) AS md, quantile_cont(delta, 0.25) AS lo, quantile_cont(delta, 0.75) AS hi FROM dl GROUP BY ALL) SELECT metric, count(*) AS n, round(avg(abs(md - delta)), 6) AS mae, round(avg((delta BETWEEN lo AND hi)::INT), 6) AS within_iqr FROM dl JOIN fo USING (tid, metric) GROUP BY metric"),
    "ver06_spot_check": _w(_ALL, f"""{_ROWS}, aq AS (SELECT DISTINCT account_id, campaign_id, pre_state, change_category FROM tr), rk AS (SELECT *, row_number() OVER (PARTITION BY pre_state, change_category ORDER BY change_date DESC, episode_id) AS r, row_number() OVER (PARTITION BY account_id, pre_state, change_category ORDER BY change_date DESC, episode_id) AS o FROM tr),
un AS (SELECT aq.*, 0 AS w, o AS r, episode_id, signed FROM aq JOIN (SELECT account_id, pre_state, change_category, episode_id, signed, o FROM rk WHERE o <= 5) USING (account_id, pre_state, change_category) UNION ALL SELECT aq.*, 1, r, episode_id, signed FROM aq JOIN (SELECT account_id AS other, pre_state, change_category, episode_id, signed, r FROM rk WHERE r <= 5) USING (pre_state, change_category) WHERE other <> account_id),
pl AS (SELECT *, row_number() OVER (PARTITION BY account_id, campaign_id, pre_state, change_category ORDER BY w, r) AS place FROM un) SELECT account_id, campaign_id, pre_state, change_category, place, episode_id, round(signed, 6) AS signed FROM pl WHERE place <= 5"""),
    "obs05_firing": f"WITH fs AS (SELECT signal_type, count(*) AS n FROM (SELECT signal_type FROM {_with('chg05_cpa_change')} UNION ALL SELECT signal_type FROM {_with('chg04_cvr_change')} UNION ALL SELECT signal_type FROM {_with('det03_cpa_spike')}) GROUP BY 1), kn AS (SELECT unnest(['cpa_change', 'cvr_change', 'cpa_spike', 'tracking_break']) AS signal_type) SELECT signal_type, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'SILENT' WHEN n > 50 THEN 'NOISY' ELSE 'CREDIBLE' END AS call FROM kn LEFT JOIN fs USING (signal_type)",
    "obs06_busiest": _w(_ALL, f"{_EPISODES} SELECT account_id, campaign_id, count(*) AS n FROM ep GROUP BY ALL ORDER BY n DESC, account_id, campaign_id LIMIT 15"),
    "ops06_daily_cycle": _w(_ALL, _RES.replace("(SELECT max(date) AS d FROM daily_metrics) z", "(SELECT DATE '2024-03-01' AS d) z") + " SELECT w AS window_days, rec AS recommendation, count(*) AS n FROM rsv GROUP BY ALL"),
    "ops07_alerts": _w(_ALL, f"{_RES}, al AS (SELECT 'freshness' AS alert, (DATE '2024-04-01' - max(date))::DOUBLE AS value, 2.0::DOUBLE AS \"limit\", TRUE AS high FROM daily_metrics UNION ALL SELECT 'accuracy', avg(rok::INT), 0.5, FALSE FROM rsv WHERE w = 14) SELECT alert, round(value, 6) AS value, \"limit\" FROM al WHERE CASE WHEN high THEN value > \"limit\" ELSE value < \"limit\" END"),
    "trd05_trend_annotation": _w("daily_metrics", f"""{_TRENDS}, sg AS (SELECT account_id, campaign_id, signal_type FROM {_with('chg05_cpa_change')} UNION ALL SELECT account_id, campaign_id, signal_type FROM {_with('chg04_cvr_change')})
SELECT sg.account_id, sg.campaign_id, signal_type, coalesce(classification, '') AS trend_classification_30d, round(slope, 6) AS trend_slope_30d FROM sg LEFT JOIN tr ON tr.account_id = sg.account_id AND tr.campaign_id = sg.campaign_id AND tr.window_days = 30 AND tr.metric = CASE signal_type WHEN 'cpa_change' THEN 'cpa' ELSE 'cvr' END"""),
    "epi08_domains": _LO["epi08_domains"].replace("SELECT CASE WHEN list_contains(cats, 'budget')", "SELECT episode_id, CASE WHEN list_contains(cats, 'budget')").replace(", count(*) AS n FROM ep GROUP BY ALL", " FROM ep"),
}
