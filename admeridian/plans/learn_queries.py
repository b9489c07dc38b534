"""Queries and DuckDB oracles of trends, episodes, segment learning, templates and refinements."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admeridian.functions.config import BENCHMARK_CPA, SEASONAL
from admeridian.functions.stats import rnd
from admeridian.operators import episodes, heldout, refinement, segment_learning, templates, trends
from admeridian.sources.adapters import TABLES, Tables, ctes, spark_sql
from admeridian.sources.tables import dealt, materialised


class Learned(Tables):
    """The chain of learned tables; each link is materialised once per instance."""

    @cached_property
    def facts(self) -> DataFrame:
        """The daily facts, an account's together and in order: sums by account and day are made before anything is moved, and what
        is moved is packed tighter. Line items are dealt by account instead of by account, campaign and day, so nothing is moved more,
        into a stated number of parts: packed as they are, parts that Spark merges by their size hold too many days to sum and sort."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = self.spark.sql(spark_sql(TABLES["daily_metrics"]), lineitem=self.lineitem.repartition(parts, "l_suppkey"))
        return materialised(rows.sortWithinPartitions("account_id", "campaign_id", "date"), "daily")

    @cached_property
    def days(self) -> episodes.Days:
        return episodes.laid(self.facts, summed=True)  # the facts are grouped by what names a campaign, and by day

    @cached_property
    def episodes(self) -> DataFrame:
        return dealt(episodes.build(self.change_events, self.days), "episodes", "campaign_id")

    @cached_property
    def tagged(self) -> DataFrame:
        return dealt(templates.tag_states(self.episodes, self.days, self.accounts), "tagged", "campaign_id")

    @cached_property
    def rows(self) -> DataFrame:
        return dealt(refinement.with_magnitude(templates.refine(templates.template_episodes(self.tagged, self.accounts), self.facts), self.change_events), "template-episodes", "campaign_id")

    @cached_property
    def members(self) -> DataFrame:
        return dealt(templates.cascade(self.rows), "members", "campaign_id")

    @cached_property
    def catalogue(self) -> DataFrame:
        return materialised(templates.backtested(self.members), "catalogue")

    @cached_property
    def baseline(self) -> DataFrame:
        return dealt(refinement.no_action_baseline(self.days, self.change_events, self.accounts), "baseline", "campaign_id")

    @cached_property
    def clean(self) -> DataFrame:
        return segment_learning.clean_episodes(self.episodes, self.accounts)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, dates as text: what the oracles are compared on."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c).cast("string").alias(c) if kinds[c] == "date" else F.col(c) for c in df.columns])


def settled(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded to nine digits, which takes the engines' last bits away, and then to ``digits``, so that a tie is one and the
    same number on both sides."""
    return df.withColumns({c: rnd(rnd(F.col(c), 9), digits) + F.lit(0.0) for c, kind in df.dtypes if kind == "double"})


def _q(make, *columns: str, digits: int = 6):
    def query(spark, sf_dir):
        out = make(Learned(spark, sf_dir))
        return rounded(out.select(*columns) if columns else out, digits)

    return query


_TEMPLATE = ("template_id", "level", "prediction_direction", "prediction_magnitude", "iqr_low", "iqr_high", "n_episodes", "n_accounts")

QUERIES = {
    "trd02_daily_values": _q(lambda t: trends.daily_values(t.daily_metrics).filter("value IS NOT NULL")),
    "trd03_campaign_trends": _q(lambda t: settled(trends.campaign_trends(t.daily_metrics)), "account_id", "campaign_id", "metric", "window_days", "n", "slope", "r_squared", "classification", "cv", "current_value", "projected_7d", digits=4),
    "trd04_volatility": _q(lambda t: trends.with_volatility(trends.campaign_trends(t.daily_metrics)), "account_id", "campaign_id", "metric", "volatility_class", "threshold_multiplier"),
    "trd05_trend_annotation": _q(lambda t: _annotated(t), "account_id", "campaign_id", "signal_type", "trend_classification_30d", "trend_slope_30d"),
    "trd06_class_summary": _q(lambda t: trends.class_summary(trends.campaign_trends(t.daily_metrics))),
    "reg01_change_points": _q(lambda t: trends.regimes(t.daily_metrics)),
    "reg03_disrupted_weeks": _q(lambda t: trends.disrupted_weeks(trends.regimes(t.daily_metrics))),
    "epi02_03_bundles": _q(lambda t: episodes.bundles(t.change_events, t.daily_metrics).withColumn("categories", F.array_join("categories", "+")), "episode_id", "account_id", "campaign_id", "change_date", "actor", "categories", "change_count", "change_event_id", "change_category", "known"),
    "epi04_window_metrics": _q(lambda t: episodes.window_metrics(episodes.bundles(t.change_events, t.daily_metrics), t.daily_metrics), "episode_id", *[f"{p}_{m}" for p in ("pre", "post") for m in episodes.METRICS]),
    "epi05_confounded": _q(lambda t: episodes.confounded(episodes.bundles(t.change_events, t.daily_metrics))),
    "epi06_07_outcomes": _q(lambda t: t.episodes, "episode_id", "confounded", "outcome_metric", "raw_outcome", "raw_magnitude", "trend_adjusted", "trend_slope", "expected_value", "outcome", "adjusted_magnitude", "trend_contribution_pct"),
    "epi08_texts": _q(lambda t: t.episodes, "episode_id", "outcome_detail", "cannot_rule_out", "check_next"),
    "epi08_domains": _q(lambda t: t.episodes, "episode_id", "domain", "confidence_tier"),
    "epi09_cards": _q(lambda t: episodes.cards(t.episodes, t.accounts), "change_category", "actor", "n", "accounts", "improved", "degraded", "neutral", "avg_improve", "avg_degrade", "confidence"),
    "sgl04_segments": _q(lambda t: segment_learning.enumerate_segments(t.clean)),
    "sgl05_patterns": _q(lambda t: segment_learning.patterns(t.clean)),
    "sgl06_comparisons": _q(lambda t: segment_learning.comparisons(t.clean).drop("p_value")),
    "sgl07_cards": _q(lambda t: segment_learning.pattern_cards(segment_learning.patterns(t.clean), segment_learning.comparisons(t.clean)), "dimension", "value", "change_category", "actor", "tilt", "confidence", "significant", "direction"),
    "sgl08_promotions": _q(lambda t: segment_learning.promotion_candidates(segment_learning.patterns(t.clean), segment_learning.comparisons(t.clean)), "dimension", "value", "change_category", "actor", "direction", "decisive_majority"),
    "tpl01_03_states": _q(lambda t: t.tagged, "episode_id", "pre_state", "own_cpa_ratio", "bench_cpa_ratio"),
    "tpl04_template_episodes": _q(lambda t: t.rows, "episode_id", "signed", "direction", "is_multi_action", "business_type", "vertical", "spend_tier", "campaign_type", "is_brand", "magnitude_bucket"),
    "tpl05_cascade": _q(lambda t: t.members, "episode_id", "template_id", "level"),
    "tpl06_summary": _q(lambda t: templates.summary(t.members), *_TEMPLATE),
    "tpl07_09_backtest": _q(lambda t: t.catalogue, "template_id", "direction_accuracy", "magnitude_mae", "n_test", "n_exact", "n_close", "n_ballpark", "n_miss", "status"),
    "tpl08_fold_predictions": _q(lambda t: templates.fold_predictions(t.members), "template_id", "episode_id", "predicted_direction", "predicted_magnitude", "direction_correct", "magnitude_score"),
    "tpl10_catalogue": _q(lambda t: templates.catalogue(t.catalogue.filter("level = 3").select("template_id", F.lit(4).alias("version")), t.catalogue, "2024-03-24"), "template_id", "version", "changelog"),
    "tpl11_shadow": _q(lambda t: templates.shadow(t.rows), "episode_id", "template_id", "prediction_direction", "direction_correct", "magnitude_score"),
    "tpl12_recommend": _q(lambda t: templates.recommend(t.tagged, t.accounts, t.catalogue), "account_id", "campaign_id", "change_category", "is_multi_action", "template_id", "prediction_direction", "prediction_magnitude"),
    "ref02_no_action_baseline": _q(lambda t: t.baseline, "account_id", "campaign_id", "window_start", "state", "cpa_change"),
    "ref03_mean_reversion": _q(lambda t: refinement.mean_reversion(t.rows, t.baseline)),
    "ref04_exceptions": _q(lambda t: refinement.exceptions(t.members, t.catalogue, cluster=2, accounts=2, alpha=0.5), "template_id", "dim", "value", "m_in", "h_in", "p_value"),
    "ref06_transfer": _q(lambda t: heldout.transfer(t.rows).groupBy("vertical").agg(F.sum("n").alias("n"), (F.sum("n_correct") / F.sum("n")).alias("accuracy"))),
    "ref07_convergence": _q(lambda t: refinement.convergence(t.members, t.catalogue)),
    "ref08_matched_controls": _q(lambda t: refinement.matched_controls(t.rows, t.baseline), "episode_id", "no_action_change", "attribution", "gap_days", "baseline_window_start"),
    "ref11_should_act": _q(lambda t: refinement.should_act(t.tagged, t.accounts, t.catalogue, t.baseline, refinement.matched_controls(t.rows, t.baseline)), "account_id", "campaign_id", "change_category", "is_multi_action", "action_cost", "decision"),
    "ref12_categories": _q(lambda t: refinement.categorised(refinement.with_natural(t.catalogue, t.baseline)), "template_id", "natural_magnitude", "action_attributable_magnitude", "call"),
    "pmt02_per_metric": _q(lambda t: refinement.per_metric(t.members)),
    "pmt03_predictability": _q(lambda t: refinement.predictability(t.members)),
    "pmt05_hypotheses": _q(lambda t: refinement.resolved_members(t.members, refinement.per_metric(t.members)).groupBy("metric").agg(F.count("*").alias("n"), F.avg("error").alias("mae"), F.avg(F.col("within_iqr").cast("double")).alias("within_iqr"))),
    "mag03_cascade": _q(lambda t: templates.cascade(t.rows, templates.with_bucket(templates.LEVELS)), "episode_id", "template_id", "level"),
    "mag05_predictability": _q(lambda t: refinement.predictability(templates.cascade(t.rows, templates.with_bucket(templates.LEVELS)))),
    "mag07_distribution": _q(lambda t: t.rows.groupBy("magnitude_bucket").agg(F.count("*").alias("n"), F.count_if(F.col("change_category") == "budget").alias("n_budget"))),
}


def _annotated(t) -> DataFrame:
    from admeridian.operators import changes

    return trends.annotated(changes.cpa_change(t.facts).unionByName(changes.cvr_change(t.facts)), trends.campaign_trends(t.facts))


# --- oracles ---

#: Two-sided 10 % points of Student's t for 5 to 28 degrees of freedom.
_T = [2.01505, 1.94318, 1.89458, 1.85955, 1.83311, 1.81246, 1.79588, 1.78229, 1.77093, 1.76131, 1.75305, 1.74588, 1.73961, 1.73406, 1.72913, 1.72472, 1.72074, 1.71714, 1.71387, 1.71088, 1.70814, 1.70562, 1.70329, 1.70113]
_TC = "tc AS (SELECT * FROM (VALUES " + ", ".join(f"({i + 5}, {v})" for i, v in enumerate(_T)) + ") AS v(dof, t))"


def _trend(name: str, points: str, keys: str) -> str:
    return f"""{name}_g AS (SELECT {keys}, metric, count(*) AS n, regr_slope(value, date - DATE '1970-01-01') AS slope, CASE WHEN stddev_pop(value) <= 1e-12 * abs(avg(value)) THEN 0 ELSE regr_r2(value, date - DATE '1970-01-01') END AS r2,
  CASE WHEN avg(value) <> 0 THEN stddev_pop(value) / abs(avg(value)) ELSE 0 END AS cv, max_by(value, date) AS cur FROM {points} WHERE value IS NOT NULL GROUP BY ALL HAVING count(*) >= 7),
{name} AS (SELECT g.*, CASE WHEN cv > 0.3 THEN 'volatile' WHEN r2 < 1 AND r2 * (n - 2) / (1 - r2) <= t * t THEN 'stable' WHEN metric = 'cost' THEN CASE WHEN slope > 0 THEN 'rising' ELSE 'falling' END
  WHEN slope * CASE metric WHEN 'cpa' THEN -1 ELSE 1 END > 0 THEN 'improving' ELSE 'declining' END AS classification FROM {name}_g g JOIN tc ON dof = n - 2)"""


_VALUES = """vals AS (SELECT account_id, campaign_id, date, unnest(['cost', 'ctr', 'cvr', 'cpa', 'roas', 'impression_share']) AS metric,
  unnest([cost_micros / 1e6, clicks / nullif(impressions, 0), conversions / nullif(clicks, 0), cost_micros / 1e6 / nullif(conversions, 0), conversion_value / nullif(cost_micros / 1e6, 0), search_impression_share]) AS value FROM daily_metrics)"""
_TRENDS = f"""a AS (SELECT max(date) AS d FROM daily_metrics), {_TC}, {_VALUES},
pts AS (SELECT v.account_id, v.campaign_id, v.date, v.metric, v.value, w.window_days FROM vals v, a, (SELECT unnest([7, 14, 30]) AS window_days) w
  WHERE v.date > d - w.window_days AND (v.account_id, v.campaign_id) IN (SELECT account_id, campaign_id FROM daily_metrics GROUP BY ALL HAVING count(DISTINCT date) >= 7)),
{_trend('tr', 'pts', 'account_id, campaign_id, window_days')}"""

_BUNDLES = """span AS (SELECT min(date) + 7 AS lo, max(date) - 7 AS hi FROM daily_metrics),
ev AS (SELECT account_id, coalesce(campaign_id, '') AS campaign_id, CAST(change_timestamp AS DATE) AS change_date, actor, change_id,
  CASE resource_type WHEN 'CAMPAIGN_BUDGET' THEN 'budget' WHEN 'BIDDING_STRATEGY' THEN 'bidding' WHEN 'CAMPAIGN' THEN 'campaign_setting' WHEN 'AD_GROUP_CRITERION' THEN 'targeting_keyword' ELSE 'ad_creative' END AS category
  FROM change_events, span WHERE CAST(change_timestamp AS DATE) BETWEEN lo AND hi),
bu0 AS (SELECT account_id, campaign_id, change_date, actor, list_sort(list(DISTINCT category)) AS cats, count(*) AS change_count, min(change_id) AS change_event_id FROM ev GROUP BY ALL),
bu1 AS (SELECT *, array_to_string(cats, '+') AS categories, CASE WHEN actor = 'auto_applied' THEN CASE array_to_string(cats, '+') WHEN 'budget+campaign_setting' THEN 'auto_budget_optimization' WHEN 'budget+targeting_keyword' THEN 'auto_budget_expand'
  WHEN 'campaign_setting+targeting_keyword' THEN 'auto_targeting_restructure' WHEN 'budget+campaign_setting+targeting_keyword' THEN 'auto_comprehensive_optimization' END END AS named FROM bu0),
bu AS (SELECT substr(sha256(concat_ws('|', account_id, campaign_id, CAST(change_date AS VARCHAR), actor)), 1, 12) AS episode_id, *,
  CASE WHEN len(cats) = 1 THEN cats[1] ELSE coalesce(named, CASE WHEN actor = 'auto_applied' THEN 'auto_unknown_bundle' ELSE 'human_unknown_bundle' END) END AS change_category, len(cats) = 1 OR named IS NOT NULL AS known FROM bu1)"""
_SUMS = ", ".join(
    f"coalesce(sum(d.impressions) FILTER ({c}), 0)::BIGINT AS {p}_impressions, coalesce(sum(d.clicks) FILTER ({c}), 0)::BIGINT AS {p}_clicks, coalesce(sum(d.cost_micros) FILTER ({c}), 0) / 1e6 AS {p}_c, coalesce(sum(d.conversions) FILTER ({c}), 0) AS {p}_conversions, coalesce(sum(d.conversion_value) FILTER ({c}), 0) AS {p}_v, count(DISTINCT d.date) FILTER ({c}) AS {p}_days"
    for p, c in (("pre", "d.date < b.change_date"), ("post", "d.date >= b.change_date"))
)
_DERIVED = ", ".join(
    f"round({p}_c * 100) / 100 AS {p}_cost, round({p}_v * 100) / 100 AS {p}_conversion_value, coalesce(round({p}_conversions / nullif({p}_clicks, 0) * 10000) / 10000, 0) AS {p}_cvr, coalesce(round({p}_c / nullif({p}_conversions, 0) * 100) / 100, 0) AS {p}_cpa, coalesce(round({p}_v / nullif({p}_c, 0) * 100) / 100, 0) AS {p}_roas"
    for p in ("pre", "post")
)
_METRICS = f"""near AS (SELECT b.episode_id, {_SUMS} FROM bu b JOIN daily_metrics d ON d.account_id = b.account_id AND (b.campaign_id = '' OR d.campaign_id = b.campaign_id) AND d.date BETWEEN b.change_date - 7 AND b.change_date + 6 GROUP BY b.episode_id),
em AS (SELECT *, {_DERIVED} FROM near WHERE pre_days >= 4 AND post_days >= 4)"""
_CONF = """conf AS (SELECT DISTINCT x.episode_id FROM bu x JOIN bu y USING (account_id, campaign_id) WHERE y.change_date BETWEEN x.change_date AND x.change_date + 6 AND x.episode_id <> y.episode_id AND len(list_filter(y.cats, lambda c: NOT list_contains(x.cats, c))) > 0)"""
_EPISODES = f"""{_BUNDLES}, {_METRICS}, {_CONF}, {_TC},
o1 AS (SELECT em.*, bu.* EXCLUDE (episode_id), CASE WHEN pre_conversions <> 0 AND post_conversions <> 0 THEN CASE WHEN pre_cpa <> 0 AND post_cpa <> 0 THEN 'cpa' WHEN pre_cvr <> 0 AND post_cvr <> 0 THEN 'cvr' END END AS outcome_metric FROM em JOIN bu USING (episode_id)),
o2 AS (SELECT *, CASE outcome_metric WHEN 'cpa' THEN pre_cpa WHEN 'cvr' THEN pre_cvr ELSE 0 END AS pv, CASE outcome_metric WHEN 'cpa' THEN post_cpa WHEN 'cvr' THEN post_cvr ELSE 0 END AS qv FROM o1),
o3 AS (SELECT *, coalesce((qv - pv) / nullif(pv, 0), 0) AS chg FROM o2),
pp AS (SELECT o.episode_id, o.outcome_metric AS metric, d.date, CASE max(o.outcome_metric) WHEN 'cpa' THEN sum(d.cost_micros) / 1e6 / nullif(sum(d.conversions), 0) ELSE sum(d.conversions) / nullif(sum(d.clicks), 0) END AS value
  FROM o3 o JOIN daily_metrics d ON d.account_id = o.account_id AND (o.campaign_id = '' OR d.campaign_id = o.campaign_id) AND d.date >= o.change_date - 14 AND d.date < o.change_date WHERE o.outcome_metric IS NOT NULL GROUP BY ALL),
{_trend('pt', 'pp', 'episode_id')},
o4 AS (SELECT o3.*, conf.episode_id IS NOT NULL OR (NOT known AND len(cats) > 1) AS confounded, CASE WHEN pt.classification IN ('improving', 'declining') THEN pt.slope ELSE 0 END AS sl FROM o3 LEFT JOIN conf USING (episode_id) LEFT JOIN pt USING (episode_id)),
o5 AS (SELECT *, NOT confounded AND outcome_metric IS NOT NULL AND pv >= CASE outcome_metric WHEN 'cpa' THEN 1.0 ELSE 0.005 END AND qv >= CASE outcome_metric WHEN 'cpa' THEN 1.0 ELSE 0.005 END AS adj FROM o4),
o6 AS (SELECT *, CASE WHEN adj THEN coalesce(sl, 0) ELSE 0 END AS slope, CASE WHEN adj THEN pv + coalesce(sl, 0) * 7 ELSE 0 END AS expv, CASE outcome_metric WHEN 'cpa' THEN -1 ELSE 1 END AS fav FROM o5),
o7 AS (SELECT *, (qv - expv) / nullif(pv, 0) AS net FROM o6),
ep AS (SELECT *, CASE WHEN chg * fav > 0.1 THEN 'improved' WHEN chg * fav < -0.1 THEN 'degraded' ELSE 'neutral' END AS raw_outcome,
  CASE WHEN confounded THEN 'confounded' WHEN adj THEN CASE WHEN abs(net) < 0.05 THEN 'neutral' WHEN net * fav > 0.1 THEN 'improved' WHEN net * fav < -0.1 THEN 'degraded' ELSE 'neutral' END
    WHEN chg * fav > 0.1 THEN 'improved' WHEN chg * fav < -0.1 THEN 'degraded' ELSE 'neutral' END AS outcome,
  CASE WHEN adj THEN abs(net) ELSE abs(chg) END AS magnitude, CASE WHEN adj AND abs(qv - pv) > 1e-9 THEN greatest(0, least(1, (expv - pv) / (qv - pv))) ELSE 0 END AS share FROM o7)"""
_CLEAN = """cl AS (SELECT episode_id, account_id, change_category, actor, outcome, coalesce(nullif(vertical, ''), 'unknown') AS vertical, coalesce(nullif(spend_tier, ''), 'unknown') AS spend_tier, coalesce(nullif(business_type, ''), 'unknown') AS business_type FROM ep LEFT JOIN accounts USING (account_id) WHERE outcome <> 'confounded'),
sl0 AS (SELECT account_id, change_category, actor, outcome, unnest(['vertical', 'spend_tier', 'business_type']) AS dimension, unnest([vertical, spend_tier, business_type]) AS value FROM cl),
sl1 AS (SELECT * FROM sl0 WHERE value <> 'unknown'),
ce AS (SELECT dimension, value, change_category, actor, count(*) AS n, count(DISTINCT account_id) AS n_accounts, count(*) FILTER (outcome = 'degraded') AS degraded, count(*) FILTER (outcome = 'improved') AS improved FROM sl1 GROUP BY ALL)"""


def _wilson(k: str) -> str:
    z = 1.959963985
    mid = f"({k} / n + {z * z} / (2 * n)) / (1 + {z * z} / n)"
    half = f"{z} / (1 + {z * z} / n) * sqrt({k} / n * (1 - {k} / n) / n + {z * z} / (4 * n * n))"
    return f"round(greatest(0, {mid} - {half}), 6) AS {k}_low, round(least(1, {mid} + {half}), 6) AS {k}_high"


_VERTICALS = ("apparel", "legal", "beauty", "home_goods")


def _bench(date: str) -> str:
    cases = " ".join(f"WHEN '{v}' THEN {BENCHMARK_CPA[v]} * CAST([{', '.join(map(str, SEASONAL[v]))}] AS DOUBLE[])[month({date})]" for v in _VERTICALS)
    return f"CASE vertical {cases} END"


def _states(name: str, keys: str) -> str:
    """``keys`` is a table of key, account_id, campaign_id, at, pre_cpa."""
    return f"""{name}_d AS (SELECT k.key, d.date, sum(d.cost_micros) AS micros, sum(d.cost_micros) / 1e6 AS cost, sum(d.conversions) AS conv FROM {keys} k JOIN daily_metrics d ON d.account_id = k.account_id AND (k.campaign_id = '' OR d.campaign_id = k.campaign_id) AND d.date >= k.at - 30 AND d.date < k.at GROUP BY ALL),
{name}_p AS (SELECT key, 'cpa' AS metric, date, cost / nullif(conv, 0) AS value FROM {name}_d WHERE cost > 0),
{_trend(name + '_t', name + '_p', 'key')},
{name}_c AS (SELECT key, coalesce(sum(micros) / 1e6 / nullif(sum(conv), 0), 0) AS avg_cpa, coalesce(CASE WHEN count(CASE WHEN conv > 0 AND cost > 0 THEN 1 END) >= 2 THEN stddev_pop(CASE WHEN conv > 0 AND cost > 0 THEN cost / conv END) / avg(CASE WHEN conv > 0 AND cost > 0 THEN cost / conv END) ELSE 0 END, 0) AS cv FROM {name}_d GROUP BY key),
{name}_r AS (SELECT k.*, coalesce(classification, 'stable') AS cls, coalesce({name}_c.cv, 0) AS vol, CASE WHEN avg_cpa > 0 THEN k.pre_cpa / avg_cpa ELSE 1 END AS own, {_bench('k.at')} AS bench FROM {keys} k LEFT JOIN {name}_c USING (key) LEFT JOIN {name}_t USING (key) LEFT JOIN accounts USING (account_id)),
{name}_s AS (SELECT *, CASE WHEN bench > 0 THEN pre_cpa / bench ELSE own END AS bra FROM {name}_r),
{name} AS (SELECT *, CASE WHEN own > 2 AND bra > 2 THEN 'crisis' WHEN cls = 'declining' AND own > 1 THEN 'struggling' WHEN cls = 'improving' AND own > 1 THEN 'recovering' WHEN cls = 'declining' THEN 'declining' WHEN own <= 1 AND bra <= 1 THEN 'performing_well' WHEN own <= 1 THEN 'above_average' WHEN vol > 0.3 THEN 'volatile' ELSE 'stable' END AS state FROM {name}_s)"""


_STATES = f"{_EPISODES}, sk AS (SELECT episode_id AS key, account_id, campaign_id, change_date AS at, pre_cpa FROM ep), {_states('st', 'sk')}"
_PCT = "CASE WHEN p < -0.3 THEN 'large_decrease' WHEN p < -0.1 THEN 'medium_decrease' WHEN p < -0.02 THEN 'small_decrease' WHEN p <= 0.02 THEN 'flat' WHEN p <= 0.1 THEN 'small_increase' WHEN p <= 0.3 THEN 'medium_increase' ELSE 'large_increase' END"
_ROWS = f"""{_STATES},
te AS (SELECT ep.*, st.state AS pre_state, coalesce(nullif(vertical, ''), 'unknown') AS vertical, coalesce(nullif(business_type, ''), 'unknown') AS business_type, coalesce(nullif(spend_tier, ''), 'unknown') AS spend_tier,
  greatest(-1, least(3, (post_cpa - pre_cpa) / pre_cpa)) AS signed, change_count > 1 AS is_multi_action FROM ep JOIN (SELECT key, state FROM st) st ON st.key = ep.episode_id LEFT JOIN accounts USING (account_id) WHERE pre_cpa <> 0 AND post_cpa <> 0),
tb AS (SELECT te.*, CASE WHEN signed <= -0.1 THEN 'improved' WHEN signed >= 0.1 THEN 'degraded' ELSE 'neutral' END AS direction, (split_part(new_value, ': ', 2)::DOUBLE - split_part(old_value, ': ', 2)::DOUBLE) / split_part(old_value, ': ', 2)::DOUBLE AS p,
  CASE WHEN is_multi_action THEN 'multi' ELSE 'single' END AS m FROM te LEFT JOIN (SELECT account_id, change_id AS change_event_id, old_value, new_value FROM change_events) USING (account_id, change_event_id)),
tr AS (SELECT *, {_PCT} AS magnitude_bucket FROM tb)"""


def _cascade(mag: bool = False, rows: str = "tr", name: str = "mem") -> str:
    pre = ["change_category", *(["'mag=' || magnitude_bucket"] if mag else []), "m"]
    levels = [[*pre, "business_type", "vertical", "spend_tier", "pre_state"], [*pre, "business_type", "vertical", "pre_state"], [*pre, "business_type", "pre_state"], [*pre, "pre_state"]]
    out, left = [], rows
    for i, keys in enumerate(levels):
        tid = f"concat_ws('__', {', '.join(keys)})"
        out.append(f"{name}_k{i} AS (SELECT *, {tid} AS tid FROM {left}), {name}_c{i} AS (SELECT tid FROM {name}_k{i} GROUP BY tid HAVING count(*) >= 10 AND count(DISTINCT account_id) >= 3), {name}_r{i} AS (SELECT * EXCLUDE (tid) FROM {name}_k{i} WHERE tid NOT IN (SELECT tid FROM {name}_c{i}))")
        left = f"{name}_r{i}"
    union = " UNION ALL ".join(f"SELECT *, {i} AS level FROM {name}_k{i} WHERE tid IN (SELECT tid FROM {name}_c{i})" for i in range(4))
    return ", ".join(out) + f", {name} AS ({union})"


def _levels() -> list[str]:
    return [f"concat_ws('__', change_category, m, {x}pre_state)" for x in ("business_type, vertical, spend_tier, ", "business_type, vertical, ", "business_type, ", "")]


def _held(by: str, train: str, test: str) -> str:
    """Trainings told apart by a column: the active templates of each under folds by hash, and what they say of the test episodes."""
    out, left = [], train
    for i, tid in enumerate(_levels()):
        out.append(f"h_k{i} AS (SELECT *, {tid} AS tid FROM {left}), h_c{i} AS (SELECT {by}, tid FROM h_k{i} GROUP BY ALL HAVING count(*) >= 10 AND count(DISTINCT account_id) >= 3), h_r{i} AS (SELECT * EXCLUDE (tid) FROM h_k{i} ANTI JOIN h_c{i} USING ({by}, tid))")
        left = f"h_r{i}"
    first = lambda d, u, z: f"WHEN {d} >= {u} AND {d} >= {z} THEN {{0}} WHEN {u} >= {z} THEN {{1}} ELSE {{2}} END"
    return ", ".join(out) + f""", h_m AS ({' UNION ALL '.join(f'SELECT {by}, tid, episode_id, direction FROM h_k{i} SEMI JOIN h_c{i} USING ({by}, tid)' for i in range(4))}),
h_d AS (SELECT {by}, tid, ('0x' || substr(md5(episode_id), 1, 8))::BIGINT % 5 AS f, count(*) FILTER (direction = 'degraded') AS d, count(*) FILTER (direction = 'improved') AS u, count(*) FILTER (direction = 'neutral') AS z FROM h_m GROUP BY ALL),
h_t AS (SELECT *, sum(d) OVER w AS ad, sum(u) OVER w AS au, sum(z) OVER w AS az FROM h_d WINDOW w AS (PARTITION BY {by}, tid)),
h_a AS (SELECT {by}, tid, any_value(CASE {first('ad', 'au', 'az').format("'degraded'", "'improved'", "'neutral'")}) AS said FROM h_t GROUP BY ALL HAVING sum(CASE {first('(ad - d)', '(au - u)', '(az - z)').format('d', 'u', 'z')}) / sum(d + u + z) >= 0.55),
h_e AS (SELECT {by}, episode_id, vertical, direction, unnest([0, 1, 2, 3]) AS lv, unnest([{', '.join(_levels())}]) AS tid FROM {test}),
h_p AS (SELECT *, row_number() OVER (PARTITION BY {by}, episode_id ORDER BY lv) AS rn FROM h_e JOIN h_a USING ({by}, tid)),
told AS (SELECT {by}, vertical, (direction = said)::INT AS ok FROM h_p WHERE rn = 1)"""


def _mode(keys: str, rows: str, name: str) -> str:
    return f"{name} AS (SELECT * FROM (SELECT {keys}, direction AS mode, row_number() OVER (PARTITION BY {keys} ORDER BY count(*) DESC, direction) AS rn FROM {rows} GROUP BY {keys}, direction) WHERE rn = 1)"


_FOLDS = f"""fo0 AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY episode_id) - 1 AS i, least(5, count(*) OVER (PARTITION BY tid)) AS k FROM mem), fo AS (SELECT *, i % k AS fold FROM fo0),
trn AS (SELECT f.tid, g.f, f.direction, f.signed FROM fo f, (SELECT unnest([0, 1, 2, 3, 4]) AS f) g WHERE g.f < f.k AND g.f <> f.fold), {_mode('tid, f', 'trn', 'tmo')},
tme AS (SELECT tid, f, median(signed) AS med FROM trn GROUP BY ALL),
pr AS (SELECT fo.tid, fo.episode_id, fo.direction, fo.signed, tmo.mode, tme.med, abs(tme.med - fo.signed) AS err FROM fo JOIN tmo ON fo.tid = tmo.tid AND fo.fold = tmo.f JOIN tme ON fo.tid = tme.tid AND fo.fold = tme.f)"""
_CAT = f"""{_ROWS}, {_cascade()}, {_mode('tid', 'mem', 'mo')},
su AS (SELECT tid, level, median(signed) AS med, quantile_cont(signed, 0.25) AS lo, quantile_cont(signed, 0.75) AS hi, count(*) AS n, count(DISTINCT account_id) AS na FROM mem GROUP BY ALL), {_FOLDS},
sc AS (SELECT tid, avg(CASE WHEN direction = mode THEN 1.0 ELSE 0.0 END) AS acc, avg(err) AS mae, count(*) AS nt, count(*) FILTER (err <= 0.05) AS b1, count(*) FILTER (err > 0.05 AND err <= 0.1) AS b2, count(*) FILTER (err > 0.1 AND err <= 0.2) AS b3, count(*) FILTER (err > 0.2) AS b4 FROM pr GROUP BY ALL),
cat AS (SELECT su.*, mo.mode, sc.* EXCLUDE (tid), CASE WHEN acc < 0.45 THEN 'RETIRED' WHEN acc < 0.55 THEN 'SHADOW_ONLY' WHEN n < 15 THEN 'PROVISIONAL' ELSE 'ACTIVE' END AS status FROM su JOIN mo USING (tid) JOIN sc USING (tid))"""
_BASE = f"""sp AS (SELECT account_id, campaign_id, min(date) AS f, max(date) AS l FROM daily_metrics GROUP BY ALL HAVING count(DISTINCT date) >= 14),
an AS (SELECT account_id, campaign_id, CAST(unnest(generate_series(f + 7, l - 7, INTERVAL 7 DAY)) AS DATE) AS at FROM sp WHERE f + 7 <= l - 7),
qu AS (SELECT * FROM an WHERE NOT EXISTS (SELECT 1 FROM change_events c WHERE c.account_id = an.account_id AND c.campaign_id = an.campaign_id AND CAST(c.change_timestamp AS DATE) >= an.at - 7 AND CAST(c.change_timestamp AS DATE) < an.at + 7)),
bm AS (SELECT q.account_id, q.campaign_id, q.at, sum(d.cost_micros) FILTER (d.date < q.at) / 1e6 / nullif(sum(d.conversions) FILTER (d.date < q.at), 0) AS pre_cpa, sum(d.cost_micros) FILTER (d.date >= q.at) / 1e6 / nullif(sum(d.conversions) FILTER (d.date >= q.at), 0) AS post_cpa
  FROM qu q JOIN daily_metrics d ON d.account_id = q.account_id AND d.campaign_id = q.campaign_id AND d.date BETWEEN q.at - 7 AND q.at + 6 GROUP BY ALL),
bk AS (SELECT concat_ws('|', account_id, campaign_id, CAST(bm.at AS VARCHAR)) AS key, bm.* FROM bm WHERE pre_cpa > 0 AND post_cpa IS NOT NULL), {_states('bs', 'bk')},
ba AS (SELECT *, greatest(-1, least(3, (post_cpa - pre_cpa) / pre_cpa)) AS chg0 FROM bs)"""
_DELTAS = ", ".join(f"CASE WHEN coalesce(pre_{m}, 0) <> 0 THEN greatest(-1, least(3, (post_{m} - pre_{m}) / pre_{m})) END" for m in refinement.METRICS if m != "ctr")
_CTR = "CASE WHEN coalesce(pre_clicks / nullif(pre_impressions, 0), 0) <> 0 THEN greatest(-1, least(3, (post_clicks / nullif(post_impressions, 0) - pre_clicks / nullif(pre_impressions, 0)) / (pre_clicks / nullif(pre_impressions, 0)))) END"


def _per_metric(mag: bool) -> str:
    names = ", ".join(f"'{m}'" for m in refinement.METRICS if m != "ctr")
    return f"""{_ROWS}, {_cascade(mag)}, dl0 AS (SELECT tid, episode_id, unnest([{names}, 'ctr']) AS metric, unnest([{_DELTAS}, {_CTR}]) AS delta FROM mem), dl1 AS (SELECT *, count(*) OVER (PARTITION BY tid, metric) AS n FROM dl0 WHERE delta IS NOT NULL),
dl AS (SELECT *, (row_number() OVER (PARTITION BY tid, metric ORDER BY episode_id) - 1) % 5 AS fold FROM dl1 WHERE n >= 10),
dm AS (SELECT x.tid, x.metric, g.f, median(x.delta) AS med FROM dl x, (SELECT unnest([0, 1, 2, 3, 4]) AS f) g WHERE g.f <> x.fold GROUP BY ALL), de AS (SELECT dl.*, abs(dl.delta - dm.med) AS err FROM dl JOIN dm ON dl.tid = dm.tid AND dl.metric = dm.metric AND dl.fold = dm.f)"""


def _w(tables: str, body: str) -> str:
    return f"WITH {ctes(*tables.split())}, {body}"


_ALL = "accounts daily_metrics change_events"
ORACLES = {
    "trd02_daily_values": _w("daily_metrics", f"{_VALUES} SELECT account_id, campaign_id, CAST(date AS VARCHAR) AS date, metric, round(value, 6) AS value FROM vals WHERE value IS NOT NULL"),
    "trd03_campaign_trends": _w("daily_metrics", f"{_TRENDS} SELECT account_id, campaign_id, metric, window_days, n, round(round((slope) * 1e9) / 1e9 * 1e4) / 1e4 + 0.0 AS slope, round(round((r2) * 1e9) / 1e9 * 1e4) / 1e4 + 0.0 AS r_squared, classification, round(round((cv) * 1e9) / 1e9 * 1e4) / 1e4 + 0.0 AS cv, round(round((cur) * 1e9) / 1e9 * 1e4) / 1e4 + 0.0 AS current_value, round(round((cur + slope * 7) * 1e9) / 1e9 * 1e4) / 1e4 + 0.0 AS projected_7d FROM tr"),
    "trd04_volatility": _w("daily_metrics", f"{_TRENDS} SELECT account_id, campaign_id, metric, CASE WHEN cv > 0.4 THEN 'high' WHEN cv > 0.15 THEN 'medium' ELSE 'low' END AS volatility_class, CASE WHEN cv > 0.4 THEN 1.5 WHEN cv > 0.15 THEN 1.0 ELSE 0.7 END::DOUBLE AS threshold_multiplier FROM tr WHERE window_days = 30"),
    "trd06_class_summary": _w("daily_metrics", f"{_TRENDS} SELECT metric, classification, count(*) AS n FROM tr GROUP BY ALL"),
    "epi02_03_bundles": _w(_ALL, f"{_BUNDLES} SELECT episode_id, account_id, campaign_id, CAST(change_date AS VARCHAR) AS change_date, actor, categories, change_count, change_event_id, change_category, known FROM bu"),
    "epi04_window_metrics": _w(_ALL, f"{_BUNDLES}, {_METRICS} SELECT episode_id, {', '.join(f'{p}_{m}' for p in ('pre', 'post') for m in episodes.METRICS)} FROM em"),
    "epi05_confounded": _w(_ALL, f"{_BUNDLES}, {_CONF} SELECT * FROM conf"),
    "epi06_07_outcomes": _w(_ALL, f"{_EPISODES} SELECT episode_id, confounded, outcome_metric, raw_outcome, round(abs(chg), 6) AS raw_magnitude, adj AS trend_adjusted, round(slope, 6) AS trend_slope, round(expv, 6) AS expected_value, outcome, round(magnitude, 6) AS adjusted_magnitude, round(share, 6) AS trend_contribution_pct FROM ep"),
    "epi08_texts": _w(_ALL, f"""{_EPISODES} SELECT episode_id, CASE WHEN pre_conversions = 0 OR post_conversions = 0 THEN 'too few conversions on one side to read an outcome'
  WHEN outcome_metric = 'cpa' THEN 'cost per conversion from $' || CAST(floor(pv + 0.5) AS BIGINT) || ' to $' || CAST(floor(qv + 0.5) AS BIGINT) || ' (' || CAST(floor(100 * chg + 0.5) AS BIGINT) || '%)'
  WHEN outcome_metric = 'cvr' THEN 'conversions per thousand clicks from ' || CAST(floor(1000 * pv + 0.5) AS BIGINT) || ' to ' || CAST(floor(1000 * qv + 0.5) AS BIGINT) || ' (' || CAST(floor(100 * chg + 0.5) AS BIGINT) || '%)'
  ELSE 'neither cost per conversion nor conversion rate moved in a way that can be read' END AS outcome_detail,
concat_ws('; ', CASE WHEN episode_id IN (SELECT episode_id FROM conf) THEN 'another bundle on the same campaign within the week' END, CASE WHEN NOT known AND len(cats) > 1 THEN 'which of its several levers did it' END, CASE WHEN NOT adj THEN 'a movement that had begun before' END, 'season and competition') AS cannot_rule_out,
CASE WHEN episode_id IN (SELECT episode_id FROM conf) THEN 'Tell the overlapping bundles apart. ' ELSE '' END || 'Look at the days before ' || CAST(change_date AS VARCHAR) || '.' AS check_next FROM ep"""),
    "epi08_domains": _w(_ALL, f"{_EPISODES} SELECT CASE WHEN list_contains(cats, 'budget') OR change_category LIKE '%budget%' OR change_category LIKE '%bidding%' THEN 'bidding_strategy' WHEN list_contains(cats, 'targeting_keyword') OR change_category LIKE '%targeting%' THEN 'non_branded_search' WHEN list_contains(cats, 'ad_creative') OR change_category LIKE '%creative%' THEN 'creative' ELSE 'campaign_structure' END AS domain, CASE WHEN NOT confounded AND pre_conversions <> 0 AND post_conversions <> 0 AND outcome_metric IS NULL THEN 'CONFIRMED' ELSE 'SUGGESTIVE' END AS confidence_tier, count(*) AS n FROM ep GROUP BY ALL"),
    "epi09_cards": _w(_ALL, f"{_EPISODES}, ca AS (SELECT change_category, count(*) AS n, count(DISTINCT account_id) AS accounts, count(*) FILTER (outcome = 'improved') AS improved, count(*) FILTER (outcome = 'degraded') AS degraded, count(*) FILTER (outcome = 'neutral') AS neutral, round(coalesce(avg(magnitude) FILTER (outcome = 'improved'), 0), 6) AS avg_improve, round(coalesce(avg(magnitude) FILTER (outcome = 'degraded'), 0), 6) AS avg_degrade, CASE WHEN count(*) FILTER (actor = 'human') > count(*) FILTER (actor = 'auto_applied') THEN 'human' ELSE 'auto_applied' END AS actor FROM ep WHERE outcome <> 'confounded' GROUP BY change_category HAVING count(*) >= 10) SELECT *, CASE WHEN n >= 30 AND accounts >= 8 THEN 'RELIABLE' WHEN accounts >= 4 THEN 'DIRECTIONAL' ELSE 'LOW' END AS confidence FROM ca"),
    "sgl04_segments": _w(_ALL, f"{_EPISODES}, {_CLEAN} SELECT dimension, value, count(DISTINCT account_id) AS n_accounts, count(*) AS n_episodes FROM sl1 GROUP BY ALL HAVING count(DISTINCT account_id) >= 3"),
    "sgl05_patterns": _w(_ALL, f"{_EPISODES}, {_CLEAN} SELECT *, n - degraded - improved AS neutral, CASE WHEN n >= 30 AND n_accounts >= 8 THEN 'RELIABLE' WHEN n_accounts >= 4 THEN 'DIRECTIONAL' ELSE 'LOW' END AS confidence, round(degraded / n, 6) AS degraded_rate, {_wilson('degraded')}, round(improved / n, 6) AS improved_rate, {_wilson('improved')} FROM ce WHERE n >= 10"),
    "sgl06_comparisons": _w(_ALL, f"{_EPISODES}, {_CLEAN}, al AS (SELECT change_category, actor, count(*) AS na, count(*) FILTER (outcome = 'degraded') AS ka FROM cl GROUP BY ALL), co AS (SELECT ce.*, na - n AS nr, ka - degraded AS kr, ka / na AS pool FROM ce JOIN al USING (change_category, actor) WHERE n >= 10 AND na - n >= 10), cz AS (SELECT *, coalesce((degraded / n - kr / nr) / nullif(sqrt(pool * (1 - pool) * (1 / n + 1 / nr)), 0), 0) AS z FROM co) SELECT dimension, value, change_category, actor, n AS n_segment, nr AS n_rest, round(degraded / n, 6) AS segment_rate, round(kr / nr, 6) AS rest_rate, round(degraded / n - kr / nr, 6) AS rate_delta, round(z, 6) AS z, abs(z) > 1.959963985 AS significant, CASE WHEN degraded / n > kr / nr THEN 'higher' ELSE 'lower' END AS direction FROM cz"),
    "tpl01_03_states": _w(_ALL, f"{_STATES} SELECT key AS episode_id, state AS pre_state, round(own, 6) AS own_cpa_ratio, round(bra, 6) AS bench_cpa_ratio FROM st"),
    "tpl04_template_episodes": _w(_ALL, f"{_ROWS} SELECT episode_id, round(signed, 6) AS signed, direction, is_multi_action, business_type, vertical, spend_tier, coalesce(ct.campaign_type, 'unknown') AS campaign_type, coalesce(lower(ct.campaign_name) LIKE '%brand%', FALSE) AS is_brand, magnitude_bucket FROM tr LEFT JOIN (SELECT DISTINCT account_id, campaign_id, campaign_type, campaign_name FROM daily_metrics) ct USING (account_id, campaign_id)"),
    "tpl05_cascade": _w(_ALL, f"{_ROWS}, {_cascade()} SELECT episode_id, tid AS template_id, level FROM mem"),
    "tpl06_summary": _w(_ALL, f"{_CAT} SELECT tid AS template_id, level, mode AS prediction_direction, round(med, 6) AS prediction_magnitude, round(lo, 6) AS iqr_low, round(hi, 6) AS iqr_high, n AS n_episodes, na AS n_accounts FROM cat"),
    "tpl07_09_backtest": _w(_ALL, f"{_CAT} SELECT tid AS template_id, round(acc, 6) AS direction_accuracy, round(mae, 6) AS magnitude_mae, nt AS n_test, b1 AS n_exact, b2 AS n_close, b3 AS n_ballpark, b4 AS n_miss, status FROM cat"),
    "tpl08_fold_predictions": _w(_ALL, f"{_CAT} SELECT tid AS template_id, episode_id, mode AS predicted_direction, round(med, 6) AS predicted_magnitude, mode = direction AS direction_correct, CASE WHEN err <= 0.05 THEN 'exact' WHEN err <= 0.1 THEN 'close' WHEN err <= 0.2 THEN 'ballpark' ELSE 'miss' END AS magnitude_score FROM pr"),
    "ref02_no_action_baseline": _w(_ALL, f"{_TC}, {_BASE} SELECT account_id, campaign_id, CAST(ba.at - 7 AS VARCHAR) AS window_start, state, round(chg0, 6) AS cpa_change FROM ba"),
    "ref03_mean_reversion": _w(_ALL, f"{_ROWS}, {_BASE}, x AS (SELECT pre_state AS state, median(signed) AS am, count(*) AS an FROM tr GROUP BY ALL), y AS (SELECT state, median(chg0) AS nm, count(*) AS nn FROM ba GROUP BY ALL) SELECT state, round(am, 6) AS action_median, coalesce(an, 0) AS action_n, round(nm, 6) AS natural_median, coalesce(nn, 0) AS natural_n, round(am - nm, 6) AS action_attributable FROM x FULL JOIN y USING (state)"),
    "ref08_matched_controls": _w(_ALL, f"{_ROWS}, {_BASE}, mc AS (SELECT t.episode_id, t.signed, b.chg0, b.at, least(abs(b.at - 7 - t.change_date), abs(b.at + 7 - t.change_date)) AS gap FROM tr t JOIN ba b ON t.campaign_id = b.campaign_id AND t.pre_state = b.state WHERE t.campaign_id <> '' AND (b.at + 7 <= t.change_date - 7 OR b.at - 7 >= t.change_date + 7)), mr AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY gap, mc.at) AS rn FROM mc WHERE gap <= 60) SELECT episode_id, round(chg0, 6) AS no_action_change, round(signed - chg0, 6) AS attribution, gap AS gap_days, CAST(mr.at - 7 AS VARCHAR) AS baseline_window_start FROM mr WHERE rn = 1"),
    "ref12_categories": _w(_ALL, f"{_CAT}, {_BASE}, y AS (SELECT state, median(chg0) AS nm FROM ba GROUP BY ALL), z AS (SELECT tid, nm, med - nm AS at0 FROM cat JOIN y ON state = string_split(tid, '__')[-1] WHERE status IN ('ACTIVE', 'PROVISIONAL')) SELECT tid AS template_id, round(nm, 6) AS natural_magnitude, round(at0, 6) AS action_attributable_magnitude, CASE WHEN at0 <= -0.1 THEN 'act_now' WHEN at0 >= 0.1 THEN 'dont_do_this' ELSE 'do_nothing' END AS call FROM z"),
    "pmt02_per_metric": _w(_ALL, f"{_per_metric(False)} SELECT tid AS template_id, metric, round(median(delta), 6) AS median_delta, round(quantile_cont(delta, 0.25), 6) AS iqr_low, round(quantile_cont(delta, 0.75), 6) AS iqr_high, round(avg(err), 6) AS mae, count(*) AS n FROM de GROUP BY ALL"),
    "pmt03_predictability": _w(_ALL, f"{_per_metric(False)} SELECT metric, round(avg(err), 6) AS mae, round(avg(CASE WHEN err <= 0.1 THEN 1.0 ELSE 0.0 END), 6) AS exact_close_share, count(*) AS n, CASE WHEN avg(err) < 0.1 THEN 'STRONG' WHEN avg(err) < 0.15 THEN 'MODERATE' ELSE 'WEAK' END AS tier FROM de GROUP BY metric"),
    "ref06_transfer": _w(_ALL, f"{_ROWS}, ho AS (SELECT account_id AS holdout FROM tr GROUP BY ALL HAVING count(*) >= 20), htr AS (SELECT ho.holdout, tr.* FROM tr, ho WHERE account_id <> holdout), hte AS (SELECT ho.holdout, tr.* FROM tr JOIN ho ON account_id = holdout), {_held('holdout', 'htr', 'hte')} SELECT vertical, count(*) AS n, round(avg(ok), 6) AS accuracy FROM told GROUP BY ALL"),
    "mag03_cascade": _w(_ALL, f"{_ROWS}, {_cascade(True)} SELECT episode_id, tid AS template_id, level FROM mem"),
    "mag05_predictability": _w(_ALL, f"{_per_metric(True)} SELECT metric, round(avg(err), 6) AS mae, round(avg(CASE WHEN err <= 0.1 THEN 1.0 ELSE 0.0 END), 6) AS exact_close_share, count(*) AS n, CASE WHEN avg(err) < 0.1 THEN 'STRONG' WHEN avg(err) < 0.15 THEN 'MODERATE' ELSE 'WEAK' END AS tier FROM de GROUP BY metric"),
    "mag07_distribution": _w(_ALL, f"{_ROWS} SELECT magnitude_bucket, count(*) AS n, count(*) FILTER (change_category = 'budget') AS n_budget FROM tr GROUP BY ALL"),
}
