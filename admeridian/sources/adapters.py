"""Ad tables derived from the star-schema tables, one SQL text per table for both dialects.

``[[days:x]]`` stands for the whole days from 1995-01-01 to x; everything else is common SQL. Money and
shares are multiples of powers of two, so that sums do not depend on their order.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from admeridian.sources.tables import by_keys

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages")

_SLOT = "CAST(l_partkey % 12 AS STRING)"
_ACCOUNT = "'a' || CAST(l_suppkey AS STRING)"
_CAMPAIGN = _ACCOUNT + " || '-c' || " + _SLOT
_NAME = "CASE l_partkey % 4 WHEN 0 THEN 'Acme Brand Search ' WHEN 1 THEN 'Generic Search US ' WHEN 2 THEN 'PMax All ' ELSE 'Shopping Feed ' END || " + _SLOT
_DAY = "DATE '2024-01-01' + CAST([[days:l_shipdate]] % 84 AS INT)"

TABLES: dict[str, str] = {
    "accounts": """
        SELECT 'a' || CAST(s_suppkey AS STRING) AS account_id, s_name AS account_name, 'm1' AS mcc_id,
          CASE s_suppkey % 7 WHEN 0 THEN 'ecommerce' WHEN 1 THEN 'lead_gen' WHEN 2 THEN 'saas' WHEN 3 THEN 'local' WHEN 4 THEN 'b2b' WHEN 5 THEN 'app' ELSE 'nonprofit' END AS business_type,
          CASE s_suppkey % 5 WHEN 0 THEN 'apparel' WHEN 1 THEN 'legal' WHEN 2 THEN 'beauty' WHEN 3 THEN 'home_goods' ELSE '' END AS vertical,
          'https://www.shop' || CAST(s_suppkey AS STRING) || '.example.com/home' AS website_url,
          CASE s_suppkey % 4 WHEN 0 THEN '<5k' WHEN 1 THEN '5k-25k' WHEN 2 THEN '25k-100k' ELSE '100k+' END AS spend_tier,
          'USD' AS currency_code, DATE '2023-12-01' AS first_seen
        FROM {supplier}""",
    "daily_metrics": f"""
        SELECT 'a' || CAST(l_suppkey AS STRING) AS account_id, {_CAMPAIGN} AS campaign_id, {_NAME} AS campaign_name,
          CASE l_partkey % 4 WHEN 2 THEN 'PERFORMANCE_MAX' WHEN 3 THEN 'SHOPPING' ELSE 'SEARCH' END AS campaign_type,
          {_DAY} AS date,
          CAST(sum(CAST(l_quantity AS BIGINT)) * 40 AS BIGINT) AS impressions,
          CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS clicks,
          CAST(sum(CAST(round(l_extendedprice) AS BIGINT)) * 10000 AS BIGINT) AS cost_micros,
          CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS DOUBLE) / 4 AS conversions,
          CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(round(l_extendedprice * (1 - l_discount)) AS BIGINT) ELSE 0 END) AS DOUBLE) / 8 AS conversion_value,
          nullif(1 - round(CAST(sum(CAST(round(l_discount * 100) + round(l_tax * 100) AS BIGINT)) AS DOUBLE) * 64 / (30 * count(*))) / 64, 0) AS search_impression_share,
          nullif(round(CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) * 320 / (100 * count(*))) / 64, 0) AS search_budget_lost_is,
          nullif(round(CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) * 192 / (100 * count(*))) / 64, 0) AS search_rank_lost_is,
          CASE (l_suppkey + l_partkey % 12) % 5 WHEN 0 THEN 'TARGET_CPA' WHEN 1 THEN 'TARGET_ROAS' WHEN 2 THEN 'MANUAL_CPC' WHEN 3 THEN 'MAXIMIZE_CLICKS' ELSE 'MAXIMIZE_CONVERSIONS' END AS bidding_strategy,
          CAST(50000000 + 10000000 * (l_suppkey % 7) AS BIGINT) AS daily_budget_micros,
          CASE WHEN sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) > sum(CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END) THEN 'PAUSED' ELSE 'ENABLED' END AS status
        FROM {{lineitem}} GROUP BY l_suppkey, l_partkey % 12, l_partkey % 4, [[days:l_shipdate]] % 84""",
    "change_events": """
        SELECT 'a' || CAST(o_custkey % n.n + 1 AS STRING) AS account_id, 'e' || CAST(o_orderkey AS STRING) AS change_id,
          CAST(DATE '2024-01-01' + CAST([[days:o_orderdate]] % 84 AS INT) AS TIMESTAMP) AS change_timestamp, 'UPDATE' AS change_type,
          CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'CAMPAIGN_BUDGET' WHEN '2' THEN 'BIDDING_STRATEGY' WHEN '3' THEN 'CAMPAIGN' WHEN '4' THEN 'AD_GROUP_CRITERION' ELSE 'AD_GROUP_AD' END AS resource_type,
          'customers/' || CAST(o_custkey AS STRING) || '/changes/' || CAST(o_orderkey AS STRING) AS resource_name,
          CASE WHEN o_orderkey % 20 = 0 THEN '' ELSE 'a' || CAST(o_custkey % n.n + 1 AS STRING) || '-c' || CAST(CAST(floor(o_custkey / n.n) AS INT) % 12 AS STRING) END AS campaign_id,
          CASE WHEN o_orderstatus = 'F' THEN 'human' ELSE 'auto_applied' END AS actor,
          'amount_micros: ' || CAST(CAST(round(o_totalprice) AS BIGINT) * 1000 AS STRING) AS old_value,
          'amount_micros: ' || CAST(CAST(round(o_totalprice) AS BIGINT) * (850 + o_orderkey % 300) AS STRING) AS new_value
        FROM {orders} CROSS JOIN (SELECT count(*) AS n FROM {supplier}) n""",
    "keyword_metrics": f"""
        SELECT 'a' || CAST(l_suppkey AS STRING) AS account_id, {_CAMPAIGN} AS campaign_id, {_NAME} AS campaign_name,
          'k' || CAST(p_partkey AS STRING) AS keyword_id, p_name AS keyword_text,
          CASE p_partkey % 3 WHEN 0 THEN 'EXACT' WHEN 1 THEN 'PHRASE' ELSE 'BROAD' END AS match_type,
          CAST(nullif(p_size % 11, 0) AS INT) AS quality_score,
          CAST(sum(CAST(l_quantity AS BIGINT)) * 40 AS BIGINT) AS impressions, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS clicks,
          CAST(sum(CAST(round(l_extendedprice) AS BIGINT)) * 10000 AS BIGINT) AS cost_micros,
          CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS DOUBLE) / 4 AS conversions
        FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey
        GROUP BY l_suppkey, l_partkey % 12, l_partkey % 4, p_partkey, p_name, p_size""",
    "keyword_counts": """
        SELECT account_id, campaign_id, min(campaign_name) AS campaign_name, CAST(count(*) AS INT) AS keyword_count,
          CAST(sum(CASE WHEN match_type = 'BROAD' THEN 1 ELSE 0 END) AS INT) AS broad_count, CAST(sum(CASE WHEN match_type = 'PHRASE' THEN 1 ELSE 0 END) AS INT) AS phrase_count,
          CAST(sum(CASE WHEN match_type = 'EXACT' THEN 1 ELSE 0 END) AS INT) AS exact_count, CAST(sum(CASE WHEN quality_score = 1 THEN 1 ELSE 0 END) AS INT) AS negative_count
        FROM {keyword_metrics} GROUP BY account_id, campaign_id""",
    "search_terms": """
        SELECT account_id, campaign_id, campaign_name, keyword_text || ' near me' AS search_term, DATE '2024-02-24' AS window_start, DATE '2024-03-24' AS window_end,
          impressions, clicks, cost_micros, conversions, conversions * 30 AS conversions_value FROM {keyword_metrics}""",
    "conversion_actions": """
        SELECT 'a' || CAST(p_partkey % n.n + 1 AS STRING) AS account_id, 'v' || CAST(p_partkey AS STRING) AS action_id,
          CASE WHEN p_size % 9 = 0 THEN 'Page view ' || p_name ELSE p_name END AS action_name,
          CASE WHEN p_size % 5 = 0 THEN 'REMOVED' ELSE 'ENABLED' END AS status, 'WEBPAGE' AS action_type,
          CASE p_size % 6 WHEN 0 THEN 'PURCHASE' WHEN 1 THEN 'PAGE_VIEW' WHEN 2 THEN 'LEAD' WHEN 3 THEN 'SIGNUP' WHEN 4 THEN 'DEFAULT' ELSE 'IMPORTED_LEAD' END AS category,
          p_partkey % 3 = 0 AS primary_for_goal, CASE WHEN p_partkey % 10 = 3 THEN 'MANY_PER_CLICK' ELSE 'ONE_PER_CLICK' END AS counting_type
        FROM {part} CROSS JOIN (SELECT count(*) AS n FROM {supplier}) n""",
    "asset_coverage": """
        SELECT account_id, campaign_id, asset_type, CAST(count(*) AS INT) AS asset_count FROM (
          SELECT account_id, campaign_id, CASE clicks % 8 WHEN 0 THEN 'SITELINK' WHEN 1 THEN 'CALLOUT' WHEN 2 THEN 'STRUCTURED_SNIPPET' WHEN 3 THEN 'CALL' WHEN 4 THEN 'LOGO' ELSE 'TEXT' END AS asset_type
          FROM {daily_metrics} WHERE campaign_type = 'SEARCH') x GROUP BY account_id, campaign_id, asset_type""",
    "campaign_segments": f"""
        SELECT account_id, campaign_id, dimension, segment_value, CAST(sum(q) * 40 AS BIGINT) AS impressions, CAST(sum(q) AS BIGINT) AS clicks, CAST(sum(c) AS BIGINT) AS cost_micros, CAST(sum(v) AS DOUBLE) / 4 AS conversions
        FROM (
          SELECT {_ACCOUNT} AS account_id, {_CAMPAIGN} AS campaign_id, d.dimension,
            CASE d.dimension WHEN 'device' THEN CASE WHEN l_linenumber % 4 < 3 THEN 'MOBILE' ELSE 'DESKTOP' END
              WHEN 'network' THEN CASE WHEN l_orderkey % 5 = 0 THEN 'SEARCH_PARTNERS' ELSE 'SEARCH' END
              WHEN 'hour' THEN CAST(l_orderkey % 24 AS STRING) WHEN 'dow' THEN CAST([[days:l_shipdate]] % 7 AS STRING)
              ELSE 'g' || CAST(l_orderkey % 6 AS STRING) END AS segment_value,
            CAST(l_quantity AS BIGINT) AS q, CAST(round(l_extendedprice) AS BIGINT) * 10000 AS c, CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END AS v
          FROM {{lineitem}} CROSS JOIN (SELECT 'device' AS dimension UNION ALL SELECT 'network' UNION ALL SELECT 'hour' UNION ALL SELECT 'dow' UNION ALL SELECT 'geo') d) x
        GROUP BY account_id, campaign_id, dimension, segment_value""",
    "ad_strength": """
        SELECT account_id, campaign_id, keyword_id AS ad_id, CASE quality_score % 4 WHEN 0 THEN 'POOR' WHEN 1 THEN 'AVERAGE' WHEN 2 THEN 'GOOD' ELSE 'EXCELLENT' END AS ad_strength
        FROM {keyword_metrics} WHERE quality_score IS NOT NULL""",
    "ga4_landing_pages": """
        SELECT 'p' || CAST(user_id % 10 AS STRING) AS ga4_property, 'a' || CAST(user_id % 10 + 1 AS STRING) AS account_id, CAST(ts AS DATE) AS date,
          '/page' || CAST(event_id % 5 AS STRING) AS landing_page, CASE event_id % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop' ELSE 'tablet' END AS device,
          CAST(count(*) AS INT) AS sessions, CAST(sum(CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN 1 ELSE 0 END) AS INT) AS engaged_sessions,
          CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / (100 * count(*)) AS avg_session_duration
        FROM {events} GROUP BY user_id % 10, CAST(ts AS DATE), event_id % 5, event_id % 3""",
    "ga4_source_engagement": """
        SELECT 'p' || CAST(user_id % 10 AS STRING) AS ga4_property, 'a' || CAST(user_id % 10 + 1 AS STRING) AS account_id,
          CASE event_id % 3 WHEN 0 THEN 'Paid Search' WHEN 1 THEN 'Organic Search' ELSE 'Direct' END AS channel, CAST(count(*) AS INT) AS sessions,
          CAST(sum(CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS engagement_rate
        FROM {events} GROUP BY user_id % 10, event_id % 3""",
    "ga4_funnel_events": """
        SELECT 'p' || CAST(user_id % 10 AS STRING) AS ga4_property, 'a' || CAST(user_id % 10 + 1 AS STRING) AS account_id, CAST(ts AS DATE) AS date,
          CASE event_type WHEN 'view' THEN 'view_item' WHEN 'click' THEN 'add_to_cart' WHEN 'signup' THEN 'begin_checkout' ELSE 'purchase' END AS event_name, CAST(count(*) AS INT) AS event_count
        FROM {events} WHERE event_type <> 'error' GROUP BY user_id % 10, CAST(ts AS DATE), event_type""",
    # the same facts with changes of strategy, budget, names and age, for the audits
    "shifted_metrics": """
        SELECT account_id, campaign_id, CASE WHEN account_id LIKE '%4' THEN 'Local ' || campaign_id WHEN account_id LIKE '%6' THEN 'Alpha ' || campaign_id ELSE campaign_name END AS campaign_name, campaign_type, date, impressions, clicks,
          CASE WHEN account_id LIKE '%8' AND date >= DATE '2024-03-11' THEN cost_micros * 5 ELSE cost_micros END AS cost_micros,
          CASE WHEN account_id LIKE '%2' THEN conversions * 3 WHEN campaign_id LIKE '%c9' AND date <> DATE '2024-03-20' THEN conversions * 0 ELSE conversions END AS conversions,
          CASE WHEN account_id LIKE '%5' THEN conversion_value * 0 WHEN account_id LIKE '%1' THEN conversion_value * 16 ELSE conversion_value END AS conversion_value, search_impression_share, search_budget_lost_is,
          CASE WHEN account_id LIKE '%7' AND date >= DATE '2024-03-11' THEN search_rank_lost_is * 2 ELSE search_rank_lost_is END AS search_rank_lost_is,
          CASE WHEN campaign_id LIKE '%c4' AND date >= DATE '2024-03-12' THEN 'MANUAL_CPM' ELSE bidding_strategy END AS bidding_strategy,
          CASE WHEN campaign_id LIKE '%c5' AND date >= DATE '2024-03-12' THEN daily_budget_micros * 2 WHEN campaign_id LIKE '%c3' THEN daily_budget_micros * 0 ELSE daily_budget_micros END AS daily_budget_micros,
          CASE WHEN campaign_id LIKE '%c6' THEN 'PAUSED' WHEN campaign_id LIKE '%c2' OR campaign_id LIKE '%c1' THEN 'ENABLED' ELSE status END AS status
        FROM {daily_metrics} WHERE NOT (campaign_id LIKE '%c7' AND date < DATE '2024-03-14') AND NOT (account_id LIKE '%3' AND date < DATE '2024-03-01')""",
    "shifted_changes": """
        SELECT account_id, change_id, change_timestamp, CASE WHEN account_id LIKE '%6' THEN 'CONVERSION_UPLOAD' ELSE change_type END AS change_type,
          CASE WHEN account_id LIKE '%3' THEN 'CONVERSION_ACTION' WHEN account_id LIKE '%4' THEN 'ASSET' ELSE resource_type END AS resource_type, campaign_id, CASE WHEN account_id LIKE '%2' THEN 'human' ELSE actor END AS actor
        FROM {change_events} WHERE account_id NOT LIKE '%9'""",
    "shifted_pages": """
        SELECT ga4_property, account_id, date, landing_page, device, CASE WHEN account_id LIKE '%4' AND date > DATE '2024-01-23' THEN sessions * 3 ELSE sessions END AS sessions,
          CASE WHEN account_id LIKE '%2' AND date > DATE '2024-01-23' THEN engaged_sessions * 0 WHEN account_id LIKE '%6' AND device = 'mobile' THEN engaged_sessions * 0 WHEN account_id LIKE '%8' THEN sessions
            WHEN account_id LIKE '%1' AND device = 'desktop' THEN sessions WHEN account_id LIKE '%7' AND device = 'mobile' AND date > DATE '2024-01-23' THEN engaged_sessions * 0 ELSE engaged_sessions END AS engaged_sessions
        FROM {ga4_landing_pages}""",
    "campaign_final_urls": """
        SELECT DISTINCT account_id, campaign_id, 'SEARCH' AS channel, 'https://www.shop.example.com/Page' || CAST(clicks % 7 AS STRING) || '/?utm=x' AS final_url FROM {daily_metrics}""",
}


#: Tables that repeat each row of a base table for several groups: the base table is dealt by account and campaign first, so that neither
#: the repeated rows nor their sums are moved. The expressions are those of the table's own text.
LAID = {"campaign_segments": ("lineitem", _ACCOUNT, _CAMPAIGN)}


def spark_sql(text: str) -> str:
    return re.sub(r"\[\[days:(\w+)\]\]", r"datediff(CAST(\1 AS DATE), DATE '1995-01-01')", text)


def duckdb_sql(text: str) -> str:
    return re.sub(r"\[\[days:(\w+)\]\]", r"datediff('day', DATE '1995-01-01', CAST(\1 AS DATE))", text)


def needs(text: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", text)


class Tables:
    """Lazy DataFrames: base tables by ``read``, ad tables as attributes, each built once per instance."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in TABLES and name not in BASE):
            raise AttributeError(name)
        if name not in self._made:
            if name in BASE:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                text = TABLES[name]
                read = {x: getattr(self, x) for x in set(needs(text))}
                if name in LAID:
                    base, *keys = LAID[name]
                    read[base] = by_keys(read[base], *map(F.expr, keys))
                self._made[name] = self.spark.sql(spark_sql(text), **read)
        return self._made[name]

    @cached_property
    def anchor(self) -> DataFrame:
        from admeridian.functions.windows import anchor_of

        return anchor_of(self.daily_metrics)


def ctes(*names: str) -> str:
    """DuckDB common table expressions of the named ad tables and of what they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in BASE or name in order:
            return
        for x in needs(TABLES[name]):
            visit(x)
        order.append(name)

    for name in names:
        visit(name)
    return ",\n".join(f"{name} AS MATERIALIZED ({duckdb_sql(TABLES[name]).format(**{x: x for x in needs(TABLES[name])})})" for name in order)
