"""Queries and DuckDB oracles of the normalisers, on raw rows derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from admeridian.operators import normalise as N
from admeridian.plans.learn_queries import rounded
from admeridian.sources.adapters import Tables, ctes


def _q(make):
    return lambda spark, sf_dir: rounded(make(Tables(spark, sf_dir)))


def _raw_changes(t):
    day = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    client = F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'GOOGLE_ADS_SCRIPTS' WHEN 1 THEN 'GOOGLE_ADS_API' ELSE 'OTHER' END")
    return t.orders.select(F.concat(F.lit("a"), F.col("o_custkey").cast("string")).alias("account_id"), day.alias("change_date_time"), F.concat(F.lit("r/"), F.col("o_orderkey").cast("string")).alias("resource_name"), F.lit("UPDATE").alias("operation"), F.col("o_orderpriority").alias("resource_type"),
                           F.concat(F.lit("customers/1/campaigns/"), (F.col("o_custkey") % 12).cast("string")).alias("campaign"), client.alias("client_type"), F.expr("CASE WHEN o_orderstatus = 'F' THEN 'x@example.com' END").alias("user_email"))


QUERIES = {
    "nrm01_daily": _q(lambda t: N.daily_metrics(t.daily_metrics.withColumns({"channel": F.expr("CASE campaign_type WHEN 'SHOPPING' THEN 'MULTI_CHANNEL' WHEN 'PERFORMANCE_MAX' THEN 'LOCAL' ELSE campaign_type END"), "bidding": F.col("bidding_strategy"), "budget_micros": F.lit(None).cast("long")}).drop("daily_budget_micros"))
        .groupBy("campaign_type", "bidding_strategy", "daily_budget_micros").agg(F.count("*").alias("n"), F.count("search_budget_lost_is").alias("n_lost"))),
    "nrm03_change_events": _q(lambda t: N.change_events(_raw_changes(t)).select("account_id", "change_id", "campaign_id", "actor", "actor_email")),
    "nrm05_assets": _q(lambda t: N.asset_coverage(t.keyword_metrics.withColumn("asset_type", F.col("match_type")))),
    "nrm06_keyword_counts": _q(lambda t: N.keyword_counts(t.keyword_metrics, t.keyword_metrics.filter("quality_score = 1"))),
    "nrm08_search_terms": _q(lambda t: N.search_terms(t.keyword_metrics.select("account_id", "campaign_id", F.col("match_type").alias("search_term"), F.lit("2024-03-01").cast("date").alias("date"), "impressions", "clicks", "cost_micros", "conversions"), 500_000_000).drop("window_start", "window_end")),
    "nrm13_hosts": _q(lambda t: N.dominant_host(t.pages.select((F.col("page_id") % 7).alias("account_id"), F.col("url").alias("final_url")))),
    "nrm14_landing_pages": _q(lambda t: N.landing_pages(t.ga4_landing_pages.withColumns({"day": F.date_format("date", "yyyyMMdd"), "device": F.upper("device"), "landing_page": F.regexp_replace("landing_page", "[34]$", "/?q=1")}).drop("date"))),
    "nrm18_property_health": _q(lambda t: N.property_health(t.ga4_landing_pages, t.ga4_landing_pages.select(F.concat("ga4_property", F.expr("CASE WHEN device = 'tablet' THEN 'x' ELSE '' END")).alias("ga4_property")), 0.5)),
    "nrm19_page_texts": _q(lambda t: N.page_texts(t.pages).select("page_id", "title")),
    "nrm20_property_map": _q(lambda t: N.property_map(t.accounts.withColumn("account_name", F.concat(F.lit("north "), F.element_at(F.array(F.lit("wind"), F.lit("gate"), F.lit("river side")), F.substring("account_id", 2, 9).cast("int") % 3 + 1), F.lit(" "), "vertical")), t.accounts.select(F.concat(F.lit("p"), F.substring("account_id", 2, 9)).alias("ga4_property"), F.expr("CASE WHEN account_id LIKE '%1' THEN website_url ELSE '' END").alias("url"), F.concat(F.lit("north gate "), "vertical").alias("name")))),
}

_K = f"WITH {ctes('keyword_metrics')}"
_HOST = "regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce({0}, ''))), '^[a-z][a-z0-9+.-]*://', ''), '[/?#].*$', ''), '^www[.]', '')"
_KNOWN_HOST = f"CASE WHEN {_HOST} <> '' AND contains({_HOST}, '.') AND {_HOST} NOT IN ({', '.join(repr(x) for x in sorted(N.IGNORED_HOSTS))}) THEN {_HOST} END"
_WORDS = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]{{4,}}'))"
ORACLES = {
    "nrm20_property_map": f"""WITH {ctes('accounts')}, a AS (SELECT account_id, {_KNOWN_HOST.format('website_url')} AS host, {_WORDS.format("'north ' || ['wind', 'gate', 'river side'][CAST(substr(account_id, 2) AS INT) % 3 + 1] || ' ' || vertical")} AS words FROM accounts),
p AS (SELECT 'p' || substr(account_id, 2) AS ga4_property, {_KNOWN_HOST.format("CASE WHEN account_id LIKE '%1' THEN website_url ELSE '' END")} AS host, {_WORDS.format("'north gate ' || vertical")} AS words FROM accounts),
ex AS (SELECT account_id, min(ga4_property) AS exact FROM a JOIN p USING (host) GROUP BY ALL), sh AS (SELECT account_id, ga4_property, len(list_intersect(a.words, p.words)) AS n FROM a, p WHERE len(list_intersect(a.words, p.words)) >= 2),
be AS (SELECT account_id, ga4_property AS fuzzy FROM sh QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY n DESC, ga4_property) = 1)
SELECT account_id, coalesce(exact, fuzzy) AS ga4_property, CASE WHEN exact IS NOT NULL THEN 'domain' WHEN fuzzy IS NOT NULL THEN 'name' ELSE 'unmatched' END AS match_method FROM a LEFT JOIN ex USING (account_id) LEFT JOIN be USING (account_id)""",
    "nrm01_daily": f"WITH {ctes('daily_metrics')} SELECT CASE campaign_type WHEN 'SHOPPING' THEN 'PERFORMANCE_MAX' WHEN 'PERFORMANCE_MAX' THEN 'UNKNOWN' ELSE campaign_type END AS campaign_type, bidding_strategy, 0::BIGINT AS daily_budget_micros, count(*) AS n, count(search_budget_lost_is) AS n_lost FROM daily_metrics GROUP BY ALL",
    "nrm03_change_events": "SELECT 'a' || o_custkey AS account_id, substr(sha256('a' || o_custkey || ':' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ':r/' || o_orderkey), 1, 16) AS change_id, CAST(o_custkey % 12 AS VARCHAR) AS campaign_id, CASE WHEN o_orderkey % 3 = 0 THEN 'auto_applied' WHEN o_orderstatus = 'F' THEN 'human' ELSE 'unknown' END AS actor, CASE WHEN o_orderstatus = 'F' THEN 'x@example.com' ELSE '' END AS actor_email FROM orders",
    "nrm05_assets": f"{_K} SELECT account_id, campaign_id, match_type AS asset_type, count(*) AS asset_count FROM keyword_metrics GROUP BY ALL",
    "nrm06_keyword_counts": f"{_K}, f AS (SELECT account_id, campaign_id, keyword_text, min(match_type) AS m FROM keyword_metrics GROUP BY ALL), c AS (SELECT account_id, campaign_id, count(*) AS keyword_count, count(*) FILTER (m = 'BROAD') AS broad_count, count(*) FILTER (m = 'PHRASE') AS phrase_count, count(*) FILTER (m = 'EXACT') AS exact_count FROM f GROUP BY ALL) SELECT c.*, coalesce(n.n, 0) AS negative_count FROM c LEFT JOIN (SELECT account_id, campaign_id, count(*) AS n FROM keyword_metrics WHERE quality_score = 1 GROUP BY ALL) n USING (account_id, campaign_id)",
    "nrm08_search_terms": f"{_K} SELECT account_id, campaign_id, match_type AS search_term, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(cost_micros) AS BIGINT) AS cost_micros, sum(conversions) AS conversions FROM keyword_metrics GROUP BY ALL HAVING sum(cost_micros) > 500000000",
    "nrm13_hosts": r"WITH h AS (SELECT page_id % 7 AS account_id, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#]+)', 1), '^www\.', '') AS host FROM pages), c AS (SELECT account_id, host, count(*) AS n, row_number() OVER (PARTITION BY account_id ORDER BY count(*) DESC, host) AS rn FROM h WHERE host LIKE '%.%' GROUP BY account_id, host) SELECT account_id, host, n FROM c WHERE rn = 1",
    "nrm14_landing_pages": f"WITH {ctes('ga4_landing_pages')} SELECT ga4_property, account_id, CAST(date AS VARCHAR) AS date, CASE WHEN landing_page IN ('/page3', '/page4') THEN '/page' ELSE landing_page END AS landing_page, device, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(engaged_sessions) AS BIGINT) AS engaged_sessions, round(sum(engaged_sessions) / sum(sessions), 6) AS engagement_rate, round(sum(avg_session_duration * sessions) / sum(sessions), 6) AS avg_session_duration, round(1 - sum(engaged_sessions) / sum(sessions), 6) AS bounce_rate FROM ga4_landing_pages GROUP BY 1, 2, 3, 4, 5",
    "nrm18_property_health": f"WITH {ctes('ga4_landing_pages')}, s AS (SELECT ga4_property, sum(sessions)::BIGINT AS sessions, sum(engaged_sessions) / sum(sessions) AS r FROM ga4_landing_pages GROUP BY ALL), p AS (SELECT DISTINCT ga4_property || CASE WHEN device = 'tablet' THEN 'x' ELSE '' END AS ga4_property FROM ga4_landing_pages) SELECT ga4_property, sessions, round(r, 6) AS engagement_rate, coalesce(r < 0.5, FALSE) AS implementation_ok, CASE WHEN sessions IS NULL THEN 'no sessions in window' WHEN r >= 0.5 THEN 'engagement near 1' ELSE '' END AS note FROM p LEFT JOIN s USING (ga4_property)",
    "nrm19_page_texts": "SELECT page_id, substr(trim(regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title>', 1)), 1, 500) AS title FROM pages",
}
