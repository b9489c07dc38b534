"""Queries and DuckDB oracles of the account classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from admeridian.operators import classifier as C
from admeridian.sources.adapters import Tables, ctes

#: Two-letter families of account names and addresses, so that the rules have something to read.
_NAMES = ["Harbor Dental Clinic", "Binance.US", "Prep For Success Tutors", "Sunrise Pool-Spa", "Law Offices of North", "City Museum Grant", "Golf_Outlet Apparel", "Plain Goods"]
_PICK = "CASE CAST(substr(account_id, 2) AS INT) % 8 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES)) + " END"
_URL = "CASE CAST(substr(account_id, 2) AS INT) % 5 WHEN 0 THEN 'https://www.airelleskincare.com' WHEN 1 THEN 'https://lockly.com/shop' WHEN 2 THEN 'museum-friends.org' WHEN 3 THEN 'https://best-law-firm.com' ELSE '' END"


def _inputs(t):
    named = t.accounts.withColumns({"account_name": F.expr(_PICK), "website_url": F.expr(_URL)})
    return C.inputs(named, t.daily_metrics, t.conversion_actions)


QUERIES = {
    "dim02_classifier": lambda spark, sf_dir: C.classify(_inputs(Tables(spark, sf_dir))).withColumn("rules", F.size("rule_trace")).drop("rule_trace"),
    "dim03_overrides": lambda spark, sf_dir: (lambda t: C.classify(_inputs(t), t.accounts.filter("account_id IN ('a1', 'a2')").select("account_id", F.lit("b2b").alias("business_type"), F.lit("legal").alias("vertical"))).groupBy("business_type", "vertical").agg(F.count("*").alias("n")))(Tables(spark, sf_dir)),
}


def _values() -> str:
    rows = []
    for source, factor in (("name", 2.0), ("url", 1.5), ("web", 1.5)):
        rows += [(source, p, b, v, w * factor) for p, b, v, w in C.NAME_RULES]
    for source, factor in (("url_raw", 1.0), ("web", 0.8)):
        rows += [(source, p, b, v, w * factor) for p, b, v, w in C.SUBSTRINGS]
    rows += [("url_raw", p, b, v, w) for _, b, v, w, p in C.ENDINGS] + [("campaigns", p, b, v, w) for p, b, v, w in C.CAMPAIGN_RULES]
    return ", ".join(f"('{s}', '{p}', '{b}', '{v}', {w!r}::DOUBLE)" for s, p, b, v, w in rows)


_CONV = ", ".join(f"('{c}', '{b}', {w}::DOUBLE)" for c, (b, w) in C.CATEGORIES.items())
_HITS = f"""WITH {ctes('accounts', 'daily_metrics', 'conversion_actions')}, acc AS (SELECT account_id, {_PICK} AS nm, {_URL} AS url FROM accounts),
camp AS (SELECT account_id, array_to_string(list_sort(list(DISTINCT campaign_name)), ' ') AS txt, bool_or(campaign_type = 'SHOPPING') AS shop FROM daily_metrics WHERE status = 'ENABLED' GROUP BY ALL),
txt AS (SELECT account_id, 'name' AS source, regexp_replace(lower(nm), '[._,\\-]+', ' ', 'g') AS text FROM acc UNION ALL SELECT account_id, 'url', regexp_replace(lower(url), '[._,\\-]+', ' ', 'g') FROM acc UNION ALL SELECT account_id, 'url_raw', lower(url) FROM acc
  UNION ALL SELECT account_id, 'campaigns', regexp_replace(lower(txt), '[._,\\-]+', ' ', 'g') FROM camp JOIN acc USING (account_id)),
ru(source, pattern, bt, vert, w) AS (VALUES {_values()}), cv(category, bt, w) AS (VALUES {_CONV}),
cc AS (SELECT account_id, category, count(*) AS n, sum(count(*)) OVER (PARTITION BY account_id) AS total FROM conversion_actions WHERE status = 'ENABLED' GROUP BY account_id, category),
hit AS (SELECT account_id, bt, vert, w FROM txt JOIN ru USING (source) WHERE regexp_matches(text, pattern) UNION ALL SELECT account_id, bt, '', w * n / total FROM cc JOIN cv USING (category) WHERE account_id IN (SELECT account_id FROM acc) UNION ALL SELECT account_id, 'ecommerce', '', 0.5 FROM camp JOIN acc USING (account_id) WHERE shop),
ty AS (SELECT account_id, bt, sum(w) AS s, row_number() OVER (PARTITION BY account_id ORDER BY round(sum(w), 9) DESC, bt) AS rn, sum(sum(w)) OVER (PARTITION BY account_id) AS total FROM hit GROUP BY account_id, bt),
ve AS (SELECT account_id, vert, row_number() OVER (PARTITION BY account_id ORDER BY round(sum(w), 9) DESC, vert) AS rn FROM hit WHERE vert <> '' GROUP BY account_id, vert),
nh AS (SELECT account_id, count(*) AS n FROM hit GROUP BY ALL)"""
ORACLES = {
    "dim02_classifier": f"{_HITS} SELECT account_id, coalesce(ty.bt, 'unknown') AS business_type, coalesce(ve.vert, '') AS vertical, coalesce(round(s / total, 3), 0) AS confidence, n AS rules FROM acc LEFT JOIN (SELECT * FROM ty WHERE rn = 1) ty USING (account_id) LEFT JOIN (SELECT * FROM ve WHERE rn = 1) ve USING (account_id) LEFT JOIN nh USING (account_id)",
    "dim03_overrides": f"{_HITS}, f AS (SELECT account_id, CASE WHEN account_id IN ('a1', 'a2') THEN 'b2b' ELSE coalesce(ty.bt, 'unknown') END AS business_type, CASE WHEN account_id IN ('a1', 'a2') THEN 'legal' ELSE coalesce(ve.vert, '') END AS vertical FROM acc LEFT JOIN (SELECT * FROM ty WHERE rn = 1) ty USING (account_id) LEFT JOIN (SELECT * FROM ve WHERE rn = 1) ve USING (account_id)) SELECT business_type, vertical, count(*) AS n FROM f GROUP BY ALL",
}
