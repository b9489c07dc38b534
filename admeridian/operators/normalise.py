"""Normalisers: raw platform rows to typed facts, all as projections and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from admeridian.functions.config import case
from admeridian.functions.windows import div
from admeridian.operators.web import normalised_path
from admeridian.sources.tables import materialised

#: Channel and bidding names of the platform.
CHANNEL = {"SEARCH": "SEARCH", "PERFORMANCE_MAX": "PERFORMANCE_MAX", "SHOPPING": "SHOPPING", "DISPLAY": "DISPLAY", "VIDEO": "VIDEO", "DEMAND_GEN": "DEMAND_GEN", "MULTI_CHANNEL": "PERFORMANCE_MAX"}
BIDDING = {x: x for x in ("TARGET_CPA", "TARGET_ROAS", "MAXIMIZE_CONVERSIONS", "MAXIMIZE_CONVERSION_VALUE", "MAXIMIZE_CLICKS", "TARGET_IMPRESSION_SHARE", "MANUAL_CPC", "MANUAL_CPM")}
#: Clients whose changes count as applied automatically.
AUTO_CLIENTS = ["GOOGLE_ADS_WEB_CLIENT", "GOOGLE_ADS_AUTOMATED_RULE", "GOOGLE_ADS_SCRIPTS", "GOOGLE_ADS_BULK", "GOOGLE_ADS_RECOMMENDATIONS", "GOOGLE_ADS_RECOMMENDATIONS_SUBSCRIPTION"]
#: Hosts that say nothing about an account.
IGNORED_HOSTS = ["googleadservices.com", "doubleclick.net", "play.google.com", "apps.apple.com", "itunes.apple.com", "youtube.com", "youtu.be", "facebook.com", "instagram.com"]
SHARES = ("search_impression_share", "search_budget_lost_is", "search_rank_lost_is")


def daily_metrics(raw: DataFrame) -> DataFrame:
    """Channel and bidding names mapped, shares of 0 to null, a missing budget to 0."""
    kinds = {"campaign_type": case(F.col("channel"), CHANNEL, "UNKNOWN"), "bidding_strategy": case(F.col("bidding"), BIDDING, "UNKNOWN"), "daily_budget_micros": F.coalesce(F.col("budget_micros").cast("long"), F.lit(0))}
    return raw.withColumns(kinds | {s: F.nullif(F.col(s), F.lit(0.0)) for s in SHARES}).drop("channel", "bidding", "budget_micros")


def keyword_metrics(raw: DataFrame) -> DataFrame:
    return raw.withColumn("quality_score", F.nullif("quality_score", F.lit(0)))


def change_events(raw: DataFrame) -> DataFrame:
    """Actor by client and address, id by hash, campaign as the last part of its path."""
    actor = F.when(F.col("client_type").isin(AUTO_CLIENTS), "auto_applied").when(F.coalesce("user_email", F.lit("")) != "", "human").otherwise("unknown")
    key = F.concat_ws(":", "account_id", "change_date_time", "resource_name")
    return raw.select("account_id", F.substring(F.sha2(key, 256), 1, 16).alias("change_id"), F.to_timestamp("change_date_time").alias("change_timestamp"), F.col("operation").alias("change_type"), "resource_type", "resource_name",
                      F.element_at(F.split(F.coalesce("campaign", F.lit("")), "/"), -1).alias("campaign_id"), actor.alias("actor"), F.coalesce("user_email", F.lit("")).alias("actor_email"))


def keyword_counts(active: DataFrame, negatives: DataFrame) -> DataFrame:
    """Distinct texts of each campaign by match type, and its negatives. A text with several match types counts once, by the first."""
    first = active.groupBy("account_id", "campaign_id", "keyword_text").agg(F.min("match_type").alias("match_type"))
    of = lambda m: F.count_if(F.col("match_type") == m).cast("int")
    counts = first.groupBy("account_id", "campaign_id").agg(F.count("*").cast("int").alias("keyword_count"), of("BROAD").alias("broad_count"), of("PHRASE").alias("phrase_count"), of("EXACT").alias("exact_count"))
    minus = negatives.groupBy("account_id", "campaign_id").agg(F.count("*").cast("int").alias("negative_count"))
    return counts.join(minus, ["account_id", "campaign_id"], "full_outer").fillna(0)


def asset_coverage(assets: DataFrame) -> DataFrame:
    return assets.groupBy("account_id", "campaign_id", "asset_type").agg(F.count("*").cast("int").alias("asset_count"))


def search_terms(raw: DataFrame, floor_micros: int = 1_000_000) -> DataFrame:
    """One row per campaign and term over the window, terms over the floor of spend only."""
    rows = raw.groupBy("account_id", "campaign_id", "search_term").agg(F.min("date").alias("window_start"), F.max("date").alias("window_end"), *[F.sum(c).alias(c) for c in ("impressions", "clicks", "cost_micros", "conversions")])
    return rows.filter(F.col("cost_micros") > floor_micros)


def host(url: Column) -> Column:
    """The host in lower case without www; null for ignored hosts and for what is none."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), "^[a-z][a-z0-9+.-]*://", ""), "[/?#].*$", "")
    bare = F.regexp_replace(bare, r"^www\.", "")
    return F.when((bare != "") & F.contains(bare, F.lit(".")) & ~bare.isin(IGNORED_HOSTS), bare)


def dominant_host(urls: DataFrame, key: str = "account_id", url: str = "final_url") -> DataFrame:
    """The host most of an account's addresses have; ties to the alphabetically first."""
    counts = urls.select(key, host(F.col(url)).alias("host")).filter("host IS NOT NULL").groupBy(key, "host").agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), "host")
    return counts.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def landing_pages(raw: DataFrame) -> DataFrame:
    """Dates parsed, devices lowered, pages that fall together after normalisation summed, rates weighted by sessions."""
    rows = raw.withColumns({"date": F.to_date("day", "yyyyMMdd"), "device": F.lower("device"), "landing_page": normalised_path(F.col("landing_page"))})
    out = rows.groupBy("ga4_property", "account_id", "date", "landing_page", "device").agg(F.sum("sessions").alias("sessions"), F.sum("engaged_sessions").alias("engaged_sessions"), F.sum(F.col("avg_session_duration") * F.col("sessions")).alias("_d"))
    return out.withColumns({"engagement_rate": div("engaged_sessions", "sessions"), "avg_session_duration": div("_d", "sessions")}).withColumn("bounce_rate", 1 - F.col("engagement_rate")).drop("_d")


def campaign_pages(pages: DataFrame, urls: DataFrame) -> DataFrame:
    """Only pages that a campaign of the account leads to."""
    paths = urls.select("account_id", normalised_path(F.col("final_url")).alias("landing_page")).distinct()
    return pages.join(paths, ["account_id", "landing_page"], "left_semi")


def property_health(pages: DataFrame, properties: DataFrame, suspicious: float = 0.97) -> DataFrame:
    """A property without sessions, or with nearly every session engaged, is not measured properly."""
    sums = pages.groupBy("ga4_property").agg(F.sum("sessions").alias("sessions"), div(F.sum("engaged_sessions"), F.sum("sessions")).alias("engagement_rate"))
    rows = properties.select("ga4_property").distinct().join(sums, "ga4_property", "left")
    return rows.withColumns({"implementation_ok": F.coalesce((F.col("sessions") > 0) & (F.col("engagement_rate") < suspicious), F.lit(False)), "note": F.when(F.coalesce("sessions", F.lit(0)) == 0, "no sessions in window").when(F.col("engagement_rate") >= suspicious, "engagement near 1").otherwise("")})


def page_texts(pages: DataFrame, html: str = "html") -> DataFrame:
    """title (og:title before <title>) and description (og:description before the plain one) of raw pages, trimmed and cut."""
    text = F.coalesce(F.col(html), F.lit(""))
    meta = lambda a, v: F.nullif(F.trim(F.regexp_extract(text, rf'(?is)<meta[^>]*\b{a}="{v}"[^>]*\bcontent="([^"]*)"', 1)), F.lit(""))
    title = F.nullif(F.trim(F.regexp_extract(text, r"(?is)<title[^>]*>([^<]*)</title>", 1)), F.lit(""))
    return pages.withColumns({"title": F.substring(F.coalesce(meta("property", "og:title"), title, F.lit("")), 1, 500), "description": F.substring(F.coalesce(meta("property", "og:description"), meta("name", "description"), F.lit("")), 1, 1000)})


def property_map(accounts: DataFrame, properties: DataFrame) -> DataFrame:
    """account_id, ga4_property, match_method: by equal host, else by at least two shared words of four letters or more (most shared
    words first, then the smallest property).

    Only the sets of words count, so each set of either side is held once, with the smallest property that has it: names that many
    share meet once. Of two shared words at most one is the commonest of its set, so sets meet on all of their words but the
    commonest; a word that stands in every name brings no two together. Sets that meet are then held against all their words."""
    words = lambda c: F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{4,}"), F.lit(0)))).alias("words")
    a = accounts.select("account_id", host(F.col("website_url")).alias("host"), words("account_name"))
    p = properties.select("ga4_property", host(F.col("url")).alias("host"), words("name"))
    hosts = p.filter("host IS NOT NULL").groupBy("host").agg(F.min("ga4_property").alias("exact"))
    exact = a.filter("host IS NOT NULL").join(hosts, "host").groupBy("account_id").agg(F.min("exact").alias("exact"))
    several = F.size("words") >= 2
    a_sets = materialised(a.join(exact, "account_id", "left_anti").filter(several).select("words").distinct(), "account-words")
    p_sets = materialised(p.filter(several).groupBy("words").agg(F.min("ga4_property").alias("ga4_property")), "property-words")
    often = a_sets.select(F.explode("words").alias("w")).unionByName(p_sets.select(F.explode("words").alias("w"))).groupBy("w").agg(F.count("*").alias("n"))

    def rarer(sets: DataFrame) -> DataFrame:
        """(words, w): all words of a set but the commonest; of equals the last by name counts as commoner."""
        found = sets.select("words", F.explode("words").alias("w")).join(often, "w")
        top = found.groupBy("words").agg(F.max(F.struct("n", "w"))["w"].alias("top"))
        return found.join(top, "words").filter("w <> top").select("words", "w")

    theirs = rarer(p_sets).withColumnRenamed("words", "p_words")
    n = F.size(F.array_intersect("words", "p_words"))
    met = rarer(a_sets).join(theirs, "w").select("words", "p_words").distinct().withColumn("n", n).filter("n >= 2")
    best = met.join(p_sets.withColumnRenamed("words", "p_words"), "p_words").groupBy("words").agg(F.min_by("ga4_property", F.struct(-F.col("n"), "ga4_property")).alias("_fuzzy"))
    best = a.select("account_id", "words").join(best, "words").groupBy("account_id").agg(F.min("_fuzzy").alias("fuzzy"))
    rows = a.select("account_id").join(exact, "account_id", "left").join(best, "account_id", "left")
    return rows.select("account_id", F.coalesce("exact", "fuzzy").alias("ga4_property"), F.when(F.col("exact").isNotNull(), "domain").when(F.col("fuzzy").isNotNull(), "name").otherwise("unmatched").alias("match_method"))


def accounts(raw: DataFrame, mcc_id: str, today: Column) -> DataFrame:
    """Accounts as the platform lists them (id, name, currency_code), with defaults and the day they were first seen."""
    return raw.select(F.col("id").cast("string").alias("account_id"), F.coalesce("name", F.lit("")).alias("account_name"), F.lit(mcc_id).alias("mcc_id"), F.coalesce("currency_code", F.lit("USD")).alias("currency_code"), today.alias("first_seen"), today.alias("last_updated"))


def conversion_actions(raw: DataFrame) -> DataFrame:
    """Conversion actions as text; an action that does not say whether it is primary is none."""
    names = {"id": "action_id", "name": "action_name", "status": "status", "type": "action_type", "category": "category", "counting_type": "counting_type", "attribution_model": "attribution_model"}
    return raw.select("account_id", *[F.col(a).cast("string").alias(b) for a, b in names.items()], F.coalesce(F.col("primary_for_goal").cast("boolean"), F.lit(False)).alias("primary_for_goal"))


SEGMENT_DIMENSIONS = ("device", "network", "hour", "dow", "geo")


def campaign_segments(raw: DataFrame, dimensions: tuple[str, ...] = SEGMENT_DIMENSIONS) -> DataFrame:
    """Window sums of each campaign by the values of five dimensions, in long form from one pass; removed campaigns are left out,
    and regions without cost."""
    long = raw.filter("status <> 'REMOVED'").withColumn("s", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("segment_value")) for d in dimensions]))).filter("s.dimension <> 'geo' OR cost_micros > 0")
    sums = [F.sum(c).alias(c) for c in ("impressions", "clicks", "cost_micros", "conversions")]
    return long.groupBy("account_id", "campaign_id", "s.dimension", "s.segment_value").agg(*sums, F.min("date").alias("window_start"), F.max("date").alias("window_end"))


def ad_strength(raw: DataFrame) -> DataFrame:
    """Ratings of responsive search ads; other ads have none, removed ones do not count."""
    return raw.filter("ad_type = 'RESPONSIVE_SEARCH_AD' AND status <> 'REMOVED'").select("account_id", "campaign_id", "ad_group_id", "ad_id", "ad_strength")


def final_urls(raw: DataFrame) -> DataFrame:
    """One row per campaign and address, with its path and its host as the pages have them."""
    return raw.dropDuplicates(["account_id", "campaign_id", "final_url"]).select("account_id", "campaign_id", "final_url", normalised_path(F.col("final_url")).alias("norm_path"), host(F.col("final_url")).alias("domain"))


def source_engagement(raw: DataFrame) -> DataFrame:
    """Engagement per channel; rates are weighted by sessions."""
    weighted = lambda c: div(F.sum(F.col(c) * F.col("sessions")), F.sum("sessions")).alias(c)
    return raw.groupBy("ga4_property", "account_id", "channel").agg(F.sum("sessions").alias("sessions"), weighted("engagement_rate"), weighted("session_cvr")).withColumn("bounce_rate", 1 - F.col("engagement_rate"))


#: The events of the purchase funnel.
FUNNEL_EVENTS = ["view_item", "add_to_cart", "begin_checkout", "purchase"]


def funnel_events(raw: DataFrame) -> DataFrame:
    """Counts of the funnel's events per day; days come as yyyyMMdd."""
    return raw.filter(F.col("event_name").isin(FUNNEL_EVENTS)).groupBy("ga4_property", "account_id", F.to_date("day", "yyyyMMdd").alias("date"), "event_name").agg(F.sum("event_count").alias("event_count"))
