"""Account and campaign dimensions derived from facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from admeridian.functions.windows import anchored, div, within

#: Words of an account name that are no brand.
STOP_WORDS = [
    "inc", "llc", "ltd", "corp", "co", "company", "the", "and", "of", "for", "google", "ads", "ad", "account", "active", "paid", "grant", "us", "uk", "ca", "eu", "au", "usa", "agency", "media", "client", "master",
    "strat", "main", "new", "old", "test", "demo", "store", "shop", "online", "marketing", "digital", "brand", "branded", "nonbrand", "non",
]


def spend_tier(daily: DataFrame, accounts: DataFrame) -> DataFrame:
    """account_id, spend_tier: from the spend of the last 30 days; an account without any keeps its tier."""
    spend = anchored(daily).filter(within(30)).groupBy("account_id").agg((F.sum("cost_micros") / 1e6).alias("spend"))
    tier = F.when(F.col("spend") < 5_000, "<5k").when(F.col("spend") < 25_000, "5k-25k").when(F.col("spend") < 100_000, "25k-100k").when(F.col("spend").isNotNull(), "100k+")
    return accounts.select("account_id", F.col("spend_tier").alias("old")).join(spend, "account_id", "left").select("account_id", F.coalesce(tier, "old").alias("spend_tier"))


def spend_ranking(daily: DataFrame, top: int) -> DataFrame:
    """The accounts with the largest positive spend; a total order, taken without a global sort."""
    spend = daily.groupBy("account_id").agg((F.sum("cost_micros") / 1e6).alias("spend")).filter("spend > 0")
    return spend.orderBy(F.desc("spend"), "account_id").limit(top)


def dormant_accounts(daily: DataFrame, quiet_days: int = 30, months: int = 6) -> DataFrame:
    """Accounts without spend in the last ``quiet_days`` that spent before: their last month with spend and its amount."""
    facts = anchored(daily)
    active = facts.filter(within(quiet_days) & (F.col("cost_micros") > 0)).select("account_id").distinct()
    by_month = facts.filter(F.col("date") > F.add_months("anchor", -months)).groupBy("account_id", F.trunc("date", "month").alias("month")).agg((F.sum("cost_micros") / 1e6).alias("spend")).filter("spend > 0")
    return by_month.join(active, "account_id", "left_anti").groupBy("account_id").agg(F.max("month").alias("last_month"), F.max_by("spend", "month").alias("last_spend"))


def dominant_campaign_type(daily: DataFrame) -> DataFrame:
    """The type most days of a campaign have; ties go to the alphabetically first."""
    counts = daily.filter("campaign_type IS NOT NULL AND campaign_type <> ''").groupBy("account_id", "campaign_id", "campaign_type").agg(F.count("*").alias("n"))
    order = Window.partitionBy("account_id", "campaign_id").orderBy(F.desc("n"), "campaign_type")
    return counts.withColumn("place", F.row_number().over(order)).filter("place = 1").select("account_id", "campaign_id", "campaign_type")


def account_summary(daily: DataFrame, days: int = 30) -> DataFrame:
    rows = anchored(daily).filter(within(days)).groupBy("account_id").agg(
        F.countDistinct("campaign_id").alias("campaigns"), F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), (F.sum("cost_micros") / 1e6).alias("cost"), F.sum("conversions").alias("conversions"), F.sum("conversion_value").alias("conversion_value"))
    return rows.withColumns({"cpa": div("cost", "conversions"), "roas": div("conversion_value", "cost"), "cvr": div("conversions", "clicks")})


def distribution(accounts: DataFrame, column: str) -> DataFrame:
    """value, n, share."""
    counts = accounts.groupBy(F.coalesce(column, F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))
    total = accounts.agg(F.count("*").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("total")).alias("share"))


def brand_tokens(accounts: DataFrame) -> DataFrame:
    """account_id, tokens: words of three letters or more of the account name, stop words left out, in order."""
    words = F.split(F.lower(F.regexp_replace("account_name", "[^A-Za-z0-9]+", " ")), " ")
    stop = F.array(*[F.lit(x) for x in STOP_WORDS])
    return accounts.select("account_id", F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w))).alias("tokens"))


def brand_keyword_share(accounts: DataFrame, keywords: DataFrame, minimum: int = 3) -> DataFrame:
    """Share of a campaign's distinct keywords that hold a brand token, for campaigns with enough keywords."""
    tokens = brand_tokens(accounts).filter(F.size("tokens") > 0)
    rows = keywords.join(tokens, "account_id")
    hit = F.exists("tokens", lambda t: F.contains(F.lower("keyword_text"), t))
    out = rows.groupBy("account_id", "campaign_id", "campaign_name").agg(F.countDistinct("keyword_id").alias("keywords"), F.countDistinct(F.when(hit, F.col("keyword_id"))).alias("matches"))
    return out.filter(F.col("keywords") >= minimum).withColumn("brand_share", F.col("matches") / F.col("keywords"))
