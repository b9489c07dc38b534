"""Episodes: bundles of changes of one campaign, day and actor with their metrics before and after.

Everything is set-based: bundles are one aggregate of the event log; the days around them come by an equality join on
(account, campaign) with a band on the date, aggregated at once; account-wide bundles take a second branch on the account.
All lies by account: events, days and bundles are dealt by it once, and no step after that moves them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from admeridian.functions.config import case
from admeridian.functions.signals import identifier
from admeridian.functions.stats import rnd, trend
from admeridian.functions.windows import div
from admeridian.sources.tables import by_account, dealt

PRE, POST, MIN_DAYS = 7, 7, 4

#: Resource types and their categories; all others are 'other'.
CATEGORY = {
    "CAMPAIGN_BUDGET": "budget", "BIDDING_STRATEGY": "bidding", "CAMPAIGN": "campaign_setting", "CAMPAIGN_CRITERION": "targeting_keyword", "AD_GROUP_CRITERION": "targeting_keyword", "AD_GROUP_AD": "ad_creative", "AD": "ad_creative",
    "AD_GROUP": "structure", "ASSET": "asset", "ASSET_SET_ASSET": "asset", "ASSET_SET": "asset", "CAMPAIGN_ASSET": "asset", "CAMPAIGN_ASSET_SET": "asset", "AD_GROUP_ASSET": "asset", "CUSTOMER_ASSET": "asset",
    "CONVERSION_ACTION": "conversion", "CUSTOMER_CONVERSION_GOAL": "conversion", "CAMPAIGN_CONVERSION_GOAL": "conversion",
}
#: Known sets of categories, joined by '+' in alphabetical order.
AUTO_BUNDLES = {
    "budget+campaign_setting": "auto_budget_optimization", "budget+targeting_keyword": "auto_budget_expand", "campaign_setting+targeting_keyword": "auto_targeting_restructure", "asset+budget": "auto_creative_budget",
    "asset+budget+campaign_setting": "auto_campaign_refresh", "budget+campaign_setting+targeting_keyword": "auto_comprehensive_optimization", "asset+campaign_setting+targeting_keyword": "auto_targeting_creative",
    "asset+budget+campaign_setting+targeting_keyword": "auto_full_optimization",
}
HUMAN_BUNDLES = {
    "structure+targeting_keyword": "human_campaign_restructure", "ad_creative+structure+targeting_keyword": "human_campaign_overhaul", "ad_creative+asset+campaign_setting+structure+targeting_keyword": "human_full_campaign_build",
}


def category(resource: Column) -> Column:
    return case(F.upper(F.coalesce(resource, F.lit(""))), CATEGORY, "other")


@dataclass(frozen=True)
class Days:
    """Sums by campaign and day and by account and day, both stored as they are dealt by account; steps that take daily facts take
    them too, and move no day."""

    facts: DataFrame
    account: DataFrame


def bundles(changes: DataFrame, daily: DataFrame | Days) -> DataFrame:
    """One row per account, campaign, day and actor, for days with a full week of facts on either side."""
    span = (daily.facts if isinstance(daily, Days) else daily).agg(F.date_add(F.min("date"), PRE).alias("first"), F.date_sub(F.max("date"), POST).alias("last"))
    events = changes.select("account_id", F.coalesce("campaign_id", F.lit("")).alias("campaign_id"), F.to_date("change_timestamp").alias("change_date"), "actor", category(F.col("resource_type")).alias("category"), "change_id")
    events = events.crossJoin(F.broadcast(span)).filter("first < last AND change_date BETWEEN first AND last")
    # the categories are few and known: a bit each
    kinds = sorted({*CATEGORY.values(), "other"})
    events = by_account(events.withColumn("bit", case(F.col("category"), {c: 1 << i for i, c in enumerate(kinds)})).drop("category"))
    rows = events.groupBy("account_id", "campaign_id", "change_date", "actor").agg(F.bit_or("bit").alias("bits"), F.count("*").alias("change_count"), F.min("change_id").alias("change_event_id"))
    named_bits = F.array_compact(F.array(*[F.when(F.col("bits").bitwiseAND(F.lit(1 << i)) != 0, c) for i, c in enumerate(kinds)]))
    rows = rows.select("account_id", "campaign_id", "change_date", "actor", named_bits.alias("categories"), "change_count", "change_event_id")
    key = F.array_join("categories", "+")
    auto = F.col("actor") == "auto_applied"
    named = F.when(auto, case(key, AUTO_BUNDLES)).otherwise(case(key, HUMAN_BUNDLES))
    unknown = F.when(auto, "auto_unknown_bundle").when(F.col("actor") == "human", "human_unknown_bundle").otherwise("mixed_unknown_bundle")
    single = F.size("categories") == 1
    return rows.select(identifier("account_id", "campaign_id", "change_date", "actor").alias("episode_id"), "*", F.when(single, F.element_at("categories", 1)).otherwise(F.coalesce(named, unknown)).alias("change_category"), (single | named.isNotNull()).alias("known"))


METRICS = ("impressions", "clicks", "cost", "conversions", "conversion_value", "days", "cvr", "cpa", "roas")


def days_of(daily: DataFrame | Days, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Sums of ``columns`` by campaign and day, dealt by campaign, and by account and day, dealt by account: what follows on a campaign
    or an account moves no fact again. Stored days stay as they lie."""
    if isinstance(daily, Days):
        return daily.facts.select("account_id", "campaign_id", "date", *columns), daily.account.select("account_id", "date", *columns)
    sums = [F.sum(c).alias(c) for c in columns]
    slim = daily.select("account_id", "campaign_id", "date", *columns)
    facts = slim.repartition("account_id", "campaign_id").groupBy("account_id", "campaign_id", "date").agg(*sums)
    account = slim.groupBy("account_id", "date").agg(*sums).repartition("account_id")
    return facts, account


def laid(daily: DataFrame, summed: bool = False) -> Days:
    """The days of all that is summed over them, stored as they are dealt. ``summed``: a campaign's day is one row of ``daily``."""
    columns = ("impressions", "clicks", "cost_micros", "conversions", "conversion_value")
    facts = daily.select("account_id", "campaign_id", "date", *columns) if summed else days_of(daily, *columns)[0]
    facts = dealt(facts, "days", "campaign_id", "date")
    return Days(facts, dealt(facts.groupBy("account_id", "date").agg(*[F.sum(c).alias(c) for c in columns]), "account-days", "date"))


def beside(keys: DataFrame, facts: DataFrame, account: DataFrame, near: Column, fold) -> DataFrame:
    """``fold(pairs, by)`` of keys with the days that are ``near``: of their campaign, or, for a ``campaign_id`` of '', of the whole
    account. ``by`` is what the pairs lie by; aggregates that have it among their keys need no exchange, and keep the account for
    what follows."""
    own = keys.filter("campaign_id <> ''").join(facts, ["account_id", "campaign_id"]).filter(near)
    whole = keys.filter("campaign_id = ''").drop("campaign_id").join(account, "account_id").filter(near)
    return fold(own, ["account_id", "campaign_id"]).unionByName(fold(whole, ["account_id"]))


def met(rows: DataFrame, found: DataFrame, key: str, daily: DataFrame | Days, how: str) -> DataFrame:
    """``rows`` with what was ``found`` for their ``key``; beside stored days they meet by account as well, where they lie."""
    more = [c for c in found.columns if c not in ("account_id", key)]
    joined = by_account(rows).join(found, ["account_id", key], how) if isinstance(daily, Days) else rows.join(found.drop("account_id"), key, how)
    return joined.select(*rows.columns, *more)


def window_metrics(rows: DataFrame, daily: DataFrame | Days) -> DataFrame:
    """``rows`` with ``pre_*`` and ``post_*`` metrics; the day of change belongs to the time after. 0 stands for undefined."""
    facts, account = days_of(daily, "impressions", "clicks", "cost_micros", "conversions", "conversion_value")
    near = F.col("date").between(F.date_sub("change_date", PRE), F.date_add("change_date", POST - 1))
    before = F.col("date") < F.col("change_date")
    aggs = []
    for name, side in (("pre", before), ("post", ~before)):
        total = lambda c, side=side: F.coalesce(F.sum(F.when(side, F.col(c))), F.lit(0))
        aggs += [total("impressions").alias(f"{name}_impressions"), total("clicks").alias(f"{name}_clicks"), (total("cost_micros") / 1e6).alias(f"{name}_raw_cost"), total("conversions").cast("double").alias(f"{name}_conversions"),
                 total("conversion_value").cast("double").alias(f"{name}_raw_value"), F.count_if(side).alias(f"{name}_days")]
    keys = rows.select("episode_id", "account_id", "campaign_id", "change_date")
    sums = beside(keys, facts, account, near, lambda pairs, by: pairs.groupBy(*by, "episode_id").agg(*aggs).drop("campaign_id"))
    for p in ("pre", "post"):
        cost, value, conv, clicks = (F.col(f"{p}_{x}") for x in ("raw_cost", "raw_value", "conversions", "clicks"))
        zero = lambda x, n: F.coalesce(rnd(x, n), F.lit(0.0))
        sums = sums.withColumns({f"{p}_cost": rnd(cost, 2), f"{p}_conversion_value": rnd(value, 2), f"{p}_cvr": zero(div(conv, clicks), 4), f"{p}_cpa": zero(div(cost, conv), 2), f"{p}_roas": zero(div(value, cost), 2)})
    found = [f"{p}_{m}" for p in ("pre", "post") for m in METRICS]
    sums = sums.filter((F.col("pre_days") >= MIN_DAYS) & (F.col("post_days") >= MIN_DAYS)).select("account_id", "episode_id", *found)
    return met(rows, sums, "episode_id", daily, "inner")


def _levers(categories: str = "categories") -> Column:
    """A bit for each lever of a bundle."""
    kinds = sorted({*CATEGORY.values(), "other"})
    return sum((F.when(F.array_contains(categories, c), F.lit(1 << i)).otherwise(0) for i, c in enumerate(kinds)), F.lit(0))


def _weeks(rows: DataFrame) -> DataFrame:
    """account_id, campaign_id, change_date, week: the levers of a campaign's day are one set, those of the week from it the union of
    its days'."""
    days = rows.withColumn("own", _levers()).groupBy("account_id", "campaign_id", "change_date").agg(F.bit_or("own").alias("day"))
    week = Window.partitionBy("account_id", "campaign_id").orderBy(F.unix_date("change_date")).rangeBetween(0, POST - 1)
    return days.withColumn("week", F.bit_or("day").over(week)).drop("day")


def _others() -> Column:
    """Whether the week pulls a lever that the bundle does not."""
    return F.col("week").bitwiseAND(F.bitwise_not("own")) != 0


def confounded(rows: DataFrame) -> DataFrame:
    """episode_id of bundles with another bundle of the same campaign within the week that pulls a lever of its own. No two bundles are
    ever paired."""
    own = rows.select("episode_id", "account_id", "campaign_id", "change_date", _levers().alias("own"))
    return own.join(_weeks(rows), ["account_id", "campaign_id", "change_date"]).filter(_others()).select("episode_id")


def _outcome(rows: DataFrame) -> DataFrame:
    """outcome, magnitude and the metric they rest on, before any adjustment."""
    read = (F.col("pre_conversions") != 0) & (F.col("post_conversions") != 0)
    cpa = read & (F.col("pre_cpa") != 0) & (F.col("post_cpa") != 0)
    cvr = read & ~cpa & (F.col("pre_cvr") != 0) & (F.col("post_cvr") != 0)
    metric = F.when(cpa, "cpa").when(cvr, "cvr")
    pick = lambda p: F.when(cpa, F.col(f"{p}_cpa")).when(cvr, F.col(f"{p}_cvr")).otherwise(0.0)
    rows = rows.withColumns({"outcome_metric": metric, "pre_value": pick("pre"), "post_value": pick("post")}).withColumn("change", F.coalesce(div(F.col("post_value") - F.col("pre_value"), "pre_value"), F.lit(0.0)))
    better = F.when(F.col("outcome_metric") == "cpa", -F.col("change")).otherwise(F.col("change"))
    return rows.withColumns({"raw_outcome": F.when(better > 0.10, "improved").when(better < -0.10, "degraded").otherwise("neutral"), "raw_magnitude": F.abs("change")})


def pre_trends(rows: DataFrame, daily: DataFrame | Days, lookback: int = 14) -> DataFrame:
    """account_id, episode_id, slope: the daily slope of the outcome metric before the change, where it is a real direction. Days of an
    account-wide episode are summed over its campaigns first."""
    facts, account = days_of(daily, "clicks", "cost_micros", "conversions")
    keys = rows.filter("outcome_metric IS NOT NULL").select("episode_id", "account_id", "campaign_id", "change_date", F.col("outcome_metric").alias("metric"))
    near = (F.col("date") >= F.date_sub("change_date", lookback)) & (F.col("date") < F.col("change_date"))
    value = F.when(F.col("metric") == "cpa", div(F.col("cost_micros") / 1e6, "conversions")).otherwise(div("conversions", "clicks"))
    found = beside(keys, facts, account, near, lambda pairs, by: trend(pairs.select(*by, "episode_id", "metric", "date", value.alias("value")), [*by, "episode_id", "metric"]).drop("campaign_id"))
    return found.filter(F.col("classification").isin("improving", "declining", "rising", "falling")).select("account_id", "episode_id", "slope")


def _told(rows: DataFrame) -> dict[str, Column]:
    """How an episode reads: what moved, what else may have moved it, and what to look at. Numbers are rounded half up."""
    whole = lambda x: F.floor(x + 0.5).cast("long")
    text, pre, post = F.format_string, F.col("pre_value"), F.col("post_value")
    share = whole(100 * F.col("change"))
    moved = (
        F.when((F.col("pre_conversions") == 0) | (F.col("post_conversions") == 0), "too few conversions on one side to read an outcome")
        .when(F.col("outcome_metric") == "cpa", text("cost per conversion from $%d to $%d (%d%%)", whole(pre), whole(post), share))
        .when(F.col("outcome_metric") == "cvr", text("conversions per thousand clicks from %d to %d (%d%%)", whole(1000 * pre), whole(1000 * post), share))
        .otherwise("neither cost per conversion nor conversion rate moved in a way that can be read")
    )
    several = ~F.col("known") & (F.size("categories") > 1)
    doubts = F.array_compact(F.array(
        F.when(F.col("external"), "another bundle on the same campaign within the week"), F.when(several, "which of its several levers did it"),
        F.when(~F.col("trend_adjusted"), "a movement that had begun before"), F.lit("season and competition"),
    ))
    check = F.concat(F.when(F.col("external"), "Tell the overlapping bundles apart. ").otherwise(""), text("Look at the days before %s.", F.col("change_date").cast("string")))
    return {"outcome_detail": moved, "cannot_rule_out": F.array_join(doubts, "; "), "check_next": check}


def build(changes: DataFrame, daily: DataFrame | Days) -> DataFrame:
    """All episodes with outcome, trend adjustment and confidence."""
    parts = dealt(bundles(changes, daily), "bundles", "campaign_id")
    rows = dealt(_outcome(window_metrics(parts, daily)), "outcomes", "campaign_id")
    names = rows.columns
    # all bundles make the week, those with an outcome look it up
    weeks = rows.withColumn("own", _levers()).join(_weeks(parts), ["account_id", "campaign_id", "change_date"], "left").withColumn("_external", _others())
    rows = met(weeks.select(*names, "_external"), pre_trends(rows, daily), "episode_id", daily, "left")
    external = F.coalesce("_external", F.lit(False))
    rows = rows.withColumn("confounded", external | (~F.col("known") & (F.size("categories") > 1)))
    floor = F.when(F.col("outcome_metric") == "cpa", 1.0).otherwise(0.005)
    adjusted = ~F.col("confounded") & F.col("outcome_metric").isNotNull() & (F.col("pre_value") >= floor) & (F.col("post_value") >= floor)
    rows = rows.withColumn("trend_adjusted", adjusted)
    slope = F.when(adjusted, F.coalesce("slope", F.lit(0.0))).otherwise(0.0)
    rows = rows.withColumns({"trend_slope": slope, "external": external}).drop("slope", "_external")
    rows = rows.withColumn("expected_value", F.when(adjusted, F.col("pre_value") + F.col("trend_slope") * POST).otherwise(0.0))
    net = div(F.col("post_value") - F.col("expected_value"), "pre_value")
    better = F.when(F.col("outcome_metric") == "cpa", -net).otherwise(net)
    moved = F.col("post_value") - F.col("pre_value")
    share = F.when(adjusted & (F.abs(moved) > 1e-9), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("expected_value") - F.col("pre_value")) / moved))).otherwise(0.0)
    after = F.when(F.abs(net) < 0.05, "neutral").when(better > 0.10, "improved").when(better < -0.10, "degraded").otherwise("neutral")
    rows = rows.withColumns({
        "adjusted_magnitude": F.when(adjusted, F.abs(net)).otherwise(F.col("raw_magnitude")), "trend_contribution_pct": share,
        "outcome": F.when(F.col("confounded"), "confounded").when(adjusted, after).otherwise(F.col("raw_outcome")),
    })
    label, has = F.col("change_category"), lambda c: F.array_contains("categories", c)
    domain = (
        F.when(label.contains("budget") | has("budget") | label.contains("bidding"), "bidding_strategy").when(label.contains("targeting") | has("targeting_keyword"), "non_branded_search")
        .when(label.contains("creative") | label.contains("asset") | has("ad_creative") | has("asset"), "creative").otherwise("campaign_structure")
    )
    quiet = ~F.col("confounded") & (F.col("pre_conversions") != 0) & (F.col("post_conversions") != 0) & F.col("outcome_metric").isNull()
    rows = rows.withColumns(_told(rows))
    description = F.format_string("%dx %s (%s) on %s", "change_count", "change_category", "actor", F.col("change_date").cast("string"))
    return rows.withColumns({"domain": domain, "confidence_tier": F.when(quiet, "CONFIRMED").otherwise("SUGGESTIVE"), "change_description": description})


def cards(episodes: DataFrame, accounts: DataFrame, minimum: int = 10) -> DataFrame:
    """Performance of each category over its unconfounded episodes, with its share of improvements by vertical and by tier."""
    rows = episodes.filter("outcome <> 'confounded'").join(accounts.select("account_id", "vertical", "spend_tier"), "account_id", "left")
    known = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")).alias(c)
    rows = rows.select("change_category", "actor", "outcome", "account_id", known("vertical"), known("spend_tier"), F.col("adjusted_magnitude").alias("magnitude"))
    hit = lambda o: F.col("outcome") == o
    main = rows.groupBy("change_category").agg(F.count("*").alias("n"), F.countDistinct("account_id").alias("accounts"), F.mode("actor", True).alias("actor"), *[F.count_if(hit(o)).alias(o) for o in ("improved", "degraded", "neutral")],
        F.coalesce(F.avg(F.when(hit("improved"), F.col("magnitude"))), F.lit(0.0)).alias("avg_improve"), F.coalesce(F.avg(F.when(hit("degraded"), F.col("magnitude"))), F.lit(0.0)).alias("avg_degrade")).filter(F.col("n") >= minimum)
    for dim, name in (("vertical", "by_vertical"), ("spend_tier", "by_tier")):
        cells = rows.groupBy("change_category", dim).agg(F.count("*").alias("m"), F.avg(hit("improved").cast("double")).alias("share")).filter("m >= 3")
        part = cells.groupBy("change_category").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(dim, F.struct("m", "share"))))).alias(name))
        main = main.join(part, "change_category", "left")
    confidence = F.when((F.col("n") >= 30) & (F.col("accounts") >= 8), "RELIABLE").when((F.col("n") >= 10) & (F.col("accounts") >= 4), "DIRECTIONAL").otherwise("LOW")
    return main.withColumn("confidence", confidence)
