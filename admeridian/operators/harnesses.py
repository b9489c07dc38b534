"""Audits of the change, structure, account and landing-page detectors, in the shape of ``audit``: one join of claims with facts
aggregated anew, tests as columns, stacked to (detector, signal_id, test, verdict).

A claim is a signal (signal_id, account_id, campaign_id, data); nothing but its keys and the named ``data`` entries is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from admeridian.functions.windows import anchored, div, max_if, since, sum_if, within
from admeridian.operators.audit import stacked, vote
from admeridian.operators.detectors import BRANDED, GEO, MICRO_CATEGORIES, TYPED
from admeridian.operators.dimensions import brand_keyword_share

CAMPAIGN = ["account_id", "campaign_id"]


def _zero(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0))


def _datum(name: str) -> Column:
    return F.col("data")[name].try_cast("double")


# --- facts ---


def change_windows(daily: DataFrame, days: int) -> DataFrame:
    """Per campaign the last ``days`` (c), the ``days`` before (p) and what holds for both."""
    aggs = []
    for w, inside in (("c", within(days)), ("p", within(2 * days, days))):
        aggs += [F.count(F.when(inside, F.col("search_budget_lost_is"))).alias(f"{w}_lost_days"), F.avg(F.when(inside, F.col("search_budget_lost_is"))).alias(f"{w}_lost"), F.avg(F.when(inside, F.col("search_rank_lost_is"))).alias(f"{w}_rank"),
                 sum_if(inside, "cost_micros").alias(f"{w}_cost"), sum_if(inside, "conversions").alias(f"{w}_conv"), max_if(inside, "conversions").alias(f"{w}_top"),
                 F.count_if(inside & (F.col("status") == "ENABLED")).alias(f"{w}_on"), F.count_if(inside & (F.col("status") != "ENABLED")).alias(f"{w}_off")]
    both, budget = within(2 * days), F.col("daily_budget_micros")
    paid = both & (budget > 0)
    aggs += [F.countDistinct(F.when(both, F.struct("campaign_type", "bidding_strategy"))).alias("configs"), F.countDistinct(F.when(paid, budget)).alias("budgets"), F.min(F.when(paid, budget)).alias("low_budget"), F.max(F.when(paid, budget)).alias("high_budget")]
    return anchored(daily).groupBy(*CAMPAIGN).agg(*aggs, (F.datediff(F.max("date"), F.min("date")) + 1).alias("age"))


def campaign_month(daily: DataFrame) -> DataFrame:
    """Per campaign the last 30 days, its age, and the account's cost."""
    month = since(30)
    rows = anchored(daily).groupBy(*CAMPAIGN).agg(
        F.count_if(month & (F.col("status") == "ENABLED")).alias("on"), F.count_if(month & (F.col("status") != "ENABLED")).alias("off"), F.countDistinct(F.when(month, F.col("bidding_strategy"))).alias("strategies"),
        *[sum_if(month, c).alias(n) for n, c in (("value", "conversion_value"), ("conv", "conversions"), ("clicks", "clicks"), ("cost", "cost_micros"))], (F.datediff(F.max("date"), F.min("date")) + 1).alias("age"))
    return rows.join(rows.groupBy("account_id").agg(F.sum("cost").alias("account_cost")), "account_id")


def account_month(daily: DataFrame) -> DataFrame:
    """Per account the last 30 days, whole and by brand and type of campaign, and the account's age."""
    month, brand = since(30), F.lower("campaign_name").contains("brand")
    of = lambda kind: month & (F.col("campaign_type") == kind)
    sums = [sum_if(when, c).alias(f"{p}{n}") for p, when in (("", month), ("p_", of("PERFORMANCE_MAX")), ("s_", of("SEARCH"))) for n, c in (("value", "conversion_value"), ("conv", "conversions"), ("clicks", "clicks"), ("cost", "cost_micros"))]
    sums += [sum_if(month & brand, "conversions").alias("brand_conv"), sum_if(month & ~brand, "conversions").alias("other_conv")]
    return anchored(daily).groupBy("account_id").agg(*sums, (F.datediff(F.max("date"), F.min("date")) + 1).alias("age"))


# --- campaign-level ---


def _rank_over_budget() -> Column:
    lost, rank = _zero("c_lost") - _zero("p_lost"), _zero("c_rank") - _zero("p_rank")
    return vote(F.abs(rank) > F.abs(lost) + 0.05, F.lit(True))


def _covered(low: int, high: int) -> Column:
    least = F.least("c_lost_days", "p_lost_days")
    return vote(least < low, least >= high)


def budget_limited_is_change(found: DataFrame, daily: DataFrame) -> DataFrame:
    rows = found.join(change_windows(daily, 7), CAMPAIGN)
    a, b = _zero("c_cost") / 1e6, _zero("p_cost") / 1e6
    small, large = F.least(a, b), F.greatest(a, b)
    return stacked(rows, "budget_limited_is_change", {"T1": _covered(5, 6), "T2": vote(F.col("configs") > 1, F.lit(True)), "T3": _rank_over_budget(), "T4": vote((small < 50) | (large / F.greatest(small, F.lit(1.0)) >= 4), F.lit(True))})


def budget_capped_change(found: DataFrame, daily: DataFrame) -> DataFrame:
    rows = found.join(change_windows(daily, 14), CAMPAIGN)
    moved = (F.col("budgets") >= 2) & (F.col("high_budget") / F.greatest("low_budget", F.lit(1)) >= 1.25)
    return stacked(rows, "budget_capped_change", {"T1": _covered(7, 10), "T2": vote(F.col("configs") > 1, F.lit(True)), "T3": _rank_over_budget(), "T4": vote(moved, F.lit(True), F.col("budgets") == 0)})


def pmax_low_conv_volume_change(found: DataFrame, daily: DataFrame, days: int = 14) -> DataFrame:
    rows = found.join(change_windows(daily, days), CAMPAIGN)
    c = F.col
    spend, conv = div("c_cost", "p_cost"), div("c_conv", "p_conv")
    share = F.greatest(_zero(div("c_top", "c_conv")), _zero(div("p_top", "p_conv")))
    return stacked(rows, "pmax_low_conv_volume_change", {
        "T1": vote((c("c_off") > c("c_on")) | (c("p_off") > c("p_on")), (c("c_on") >= days - 2) & (c("p_on") >= days - 2)),
        "T2": vote((F.abs(_zero(spend) - _zero(conv)) <= 0.15) & (F.abs(_zero(spend) - 1) >= 0.20), F.lit(True), (_zero("p_cost") == 0) | (_zero("p_conv") == 0)),
        "T3": vote(share > 0.50, F.lit(True)), "T4": vote(F.lit(False), c("age") >= 42),
    })


def _active() -> Column:
    return vote((F.col("on") == 0) | (F.col("off") > F.col("on")), F.lit(True))


def insufficient_conversions(found: DataFrame, daily: DataFrame) -> DataFrame:
    rows = found.join(campaign_month(daily), CAMPAIGN)
    other = F.coalesce(F.upper(F.col("data")["strategy"]), F.lit("")) != "TARGET_ROAS"
    return stacked(rows, "insufficient_conv", {"T1": _active(), "T2": vote(F.col("strategies") > 1, F.lit(True)), "T3": vote((_zero("value") >= 5000) & (_zero("conv") >= 8), _zero("value") < 500, other), "T4": vote(F.col("age") < 14, F.lit(True))})


def pmax_low_volume(found: DataFrame, daily: DataFrame) -> DataFrame:
    rows = found.join(campaign_month(daily), CAMPAIGN)
    rich = (div("value", "conv") >= 500) & (F.col("conv") >= 10)
    return stacked(rows, "pmax_low_volume", {"T1": _active(), "T2": vote(rich, F.lit(True), _zero("conv") == 0), "T3": vote(_zero(div("cost", "account_cost")) < 0.05, F.lit(True), _zero("account_cost") == 0), "T4": vote(F.col("age") < 21, F.lit(True))})


def search_terms_waste(found: DataFrame, daily: DataFrame) -> DataFrame:
    rows = found.join(campaign_month(daily), CAMPAIGN)
    clicks, share, conv = _zero(_datum("waste_clicks")), _zero(_datum("waste_share")), _zero("conv")
    # a campaign that barely converts has nothing that the terms could have helped
    helped = F.when(conv < 5, "confirm").when(_zero(div("conv", "clicks")) >= 0.05, "disconfirm").otherwise("inconclusive")
    return stacked(rows, "search_terms_waste", {"T1": vote(clicks < 20, clicks >= 50), "T2": vote(share < 0.15, share >= 0.30), "T3": helped})


# --- account-level ---

#: Resource types whose change is one of substance.
SUBSTANTIVE = ["CAMPAIGN", "CAMPAIGN_BUDGET", "CAMPAIGN_CRITERION", "AD_GROUP", "AD_GROUP_CRITERION", "AD_GROUP_AD", "AD", "BIDDING_STRATEGY"]


def _since_timestamp(days: int) -> Column:
    return F.col("change_timestamp") >= F.date_sub("anchor", days).cast("timestamp")


def _change_month(changes: DataFrame, daily: DataFrame) -> DataFrame:
    anchor = daily.agg(F.max("date").alias("anchor"))  # one row
    auto = F.col("actor") == "auto_applied"
    tracked = F.upper("resource_type").contains("CONVERSION") | F.upper("change_type").contains("CONVERSION")
    month = _since_timestamp(30)
    return changes.crossJoin(F.broadcast(anchor)).groupBy("account_id").agg(F.count_if(month).alias("n_changes"), F.count_if(month & auto).alias("n_auto"), F.count_if(month & auto & F.col("resource_type").isin(SUBSTANTIVE)).alias("n_substantive"), F.count_if(_since_timestamp(60) & F.coalesce(tracked, F.lit(False))).alias("n_tracking"))


def auto_applied(found: DataFrame, changes: DataFrame, daily: DataFrame) -> DataFrame:
    rows = found.join(_change_month(changes, daily), "account_id", "left")
    n, share = _zero(_datum("count")), div("n_substantive", "n_auto")
    return stacked(rows, "auto_applied", {"T1": vote(n < 5, n >= 10), "T2": vote(share < 0.2, share >= 0.5, share.isNull()), "T3": vote(F.lit(False), div("n_auto", "n_changes") >= 0.5)})


def _primaries(actions: DataFrame) -> DataFrame:
    return actions.filter(F.col("primary_for_goal") & (F.col("status") == "ENABLED"))


def duplicate_conversions(found: DataFrame, actions: DataFrame, daily: DataFrame) -> DataFrame:
    per = _primaries(actions).groupBy("account_id", "category").agg(F.count("*").alias("n")).groupBy("account_id").agg(F.count("*").alias("n_categories"), F.max("n").alias("most"))
    rows = found.join(per, "account_id", "left").join(account_month(daily), "account_id", "left")
    cvr, worth = div("conv", "clicks"), div("value", "conv")
    return stacked(rows, "duplicate_conversions", {"T1": vote((F.col("n_categories") >= 3) & (F.col("most") < 2), F.col("most") >= 2, F.col("most").isNull()), "T2": vote(cvr < 0.20, cvr > 0.50, cvr.isNull()), "T3": vote(F.lit(False), worth < 1, worth.isNull() | (_zero("value") == 0))})


def over_segmentation(found: DataFrame, daily: DataFrame) -> DataFrame:
    running = anchored(daily).filter(since(30) & (F.col("status") == "ENABLED"))
    campaigns = running.groupBy("account_id", "campaign_id", "campaign_name").agg(F.sum("conversions").alias("conv")).filter("conv < 30 AND conv > 0")
    hint = lambda *p: F.avg(F.greatest(*[F.rlike(F.coalesce("campaign_name", F.lit("")), F.lit(x)).cast("double") for x in (*p, p[0])]))
    names = campaigns.groupBy("account_id").agg(hint(GEO).alias("geo"), hint(TYPED, BRANDED).alias("split"))
    spend = running.groupBy("account_id", "campaign_id").agg(F.sum("cost_micros").alias("cost"), F.sum("conversions").alias("conv"))
    spend = spend.groupBy("account_id").agg(div(F.sum(F.when(F.col("conv") < 30, F.col("cost")).otherwise(0)), F.sum("cost")).alias("share"))
    rows = found.join(names, "account_id", "left").join(spend, "account_id", "left")
    c = F.col
    return stacked(rows, "over_segmentation", {"T1": vote(c("geo") >= 0.5, F.lit(True), c("geo").isNull()), "T2": vote(c("split") >= 0.6, F.lit(True), c("split").isNull()), "T3": vote(c("share") < 0.10, c("share") >= 0.30, c("share").isNull())})


def pmax_conversion_inflation(found: DataFrame, actions: DataFrame, daily: DataFrame) -> DataFrame:
    ways = F.max(F.col("category").isin(MICRO_CATEGORIES) | (F.col("counting_type") == "MANY_PER_CLICK"))
    rows = found.join(_primaries(actions).groupBy("account_id").agg(ways.alias("mechanism")), "account_id", "left").join(account_month(daily), "account_id", "left")
    c = F.col
    worth, other = div("p_value", "p_conv"), div("s_value", "s_conv")
    worthless = (_zero(worth) == 0) | (_zero(other) == 0)
    cvr, base = _zero(div("p_conv", "p_clicks")), _zero(div("s_conv", "s_clicks"))
    return stacked(rows, "pmax_conversion_inflation", {
        "T1": vote((_zero("p_conv") < 15) | (_zero("s_conv") < 5), F.lit(True)), "T2": vote(~c("mechanism"), c("mechanism"), c("mechanism").isNull()),
        "T3": vote(div(worth, other) >= 0.8, div(worth, other) < 0.5, worthless), "T4": vote((cvr < 0.10) & (base < 0.03), cvr > 0.50),
    })


def _value_justifies() -> Column:
    roas = div("value", F.col("cost") / 1e6)
    return vote(_zero(roas) >= 3, _zero(roas) < 1, _zero("value") <= 0)


def cross_account_outlier(found: DataFrame, daily: DataFrame) -> DataFrame:
    rows = found.join(account_month(daily), "account_id", "left")
    segment = F.coalesce(F.col("data")["segment"], F.lit("global"))
    own = segment.isin("vertical+tier", "vertical")
    return stacked(rows, "cross_account_outlier", {"T1": _value_justifies(), "T2": vote(~own & (segment != "spend_tier"), own), "T3": vote(F.col("age") < 30, F.lit(True), F.col("age").isNull()), "T4": vote(F.lit(False), _zero("conv") >= 100)})


def vertical_cpa_benchmark(found: DataFrame, daily: DataFrame) -> DataFrame:
    rows = found.join(account_month(daily), "account_id", "left")
    return stacked(rows, "vertical_cpa_benchmark", {"T1": _value_justifies(), "T2": vote(F.lit(False), _zero(_datum("ratio")) >= 5), "T3": vote(F.col("age") < 30, F.lit(True), F.col("age").isNull())})


def brand_nonbrand(found: DataFrame, accounts: DataFrame, keywords: DataFrame, counts: DataFrame, changes: DataFrame, daily: DataFrame) -> DataFrame:
    named = F.lower("campaign_name").contains("brand")
    some = lambda when: F.max(F.coalesce(when, F.lit(False)))
    recent = anchored(daily).filter(since(30)).select("account_id", "campaign_id", "campaign_name").distinct()
    shares = brand_keyword_share(accounts, keywords).select("account_id", "campaign_id", "brand_share").join(recent, CAMPAIGN)
    share = F.col("brand_share")
    naming = shares.groupBy("account_id").agg(some((named & (share < 0.30)) | (~named & (share > 0.30))).alias("name_wrong"), some((named & (share >= 0.50)) | (~named & (share <= 0.15))).alias("name_right"))
    kinds = counts.drop("campaign_name").filter("keyword_count >= 3").join(recent, CAMPAIGN)
    tight, broad = (F.col("exact_count") + F.col("phrase_count")) / F.col("keyword_count"), F.col("broad_count") / F.col("keyword_count")
    structure = kinds.groupBy("account_id").agg(some((named & (broad > 0.50)) | (~named & (tight > 0.70))).alias("match_wrong"), some(named & (tight >= 0.70)).alias("match_right"))
    rows = found.join(naming, "account_id", "left").join(structure, "account_id", "left").join(account_month(daily), "account_id", "left").join(_change_month(changes, daily), "account_id", "left")
    c = F.col
    roas = _zero(_datum("brand_roas"))
    return stacked(rows, "brand_nonbrand", {
        "T1": vote(c("name_wrong"), c("name_right")), "T2": vote(c("match_wrong"), c("match_right")), "T3": vote(_zero("other_conv") < 10, (c("other_conv") >= 30) & (_zero("brand_conv") >= 30)),
        "T4": vote(_zero("n_tracking") > 0, F.lit(True)), "T5": vote(roas > 25, roas <= 15),
    })


# --- landing pages ---

RECENT, BASE, MIN_SESSIONS, USUAL_ENGAGEMENT = 7, 21, 50, 0.526
PAGE = ["account_id", "landing_page"]


def page_windows(pages: DataFrame) -> DataFrame:
    """Per page its sessions, engagement and bounce in the last week and the three weeks before, and by device over all days."""
    span, recent = within(RECENT + BASE), within(RECENT)
    base = within(RECENT + BASE, RECENT)
    device = lambda d: F.col("device") == d
    bounced = F.col("sessions") - F.col("engaged_sessions")
    part = lambda when: div(sum_if(when, "engaged_sessions"), sum_if(when, "sessions"))
    bounce = lambda when: div(sum_if(when, bounced), sum_if(when, "sessions"))
    return anchored(pages).groupBy(*PAGE).agg(
        sum_if(span, "sessions").alias("all_sessions"), sum_if(recent, "sessions").alias("rs"), sum_if(base, "sessions").alias("bs"), part(recent).alias("re"), part(base).alias("be"),
        *[sum_if(device(d), "sessions").alias(f"{d[0]}s") for d in ("mobile", "desktop")], *[part(device(d)).alias(f"{d[0]}e") for d in ("mobile", "desktop")],
        *[bounce(device(d) & w).alias(f"{d[0]}_{n}") for d in ("mobile", "desktop") for n, w in (("recent", recent), ("base", base))], sum_if(device("mobile") & recent, "sessions").alias("mrs"))


def with_other_pages(facts: DataFrame) -> DataFrame:
    """``shift``: the median change of engagement over the account's other pages. The median without one page lies at the middle
    ranks of all pages, or one further where the page itself stands before them: four values of an account are enough."""
    busy = ~F.col("landing_page").isin("(not set)", "(other)", "") & (F.col("all_sessions") >= MIN_SESSIONS)
    rows = facts.withColumn("_move", F.when(busy, F.col("re") - F.col("be")))
    w = Window.partitionBy("account_id")
    rows = rows.withColumns({"_m": F.count("_move").over(w), "_r": F.when(F.col("_move").isNotNull(), F.row_number().over(w.orderBy(F.col("_move").asc_nulls_last(), "landing_page")))})
    low = F.floor(F.col("_m") / 2)
    middle = rows.filter(F.col("_r").between(low - 1, low + 2)).groupBy("account_id").agg(F.map_from_entries(F.collect_list(F.struct("_r", "_move"))).alias("_at"))
    n = F.col("_m") - F.col("_r").isNotNull().cast("int")
    value = lambda q: F.try_element_at("_at", (q + F.coalesce((q >= F.col("_r")).cast("int"), F.lit(0))).cast("int"))
    shift = F.when(n > 0, (value(F.floor((n + 1) / 2)) + value(F.floor(n / 2) + 1)) / 2)
    return rows.join(middle, "account_id", "left").withColumn("shift", shift).drop("_move", "_m", "_r", "_at")


def _on_page(found: DataFrame, facts: DataFrame) -> DataFrame:
    return found.withColumn("landing_page", F.col("data")["landing_page"]).join(facts, PAGE, "left")


def _site_wide() -> Column:
    return vote(F.col("shift") <= -0.10, F.lit(True))


def _enough() -> Column:
    return vote(_zero("rs") < MIN_SESSIONS, F.lit(True))


def ga4_engagement_drop(found: DataFrame, facts: DataFrame) -> DataFrame:
    return stacked(_on_page(found, facts), "ga4_engagement_drop", {"T1": _enough(), "T2": _site_wide(), "T3": vote(F.col("re") >= 0.55, F.col("re") < USUAL_ENGAGEMENT)})


def ga4_session_duration_collapse(found: DataFrame, facts: DataFrame) -> DataFrame:
    surge = div(F.col("rs") / RECENT, F.col("bs") / BASE)
    return stacked(_on_page(found, facts), "ga4_session_duration_collapse", {"T1": _enough(), "T2": vote(surge >= 1.5, F.lit(True), (_zero("rs") == 0) | (_zero("bs") == 0)), "T3": _site_wide()})


def ga4_mobile_engagement_gap(found: DataFrame, facts: DataFrame) -> DataFrame:
    gap = _zero(F.col("de") - F.col("me"))
    return stacked(_on_page(found, facts), "ga4_mobile_engagement_gap", {"T1": vote(F.least(_zero("ms"), _zero("ds")) < 100, F.lit(True)), "T2": vote(gap < 0.25, gap >= 0.30), "T3": vote(F.lit(False), F.col("me") < 0.40)})


def ga4_mobile_bounce_regression(found: DataFrame, facts: DataFrame) -> DataFrame:
    steady = F.abs(F.col("d_recent") - F.col("d_base")) <= 0.05
    return stacked(_on_page(found, facts), "ga4_mobile_bounce_regression", {"T1": vote(_zero("mrs") < 50, F.lit(True)), "T2": vote(~F.coalesce(steady, F.lit(False)), F.lit(True)), "T3": vote(F.lit(False), F.col("m_recent") - F.col("m_base") >= 0.15)})


# --- all of them ---

#: Harness by the signal type it audits, and the tables it reads beside the signals.
HARNESSES = {
    "budget_limited_is_change": (budget_limited_is_change, "daily"), "budget_capped_change": (budget_capped_change, "daily"), "pmax_low_conv_volume_change": (pmax_low_conv_volume_change, "daily"),
    "insufficient_conversions_for_strategy": (insufficient_conversions, "daily"), "pmax_low_conv_volume": (pmax_low_volume, "daily"), "search_terms_waste": (search_terms_waste, "daily"), "auto_applied_changes": (auto_applied, "changes daily"),
    "duplicate_primary_conversions": (duplicate_conversions, "actions daily"), "over_segmentation": (over_segmentation, "daily"), "pmax_conversion_inflation": (pmax_conversion_inflation, "actions daily"),
    "cross_account_cpa_outlier": (cross_account_outlier, "daily"), "vertical_cpa_benchmark": (vertical_cpa_benchmark, "daily"), "roas_contamination": (brand_nonbrand, "accounts keywords counts changes daily"),
    "ga4_engagement_drop": (ga4_engagement_drop, "pages"), "ga4_session_duration_collapse": (ga4_session_duration_collapse, "pages"), "ga4_mobile_engagement_gap": (ga4_mobile_engagement_gap, "pages"), "ga4_mobile_bounce_regression": (ga4_mobile_bounce_regression, "pages"),
}


def run(found: DataFrame, **tables: DataFrame) -> DataFrame:
    """All harnesses whose tables are given (``pages`` as made by ``with_other_pages``), each over its signals in ``found``."""
    out = None
    for kind, (make, needed) in HARNESSES.items():
        if set(needed.split()) <= set(tables):
            part = make(found.filter(F.col("signal_type") == kind), *[tables[t] for t in needed.split()])
            out = part if out is None else out.unionByName(part)
    return out
