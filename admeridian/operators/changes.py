"""Change detectors: two adjacent windows of equal length, ``(anchor - 2N, anchor - N]`` and ``(anchor - N, anchor]``.

The current window is grouped by campaign and name, the prior one by campaign; both come from one conditional aggregate, the
prior part summed over the names by a window of the same campaign.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from admeridian.functions.config import THRESHOLDS
from admeridian.functions.signals import signals, text
from admeridian.functions.windows import anchored, div, within
from admeridian.operators.detectors import BIDDING, CAMPAIGN, LANDING, MICROS, PMAX


def adjacent(daily: DataFrame, days: int, measures: dict[str, tuple[str, Column]], where: Column | None = None) -> DataFrame:
    """``cur_x`` and ``prior_x`` of each measure: name -> ("sum" | "max" | "count", value)."""
    rows = anchored(daily).filter(within(2 * days))
    if where is not None:
        rows = rows.filter(where)
    how = {"sum": F.sum, "max": F.max, "count": F.count}
    current = within(days)
    aggs = [how[fn](F.when(part, v)).alias(f"{p}_{name}") for p, part in (("cur", current), ("prior", ~current)) for name, (fn, v) in measures.items()]
    rows = rows.groupBy(*CAMPAIGN).agg(*aggs)
    w = Window.partitionBy("account_id", "campaign_id")
    return rows.withColumns({f"prior_{n}": (F.max if fn == "max" else F.sum)(f"prior_{n}").over(w) for n, (fn, _) in measures.items()})


def _budget_change(daily: DataFrame, kind: str, given: dict) -> DataFrame:
    th = THRESHOLDS[kind] | given
    lost = F.col("search_budget_lost_is")
    rows = adjacent(daily, th["window_days"], {"lost": ("sum", lost), "days": ("count", lost), "cost": ("sum", F.col("cost_micros"))}, lost.isNotNull())
    rows = rows.withColumns({"cur": div("cur_lost", "cur_days"), "prior": div("prior_lost", "prior_days")}).withColumn("delta", F.col("cur") - F.col("prior"))
    hit = rows.filter((F.col("cur_days") >= th["min_days_with_data"]) & (F.col("prior_days") >= th["min_days_with_data"]) & (F.col("cur_cost") >= th["min_cost_micros"]) & (F.abs("delta") >= th["min_delta_pp"]))
    direction = F.when(F.col("delta") > 0, F.lit("worsening")).otherwise("improving")
    return signals(hit, kind, BIDDING, "info", F.col("cur"), F.col("prior"), text("%s: the budget presses %s", "campaign_name", direction), {"delta_pp": "delta", "direction": direction}, key=("campaign_name",))


def budget_capped_change(daily: DataFrame, **given) -> DataFrame:
    return _budget_change(daily, "budget_capped_change", given)


def budget_limited_is_change(daily: DataFrame, **given) -> DataFrame:
    return _budget_change(daily, "budget_limited_is_change", given)


def pmax_low_volume_change(daily: DataFrame, **given) -> DataFrame:
    th = THRESHOLDS["pmax_low_conv_volume_change"] | given
    rows = adjacent(daily, th["window_days"], {"conv": ("sum", F.col("conversions")), "cost": ("sum", F.col("cost_micros")), "days": ("count", F.lit(1))}, (F.col("campaign_type") == "PERFORMANCE_MAX") & (F.col("status") == "ENABLED"))
    rows = rows.withColumn("delta", F.col("cur_conv") - F.col("prior_conv")).withColumn("pct", div("delta", "prior_conv"))
    hit = rows.filter((F.col("cur_days") >= th["min_days_with_data"]) & (F.col("prior_days") >= th["min_days_with_data"]) & (F.col("cur_cost") >= th["min_cost_micros"]) & (F.col("prior_conv") > 0) & (F.abs("delta") >= th["min_abs_delta"]) & (F.abs("pct") >= th["min_pct_delta"]))
    direction = F.when(F.col("delta") > 0, F.lit("improving")).otherwise("worsening")
    return signals(hit, "pmax_low_conv_volume_change", PMAX, "info", F.col("cur_conv"), F.col("prior_conv"), text("%s: PMax conversions are %s", "campaign_name", direction), {"pct_delta": "pct", "direction": direction}, key=("campaign_name",))


def cvr_change(daily: DataFrame, **given) -> DataFrame:
    th = THRESHOLDS["cvr_change"] | given
    rows = adjacent(daily, th["window_days"], {"conv": ("sum", F.col("conversions")), "clicks": ("sum", F.col("clicks")), "top": ("max", F.col("clicks"))})
    rows = rows.withColumns({"cur": div("cur_conv", "cur_clicks"), "prior": div("prior_conv", "prior_clicks")}).withColumn("pct", div(F.col("cur") - F.col("prior"), "prior"))
    share = th["max_single_day_click_share"]
    hit = rows.filter((F.col("cur_clicks") >= th["min_current_clicks"]) & (F.col("cur_top") <= share * F.col("cur_clicks")) & (F.col("prior_clicks") >= th["min_prior_clicks"]) & (F.col("prior_conv") >= th["min_prior_conv"]) & (F.col("prior_top") <= share * F.col("prior_clicks")) & (F.col("prior") >= th["min_prior_cvr"]) & (F.abs("pct") >= th["min_pct_delta"]))
    direction = F.when(F.col("pct") > 0, F.lit("improving")).otherwise("worsening")
    return signals(hit, "cvr_change", LANDING, "info", F.col("cur"), F.col("prior"), text("%s: conversion rate %s", "campaign_name", direction), {"pct_delta": "pct", "direction": direction}, key=("campaign_name",))


def cpa_change(daily: DataFrame, **given) -> DataFrame:
    th = THRESHOLDS["cpa_change"] | given
    cost = F.col("cost_micros")
    rows = adjacent(daily, th["window_days"], {"conv": ("sum", F.col("conversions")), "cost": ("sum", cost), "top": ("max", cost), "active": ("count", F.when(cost > 0, F.col("date")))})
    rows = rows.withColumns({"cur": div("cur_cost", "cur_conv") / MICROS, "prior": div("prior_cost", "prior_conv") / MICROS}).withColumn("pct", div(F.col("cur") - F.col("prior"), "prior"))
    both = F.lit(True)
    for p in ("cur", "prior"):
        both = both & (F.col(f"{p}_conv") >= th["min_conv_per_window"]) & (F.col(f"{p}_active") >= th["min_active_days"]) & (F.col(f"{p}_cost") > 0)
    hit = rows.filter(both & (div("cur_top", "cur_cost") <= th["max_single_day_share"]) & (F.abs("pct") >= th["min_pct_delta"]))
    direction = F.when(F.col("pct") > 0, F.lit("worsening")).otherwise("improving")
    return signals(hit, "cpa_change", BIDDING, "info", F.col("cur"), F.col("prior"), text("%s: cost per conversion %s", "campaign_name", direction), {"pct_delta": "pct", "direction": direction}, key=("campaign_name",))


def run_all(daily: DataFrame) -> DataFrame:
    return budget_capped_change(daily).unionByName(budget_limited_is_change(daily)).unionByName(pmax_low_volume_change(daily)).unionByName(cvr_change(daily)).unionByName(cpa_change(daily))
