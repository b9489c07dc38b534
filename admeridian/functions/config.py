"""Thresholds, skip rules and benchmarks. They must equal those of the analyses they reproduce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLDS: dict[str, dict] = {
    "brand_nonbrand_contamination": {"window_days": 30, "min_brand_cost_30d": 100, "min_nonbrand_cost_30d": 100, "min_brand_conversions_30d": 10, "min_nonbrand_conversions_30d": 10, "brand_roas_min": 10, "brand_roas_max": 25, "nonbrand_roas_max": 2.0, "blended_roas_min": 5, "brand_token_match_pct_min": 0.30},
    "budget_limited_is": {"window_days": 7, "avg_budget_lost_is_min": 0.35, "total_cost_micros_min": 500_000_000, "min_conv_in_window": 5},
    "cvr_drop": {"current_window_days": 7, "prior_window_days": 7, "cvr_drop_ratio": 0.7, "prior_clicks_min": 100, "current_clicks_min": 100, "prior_conv_min": 10, "prior_cvr_min": 0.01},
    "cvr_change": {"window_days": 7, "min_pct_delta": 0.15, "min_current_clicks": 50, "min_prior_clicks": 50, "min_prior_conv": 5, "min_prior_cvr": 0.005, "max_single_day_click_share": 0.5},
    "cpa_change": {"window_days": 7, "min_pct_delta": 0.25, "min_conv_per_window": 5, "min_active_days": 3, "max_single_day_share": 0.50},
    "cpa_spike": {"recent_window_days": 7, "baseline_window_days": 30, "recent_cpa_multiplier": 3.0, "recent_conv_min": 5, "baseline_conv_min": 3, "recent_active_days_min": 3, "max_single_day_share_max": 0.50, "aov_lift_max": 2.0, "use_volatility_multiplier": False},
    "budget_capped": {"window_days": 14, "avg_budget_lost_is_min": 0.30, "min_days_capped": 7, "min_conv_in_window": 15},
    "budget_limited_is_change": {"window_days": 7, "min_delta_pp": 0.10, "min_days_with_data": 5, "min_cost_micros": 250_000_000},
    "budget_capped_change": {"window_days": 14, "min_delta_pp": 0.10, "min_days_with_data": 5, "min_cost_micros": 0},
    "auto_applied_changes": {"window_days": 30, "min_changes": 5, "critical_count": 50},
    "duplicate_primary_conversions": {"same_category_min": 2, "inflation_cvr_min": 0.5, "inflation_value_per_conv_max": 1.0},
    "over_segmentation": {"window_days": 30, "per_campaign_conv_min": 30, "account_total_conv_min": 100, "account_campaigns_min": 5, "starving_share_min": 0.5, "intentional_geo_share_max": 0.5, "intentional_type_brand_share_max": 0.6},
    "insufficient_conversions_for_strategy": {"window_days": 30, "monthly_conv_min": 15, "min_campaign_age_days": 14, "min_spend_30d": 500, "troas_value_sufficient": 5000, "troas_conv_floor": 8, "strategies": ["TARGET_CPA", "TARGET_ROAS"]},
    "pmax_low_conv_volume": {"window_days": 30, "monthly_conv_min": 30, "monthly_cost_micros_min": 1_000_000_000, "min_campaign_age_days": 21, "high_value_per_conv_exempt": 500, "high_value_conv_min": 10},
    "pmax_low_conv_volume_change": {"window_days": 14, "min_pct_delta": 0.25, "min_abs_delta": 5, "min_days_with_data": 7, "min_cost_micros": 500_000_000},
    "pmax_conversion_inflation": {"window_days": 30, "cvr_ratio_min": 3.0, "min_pmax_clicks": 200, "min_search_clicks": 200, "min_pmax_conv": 15, "min_search_conv": 10},
    "search_terms_waste": {"window_days": 30, "min_term_cost_micros": 50_000_000, "min_term_impressions": 100, "min_total_waste_micros": 100_000_000, "waste_share_min": 0.15, "min_waste_clicks": 30},
    "cross_account_cpa_outlier": {"window_days": 30, "min_conversions": 50, "min_cost_micros": 5_000_000_000, "z_threshold": 2.0, "min_peers": 5},
    "vertical_cpa_benchmark": {"window_days": 30, "min_conversions": 30, "min_cost_micros": 3_000_000_000, "high_multiple": 3.0},
}

#: (detector, condition column, condition value, overridden values or None to skip the account), first to last.
OVERRIDES: list[tuple[str, str, str, dict | None]] = [
    ("brand_nonbrand_contamination", "business_type", "local", {"nonbrand_roas_max": 0.5}),
    ("brand_nonbrand_contamination", "business_type", "lead_gen", None),
    ("budget_limited_is", "business_type", "nonprofit", None),
    ("budget_capped", "business_type", "nonprofit", None),
    ("budget_limited_is_change", "business_type", "nonprofit", None),
    ("insufficient_conversions_for_strategy", "business_type", "nonprofit", None),
    ("insufficient_conversions_for_strategy", "business_type", "app", None),
    ("pmax_low_conv_volume", "business_type", "nonprofit", None),
    ("pmax_low_conv_volume_change", "business_type", "nonprofit", None),
    ("pmax_conversion_inflation", "business_type", "nonprofit", None),
]

BENCHMARK_CPA = {
    "apparel": 108, "collectibles": 91, "baby_kids": 91, "smart_home": 95, "food_beverage": 29, "supplements": 74, "fitness": 74, "beauty": 73, "pets": 30, "automotive": 31,
    "sporting_goods": 35, "outdoors_fishing": 35, "furniture": 141, "home_goods": 107, "home_improvement": 107, "appliances": 107, "pool_spa": 107, "home_services": 107, "energy": 107,
    "healthcare": 43, "medical_cosmetic": 43, "dental": 86, "sports_dental": 86, "education": 55, "education_test_prep": 55, "real_estate": 77, "legal": 160, "finance": 136,
    "fintech_crypto": 136, "tax_services": 60, "hospitality_country_club": 60, "software": 109, "agency_marketing": 109, "b2b_other": 109, "safety_gear": 79, "safety_industrial": 79, "industrial_supply": 79,
}

#: Monthly index of the cost per conversion, January first.
SEASONAL_DEFAULT = [1.12, 1.08, 1.04, 1.0, 0.98, 0.96, 0.95, 0.96, 0.99, 1.02, 0.93, 0.9]
SEASONAL = {
    "apparel": [1.35, 1.25, 1.15, 1.0, 0.95, 0.9, 0.85, 0.9, 0.95, 1.0, 0.8, 0.75],
    "beauty": [1.3, 1.2, 1.1, 1.0, 0.95, 0.92, 0.9, 0.92, 0.98, 1.02, 0.82, 0.78],
    "collectibles": [1.3, 1.18, 1.08, 1.0, 0.96, 0.93, 0.92, 0.95, 1.0, 1.05, 0.78, 0.72],
    "baby_kids": [1.28, 1.18, 1.08, 1.0, 0.96, 0.93, 0.92, 0.96, 1.0, 1.02, 0.82, 0.78],
    "furniture": [1.2, 1.12, 1.05, 1.0, 1.02, 1.0, 0.98, 0.96, 0.98, 1.0, 0.88, 0.85],
    "home_goods": [1.2, 1.12, 1.05, 1.0, 1.0, 0.98, 0.96, 0.96, 0.98, 1.0, 0.85, 0.82],
    "food_beverage": [1.15, 1.08, 1.04, 1.0, 0.98, 0.96, 0.95, 0.96, 1.0, 1.02, 0.9, 0.88],
    "pool_spa": [1.25, 1.15, 1.0, 0.9, 0.85, 0.85, 0.9, 0.95, 1.05, 1.15, 1.2, 1.25],
    "sporting_goods": [1.1, 1.05, 1.0, 0.98, 0.96, 0.95, 0.95, 0.96, 0.98, 1.0, 0.88, 0.85],
    "healthcare": [0.95, 0.98, 1.0, 1.02, 1.02, 1.03, 1.05, 1.03, 1.0, 0.98, 1.0, 1.05],
    "legal": [0.95, 0.98, 1.0, 1.02, 1.02, 1.03, 1.05, 1.03, 1.0, 0.98, 1.02, 1.08],
}


def case(column: Column, values: dict, default=None) -> Column:
    """A literal look-up; the table is as large as the source text that holds it."""
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    found = F.try_element_at(table, column)
    return found if default is None else F.coalesce(found, F.lit(default))


def skipped(accounts: DataFrame) -> DataFrame:
    """(signal_type, account_id) pairs that a skip override silences."""
    rows = None
    for detector, column, value, changed in OVERRIDES:
        if changed is None:
            own = accounts.filter(F.col(column) == value).select(F.lit(detector).alias("signal_type"), "account_id")
            rows = own if rows is None else rows.unionByName(own)
    return rows.distinct()


def thresholds_table(spark: SparkSession) -> DataFrame:
    """detector, name, value of all numeric defaults."""
    rows = [(d, k, float(v)) for d, t in THRESHOLDS.items() for k, v in t.items() if isinstance(v, int | float) and not isinstance(v, bool)]
    return spark.createDataFrame(rows, "detector string, name string, value double")


def resolve_thresholds(accounts: DataFrame) -> DataFrame:
    """account_id, detector, name, value, skip: the defaults with the account's overrides, the last matching one first."""
    spark = accounts.sparkSession
    changes = [(d, c, v, k, float(x)) for d, c, v, t in OVERRIDES if t for k, x in t.items()]
    over = spark.createDataFrame([(i, *r) for i, r in enumerate(changes)], "place int, detector string, kind string, wanted string, name string, changed double")
    base = accounts.select("account_id", "business_type", "spend_tier", "vertical").crossJoin(F.broadcast(thresholds_table(spark)))
    own = F.when(F.col("kind") == "business_type", F.col("business_type")).when(F.col("kind") == "spend_tier", F.col("spend_tier")).otherwise(F.col("vertical"))
    hits = base.join(F.broadcast(over), ["detector", "name"]).filter(own == F.col("wanted")).groupBy("account_id", "detector", "name").agg(F.max_by("changed", "place").alias("changed"))
    skips = skipped(accounts).withColumnsRenamed({"signal_type": "detector"}).withColumn("skip", F.lit(True))
    out = base.join(hits, ["account_id", "detector", "name"], "left").join(skips, ["account_id", "detector"], "left")
    return out.select("account_id", "detector", "name", F.coalesce("changed", "value").alias("value"), F.coalesce("skip", F.lit(False)).alias("skip"))


def benchmark(vertical: Column) -> Column:
    return case(vertical, {k: float(v) for k, v in BENCHMARK_CPA.items()})


def seasonal_index(vertical: Column, month: Column) -> Column:
    curves = F.create_map(*[x for k, v in SEASONAL.items() for x in (F.lit(k), F.array(*[F.lit(float(i)) for i in v]))])
    default = F.array(*[F.lit(float(i)) for i in SEASONAL_DEFAULT])
    return F.element_at(F.coalesce(F.try_element_at(curves, vertical), default), month)
