"""What kinds of change do in which segments: rates, intervals, comparison with the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admeridian.functions.stats import normal_two_sided, two_proportion_z, wilson

DIMENSIONS = ("vertical", "spend_tier", "business_type")
RELIABLE, DIRECTIONAL, MIN_ACCOUNTS, MIN_SEGMENT_ACCOUNTS, ALPHA = 30, 10, 4, 3, 0.05


def clean_episodes(episodes: DataFrame, accounts: DataFrame) -> DataFrame:
    dims = [F.coalesce(F.nullif(F.col(d), F.lit("")), F.lit("unknown")).alias(d) for d in DIMENSIONS]
    return episodes.filter("outcome NOT IN ('confounded', 'pending')").join(accounts.select("account_id", *DIMENSIONS), "account_id", "left").select("episode_id", "account_id", "change_category", "actor", "outcome", *dims)


def _sliced(clean: DataFrame) -> DataFrame:
    """One row per episode and dimension with a known value; no more than three times the episodes."""
    slices = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in DIMENSIONS])
    return clean.select("account_id", "change_category", "actor", "outcome", F.explode(slices).alias("s")).select("account_id", "change_category", "actor", "outcome", "s.*").filter("value <> 'unknown'")


def enumerate_segments(clean: DataFrame) -> DataFrame:
    return _sliced(clean).groupBy("dimension", "value").agg(F.countDistinct("account_id").alias("n_accounts"), F.count("*").alias("n_episodes")).filter(F.col("n_accounts") >= MIN_SEGMENT_ACCOUNTS)


def _cells(clean: DataFrame) -> DataFrame:
    hit = lambda o: F.count_if(F.col("outcome") == o)
    return _sliced(clean).groupBy("dimension", "value", "change_category", "actor").agg(F.count("*").alias("n"), F.countDistinct("account_id").alias("n_accounts"), hit("degraded").alias("degraded"), hit("improved").alias("improved"))


def confidence(n: Column, accounts: Column) -> Column:
    return F.when((n >= RELIABLE) & (accounts >= 8), "RELIABLE").when((n >= DIRECTIONAL) & (accounts >= MIN_ACCOUNTS), "DIRECTIONAL").otherwise("LOW")


def patterns(clean: DataFrame, minimum: int = DIRECTIONAL) -> DataFrame:
    cells = _cells(clean).filter(F.col("n") >= minimum)
    out = cells.withColumns({"neutral": F.col("n") - F.col("degraded") - F.col("improved"), "confidence": confidence(F.col("n"), F.col("n_accounts"))})
    for k in ("degraded", "improved"):
        low, high = wilson(F.col(k), F.col("n"))
        out = out.withColumns({f"{k}_rate": F.col(k) / F.col("n"), f"{k}_low": low, f"{k}_high": high})
    return out


def comparisons(clean: DataFrame, minimum: int = DIRECTIONAL) -> DataFrame:
    """Each cell against the same change outside its segment: the rest is the population less the cell."""
    whole = clean.groupBy("change_category", "actor").agg(F.count("*").alias("n_all"), F.count_if(F.col("outcome") == "degraded").alias("k_all"))
    rows = _cells(clean).filter(F.col("n") >= minimum).join(whole, ["change_category", "actor"]).withColumns({"n_rest": F.col("n_all") - F.col("n"), "k_rest": F.col("k_all") - F.col("degraded")}).filter(F.col("n_rest") >= minimum)
    rows = rows.withColumns({"segment_rate": F.col("degraded") / F.col("n"), "rest_rate": F.col("k_rest") / F.col("n_rest"), "z": two_proportion_z(F.col("degraded"), F.col("n"), F.col("k_rest"), F.col("n_rest"))})
    rows = rows.withColumn("p_value", normal_two_sided(F.col("z")))
    return rows.select("dimension", "value", "change_category", "actor", F.col("n").alias("n_segment"), "n_rest", "segment_rate", "rest_rate", (F.col("segment_rate") - F.col("rest_rate")).alias("rate_delta"), "z", "p_value",
                       (F.col("p_value") < ALPHA).alias("significant"), F.when(F.col("segment_rate") > F.col("rest_rate"), "higher").otherwise("lower").alias("direction"))


_KEYS = ["dimension", "value", "change_category", "actor"]


def pattern_cards(found: DataFrame, compared: DataFrame) -> DataFrame:
    rows = found.filter("confidence <> 'LOW'").join(compared.select(*_KEYS, "rest_rate", "rate_delta", "p_value", "significant", "direction"), _KEYS, "left")
    return rows.withColumn("tilt", F.when(F.col("degraded_rate") > F.col("improved_rate"), "degrades").otherwise("improves"))


def promotion_candidates(found: DataFrame, compared: DataFrame) -> DataFrame:
    rows = found.filter("confidence = 'RELIABLE'").join(compared.filter("significant").select(*_KEYS, "rate_delta", "p_value", "direction"), _KEYS)
    return rows.withColumn("decisive_majority", (F.col("degraded_low") > 0.5) | (F.col("degraded_high") < 0.5))
