"""Reports as tables: scorecard, status, live state, pipeline trace, account bundles, audit export."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from admeridian.operators import operate


def _lines(section: str, df: DataFrame, key: Column | str, value: Column) -> DataFrame:
    key = F.col(key) if isinstance(key, str) else key
    return df.select(F.lit(section).alias("section"), key.cast("string").alias("key"), value.cast("double").alias("value"))


def _counts(section: str, df: DataFrame, by: str, empty: str = "(none)") -> DataFrame:
    named = F.coalesce(F.nullif(F.col(by).cast("string"), F.lit("")), F.lit(empty))
    return _lines(section, df.groupBy(named.alias("key")).agg(F.count("*").alias("n")), "key", F.col("n"))


def _one(section: str, df: DataFrame, **values: Column) -> DataFrame:
    """Each of ``values``, aggregates over ``df``, as a line of its own."""
    wide = df.agg(*[v.cast("double").alias(k) for k, v in values.items()])
    return wide.select(F.lit(section).alias("section"), F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in values])).alias("x")).select("section", "x.*")


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def scorecard(daily: DataFrame, pages: DataFrame, signals: DataFrame, episodes: DataFrame, templates: DataFrame, predictions: DataFrame, resolutions: DataFrame, hypotheses: DataFrame, page_trends: DataFrame) -> DataFrame:
    """(section, key, value) of the whole system: coverage, signals, episodes, templates, recommendations, accuracy at 14 days,
    calibration by metric, landing pages. ``signals`` carry ``confidence_tier``, ``episodes`` a ``pre_state``."""
    at14 = resolutions.filter("window_days = 14")
    decisive = F.col("recommendation") != "EITHER"
    hit = F.col("recommendation_correct").cast("double")
    calibration = hypotheses.groupBy("metric").agg(F.count("*").alias("n"), F.avg("error").alias("mae"), F.avg(F.col("within_iqr").cast("double")).alias("within_iqr"))
    return _all([
        _one("coverage", daily, accounts=F.countDistinct("account_id"), campaigns=F.countDistinct("campaign_id")), _one("coverage", episodes, episodes=F.count("*")), _one("coverage", pages, page_accounts=F.countDistinct("account_id")),
        _one("signals", signals, total=F.count("*")), _counts("signals by tier", signals, "confidence_tier"), _counts("signals by severity", signals, "severity"), _counts("signals by type", signals, "signal_type"),
        _counts("episodes by outcome", episodes, "outcome"), _counts("episodes by state", episodes, "pre_state", "(untagged)"), _one("episodes", episodes, confounded_share=F.avg((F.col("outcome") == "confounded").cast("double"))),
        _one("templates", templates, total=F.countDistinct("template_id")), _counts("templates by status", templates, "status"),
        _one("recommendations", predictions, registered=F.count("*")), _counts("recommendations by call", predictions, "recommendation"),
        _one("accuracy", at14, n=F.count("*"), decisive_n=F.count_if(decisive), decisive=F.avg(F.when(decisive, hit)), abstention=F.avg((~decisive).cast("double")), direction=F.avg(F.col("direction_correct").cast("double"))),
        _lines("accuracy by call", at14.groupBy("recommendation").agg(F.avg(hit).alias("acc")), "recommendation", F.col("acc")),
        _lines("calibration mae", calibration, "metric", F.col("mae")), _lines("calibration within iqr", calibration, "metric", F.col("within_iqr")),
        _counts("page signals", signals.filter(F.startswith("signal_type", F.lit("ga4_"))), "signal_type"), _counts("page trends", page_trends, "classification"),
    ])


def status(daily: DataFrame, **tables: DataFrame) -> DataFrame:
    """Row counts of the named tables, and the span of the daily facts."""
    span = daily.agg(F.count("*").alias("n_rows"), F.min("date").cast("string").alias("first"), F.max("date").cast("string").alias("last")).select(F.lit("daily_metrics").alias("table_name"), "n_rows", "first", "last")
    none = F.lit(None).cast("string")
    return _all([span, *[df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows", none.alias("first"), none.alias("last")) for name, df in tables.items()]])


def top_drift(health: DataFrame, top: int = 10) -> DataFrame:
    return health.filter("drift_flag = 'DRIFT'").orderBy("live", "template_id").limit(top).select("template_id", "live", "backtest")


def strongest_calls(predictions: DataFrame, resolutions: DataFrame, top: int = 8) -> DataFrame:
    """The decisive calls with the largest predicted cost or gain, with how they turned out."""
    done = resolutions.filter("window_days = 14").select("prediction_id", "recommendation_correct")
    rows = predictions.filter("recommendation IN ('DO_NOT_ACT', 'ACT')").join(done, "prediction_id")
    return rows.orderBy(F.desc(F.abs("action_cost")), "prediction_id").limit(top).select("prediction_id", "recommendation", "template_id", "campaign_id", "action_cost", "recommendation_correct")


def live_state(daily: DataFrame, episodes: DataFrame, predictions: DataFrame, resolutions: DataFrame, health: DataFrame) -> DataFrame:
    """(section, key, value): what is watched, what is registered and resolved, the health of the templates, accuracy at 14 days."""
    by_window = resolutions.groupBy("window_days").agg(F.count("*").alias("n"))
    at14 = operate.accuracy(resolutions).filter("window_days = '14'")
    return _all([
        _one("monitored", daily, accounts=F.countDistinct("account_id")), _one("monitored", episodes, episodes=F.count("*")), _one("monitored", predictions, predictions=F.count("*")),
        _lines("resolved", by_window, "window_days", F.col("n")), _counts("templates", health, "status"), _lines("calls", at14, "recommendation", F.col("n")), _lines("accuracy", at14, "recommendation", F.col("accuracy")),
    ])


def best_and_worst(catalogue: DataFrame, top: int = 10) -> DataFrame:
    """The report of the templates: the most and the least accurate active ones."""
    rows = catalogue.filter("status = 'ACTIVE'").select("template_id", "direction_accuracy", "prediction_direction", "prediction_magnitude", "n_episodes")
    best = rows.orderBy(F.desc("direction_accuracy"), F.desc("n_episodes"), "template_id").limit(top).withColumn("section", F.lit("best"))
    worst = rows.orderBy("direction_accuracy", F.desc("n_episodes"), "template_id").limit(top).withColumn("section", F.lit("worst"))
    return best.unionByName(worst)


CALL = ("recommendation", "state", "prediction_direction")


def audit_export(resolved: DataFrame, predictions: DataFrame | None = None) -> DataFrame:
    """One row per resolved metric prediction, nothing derived: whoever audits computes accuracy anew. Without ``predictions`` the
    rows carry the columns of their ``CALL``."""
    rows = resolved if predictions is None else resolved.join(predictions.select("episode_id", *CALL), "episode_id", "left")
    return rows.select("prediction_id", "episode_id", "template_id", "metric", F.col("median_delta").alias("predicted_median"), "iqr_low", "iqr_high", F.col("delta").alias("actual_delta"), F.col("error").alias("abs_error"), "within_iqr", "recommendation", "state", "prediction_direction", "registered_at")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def account_bundles(accounts: DataFrame, summary: DataFrame, signals: DataFrame, page: int = 200) -> DataFrame:
    """JSON texts of each account: its profile, its 30 days and all its signals in order of their ids, ``page`` of them a text; an
    account has as many texts (``part`` from 0) as its signals need, one at least, so that no text grows without bound."""
    numbered = signals.withColumn("_r", F.row_number().over(Window.partitionBy("account_id").orderBy("signal_id"))).withColumn("part", F.expr(f"CAST((_r - 1) div {page} AS INT)"))
    own = numbered.groupBy("account_id", "part").agg(F.array_sort(F.collect_list(F.struct("signal_id", "signal_type", "severity", "message"))).alias("signals"))
    n = signals.groupBy("account_id").agg(F.count("*").alias("n_signals"))
    profile = [c for c in accounts.columns if c != "account_id"]
    month = [c for c in summary.columns if c != "account_id"]
    rows = accounts.join(summary.select("account_id", F.struct(*month).alias("performance_30d")), "account_id", "left").join(own, "account_id", "left").join(n, "account_id", "left").fillna(0, ["n_signals", "part"])
    return rows.select("account_id", "part", "n_signals", F.to_json(F.struct(F.struct("account_id", *profile).alias("account"), "performance_30d", "signals")).alias("bundle"))


def trace(tagged: DataFrame, signals: DataFrame, changes: DataFrame, assigned: DataFrame, forecasts: DataFrame, baseline: DataFrame, controls: DataFrame, decisions: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row per campaign: how its latest episode went through analysis, changes, patterns, recommendation, decision and
    monitoring. ``assigned``: episode_id and magnitude-aware template; ``decisions``: campaign, action and call."""
    from admeridian.operators.refinement import natural_trajectory

    w = Window.partitionBy("account_id", "campaign_id").orderBy(F.desc("change_date"), F.desc("episode_id"))
    last = tagged.withColumn("_r", F.row_number().over(w)).filter("_r = 1 AND campaign_id <> ''").drop("_r")
    own = signals.filter("campaign_id <> ''").groupBy("account_id", "campaign_id").agg(F.count("*").alias("campaign_signals"))
    wide = signals.filter("campaign_id = ''").groupBy("account_id").agg(F.count("*").alias("account_signals"))
    first = changes.select("account_id", F.col("change_id").alias("change_event_id"), "resource_type", "change_type")
    natural = natural_trajectory(baseline).select(F.col("state").alias("pre_state"), F.col("natural_median").alias("do_nothing_forecast"))
    matched = controls.groupBy("campaign_id", F.col("state").alias("pre_state")).agg(F.percentile("attribution", F.lit(0.5)).alias("matched_attribution"), F.count("*").alias("matched_n"))
    calls = decisions.select("account_id", "campaign_id", "change_category", "is_multi_action", F.col("decision").alias("call"), F.col("action_cost").alias("call_cost"))
    scored = resolved.groupBy("episode_id").agg(F.count("*").alias("metrics_resolved"), F.avg(F.col("within_iqr").cast("double")).alias("within_iqr_share"))
    told = forecasts.groupBy("template_id").agg(F.count("*").alias("metrics_forecast"))
    rows = last.withColumn("is_multi_action", F.col("change_count") > 1).join(own, ["account_id", "campaign_id"], "left").join(wide, "account_id", "left").join(first, ["account_id", "change_event_id"], "left")
    rows = rows.join(assigned.select("episode_id", "template_id"), "episode_id", "left").join(told, "template_id", "left").join(natural, "pre_state", "left").join(matched, ["campaign_id", "pre_state"], "left")
    rows = rows.join(calls, ["account_id", "campaign_id", "change_category", "is_multi_action"], "left").join(scored, "episode_id", "left")
    status = F.when(F.col("actor").isin("auto_applied", "human"), F.col("actor")).otherwise("unknown")
    return rows.select(
        "account_id", "campaign_id", "episode_id", F.col("pre_state").alias("state"), (F.coalesce("campaign_signals", F.lit(0)) + F.coalesce("account_signals", F.lit(0))).alias("n_signals"), "pre_cpa", "resource_type", "change_category", "change_count",
        (F.col("outcome") == "confounded").alias("confounded"), "template_id", F.coalesce("metrics_forecast", F.lit(0)).alias("metrics_forecast"), "do_nothing_forecast", "matched_attribution", F.coalesce("matched_n", F.lit(0)).alias("matched_n"),
        F.col("call"), "call_cost", status.alias("decided_by"), F.coalesce("metrics_resolved", F.lit(0)).alias("metrics_resolved"), "within_iqr_share", "outcome")
