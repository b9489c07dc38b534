"""The operating loop: register predictions, resolve them when their windows close, watch the templates' health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admeridian.functions.stats import winsorised
from admeridian.functions.windows import div
from admeridian.operators import refinement
from admeridian.operators import templates as T
from admeridian.operators.episodes import Days, days_of
from admeridian.sources.tables import as_it_lies, by_account, dealt, materialised

WINDOWS = (7, 14, 30)


def register(rows: DataFrame, templates: DataFrame, baseline: DataFrame) -> DataFrame:
    """One prediction per episode that fits an active template in a state with a natural trajectory. Nothing of the outcome is
    read: the episode contributes its keys and its date only."""
    keys = ["episode_id", "account_id", "campaign_id", "change_date", *T.LEVELS[0]]
    matched = T.sharpest(rows.select(*keys), T.active(templates), ["template_id", "prediction_direction", "prediction_magnitude"])
    natural = refinement.natural_trajectory(baseline).select(F.col("state").alias("pre_state"), F.col("natural_median").alias("natural_magnitude"))
    out = matched.join(natural, "pre_state").withColumn("action_cost", F.col("prediction_magnitude") - F.col("natural_magnitude"))
    pid = F.substring(F.sha2(F.concat_ws("|", "episode_id", "template_id"), 256), 1, 16)
    return out.select(pid.alias("prediction_id"), "template_id", "episode_id", "account_id", "campaign_id", F.col("pre_state").alias("state"), "prediction_direction", "prediction_magnitude", "natural_magnitude", "action_cost",
                      refinement.decision(F.col("action_cost")).alias("recommendation"), F.col("change_date").alias("registered_at"))


def _right(call: Column, cost: Column) -> Column:
    helped, hurt = cost < -refinement.ACT, cost > refinement.ACT
    return F.when(call == "DO_NOT_ACT", hurt).when(call == "ACT", helped).when(call == "EITHER", ~helped & ~hurt).otherwise(~helped)


def cost_per_conversion(micros: Column, conversions: Column) -> Column:
    return div(micros / 1e6, conversions)


def scored(rows: DataFrame, *more: str) -> DataFrame:
    """The verdicts on predictions whose cost per conversion before and after is known (``pre``, ``post``)."""
    rows = rows.filter("pre > 0 AND post IS NOT NULL").withColumn("actual_magnitude", winsorised((F.col("post") - F.col("pre")) / F.col("pre")))
    rows = rows.withColumns({"actual_direction": T.direction(F.col("actual_magnitude")), "magnitude_error": F.abs(F.col("prediction_magnitude") - F.col("actual_magnitude")), "actual_action_cost": F.col("actual_magnitude") - F.col("natural_magnitude")})
    return rows.select("prediction_id", "template_id", "recommendation", "window_days", "actual_magnitude", "actual_direction", (F.col("prediction_direction") == F.col("actual_direction")).alias("direction_correct"), "magnitude_error", T.error_bucket(F.col("magnitude_error")).alias("magnitude_score"), "actual_action_cost",
                       _right(F.col("recommendation"), F.col("actual_action_cost")).alias("recommendation_correct"), *more)


def resolve(predictions: DataFrame, daily: DataFrame | Days, resolved: DataFrame | None = None, as_of: Column | None = None) -> DataFrame:
    """One row per prediction and window that has closed by ``as_of`` (default: the data anchor) and is not yet in ``resolved``."""
    facts = days_of(daily, "cost_micros", "conversions")[0]
    at = (daily.facts if isinstance(daily, Days) else daily).agg(F.max("date").alias("as_of"))
    made = predictions.filter("campaign_id <> ''")
    made = (by_account(made) if isinstance(daily, Days) else made).crossJoin(F.broadcast(at))
    if as_of is not None:
        made = made.withColumn("as_of", as_of)
    closed = lambda w: F.date_add("registered_at", w) <= F.col("as_of")
    made = made.filter(closed(min(WINDOWS)))
    # a prediction meets its days once for all windows, where the days lie
    near = F.col("date").between(F.date_sub("registered_at", 7), F.date_add("registered_at", max(WINDOWS) - 1))
    part = lambda side: cost_per_conversion(F.sum(F.when(side, F.col("cost_micros"))), F.sum(F.when(side, F.col("conversions"))))
    after = lambda w: (F.col("date") >= F.col("registered_at")) & (F.col("date") < F.date_add("registered_at", w))
    sums = made.join(facts, ["account_id", "campaign_id"]).filter(near).groupBy(*made.columns).agg(part(F.col("date") < F.col("registered_at")).alias("pre"), *[part(after(w)).alias(f"_{w}") for w in WINDOWS])
    open_ = sums.withColumn("_w", F.explode(F.array(*[F.struct(F.lit(w).alias("window_days"), F.col(f"_{w}").alias("post")) for w in WINDOWS]))).select("*", "_w.*").filter(closed(F.col("window_days")))
    if resolved is not None:
        open_ = open_.join(resolved.select("prediction_id", "window_days"), ["prediction_id", "window_days"], "left_anti")
    return scored(open_)


def health(resolved: DataFrame, templates: DataFrame) -> DataFrame:
    """Live against backtested accuracy of each template over its 14-day resolutions."""
    rows = resolved.filter("window_days = 14").groupBy("template_id").agg(F.count("*").alias("n_resolved"), F.avg(F.col("direction_correct").cast("double")).alias("live"), F.avg(F.col("recommendation_correct").cast("double")).alias("live_recommendation"), F.avg("magnitude_error").alias("mae"))
    rows = rows.join(templates.select("template_id", F.col("direction_accuracy").alias("backtest")), "template_id", "left").withColumn("backtest", F.coalesce("backtest", F.lit(0.0)))
    n, live = F.col("n_resolved"), F.col("live")
    flag = F.when((n >= 10) & (live < F.col("backtest") - 0.15), "DRIFT").when((n >= 10) & (live > F.col("backtest") + 0.05), "IMPROVING").otherwise("")
    state = F.when((n >= 10) & (live > 0.55), "ACTIVE").when((n < 10) | live.between(0.45, 0.55), "SHADOW_ONLY").otherwise("RETIRED")
    return rows.withColumns({"drift_flag": flag, "status": state})


def accuracy(resolved: DataFrame) -> DataFrame:
    """Accuracy overall, by call, by window and by both, in one pass over the resolutions."""
    hit = F.avg(F.col("recommendation_correct").cast("double"))
    out = resolved.cube("window_days", "recommendation").agg(F.count("*").alias("n"), hit.alias("accuracy"), F.avg(F.col("direction_correct").cast("double")).alias("direction_accuracy"), F.avg((F.col("recommendation") == "EITHER").cast("double")).alias("abstention"))
    return out.select(F.coalesce(F.col("window_days").cast("string"), F.lit("all")).alias("window_days"), F.coalesce("recommendation", F.lit("all")).alias("recommendation"), "n", "accuracy", "direction_accuracy", "abstention")


def alerts(daily: DataFrame, scores: DataFrame, today: Column, stale_days: int = 2, floor: float = 0.5) -> DataFrame:
    """Rows of what is wrong: facts too old, accuracy under the floor."""
    old = daily.agg(F.max("date").alias("last")).select(F.lit("freshness").alias("alert"), F.datediff(today, "last").cast("double").alias("value"), F.lit(float(stale_days)).alias("limit")).filter(F.col("value") > F.col("limit"))
    weak = scores.filter("window_days = '14' AND recommendation = 'all'").select(F.lit("accuracy").alias("alert"), F.col("accuracy").alias("value"), F.lit(floor).alias("limit")).filter(F.col("value") < F.col("limit"))
    return old.unionByName(weak)


def daily_cycle(t, as_of: Column | None = None, resolved: DataFrame | None = None) -> dict[str, DataFrame]:
    """Register, resolve, judge: the same inputs give the same rows, so a rerun replaces what it wrote."""
    predictions = register(t.rows if as_of is None else t.rows.filter(F.col("change_date") <= as_of), t.catalogue, t.baseline)
    if isinstance(t.days, Days):
        predictions = dealt(predictions, "cycle-predictions", "campaign_id")
        with as_it_lies(predictions.sparkSession):
            fresh = materialised(resolve(predictions, t.days, resolved, as_of), "cycle-resolutions")
    else:
        fresh = resolve(predictions, t.days, resolved, as_of)
    return {"predictions": predictions, "resolutions": fresh, "health": health(fresh, t.catalogue), "accuracy": accuracy(fresh)}
