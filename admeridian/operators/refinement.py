"""Controls and refinements of templates: no-action baselines, exceptions, transfer, convergence, act-or-wait."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from admeridian.functions.stats import fisher_greater, winsorised
from admeridian.functions.windows import div
from admeridian.operators import templates as T
from admeridian.operators.episodes import Days, days_of
from admeridian.sources.tables import by_account, dealt

PRE, POST, MATCH_DAYS, ACT, AVOID = 7, 7, 60, 0.10, 0.20


def no_action_baseline(daily: DataFrame | Days, changes: DataFrame, accounts: DataFrame) -> DataFrame:
    """Adjacent weeks without any change of the campaign: state at the start and the natural change of the cost per conversion."""
    facts = days_of(daily, "cost_micros", "conversions")[0].withColumnsRenamed({"cost_micros": "micros", "conversions": "conv"})
    # a campaign's day is one row
    span = facts.filter("campaign_id <> ''").groupBy("account_id", "campaign_id").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("date").alias("days")).filter(F.col("days") >= PRE + POST)
    low, high = F.date_add("first", PRE), F.date_sub("last", POST)
    anchors = span.filter(low <= high).select("account_id", "campaign_id", F.explode(F.sequence(low, high, F.expr("INTERVAL 7 DAYS"))).alias("at"))
    events = by_account(changes.filter("campaign_id <> ''").select("account_id", "campaign_id", F.to_date("change_timestamp").alias("day")))
    # a campaign's days of change are one short list, held against its anchors where they lie
    busy = events.groupBy("account_id", "campaign_id").agg(F.collect_set("day").alias("busy"))
    close = F.exists("busy", lambda d: d.between(F.date_sub("at", PRE), F.date_add("at", POST - 1)))
    quiet = anchors.join(busy, ["account_id", "campaign_id"], "left").filter(~F.coalesce(close, F.lit(False))).drop("busy")
    near = quiet.join(facts, ["account_id", "campaign_id"]).filter(F.col("date").between(F.date_sub("at", PRE), F.date_add("at", POST - 1)))
    before = F.col("date") < F.col("at")
    part = lambda side: div(F.sum(F.when(side, F.col("micros"))) / 1e6, F.sum(F.when(side, F.col("conv"))))
    rows = near.groupBy("account_id", "campaign_id", "at").agg(part(before).alias("pre_cpa"), part(~before).alias("post_cpa")).filter("pre_cpa > 0 AND post_cpa IS NOT NULL")
    rows = rows.withColumn("key", F.concat_ws("|", "account_id", "campaign_id", F.col("at").cast("string")))
    rows = dealt(rows, "quiet-weeks", "campaign_id")  # read twice, for their days and for their state
    rows = T.with_state(rows, rows.select("key", "account_id", "campaign_id", "at"), daily, accounts, "key", "pre_cpa", "at")
    return rows.select("account_id", "campaign_id", F.col("pre_state").alias("state"), F.date_sub("at", PRE).alias("window_start"), F.date_add("at", POST).alias("window_end"), "pre_cpa", "post_cpa", winsorised((F.col("post_cpa") - F.col("pre_cpa")) / F.col("pre_cpa")).alias("cpa_change"))


def natural_trajectory(baseline: DataFrame) -> DataFrame:
    return baseline.groupBy("state").agg(F.percentile("cpa_change", F.lit(0.5)).alias("natural_median"), F.count("*").alias("natural_n"))


def mean_reversion(rows: DataFrame, baseline: DataFrame) -> DataFrame:
    """Per state the median change with and without action."""
    acted = rows.groupBy(F.col("pre_state").alias("state")).agg(F.percentile("signed", F.lit(0.5)).alias("action_median"), F.count("*").alias("action_n"))
    out = acted.join(natural_trajectory(baseline), "state", "full_outer").fillna(0, ["action_n", "natural_n"])
    return out.withColumn("action_attributable", F.col("action_median") - F.col("natural_median"))


def with_natural(templates: DataFrame, baseline: DataFrame) -> DataFrame:
    """Templates with natural_magnitude and action_attributable_magnitude of their state (the last part of their id)."""
    natural = natural_trajectory(baseline).select(F.col("state").alias("_state"), F.col("natural_median").alias("natural_magnitude"))
    rows = templates.withColumn("_state", F.element_at(F.split("template_id", "__"), -1)).join(natural, "_state", "left").drop("_state")
    return rows.withColumn("action_attributable_magnitude", F.col("prediction_magnitude") - F.col("natural_magnitude"))


EXCEPTION_DIMENSIONS = ("campaign_type", "is_pmax", "is_brand", "vertical", "spend_tier", "change_bucket", "actor")


def exceptions(members: DataFrame, templates: DataFrame, top: int = 10, dims: tuple[str, ...] = EXCEPTION_DIMENSIONS, cluster: int = 10, accounts: int = 3, alpha: float = 0.05) -> DataFrame:
    """Conditions over-represented among the misses of the best active templates."""
    best = templates.filter("status = 'ACTIVE'").orderBy(F.desc("direction_accuracy"), F.desc("n_episodes"), "template_id").limit(top).select("template_id", F.col("prediction_direction").alias("base"), "level")
    rows = members.drop("level").join(F.broadcast(best), "template_id").withColumn("miss", F.col("direction") != F.col("base"))
    fixed = F.array(*[F.array(*[F.lit(k) for k in keys]) for keys in T.LEVELS])
    slices = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims])
    long = rows.select("template_id", "base", "level", "account_id", "direction", "signed", "miss", F.explode(slices).alias("s")).select("*", "s.*").filter(~F.array_contains(F.element_at(fixed, F.col("level") + 1), F.col("dim")))
    totals = rows.groupBy("template_id").agg(F.count_if("miss").alias("misses"), F.count_if(~F.col("miss")).alias("hits")).filter("misses >= 5")
    cells = long.groupBy("template_id", "base", "dim", "value").agg(F.count_if("miss").alias("m_in"), F.count_if(~F.col("miss")).alias("h_in"), F.countDistinct(F.when(F.col("miss"), F.col("account_id"))).alias("n_accounts"), F.count("*").alias("n"),
        F.mode("direction", True).alias("exception_direction"), F.percentile("signed", F.lit(0.5)).alias("exception_magnitude"))
    cells = cells.join(totals, "template_id").filter((F.col("m_in") >= cluster) & (F.col("n_accounts") >= accounts))
    cells = cells.withColumn("p_value", fisher_greater(F.col("m_in"), F.col("misses") - F.col("m_in"), F.col("h_in"), F.col("hits") - F.col("h_in")))
    return cells.filter(F.col("p_value") < alpha).withColumn("flips", F.col("exception_direction") != F.col("base"))


def convergence(members: DataFrame, templates: DataFrame, top: int = 10, alpha: float = 0.1, block: int = 256) -> DataFrame:
    """Running error of an exponentially smoothed estimate over each template's episodes in order of date.

    An update maps the estimate e to (1 - alpha) e + alpha x. Within a block of updates the estimate is a closed form in the block's
    first estimate and a running sum; only one sum per block is folded in order, so no template's episodes are gathered."""
    keep, by = 1 - alpha, "template_id"
    best = templates.filter("status = 'ACTIVE'").orderBy(F.desc("n_episodes"), "template_id").limit(top).select(by, F.col("prediction_direction").alias("usual"))
    order = Window.partitionBy(by).orderBy("change_date", "episode_id")
    rows = members.join(F.broadcast(best), by).withColumns({"observation": F.row_number().over(order), "_n": F.count("*").over(Window.partitionBy(by)), "_hit": (F.col("direction") == F.col("usual")).cast("int")}).filter("_n >= 8")
    first = rows.filter("observation <= 3").groupBy(by).agg(F.percentile("signed", F.lit(0.5)).alias("_first"))
    rows = rows.withColumn("_c", F.sum("_hit").over(order)).withColumns({"_b": F.floor((F.col("_c") - 1) / block), "_p": F.pmod(F.col("_c") - 1, F.lit(block))})
    part = F.when(F.col("_hit") == 1, alpha * F.col("signed") * F.pow(F.lit(keep), -(F.col("_p") + 1))).otherwise(0.0)
    rows = rows.withColumn("_s", F.sum(part).over(Window.partitionBy(by, "_b").orderBy("observation")))
    sums = rows.filter("_c > 0").groupBy(by, "_b").agg(F.sum(part).alias("s"))
    listed = sums.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_b", "s"))).alias("l")).join(first, by)
    step = lambda e, x: F.array_append(e, F.pow(F.lit(keep), F.lit(block)) * (F.element_at(e, -1) + x["s"]))
    starts = listed.select(by, F.posexplode(F.aggregate("l", F.array("_first"), step)).alias("_b", "_e"))
    rows = rows.join(first, by).join(starts, [by, "_b"], "left")
    after = F.when(F.col("_c") == 0, F.col("_first")).otherwise(F.pow(F.lit(keep), F.col("_p") + 1) * (F.col("_e") + F.col("_s")))
    rows = rows.withColumn("running_estimate", F.coalesce(F.lag(after).over(order), F.col("_first")))
    error = F.avg(F.abs(F.col("running_estimate") - F.col("signed"))).over(order)
    return rows.select(by, "observation", "running_estimate", F.col("signed").alias("actual"), error.alias("running_mae"))


def matched_controls(rows: DataFrame, baseline: DataFrame) -> DataFrame:
    """Each episode with the nearest quiet window of its campaign in the same state, apart from it and within 60 days."""
    a = rows.filter("campaign_id <> ''").select("episode_id", "campaign_id", F.col("pre_state").alias("state"), "change_date", "signed")
    b = baseline.select("campaign_id", "state", "window_start", "window_end", "cpa_change")
    apart = (F.col("window_end") <= F.date_sub("change_date", PRE)) | (F.col("window_start") >= F.date_add("change_date", POST))
    gap = F.least(F.abs(F.datediff("window_start", "change_date")), F.abs(F.datediff("window_end", "change_date")))
    pairs = a.join(b, ["campaign_id", "state"]).filter(apart).withColumn("gap_days", gap).filter(F.col("gap_days") <= MATCH_DAYS)
    best = pairs.groupBy("episode_id", "campaign_id", "state", "signed").agg(F.min_by(F.struct("cpa_change", "gap_days", "window_start"), F.struct("gap_days", "window_start")).alias("b"))
    return best.select("episode_id", "campaign_id", "state", F.col("signed").alias("action_change"), F.col("b.cpa_change").alias("no_action_change"), (F.col("signed") - F.col("b.cpa_change")).alias("attribution"), F.col("b.gap_days").alias("gap_days"), F.col("b.window_start").alias("baseline_window_start"))


def decision(cost: Column) -> Column:
    return F.when(cost.isNull(), "WAIT").when(cost >= AVOID, "DO_NOT_ACT").when(cost >= ACT, "WAIT").when(cost <= -ACT, "ACT").otherwise("EITHER")


def should_act(tagged: DataFrame, accounts: DataFrame, templates: DataFrame, baseline: DataFrame, matched: DataFrame) -> DataFrame:
    """For every campaign and action: what the template costs beyond doing nothing, and the call."""
    rows = T.recommend(tagged, accounts, templates).join(natural_trajectory(baseline).select(F.col("state").alias("pre_state"), "natural_median"), "pre_state")
    own = matched.groupBy("campaign_id", F.col("state").alias("pre_state")).agg(F.percentile("attribution", F.lit(0.5)).alias("matched_median"), F.count("*").alias("matched_n"))
    rows = rows.join(own, ["campaign_id", "pre_state"], "left")
    rows = rows.withColumn("action_cost", F.coalesce("matched_median", F.col("prediction_magnitude") - F.col("natural_median")))
    return rows.withColumn("decision", decision(F.col("action_cost")))


def categorised(templates: DataFrame) -> DataFrame:
    attr = F.col("action_attributable_magnitude")
    return T.active(templates).filter(attr.isNotNull()).withColumn("call", F.when(attr <= -ACT, "act_now").when(attr >= ACT, "dont_do_this").otherwise("do_nothing"))


# --- per-metric forecasts and magnitudes ---

METRICS = ("impressions", "clicks", "cost", "conversions", "conversion_value", "cpa", "cvr", "ctr", "roas")


def metric_deltas(rows: DataFrame) -> DataFrame:
    """One row per episode and metric: the winsorised relative change; null where the value before is 0."""
    rows = rows.withColumns({f"{p}_ctr": div(f"{p}_clicks", f"{p}_impressions") for p in ("pre", "post")})
    change = lambda m: winsorised(div(F.col(f"post_{m}") - F.col(f"pre_{m}"), f"pre_{m}")).alias("delta")
    slices = F.array(*[F.struct(F.lit(m).alias("metric"), F.when(F.coalesce(F.col(f"pre_{m}"), F.lit(0)) != 0, change(m)).alias("delta")) for m in METRICS])
    return rows.withColumn("_m", F.explode(slices)).select(*[c for c in rows.columns if not c.endswith("_ctr")], "_m.metric", "_m.delta").filter("delta IS NOT NULL")


def per_metric(members: DataFrame) -> DataFrame:
    """template_id, metric: median, quartiles, k-fold error, n; for cells of at least ten episodes."""
    rows = metric_deltas(members)
    w = Window.partitionBy("template_id", "metric")
    rows = rows.withColumn("n", F.count("*").over(w)).filter(F.col("n") >= T.MIN_EPISODES)
    # cells of so many episodes have folds, so every row comes back with its prediction, where it lies
    told = T.fold_predictions(rows.drop("n"), value="delta", extra=["metric"])
    q = told.groupBy("template_id", "metric").agg(F.percentile("actual_magnitude", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.count("*").alias("n"), F.avg("magnitude_error").alias("mae"))
    return q.select("template_id", "metric", F.col("q")[1].alias("median_delta"), F.col("q")[0].alias("iqr_low"), F.col("q")[2].alias("iqr_high"), "mae", "n")


def predictability(members: DataFrame) -> DataFrame:
    rows = metric_deltas(members)
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("template_id", "metric"))).filter(F.col("n") >= T.MIN_EPISODES).drop("n")
    out = T.fold_predictions(rows, value="delta", extra=["metric"]).groupBy("metric").agg(F.avg("magnitude_error").alias("mae"), F.avg((F.col("magnitude_error") <= 0.10).cast("double")).alias("exact_close_share"), F.count("*").alias("n"))
    return out.withColumn("tier", F.when(F.col("mae") < 0.10, "STRONG").when(F.col("mae") < 0.15, "MODERATE").otherwise("WEAK"))


def _hypothesis_id() -> Column:
    return F.substring(F.sha2(F.concat_ws("|", "episode_id", "template_id", "metric"), 256), 1, 16)


def metric_hypotheses(members: DataFrame, forecasts: DataFrame) -> DataFrame:
    """One prediction per episode and metric of its template; known before the outcome."""
    return members.select("episode_id", "template_id", "change_date").join(forecasts, "template_id").select(_hypothesis_id().alias("prediction_id"), "episode_id", "template_id", "metric", "median_delta", "iqr_low", "iqr_high", F.col("change_date").alias("registered_at"))


def _judged(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"error": F.abs(F.col("median_delta") - F.col("delta")), "within_iqr": F.col("delta").between(F.col("iqr_low"), F.col("iqr_high"))})


def resolved_hypotheses(hypotheses: DataFrame, members: DataFrame) -> DataFrame:
    actual = metric_deltas(members).select("episode_id", "metric", "delta")
    return _judged(hypotheses.join(actual, ["episode_id", "metric"]))


def resolved_members(members: DataFrame, forecasts: DataFrame, *more: str) -> DataFrame:
    """``resolved_hypotheses`` of the ``metric_hypotheses`` of ``members`` with one template an episode, with ``account_id`` and ``more``
    of their columns: forecasts are few and sent to the members, which are not moved."""
    told = forecasts.select("template_id", "metric", "median_delta", "iqr_low", "iqr_high")
    actual = metric_deltas(members).select("account_id", "episode_id", "template_id", "metric", "delta", F.col("change_date").alias("registered_at"), *more)
    return _judged(actual.join(F.broadcast(told), ["template_id", "metric"]).withColumn("prediction_id", _hypothesis_id()))


def _percent_bucket(p: Column) -> Column:
    return F.when(p < -0.30, "large_decrease").when(p < -0.10, "medium_decrease").when(p < -0.02, "small_decrease").when(p <= 0.02, "flat").when(p <= 0.10, "small_increase").when(p <= 0.30, "medium_increase").otherwise("large_increase")


def with_magnitude(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """``magnitude_bucket`` by the amounts in the bundle's first event, else by the size of the batch."""
    events = by_account(changes).select("account_id", F.col("change_id").alias("change_event_id"), "old_value", "new_value")
    bucket = None
    patterns = (r"amount_micros:\s*(\d+)", r"target_roas:\s*([\d.]+)", r"target_cpa_micros:\s*(\d+)")
    number = lambda c, pattern: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), pattern, 1), F.lit("")).try_cast("double")
    rows = by_account(rows).join(events, ["account_id", "change_event_id"], "left")
    # each text is searched once, and not again for every bound of a bucket
    found_in = {f"_{c}{i}": number(F.col(c), p) for i, p in enumerate(patterns) for c in ("old_value", "new_value")}
    rows = rows.withColumns(found_in)
    for i in range(len(patterns)):
        old, new = F.col(f"_old_value{i}"), F.col(f"_new_value{i}")
        hit = (old > 0) & (new > 0)
        found = _percent_bucket((new - old) / old)
        bucket = F.when(hit, found) if bucket is None else bucket.when(hit, found)
    n = F.col("change_count")
    batch = F.when(n <= 5, "small_batch").when(n <= 20, "medium_batch").otherwise("large_batch")
    bucket = bucket.when(F.col("change_category").isin("targeting_keyword", "asset", "ad_creative"), batch).otherwise("na")
    return rows.withColumn("magnitude_bucket", bucket).drop("old_value", "new_value", *found_in)
