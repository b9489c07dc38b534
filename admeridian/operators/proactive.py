"""Looking ahead: what each campaign's state makes of every known action, what is untried, and forecasts metric by metric."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from admeridian.operators import refinement
from admeridian.operators import templates as T
from admeridian.operators.reads import template_conditions

MAG_LEVELS = T.with_bucket(T.LEVELS)


def mag_library(members: DataFrame) -> DataFrame:
    """Per-metric forecasts of magnitude-aware templates, their ids marked ``mag:``. ``members``: of the magnitude cascade."""
    return refinement.per_metric(members).withColumn("template_id", F.concat(F.lit("mag:"), "template_id"))


def library_conditions(forecasts: DataFrame) -> DataFrame:
    return forecasts.select("template_id").distinct().withColumn("c", template_conditions(F.col("template_id"))).select("template_id", "c.*")


def _campaigns(tagged: DataFrame, accounts: DataFrame) -> DataFrame:
    known = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")).alias(c)
    states = T.current_states(tagged.filter("campaign_id <> '' AND pre_state <> ''"))
    profile = accounts.select("account_id", known("business_type"), known("vertical"), known("spend_tier"))
    return states.join(profile, "account_id", "left").fillna("unknown", ["business_type", "vertical", "spend_tier"])


def _cost_forecasts(forecasts: DataFrame) -> DataFrame:
    """template_id, cpa_median (null where it has none), n: one row per template."""
    return forecasts.groupBy("template_id").agg(F.max(F.when(F.col("metric") == "cpa", F.col("median_delta"))).alias("cpa_median"), F.max("n").alias("n"))


def matches(tagged: DataFrame, accounts: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Every campaign with the sharpest template for each action of the library: action, magnitude, one or several changes."""
    library = _cost_forecasts(forecasts).withColumn("template_id", F.regexp_replace("template_id", "^mag:", ""))
    actions = library_conditions(forecasts).select("change_category", "magnitude_bucket").distinct()  # categories x magnitudes, a fixed short list
    several = F.explode(F.array(F.lit(False), F.lit(True))).alias("is_multi_action")
    rows = _campaigns(tagged, accounts).crossJoin(F.broadcast(actions)).select("*", several)
    return T.sharpest(rows, library, ["template_id", "cpa_median", "n"], MAG_LEVELS).withColumn("template_id", F.concat(F.lit("mag:"), "template_id"))


def scan(found: DataFrame, act: float = 0.10) -> DataFrame:
    """``matches`` that promise a fall (recommendation) or a rise (warning) of the cost per conversion."""
    call = F.when(F.col("cpa_median") <= -act, "recommendation").when(F.col("cpa_median") >= act, "warning")
    return found.withColumn("call", call).filter("call IS NOT NULL").select("call", "account_id", "campaign_id", "pre_state", "change_category", "magnitude_bucket", "is_multi_action", "cpa_median", "n", "template_id")


def experiments(tagged: DataFrame, accounts: DataFrame, forecasts: DataFrame, found: DataFrame) -> DataFrame:
    """Per state and action: campaigns that no template fits though the library knows the action for their state, and the
    magnitude most of these templates have (ties to the alphabetically first)."""
    known = library_conditions(forecasts).groupBy("pre_state", "change_category").agg(F.mode("magnitude_bucket", True).alias("suggested_magnitude"))
    open_ = _campaigns(tagged, accounts).select("account_id", "campaign_id", "pre_state").join(known, "pre_state").join(found.select("account_id", "campaign_id", "change_category").distinct(), ["account_id", "campaign_id", "change_category"], "left_anti")
    return open_.groupBy("pre_state", F.col("change_category").alias("proposed_action"), "suggested_magnitude").agg(F.count("*").alias("campaigns_in_gap"))


def report(campaigns: DataFrame, found: DataFrame, gaps: DataFrame, top: int = 10) -> DataFrame:
    """The report of a scan as rows: how much it covers, the strongest warnings and recommendations, and the largest gaps. ``campaigns``:
    those whose state is known; ``found``: of ``scan``; ``gaps``: of ``experiments``."""
    empty = {"account_id": "string", "campaign_id": "string", "change_category": "string", "magnitude_bucket": "string", "pre_state": "string", "cpa_median": "double"}
    count = lambda df, *keys: (df.select(*keys).distinct() if keys else df).agg(F.count("*").alias("n"))
    of = lambda call: found.filter(F.col("call") == call)
    facts = [("campaigns scanned", count(campaigns)), ("with a recommendation", count(of("recommendation"), "account_id", "campaign_id")), ("with a warning", count(of("warning"), "account_id", "campaign_id")), ("experiments", count(gaps))]
    parts = [df.select(F.lit("coverage").alias("section"), F.lit(i + 1).alias("place"), F.lit(name).alias("what"), "n") for i, (name, df) in enumerate(facts)]
    for call, order in (("warning", F.desc("cpa_median")), ("recommendation", F.asc("cpa_median"))):
        best = of(call).orderBy(order, F.desc("n"), "account_id", "campaign_id", "change_category", "magnitude_bucket", "is_multi_action").limit(top)
        what = F.concat_ws(" ", "magnitude_bucket", "change_category", F.when(F.col("is_multi_action"), "with others"))
        parts.append(best.select("account_id", "campaign_id", "change_category", "magnitude_bucket", "pre_state", "cpa_median", "is_multi_action", F.lit(call).alias("section"), what.alias("what"), "n"))
    largest = gaps.orderBy(F.desc("campaigns_in_gap"), "pre_state", "proposed_action").limit(top)
    parts.append(largest.select(F.lit("experiment").alias("section"), F.col("proposed_action").alias("change_category"), F.col("suggested_magnitude").alias("magnitude_bucket"), "pre_state", F.concat_ws(" ", "suggested_magnitude", "proposed_action").alias("what"), F.col("campaigns_in_gap").alias("n")))
    out = parts[0].select("section", "place", "what", "n", *[F.lit(None).cast(t).alias(c) for c, t in empty.items()])
    for p in parts[1:]:
        out = out.unionByName(p.drop("is_multi_action"), allowMissingColumns=True)
    # the few rows of a section in the order above
    w = Window.partitionBy("section").orderBy("place", F.when(F.col("section") == "warning", -F.col("cpa_median")).otherwise(F.col("cpa_median")), F.desc("n"), "account_id", "campaign_id", "pre_state", "change_category", "magnitude_bucket", "what")
    return out.withColumn("place", F.row_number().over(w))


def metric_forecast(tagged: DataFrame, accounts: DataFrame, forecasts: DataFrame) -> DataFrame:
    """For each campaign and action the sharpest template that has per-metric forecasts, metric by metric."""
    library = forecasts.select("template_id").distinct()
    actions = library_conditions(forecasts).select("change_category").distinct()
    several = F.explode(F.array(F.lit(False), F.lit(True))).alias("is_multi_action")
    rows = _campaigns(tagged, accounts).crossJoin(F.broadcast(actions)).select("*", several)
    best = T.sharpest(rows, library, ["template_id"], T.LEVELS)
    return best.select("account_id", "campaign_id", "pre_state", "change_category", "is_multi_action", "template_id").join(forecasts, "template_id")


def _held_out_errors(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Errors of the other folds' medians; cells of fewer than ten values are left out."""
    w = Window.partitionBy(*keys)
    rows = rows.withColumn("_n", F.count("*").over(w)).filter(F.col("_n") >= T.MIN_EPISODES).drop("_n")
    folded = T.folded(rows, keys)
    others = folded.withColumn("fold", F.explode(F.filter(F.sequence(F.lit(0), F.col("k").cast("int") - 1), lambda f: f != F.col("fold"))))
    medians = others.groupBy(*keys, "fold").agg(F.percentile("delta", F.lit(0.5)).alias("usual"))
    return folded.withColumn("fold", F.col("fold").cast("int")).join(medians, [*keys, "fold"]).select(F.abs(F.col("usual") - F.col("delta")).alias("error"))


def budget_cost_error(rows: DataFrame, limit: float = 0.15) -> DataFrame:
    """Held-out error of the cost change after budget changes: by magnitude-aware templates and by state alone; one row."""
    budget = rows.filter("change_category = 'budget'")
    cost = lambda df: refinement.metric_deltas(df).filter("metric = 'cost'")
    one = lambda df, p: df.agg(F.avg("error").alias(f"{p}_cost_mae"), F.count("*").alias(f"{p}_n"))
    sharp = one(_held_out_errors(cost(T.cascade(budget, MAG_LEVELS)), ["template_id"]), "magnitude")
    plain = one(_held_out_errors(cost(budget), ["pre_state"]), "category")
    return sharp.crossJoin(F.broadcast(plain)).withColumn("passes", F.coalesce(F.col("magnitude_cost_mae") < limit, F.lit(False)))
