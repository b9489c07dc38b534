"""Signal audits: independent tests that try to disconfirm each signal, as rows of verdicts.

A harness is one join of its signals with facts aggregated anew per campaign; the tests are columns of that join, then stacked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admeridian.functions.windows import anchored, div, max_if, since, sum_if, within


def campaign_facts(daily: DataFrame) -> DataFrame:
    """Everything the campaign-level tests read, in one pass: the windows of both conventions."""
    wins = {"s7": since(7), "s14": since(14), "s30": since(30), "b30": since(30) & ~since(7), "c7": within(7), "p7": within(14, 7), "c14": within(14), "p14": within(28, 14)}
    aggs = []
    for w, c in wins.items():
        aggs += [sum_if(c, v).alias(f"{w}_{n}") for n, v in (("cost", "cost_micros"), ("conv", "conversions"), ("value", "conversion_value"), ("clicks", "clicks"))]
        aggs += [max_if(c, "cost_micros").alias(f"{w}_max_cost"), max_if(c, "clicks").alias(f"{w}_max_clicks"), F.countDistinct(F.when(c & (F.col("cost_micros") > 0), F.col("date"))).alias(f"{w}_active"), F.countDistinct(F.when(c, F.col("bidding_strategy"))).alias(f"{w}_strategies"),
                 F.avg(F.when(c, F.col("search_budget_lost_is"))).alias(f"{w}_lost"), F.avg(F.when(c, F.col("search_rank_lost_is"))).alias(f"{w}_rank"), F.count(F.when(c, F.col("search_budget_lost_is"))).alias(f"{w}_lost_days")]
    aggs.append((F.datediff(F.max("date"), F.min("date")) + 1).alias("age_days"))
    for w, c in {"s3": since(21) & ~since(14), "s4": since(28) & ~since(21), "c3": within(21, 14), "c4": within(28, 21)}.items():
        aggs += [sum_if(c, "conversions").alias(f"{w}_conv"), sum_if(c, "clicks").alias(f"{w}_clicks")]
    prior = since(14) & ~since(7)
    config = F.concat_ws("|", "campaign_type", "bidding_strategy")
    aggs += [sum_if(prior, "conversions").alias("q7_conv"), sum_if(prior, "clicks").alias("q7_clicks"), F.countDistinct(F.when(since(14), config)).alias("s14_configs"), F.countDistinct(F.when(within(14), config)).alias("c14x_configs"),
             F.avg(F.when(since(14) & (F.col("daily_budget_micros") > 0), F.col("cost_micros") / F.col("daily_budget_micros"))).alias("s14_utilisation"), F.avg(F.when(since(7), F.col("daily_budget_micros"))).alias("s7_budget")]
    both = within(14)
    aggs += [F.countDistinct(F.when(both, F.col("bidding_strategy"))).alias("c14x_strategies")]
    return anchored(daily).groupBy("account_id", "campaign_id").agg(*aggs)


def vote(disconfirm: Column, confirm: Column, unknown: Column | None = None) -> Column:
    """A verdict; an unknown test is inconclusive, and so is one that neither condition settles."""
    out = F.when(F.coalesce(unknown, F.lit(False)), "inconclusive") if unknown is not None else F.when(F.lit(False), "inconclusive")
    return out.when(F.coalesce(disconfirm, F.lit(False)), "disconfirm").when(F.coalesce(confirm, F.lit(False)), "confirm").otherwise("inconclusive")


def stacked(rows: DataFrame, detector: str, tests: dict[str, Column]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("test"), v.alias("verdict")) for n, v in tests.items()])
    return rows.select(F.lit(detector).alias("detector"), "signal_id", F.explode(pairs).alias("t")).select("detector", "signal_id", "t.*")


def _spread(share: Column) -> Column:
    return vote(share > 0.50, share <= 0.50, share.isNull())


def cpa_change(found: DataFrame, facts: DataFrame) -> DataFrame:
    rows = found.join(facts, ["account_id", "campaign_id"])
    c = F.col
    lift = div(div("c7_value", "c7_conv"), div("p7_value", "p7_conv"))
    worse = c("value") > c("threshold")
    no_value = ~F.coalesce((c("c7_conv") > 0) & (c("p7_conv") > 0) & (c("p7_value") > 0), F.lit(False))
    return stacked(rows, "cpa_change", {
        "T1": vote((F.coalesce("p7_conv", F.lit(0)) < 5) | (c("p7_active") < 3), (c("p7_conv") >= 15) & (c("p7_active") >= 5)), "T2": vote(c("c14x_strategies") > 1, c("c14x_strategies") <= 1),
        "T3": vote((worse & (lift >= 1.5)) | (~worse & (lift <= 0.67)), F.lit(True), no_value), "T4": _spread(div("p7_max_cost", "p7_cost")),
    })


def cpa_spike(found: DataFrame, facts: DataFrame) -> DataFrame:
    rows = found.join(facts, ["account_id", "campaign_id"])
    c = F.col
    lift = div(div("s7_value", "s7_conv"), div("b30_value", "b30_conv"))
    return stacked(rows, "cpa_spike", {
        "T1": vote(F.coalesce("s7_conv", F.lit(0)) < 5, c("s7_conv") >= 15), "T2": _spread(div("s7_max_cost", "s7_cost")), "T3": vote(c("s30_strategies") > 1, c("s30_strategies") <= 1),
        "T4": vote(lift >= 2.0, F.lit(True), ~F.coalesce((c("s7_conv") > 0) & (c("b30_conv") > 0) & (c("b30_value") > 0), F.lit(False))),
    })


def tracking_changes(changes: DataFrame, daily: DataFrame) -> DataFrame:
    """account_id of accounts with a change of conversion tracking in the last two weeks, in either convention."""
    anchor = daily.agg(F.max("date").alias("anchor"))
    rows = changes.filter(F.upper("resource_type").contains("CONVERSION") | F.upper("change_type").contains("CONVERSION")).crossJoin(F.broadcast(anchor))
    day = F.col("change_timestamp")
    rows = rows.select("account_id", (day >= F.date_sub("anchor", 14).cast("timestamp")).alias("s"), ((day > F.date_sub("anchor", 14).cast("timestamp")) & (day <= F.col("anchor").cast("timestamp"))).alias("c"))
    return rows.groupBy("account_id").agg(F.max("s").alias("tracking_s"), F.max("c").alias("tracking_c"))


def _earlier(a: str, b: str) -> Column:
    """Mean conversion rate of two earlier weeks, of those that have one."""
    rates = F.filter(F.array(*[F.coalesce(div(f"{w}_conv", f"{w}_clicks"), F.lit(0.0)) for w in (a, b)]), lambda x: x > 0)
    return F.when(F.size(rates) > 0, F.aggregate(rates, F.lit(0.0), lambda s, x: s + x) / F.size(rates))


def cvr_drop(found: DataFrame, facts: DataFrame, tracking: DataFrame) -> DataFrame:
    rows = found.join(facts, ["account_id", "campaign_id"]).join(tracking, "account_id", "left")
    c, base = F.col, _earlier("s3", "s4")
    prior = F.coalesce(div("q7_conv", "q7_clicks"), F.lit(0.0))
    return stacked(rows, "cvr_drop", {"T1": vote(c("tracking_s"), F.lit(True)), "T2": vote(c("s14_configs") > 1, F.lit(True)), "T3": F.lit("inconclusive"), "T4": vote(prior > base * 1.4, F.lit(True), base.isNull())})


def cvr_change(found: DataFrame, facts: DataFrame, tracking: DataFrame) -> DataFrame:
    rows = found.join(facts, ["account_id", "campaign_id"]).join(tracking, "account_id", "left")
    c, base = F.col, _earlier("c3", "c4")
    prior = F.coalesce(div("p7_conv", "p7_clicks"), F.lit(0.0))
    worse = c("value") < c("threshold")
    back = (worse & (prior > base * 1.4)) | (~worse & (prior > 0) & (prior < base * 0.7))
    share = F.greatest(div("c7_max_clicks", "c7_clicks"), div("p7_max_clicks", "p7_clicks"))
    return stacked(rows, "cvr_change", {"T1": vote(c("tracking_c"), F.lit(True)), "T2": vote(c("c14x_configs") > 1, F.lit(True)), "T3": vote(back, F.lit(True), base.isNull()), "T4": vote(share > 0.50, F.lit(True))})


def budget_capped(found: DataFrame, facts: DataFrame) -> DataFrame:
    rows = found.join(facts, ["account_id", "campaign_id"])
    c = F.col
    conv, used = F.coalesce("s14_conv", F.lit(0.0)), c("s14_utilisation")
    return stacked(rows, "budget_capped", {"T1": vote(used < 0.50, used >= 0.85, used.isNull()), "T2": vote(F.coalesce("s14_rank", F.lit(0.0)) > F.coalesce("s14_lost", F.lit(0.0)) + 0.10, F.lit(True)), "T3": vote(conv < 5, conv >= 15)})


def budget_limited(found: DataFrame, facts: DataFrame) -> DataFrame:
    """The last test holds the campaign's budget against the median of its account's campaigns."""
    middle = facts.groupBy("account_id").agg(F.percentile("s7_budget", F.lit(0.5)).alias("usual_budget"))
    rows = found.join(facts, ["account_id", "campaign_id"]).join(middle, "account_id", "left")
    c = F.col
    cpa, conv, ratio = div(c("s30_cost") / 1e6, "s30_conv"), F.coalesce("s7_conv", F.lit(0.0)), div("s7_budget", "usual_budget")
    rank, lost = F.coalesce("s7_rank", F.lit(0.0)), F.coalesce("s7_lost", F.lit(0.0))
    return stacked(rows, "budget_limited", {"T1": vote(rank > lost + 0.05, lost > rank + 0.10), "T2": vote(cpa > 500, cpa <= 200, F.coalesce("s30_conv", F.lit(0.0)) < 1), "T3": vote(conv < 5, conv >= 20), "T4": vote(ratio < 0.4, ratio >= 0.7, ratio.isNull())})


def widened_spikes(found: DataFrame, volatility: DataFrame, tests: DataFrame) -> DataFrame:
    """False positives among cost spikes under the flat threshold, under one multiplied by the campaign's volatility, and among
    what the second leaves out. ``volatility``: account_id, campaign_id, threshold_multiplier; a false positive has a test
    against it."""
    against = tests.groupBy("signal_id").agg(F.count_if(F.col("verdict") == "disconfirm").alias("wrong"))
    rows = found.join(volatility.select("account_id", "campaign_id", "threshold_multiplier"), ["account_id", "campaign_id"], "left").join(against, "signal_id")
    kept = F.col("value") > F.col("threshold") * F.coalesce("threshold_multiplier", F.lit(1.0))
    sets = F.array(F.lit("flat"), F.when(kept, F.lit("widened")).otherwise("dropped"))
    out = rows.select(F.explode(sets).alias("threshold"), "wrong").groupBy("threshold").agg(F.count("*").alias("n"), F.count_if(F.col("wrong") > 0).alias("false_positives"), F.sum("wrong").alias("disconfirming_tests"))
    return out.withColumn("false_positive_rate", F.col("false_positives") / F.col("n"))


def run(signals: dict[str, DataFrame], daily: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """All campaign-level harnesses over those of their signals that are given."""
    facts = campaign_facts(daily)
    parts = [make(signals[k], facts) for k, make in (("cpa_change", cpa_change), ("cpa_spike", cpa_spike), ("budget_capped", budget_capped), ("budget_limited_is", budget_limited)) if k in signals]
    if changes is not None:
        tracking = tracking_changes(changes, daily)
        parts += [make(signals[k], facts, tracking) for k, make in (("cvr_drop", cvr_drop), ("cvr_change", cvr_change)) if k in signals]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
