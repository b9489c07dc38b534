"""Replays: training up to a date, testing after it; fewer accounts; weeks of disruption."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from admeridian.operators import templates as T
from admeridian.operators.heldout import predicted_ranges
from admeridian.sources.tables import materialised


def rolling_origin(rows: DataFrame, step_days: int = 7, min_train: int = 50) -> DataFrame:
    """Weekly cut-offs: templates trained on all before a cut-off predict the week after it."""
    span = rows.agg(F.min("change_date").alias("lo"), F.max("change_date").alias("hi"))
    cuts = span.select(F.explode(F.sequence(F.date_add("lo", step_days), F.col("hi"), F.expr(f"INTERVAL {step_days} DAYS"))).alias("lo"))  # one row per week
    found = predicted_ranges(rows, cuts.select(F.col("lo").alias("range_id"), "lo", F.date_add("lo", step_days).alias("hi")), min_train)
    return found.withColumnRenamed("range_id", "cutoff")


def disruption(rows: DataFrame, weeks: DataFrame) -> DataFrame:
    """Accuracy in the two weeks before, during, and in the two weeks after each disrupted week. ``weeks``: week."""
    spans = {"before": (-14, 0), "during": (0, 7), "after": (7, 21)}
    parts = F.array(*[F.struct(F.lit(k).alias("part"), F.date_add("week", a).alias("lo"), F.date_add("week", b).alias("hi")) for k, (a, b) in spans.items()])
    ranges = weeks.select("week", F.explode(parts).alias("p")).select("week", "p.*").withColumn("range_id", F.concat_ws("|", F.col("week").cast("string"), "part"))
    ranges = materialised(ranges, "disruption-ranges")  # read three times; the search for change points behind it is done once
    found = predicted_ranges(rows, ranges.select("range_id", "lo", "hi"), T.MIN_EPISODES)
    return ranges.select("range_id", "week", "part").join(found, "range_id", "left").drop("range_id")


def account_samples(accounts: DataFrame, tiers: tuple[int, ...], repeats: int) -> DataFrame:
    """(tier, rep, account_id): stratified by business type, the accounts of a type in order of their ids, rotated from repeat to
    repeat. A tier that holds all accounts has one repeat. The windows run over one row per account, tier and repeat."""
    typed = accounts.select("account_id", F.coalesce(F.nullif("business_type", F.lit("")), F.lit("unknown")).alias("kind"))
    w = Window.partitionBy("kind")
    typed = typed.withColumns({"_p": F.row_number().over(w.orderBy("account_id")) - 1, "_size": F.count("*").over(w), "_first": F.min("account_id").over(w)})
    total = typed.agg(F.count("*").alias("_total"))
    runs = F.explode(F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(r).alias("rep")) for t in tiers for r in range(repeats)]))
    rows = typed.crossJoin(F.broadcast(total)).withColumn("_run", runs).select("*", "_run.tier", "_run.rep").filter("rep = 0 OR tier < _total")
    place = F.pmod(F.col("_p") - F.pmod(F.col("rep") * 7 + 1, F.col("_size")), F.col("_size"))
    take = F.greatest(F.lit(1), F.bround(F.least("tier", "_total") * F.col("_size") / F.col("_total")).cast("int"))
    rows = rows.withColumn("_place", place).filter(F.col("_place") < take)
    order = Window.partitionBy("tier", "rep").orderBy("_first", "_place")
    return rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= F.least("tier", "_total")).select("tier", "rep", "account_id")


def learning_curve(rows: DataFrame, accounts: DataFrame, tiers: tuple[int, ...] = (50, 100, 150, 223), repeats: int = 5) -> DataFrame:
    """How many templates, how much coverage and what accuracy of the active ones fewer accounts would give, mean and spread over the
    repeats of each tier."""
    with_episodes = accounts.join(rows.select("account_id").distinct(), "account_id", "left_semi")
    samples = account_samples(with_episodes, tiers, repeats)
    slim = rows.select("episode_id", "account_id", "direction", *T.LEVELS[0]).join(samples, "account_id")
    by = ["tier", "rep"]
    enough = slim.groupBy(*by).agg(F.count("*").alias("n_sample")).filter(F.col("n_sample") >= T.MIN_EPISODES)
    members = T.cascade(slim, by=by)
    covered = members.groupBy(*by).agg(F.count("*").alias("n_covered"), F.countDistinct("template_id").alias("n_templates"))
    accuracy = T.active_directions(members, by).filter("status = 'ACTIVE'").groupBy(*by).agg(F.avg("direction_accuracy").alias("accuracy"))
    runs = enough.join(covered, by, "left").join(accuracy, by, "left").fillna(0, ["n_covered", "n_templates"]).withColumn("coverage", F.col("n_covered") / F.col("n_sample"))
    return runs.groupBy("tier").agg(F.count("*").alias("repeats"), F.avg("n_templates").alias("templates_mean"), F.stddev_pop("n_templates").alias("templates_std"), F.avg("coverage").alias("coverage_mean"), F.avg("accuracy").alias("accuracy_mean"), F.stddev_pop("accuracy").alias("accuracy_std"))
