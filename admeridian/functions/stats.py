"""Statistics as column expressions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admeridian.functions.config import case

VOLATILE_CV, SIGNIFICANT_P, MIN_POINTS = 0.30, 0.10, 7
#: The favourable direction of a metric; 0: neither.
FAVORABLE = {"cpa": -1, "cvr": 1, "ctr": 1, "roas": 1, "impression_share": 1, "cost": 0}
MAGNITUDE_CAP = 3.0


def rnd(x: Column, digits: int) -> Column:
    """Rounds on the scaled double, the same in every engine."""
    return F.round(x * float(10**digits)) / float(10**digits)


def winsorised(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(MAGNITUDE_CAP), x))


def t_two_sided(t: Column, dof: Column) -> Column:
    """Two-sided p of Student's t for whole degrees of freedom, by the finite series in the cosine of atan(t / sqrt(dof))."""
    theta = F.atan(F.abs(t) / F.sqrt(dof.cast("double")))
    c2 = F.cos(theta) * F.cos(theta)
    odd = dof % 2 == 1
    terms = F.when(odd, (dof - 3) / 2).otherwise((dof - 2) / 2).cast("int")
    first = F.when(odd, F.cos(theta)).otherwise(F.lit(1.0))

    def step(s: Column, i: Column) -> Column:
        factor = F.when(odd, (2 * i) / (2 * i + 1)).otherwise((2 * i - 1) / (2 * i)).cast("double")
        term = s["term"] * factor * c2
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    start = F.struct(first.alias("term"), first.alias("total"))
    steps = F.when(terms >= 1, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(steps, start, step, lambda s: s["total"])
    area = F.when(dof == 1, theta * 2 / math.pi).when(odd, (theta + F.sin(theta) * total) * 2 / math.pi).otherwise(F.sin(theta) * total)
    return F.greatest(F.lit(0.0), 1 - area)


def trend_sums() -> list[Column]:
    """Aggregates of ``value`` over ``date`` that a trend is made of; days without a value do not count."""
    x, day = F.unix_date("date"), F.when(F.col("value").isNotNull(), F.col("date"))
    return [F.count("value").alias("n"), F.regr_slope("value", x).alias("slope"), F.regr_r2("value", x).alias("r2"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.max_by("value", day).alias("current_value"), (F.min(day) < F.max(day)).alias("days")]


def with_trend(rows: DataFrame, metric: Column, minimum: int = MIN_POINTS) -> DataFrame:
    """Rows of ``trend_sums`` with p_value, r_squared, cv, classification, and ``found``: whether they make a trend."""
    rows = rows.withColumns({"found": (F.col("n") >= minimum) & F.coalesce("days", F.lit(False)), "r_squared": F.when(F.col("std") <= 1e-12 * F.abs("mean"), 0.0).otherwise(F.col("r2"))})
    t = F.sqrt(F.col("r_squared") * (F.col("n") - 2) / (1 - F.col("r_squared")))
    p = F.when(~F.col("found"), F.lit(None)).when(F.col("r_squared") >= 1 - 1e-15, 0.0).otherwise(t_two_sided(t, F.col("n") - 2))
    rows = rows.withColumns({"p_value": p, "cv": F.when(F.col("mean") != 0, F.col("std") / F.abs("mean")).otherwise(0.0), "_fav": case(metric, FAVORABLE, 0)})
    sign = F.col("slope") * F.col("_fav")
    label = F.when(F.col("cv") > VOLATILE_CV, "volatile").when(F.col("p_value") >= SIGNIFICANT_P, "stable").when(F.col("_fav") == 0, F.when(F.col("slope") > 0, "rising").otherwise("falling")).when(sign > 0, "improving").otherwise("declining")
    return rows.withColumn("classification", label)


def trend(points: DataFrame, keys: list[str], metric: str | Column = "metric", minimum: int = MIN_POINTS) -> DataFrame:
    """Least-squares trend of ``value`` over ``date`` for each key: slope, p_value, r_squared, cv, current_value, projected_7d,
    classification, n. Series of fewer than ``minimum`` points, or on one day, have none."""
    metric = F.col(metric) if isinstance(metric, str) else metric
    rows = points.filter("value IS NOT NULL").withColumn("_metric", metric).groupBy(*keys, "_metric").agg(*trend_sums())
    rows = with_trend(rows, F.col("_metric"), minimum).filter("found")
    return rows.select(*keys, *([F.col("_metric").alias("metric")] if "metric" not in keys else []), "n", "slope", "p_value", "r_squared", "classification", "cv", "current_value", (F.col("current_value") + F.col("slope") * 7).alias("projected_7d"))


def wilson(k: Column, n: Column, z: float = 1.959963985) -> tuple[Column, Column]:
    """Lower and upper end of the 95 % score interval of k / n."""
    p = k / n
    denominator = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / denominator
    margin = z / denominator * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.greatest(F.lit(0.0), centre - margin), F.least(F.lit(1.0), centre + margin)


def two_proportion_z(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    pool = (k1 + k2) / (n1 + n2)
    error = F.sqrt(pool * (1 - pool) * (1 / n1 + 1 / n2))
    return F.when(error == 0, 0.0).otherwise((k1 / n1 - k2 / n2) / error)


def normal_two_sided(z: Column) -> Column:
    """Two-sided p of a standard normal; the error function is not among Spark's own functions."""

    def p(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda v: math.erfc(abs(v) / math.sqrt(2)), na_action="ignore")

    return F.pandas_udf(p, "double")(z)


def fisher_greater(a: Column, b: Column, c: Column, d: Column) -> Column:
    """One-sided p of Fisher's exact test that a is larger than chance, for the table ((a, b), (c, d))."""

    def p(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for rows in batches:
            out = []
            for w, x, y, z in zip(*rows, strict=True):
                top, left, n = w + x, w + y, w + x + y + z
                whole = math.lgamma(n + 1) - math.lgamma(left + 1) - math.lgamma(n - left + 1)
                choose = lambda m, k: math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1)
                out.append(min(1.0, sum(math.exp(choose(top, i) + choose(n - top, left - i) - whole) for i in range(w, min(top, left) + 1))))
            yield pd.Series(out, dtype="float64")

    return F.pandas_udf(p, "double")(a, b, c, d)
