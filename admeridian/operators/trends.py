"""Trends, volatility and change points of campaign metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from admeridian.functions.stats import MIN_POINTS, trend
from admeridian.functions.windows import anchored, div

WINDOWS = (7, 14, 30)


def metric_columns() -> dict[str, Column]:
    """Daily values; null where a metric is undefined."""
    cost = F.col("cost_micros") / 1e6
    return {"cost": cost, "ctr": div("clicks", "impressions"), "cvr": div("conversions", "clicks"), "cpa": div(cost, "conversions"), "roas": div("conversion_value", cost), "impression_share": F.col("search_impression_share")}


def daily_values(daily: DataFrame, keys: tuple[str, ...] = ("account_id", "campaign_id", "date")) -> DataFrame:
    """One row per key and metric: metric, value."""
    pairs = [F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in metric_columns().items()]
    return daily.select(*keys, F.explode(F.array(*pairs)).alias("p")).select(*keys, "p.metric", "p.value")


def campaign_trends(daily: DataFrame) -> DataFrame:
    """Trends of six metrics over the last 7, 14 and 30 days, for campaigns with enough days."""
    enough = daily.groupBy("account_id", "campaign_id").agg(F.countDistinct("date").alias("days")).filter(F.col("days") >= MIN_POINTS)
    recent = anchored(daily).filter(F.col("date") > F.date_sub("anchor", max(WINDOWS)))
    points = daily_values(recent, ("account_id", "campaign_id", "date", "anchor")).join(enough.select("account_id", "campaign_id"), ["account_id", "campaign_id"], "left_semi")
    points = points.withColumn("window_days", F.explode(F.array(*[F.lit(w) for w in WINDOWS]))).filter(F.col("date") > F.date_sub("anchor", F.col("window_days")))
    return trend(points, ["account_id", "campaign_id", "metric", "window_days"])


def with_volatility(trends: DataFrame) -> DataFrame:
    """Volatility class and threshold multiplier of the 30-day trends."""
    cv = F.col("cv")
    level = F.when(cv > 0.40, "high").when(cv > 0.15, "medium").otherwise("low")
    return trends.filter("window_days = 30").withColumns({"volatility_class": level, "threshold_multiplier": F.when(cv > 0.40, 1.5).when(cv > 0.15, 1.0).otherwise(0.7)})


#: Signal type: the metric whose trend gives it context. Fixed values.
SIGNAL_METRIC = {
    "cvr_drop": "cvr", "cvr_change": "cvr", "cpa_spike": "cpa", "cpa_change": "cpa", "budget_limited_is": "impression_share", "budget_capped": "impression_share", "budget_limited_is_change": "impression_share",
    "budget_capped_change": "impression_share", "pmax_low_conv_volume": "cvr", "pmax_low_conv_volume_change": "cvr",
}


def annotated(found: DataFrame, trends: DataFrame) -> DataFrame:
    """Signals with ``trend_context``, ``trend_slope_30d`` and ``trend_classification_30d``."""
    from admeridian.functions.config import case

    rows = found.withColumn("_metric", case(F.col("signal_type"), SIGNAL_METRIC))
    of = lambda days, n: trends.filter(f"window_days = {days}").select("account_id", "campaign_id", F.col("metric").alias("_metric"), F.col("slope").alias(f"_slope{n}"), F.col("classification").alias(f"_class{n}"))
    rows = rows.join(of(30, 30), ["account_id", "campaign_id", "_metric"], "left").join(of(7, 7), ["account_id", "campaign_id", "_metric"], "left")
    falling = lambda c: F.coalesce(F.col(c).isin("declining", "falling"), F.lit(False))
    context = (
        F.when(F.col("_class30").isNull(), F.lit("too few days for a trend")).when(falling("_class30"), F.lit("had been falling for a month before"))
        .when(F.col("_class30") == "volatile", F.lit("swings this wide are usual here")).when(falling("_class7"), F.lit("level for a month, falling in the last week"))
        .otherwise(F.concat(F.lit("month: "), F.col("_class30")))
    )
    return rows.withColumns({"trend_context": context, "trend_slope_30d": F.col("_slope30"), "trend_classification_30d": F.coalesce("_class30", F.lit(""))}).select(*found.columns, "trend_context", "trend_slope_30d", "trend_classification_30d")


def class_summary(trends: DataFrame) -> DataFrame:
    return trends.groupBy("metric", "classification").agg(F.count("*").alias("n"))


# --- change points ---

MIN_SEGMENT, PENALTY = 14, 3.0
REGIME_METRICS = ("cpa", "cvr", "roas", "impression_share", "cost")


def change_points(values: np.ndarray, min_size: int = MIN_SEGMENT, penalty: float = PENALTY) -> list[int]:
    """Starts of segments after the first: optimal partitioning of the standardised series under squared error and a penalty
    per segment, with a minimum length."""
    n = len(values)
    if n < 2 * min_size:
        return []
    y = np.asarray(values, float)
    y = y - y.mean()
    if (s := y.std()) > 0:
        y = y / s
    one, two = np.concatenate([[0.0], np.cumsum(y)]), np.concatenate([[0.0], np.cumsum(y * y)])
    best, came = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = -penalty
    for end in range(min_size, n + 1):
        starts = np.concatenate([[0], np.arange(min_size, end - min_size + 1)])
        total = best[starts] + two[end] - two[starts] - (one[end] - one[starts]) ** 2 / (end - starts) + penalty
        k = int(np.argmin(total))
        best[end], came[end] = total[k], starts[k]
    out, at = [], n
    while came[at] > 0:
        at = int(came[at])
        out.append(at)
    return out[::-1]


def change_points_of(series: np.ndarray, min_size: int = MIN_SEGMENT, penalty: float = PENALTY) -> np.ndarray:
    """``change_points`` of many series of one length at once, one a row: for each day, whether a segment starts there."""
    rows, n = series.shape
    marks = np.zeros((rows, n + 1), bool)
    if n < 2 * min_size or not rows:
        return marks[:, :n]
    y = series - series.mean(axis=1, keepdims=True)
    s = y.std(axis=1, keepdims=True)
    y = np.divide(y, s, out=y, where=s > 0)
    zero = np.zeros((rows, 1))
    one, two = np.hstack([zero, np.cumsum(y, axis=1)]), np.hstack([zero, np.cumsum(y * y, axis=1)])
    best, came = np.full((rows, n + 1), np.inf), np.zeros((rows, n + 1), int)
    best[:, 0] = -penalty
    for end in range(min_size, n + 1):
        starts = np.concatenate([[0], np.arange(min_size, end - min_size + 1)])
        total = best[:, starts] + two[:, [end]] - two[:, starts] - (one[:, [end]] - one[:, starts]) ** 2 / (end - starts) + penalty
        k = np.argmin(total, axis=1)
        best[:, end], came[:, end] = np.take_along_axis(total, k[:, None], 1)[:, 0], starts[k]
    every, at = np.arange(rows), np.full(rows, n)
    while at.any():
        at = came[every, at]
        marks[every, at] = True
    marks[:, 0] = False
    return marks[:, :n]


REGIMES = "account_id string, campaign_id string, metric string, change_date date, pre_mean double, post_mean double, shift_magnitude double, shift_direction string, days_before int, days_after int"


def regimes(daily: DataFrame, min_size: int = MIN_SEGMENT, penalty: float = PENALTY) -> DataFrame:
    """One row per change point of a campaign's metric; the part after it reaches to the end of the series. A campaign's days are
    gathered in one row, and the series of a batch of campaigns that have equally many days are searched together."""
    values = metric_columns()
    facts = daily.select("account_id", "campaign_id", "date", *[values[m].cast("double").alias(m) for m in REGIME_METRICS])
    campaigns = facts.groupBy("account_id", "campaign_id").agg(F.collect_list(F.struct("date", *REGIME_METRICS)).alias("days"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [c.split()[0] for c in REGIMES.split(", ")]
        for batch in batches:
            held = batch.column("days")
            days, owner = held.flatten(), np.repeat(np.arange(batch.num_rows), np.diff(held.offsets.to_numpy()))
            dates = days.field("date").cast("int32").to_numpy(zero_copy_only=False)
            accounts, names, out = batch.column("account_id"), batch.column("campaign_id"), []
            for metric in REGIME_METRICS:
                known = days.field(metric).is_valid().to_numpy(zero_copy_only=False)
                v, d, o = days.field(metric).to_numpy(zero_copy_only=False)[known], dates[known], owner[known]
                order = np.lexsort((v, d, o))
                v, d, o = v[order], d[order], o[order]
                firsts = np.flatnonzero(np.r_[True, o[1:] != o[:-1]]) if len(o) else np.array([], int)
                lengths = np.diff(np.r_[firsts, len(o)])
                for n in np.unique(lengths[lengths >= 2 * min_size]):
                    at = firsts[lengths == n]
                    series = v[at[:, None] + np.arange(n)]
                    marks = change_points_of(series, min_size, penalty)
                    for i in np.flatnonzero(marks.any(axis=1)):
                        one, start = series[i], 0
                        for cut in np.flatnonzero(marks[i]).tolist():
                            if cut - start >= min_size and n - cut >= min_size:
                                pre, post = float(one[start:cut].mean()), float(one[cut:].mean())
                                out.append((int(o[at[i]]), metric, int(d[at[i] + cut]), pre, post, abs((post - pre) / pre) if pre else 0.0, "up" if post > pre else "down", cut - start, int(n) - cut))
                            start = cut
            if out:
                row, *rest = zip(*out, strict=True)
                kinds = [pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.string(), pa.int32(), pa.int32()]
                columns = [pa.array(x, k) for x, k in zip(rest, kinds, strict=True)]
                columns[1] = columns[1].cast(pa.date32())
                yield pa.RecordBatch.from_arrays([accounts.take(pa.array(row)), names.take(pa.array(row)), *columns], fields)

    return campaigns.mapInArrow(find, REGIMES)


def disrupted_weeks(found: DataFrame, sigmas: float = 2.0, top: int = 3) -> DataFrame:
    """Weeks with unusually many change points; the ``top`` fullest where none stands out."""
    weeks = found.groupBy(F.date_trunc("week", "change_date").cast("date").alias("week")).agg(F.count("*").alias("n"))
    stats = weeks.agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"))
    rows = weeks.crossJoin(F.broadcast(stats)).withColumn("stands_out", (F.col("std") > 0) & (F.col("n") >= F.col("mean") + sigmas * F.col("std")))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "week"))  # one row per week
    rows = rows.withColumns({"any": F.max("stands_out").over(Window.partitionBy(F.lit(0))), "place": place})
    return rows.filter(F.when(F.col("any"), F.col("stands_out")).otherwise(F.col("place") <= top)).select("week", "n")
