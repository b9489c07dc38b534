"""Predictions resolved as a stream, with timers in event time.

Loads come in order of their date ``as_of``: predictions as they are registered, daily facts as they are known. Each account keeps
the open predictions and the sums of the recent days of its campaigns, so a run takes a step an account, not a step a campaign. A prediction opens three timers, one for each of ``operate.WINDOWS``; when the
clock, the latest ``as_of`` of the stream, reaches the end of a window, its sums before and after are emitted, whether or not the
campaign has facts that day. A fact that comes later, or that corrects an earlier one, changes sums that have been emitted: they are
emitted again as the next ``revision``. The verdicts on these sums are the batch operator's own.

A run takes up where the last one ended. Rows go to a stored table by prediction, window and revision, so a batch that is repeated
adds nothing. Defined results: a fact is known by campaign and day, the last one read counts; predictions of whole accounts
(``campaign_id`` empty) are left out, as in the batch; a prediction that comes again changes nothing; loads older than the clock by
more than ``LATE`` days are too late and are not read. A campaign keeps ``KEPT`` days of facts for predictions to come, and a
prediction for ``KEPT`` days after its last window.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from admeridian.operators import operate
from admeridian.sources import store

EVENTS = "kind string, account_id string, campaign_id string, as_of timestamp, prediction_id string, date date, cost_micros long, conversions double"
SUMS = "prediction_id string, window_days int, revision int, resolved_on date, pre_micros long, pre_conv double, post_micros long, post_conv double"
#: Days that a load may be older than the newest one; days that facts and resolved predictions are kept.
LATE, KEPT = 1, 45
BEFORE = 7


def events(predictions: DataFrame, daily: DataFrame, known_on: str = "date") -> DataFrame:
    """Predictions and facts as rows of one feed; facts are known on the day in ``known_on``."""
    facts = daily.groupBy("account_id", "campaign_id", "date").agg(F.sum("cost_micros").alias("cost_micros"), F.sum("conversions").alias("conversions"), F.max(known_on).alias("_on"))
    made = predictions.filter("campaign_id <> ''").select(F.lit("prediction").alias("kind"), "account_id", "campaign_id", F.col("registered_at").cast("timestamp").alias("as_of"), "prediction_id", F.col("registered_at").alias("date"))
    seen = facts.select(F.lit("fact").alias("kind"), "account_id", "campaign_id", F.col("_on").cast("timestamp").alias("as_of"), "date", "cost_micros", "conversions")
    return seen.unionByName(made, allowMissingColumns=True).select(*[x.split()[0] for x in EVENTS.split(", ")])


def _day(ms: int) -> int:
    return (dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=ms)).date().toordinal()


def _sums(facts: dict[int, list], at: int, window: int) -> list:
    """Cost and conversions before and after; None where there is no fact."""
    out = []
    for first, last in ((at - BEFORE, at), (at, at + window)):
        own = [facts[d] for d in range(first, last) if d in facts]
        out += [sum(x[0] for x in own) if own else None, sum(x[1] for x in own) if own else None]
    return out


def _told(facts: dict[int, list], made: dict, now: int, touched: list[int]) -> tuple[list, list[int]]:
    """What a campaign emits, and the days on which its open windows end. Windows that were told and hold none of the ``touched`` days
    are not summed again."""
    rows, due = [], []
    first, last = (min(touched), max(touched)) if touched else (0, -1)
    for name, p in made.items():
        for w in operate.WINDOWS:
            if p["at"] + w > now:
                due.append(p["at"] + w)
                continue
            told = p["told"].get(str(w))
            if told is not None and (last < p["at"] - BEFORE or first >= p["at"] + w):
                continue
            sums = _sums(facts, p["at"], w)
            if told is None or told[1] != sums:
                revision = 0 if told is None else told[0] + 1
                p["told"][str(w)] = [revision, sums]
                rows.append((name, w, revision, dt.date.fromordinal(now), *sums))
    return rows, due


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One account: ``held`` has the open predictions and the days of each of its campaigns, and when it is next due."""
    held = json.loads(state.get[0]) if state.exists else {}
    now = _day(state.getCurrentWatermarkMs()) + LATE
    touched: dict[str, list[int]] = {}
    for frame in frames:
        now = max(now, frame["as_of"].max().toordinal()) if len(frame) else now
        for r in frame[["kind", "campaign_id", "prediction_id", "date", "cost_micros", "conversions"]].itertuples(index=False):
            own = held.setdefault(r.campaign_id, {"open": {}, "facts": {}, "due": 0})
            days, day = touched.setdefault(r.campaign_id, []), r.date.toordinal()
            if r.kind == "prediction":
                own["open"].setdefault(r.prediction_id, {"at": day, "told": {}})
            else:
                own["facts"][str(day)] = [int(r.cost_micros), float(r.conversions)]
                days.append(day)
    rows = []
    for campaign in [c for c, own in held.items() if c in touched or own["due"] <= now]:
        own = held[campaign]
        facts, made = {int(d): x for d, x in own["facts"].items()}, own["open"]
        out, due = _told(facts, made, now, touched.get(campaign, []))
        rows += out
        made = {k: p for k, p in made.items() if p["at"] + max(operate.WINDOWS) + KEPT > now}
        oldest = min([now - KEPT, *(p["at"] - BEFORE for p in made.values())])
        facts = {str(d): x for d, x in facts.items() if d >= oldest}
        if made or facts:
            held[campaign] = {"open": made, "facts": facts, "due": min(due, default=now + KEPT)}
        else:
            del held[campaign]
    if held:
        state.update((json.dumps(held),))
        # a timer goes off when the watermark, LATE days behind the clock, has passed it
        next_day = min(own["due"] for own in held.values())
        state.setTimeoutTimestamp(int((dt.datetime.fromordinal(next_day - LATE) - dt.datetime(1970, 1, 1)).total_seconds() * 1000) - 1)
    elif state.exists:
        state.remove()
    if rows:
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in SUMS.split(", ")]).astype({"pre_micros": "Int64", "post_micros": "Int64"})


def table(spark: SparkSession, path: str | None = None) -> store.Stored:
    """A stored table for what the stream emits, by the day it is emitted on."""
    return store.create(spark, spark.createDataFrame([], SUMS).schema, ("prediction_id", "window_days", "revision"), day="resolved_on", bucketed=("prediction_id",), buckets=8, path=path)


def run(spark: SparkSession, source: str, target: store.Stored, checkpoint: str, files: int | None = None) -> None:
    """Takes in all loads in the folder ``source`` that no earlier run with this ``checkpoint`` has seen, ``files`` at a time."""
    reader = spark.readStream.schema(EVENTS)
    feed = (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(source)
    watched = feed.withWatermark("as_of", f"{LATE} days").groupBy("account_id")
    sums = watched.applyInPandasWithState(_step, SUMS, "held string", "append", GroupStateTimeout.EventTimeTimeout)
    query = sums.writeStream.foreachBatch(lambda batch, batch_id: target.add(batch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def latest(target: store.Stored) -> DataFrame:
    """The last revision of each prediction and window."""
    w = Window.partitionBy("prediction_id", "window_days").orderBy(F.desc("revision"))
    return target.read().withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def resolutions(target: store.Stored, predictions: DataFrame) -> DataFrame:
    """The batch operator's rows from the stream's last sums, with their ``revision``."""
    rows = latest(target).join(predictions, "prediction_id")
    return operate.scored(rows.withColumns({f"{x}": operate.cost_per_conversion(F.col(f"{x}_micros"), F.col(f"{x}_conv")) for x in ("pre", "post")}), "revision")
