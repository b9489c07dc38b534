"""Trust: patterns of signals, audit votes, checksums, inventory, provenance, versions, events, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from admeridian.functions.signals import identifier

RANK = {"info": 0, "warning": 1, "critical": 2}


def patterns(found: DataFrame) -> DataFrame:
    """Signals grouped by domain and type: largest severity, whether several accounts are hit, confidence by count, evidence."""
    rank = F.when(F.col("severity") == "critical", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    rows = found.groupBy("domain", "signal_type").agg(F.max(rank).alias("rank"), F.count("*").alias("n"), F.countDistinct("account_id").alias("n_accounts"), F.min_by("message", "signal_id").alias("first_message"),
        F.min("signal_id").alias("first_signal"))
    # ten pieces of evidence, ranked within the group, so that no group is gathered whole
    top = found.withColumn("_rank", F.row_number().over(Window.partitionBy("domain", "signal_type").orderBy("signal_id"))).filter("_rank <= 10").groupBy("domain", "signal_type").agg(F.array_sort(F.collect_list("signal_id")).alias("evidence"))
    n = F.col("n")
    severity = F.element_at(F.array(F.lit("info"), F.lit("warning"), F.lit("critical")), F.col("rank") + 1)
    confidence = F.when(n >= 5, 0.9).when(n >= 3, 0.75).when(n >= 2, 0.6).otherwise(0.5)
    summary = F.format_string("%s: %d instances across %d accounts: %s", "signal_type", "n", "n_accounts", "first_message")
    return rows.join(top, ["domain", "signal_type"]).select(identifier("domain", "signal_type").alias("pattern_id"), "domain", "signal_type", F.when(F.col("n_accounts") > 1, "cross_account").otherwise("threshold_violation").alias("pattern_type"), severity.alias("severity"), confidence.alias("confidence"), "n", "n_accounts", summary.alias("summary"), "evidence")


def verdicts(tests: DataFrame) -> DataFrame:
    """(detector, signal_id, test, verdict) rows to one vote per signal."""
    c = lambda v: F.count_if(F.col("verdict") == v)
    rows = tests.groupBy("detector", "signal_id").agg(c("confirm").alias("confirm"), c("disconfirm").alias("disconfirm"), c("inconclusive").alias("inconclusive"))
    yes, no = F.col("confirm"), F.col("disconfirm")
    return rows.withColumn("overall", F.when(no >= 2, "likely_false_positive").when((no == 1) & (yes >= 2), "confirmed_with_caveat").when((yes >= 3) & (no == 0), "well_supported").when((yes >= 2) & (no == 0), "supported").otherwise("weak_evidence"))


def test_table(tests: DataFrame) -> DataFrame:
    """Verdict counts of each test, and whether it is to be relied on."""
    rows = tests.groupBy("detector", "test").pivot("verdict", ["confirm", "disconfirm", "inconclusive"]).agg(F.count(F.lit(1))).fillna(0)
    yes, no, unknown = F.col("confirm"), F.col("disconfirm"), F.col("inconclusive")
    call = F.when(no > yes, "unreliable").when((no > 0) & (yes > 0), "mixed").when((no + unknown) == 0, "holds").when((yes + no) == 0, "needs data").otherwise("partial")
    return rows.withColumn("recommendation", call)


def scorecard(votes: DataFrame, detectors: list[str], tolerated: float = 0.15) -> DataFrame:
    """KEEP, MONITOR or REVISE by the share of likely false positives; NO_SIGNALS for silent detectors."""
    rows = votes.groupBy("detector").agg(F.count("*").alias("n"), F.avg((F.col("overall") == "likely_false_positive").cast("double")).alias("false_positive_rate"))
    rate = F.col("false_positive_rate")
    known = votes.sparkSession.createDataFrame([(d,) for d in detectors], "detector string")
    call = F.when(rate.isNull(), "NO_SIGNALS").when(rate == 0, "KEEP").when(rate < tolerated, "MONITOR").otherwise("REVISE")
    return known.join(rows, "detector", "left").fillna(0, ["n"]).withColumn("call", call)


def detector_calls(votes: DataFrame, detectors: list[str]) -> DataFrame:
    """KEEP, MONITOR, TIGHTEN or REVISE for each detector; NO_SIGNALS for silent ones."""
    c = lambda *v: F.count_if(F.col("overall").isin(*v))
    rows = votes.groupBy("detector").agg(F.count("*").alias("n"), c("likely_false_positive").alias("false_positive"), c("likely_false_positive", "weak_evidence").alias("bad"), c("supported", "well_supported").alias("good"))
    call = F.when(F.col("bad") > F.col("good"), "REVISE").when(F.col("false_positive") > 0, "TIGHTEN").when(F.col("good") == F.col("n"), "KEEP").otherwise("MONITOR")
    known = votes.sparkSession.createDataFrame([(d,) for d in detectors], "detector string")
    return known.join(rows.withColumn("call", call), "detector", "left").fillna(0, ["n", "false_positive", "bad", "good"]).fillna("NO_SIGNALS", ["call"])


# --- checksums and checks ---


def checksums(facts: DataFrame, date: str = "date") -> DataFrame:
    """Rows and an order-free content sum of each day. A field is told from its neighbours by its length, null from the empty text."""
    text = lambda c: F.col(c).cast("string")
    fields = [F.coalesce(F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in sorted(facts.columns)]
    part = F.conv(F.substring(F.md5(F.concat(*fields)), 1, 15), 16, 10).cast("decimal(20,0)")
    return facts.groupBy(F.col(date).cast("date").alias("date")).agg(F.count("*").alias("n_rows"), F.sum(part).cast("string").alias("content"))


def checksums_of(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(table_name, date, n_rows, content) over several tables; each comes with the column that dates its rows."""
    out = None
    for name, (rows, date) in tables.items():
        one = checksums(rows, date).select(F.lit(name).alias("table_name"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def flagged(before: DataFrame, after: DataFrame) -> DataFrame:
    """The checksums of a run with what the run before had of the same table and day, and whether its content has changed. A day that
    is new has not changed, one that is gone has no content."""
    old = before.select("table_name", F.col("date").alias("_date"), F.col("n_rows").alias("n_before"), F.col("content").alias("previous"))
    same = (after["table_name"] == old["table_name"]) & after["date"].eqNullSafe(old["_date"])
    rows = after.join(old, same, "full_outer")
    changed = F.col("previous").isNotNull() & ~F.col("content").eqNullSafe(F.col("previous"))
    return rows.select(F.coalesce(after["table_name"], old["table_name"]).alias("table_name"), F.coalesce("date", "_date").alias("date"), "n_rows", "content", "n_before", "previous", changed.alias("changed"))


def changed_days(before: DataFrame, after: DataFrame) -> DataFrame:
    a, b = before.select("date", F.col("n_rows").alias("n_before"), F.col("content").alias("c_before")), after
    return a.join(b, "date", "full_outer").filter(~(F.col("c_before").eqNullSafe(F.col("content")) & F.col("n_before").eqNullSafe(F.col("n_rows"))))


def spot_check(rows: DataFrame, top: int = 5) -> DataFrame:
    """For each campaign and action up to ``top`` real episodes of the same state, the account's own first."""
    asked = rows.groupBy("account_id", "campaign_id", "pre_state", "change_category").agg(F.count("*").alias("_n")).drop("_n")
    w = Window.partitionBy("pre_state", "change_category").orderBy(F.desc("change_date"), "episode_id")
    pool = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top).select("pre_state", "change_category", F.col("account_id").alias("other"), "episode_id", "signed", F.col("_r").alias("_r"))
    own_w = Window.partitionBy("account_id", "pre_state", "change_category").orderBy(F.desc("change_date"), "episode_id")
    own = rows.withColumn("_r", F.row_number().over(own_w)).filter(F.col("_r") <= top).select("account_id", "pre_state", "change_category", "episode_id", "signed", "_r")
    a = asked.join(own, ["account_id", "pre_state", "change_category"]).withColumn("_o", F.lit(0))
    b = asked.join(pool, ["pre_state", "change_category"]).filter("other <> account_id").drop("other").withColumn("_o", F.lit(1))
    order = Window.partitionBy("account_id", "campaign_id", "pre_state", "change_category").orderBy("_o", "_r")
    both = a.unionByName(b).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)
    return both.select("account_id", "campaign_id", "pre_state", "change_category", "place", "episode_id", "signed")


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and accounts of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n_rows"), F.countDistinct("account_id").alias("n_accounts")).select(F.lit(name).alias("table_name"), "n_rows", "n_accounts")
        out = one if out is None else out.unionByName(one)
    return out


def firing(found: DataFrame, detectors: list[str], noisy: int = 50) -> DataFrame:
    """SILENT, CREDIBLE or NOISY by the number of signals."""
    known = found.sparkSession.createDataFrame([(d,) for d in detectors], "signal_type string")
    counts = found.groupBy("signal_type").agg(F.count("*").alias("n"))
    return known.join(counts, "signal_type", "left").fillna(0, ["n"]).withColumn("call", F.when(F.col("n") == 0, "SILENT").when(F.col("n") > noisy, "NOISY").otherwise("CREDIBLE"))


# --- provenance, versions, events, health ---


def resolved_once(entries: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Ledger entries with their outcome and its hash. An entry that has one keeps it; of several new outcomes of an entry the first
    by its text counts. ``outcomes``: prediction_id, actual_direction, actual_metrics (a struct or map)."""
    body = F.to_json(F.struct("actual_direction", "actual_metrics"))
    new = outcomes.select("prediction_id", F.struct(F.sha2(body, 256).alias("hash"), F.col("actual_direction")).alias("r")).groupBy("prediction_id").agg(F.min("r").alias("_r"))
    old = {c: F.col(c) if c in entries.columns else F.lit(None).cast("string") for c in ("resolution_hash", "actual_direction")}
    rows = entries.join(new, "prediction_id", "left")
    open_ = old["resolution_hash"].isNull()
    return rows.withColumns({"actual_direction": F.when(open_, F.col("_r.actual_direction")).otherwise(old["actual_direction"]), "resolution_hash": F.when(open_, F.col("_r.hash")).otherwise(old["resolution_hash"])}).drop("_r")


def template_links(members: DataFrame, version: int = 1) -> DataFrame:
    """Which episodes formed which magnitude-aware template."""
    marked = F.when(F.startswith("template_id", F.lit("mag:")), F.col("template_id")).otherwise(F.concat(F.lit("mag:"), "template_id"))
    return members.select(marked.alias("template_id"), F.lit(version).alias("template_version"), "episode_id")


def provenance(predictions: DataFrame, links: DataFrame, baseline: DataFrame) -> DataFrame:
    """A hash per prediction over its key, the episodes behind its template and the size of the baseline of its state. Episodes
    enter as a hash of per-block hashes, so that no template's list is gathered whole."""
    per = episode_digest(links)
    quiet = baseline.groupBy("state").agg(F.count("*").alias("baseline_n"))
    rows = predictions.select("prediction_id", "template_id", "state").join(per, "template_id", "left").join(quiet, "state", "left").fillna(0, ["episode_count", "baseline_n"])
    return rows.withColumn("provenance_hash", F.sha2(F.concat_ws("|", "prediction_id", "template_id", F.coalesce("episodes_hash", F.lit("")), F.col("episode_count").cast("string"), F.col("baseline_n").cast("string")), 256))


def episode_digest(links: DataFrame) -> DataFrame:
    """template_id, episode_count, episodes_hash: ids are dealt to 256 blocks by hash, each block's sorted ids are hashed, then the
    block hashes in order."""
    blocks = links.withColumn("_b", F.substring(F.sha2("episode_id", 256), 1, 2)).groupBy("template_id", "_b").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("episode_id")), ","), 256).alias("h"))
    tops = F.transform(F.array_sort(F.collect_list(F.struct("_b", "h"))), lambda x: x["h"])
    return blocks.groupBy("template_id").agg(F.sum("n").alias("episode_count"), F.sha2(F.array_join(tops, ","), 256).alias("episodes_hash"))


def version_snapshot(templates: DataFrame, forecasts: DataFrame, links: DataFrame, version: int, commit: str) -> DataFrame:
    """template_id, version, version_hash over what a template says and what it rests on."""
    told = F.concat_ws(":", "metric", *[F.format_number(c, 6) for c in ("median_delta", "iqr_low", "iqr_high")])
    per = forecasts.groupBy(F.regexp_replace("template_id", "^mag:", "").alias("template_id")).agg(F.array_join(F.array_sort(F.collect_list(told)), ",").alias("_told"))  # at most nine metrics
    rows = templates.join(per, "template_id", "left").join(episode_digest(links), "template_id", "left")
    text = F.concat_ws("|", "template_id", F.lit(str(version)), "prediction_direction", F.coalesce("_told", F.lit("")), F.coalesce("episodes_hash", F.lit("")), F.col("n_episodes").cast("string"), F.col("n_accounts").cast("string"), F.format_number("direction_accuracy", 6))
    return rows.select("template_id", F.lit(version).alias("version"), F.sha2(text, 256).alias("version_hash"), F.lit(commit).alias("code_commit"))


def irreproducible(frozen: DataFrame, fresh: DataFrame) -> DataFrame:
    """Frozen versions that are not made again alike: missing, or with another hash."""
    now = fresh.select("template_id", "version", F.col("version_hash").alias("_now"))
    rows = frozen.join(now, ["template_id", "version"], "left").filter(~F.col("version_hash").eqNullSafe(F.col("_now")))
    return rows.select("template_id", "version", F.when(F.col("_now").isNull(), "missing").otherwise("hash differs").alias("reason"))


EVENTS = "event_id string, event_type string, severity string, related_entity string, created_at date, resolved_at date"


def drift_events(health: DataFrame, log: DataFrame, today: Column) -> DataFrame:
    """Events for templates that drift and have no open drift event: appended to the log, a rerun adds nothing."""
    open_ = log.filter("event_type = 'drift_alert' AND resolved_at IS NULL").select(F.col("related_entity").alias("template_id"))
    new = health.filter("drift_flag = 'DRIFT'").join(open_, "template_id", "left_anti")
    return new.select(identifier(F.lit("drift_alert"), "template_id", today).alias("event_id"), F.lit("drift_alert").alias("event_type"), F.lit("warning").alias("severity"), F.col("template_id").alias("related_entity"), today.alias("created_at"), F.lit(None).cast("date").alias("resolved_at"))


def event_counts(log: DataFrame, days: int = 7) -> DataFrame:
    """Open drift alerts, all open events, events of the last days up to the newest; one row."""
    newest = log.agg(F.max("created_at").alias("_last"))
    open_ = F.col("resolved_at").isNull()
    return log.crossJoin(F.broadcast(newest)).agg(F.count_if(open_ & (F.col("event_type") == "drift_alert")).alias("open_drift"), F.count_if(open_).alias("open_events"), F.count_if(F.col("created_at") >= F.date_sub("_last", days)).alias("recent"))


#: What each failing costs of 100 points.
DEDUCTIONS = {"ledger": 40, "checksums": 30, "reproducibility": 20, "drift": 10, "recent": 10, "accuracy": 15, "accuracy_slightly": 5}


def health_score(broken: DataFrame, changed: DataFrame, unlike: DataFrame, events: DataFrame, scores: DataFrame, usual_accuracy: float = 0.67) -> DataFrame:
    """One row: score and status from broken ledger links, changed days, versions that cannot be made again, events, and the
    accuracy of decisive 14-day calls against the usual one (``scores``: accuracy, one row or none)."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    rows = count(broken, "broken_links").crossJoin(F.broadcast(count(changed, "changed_days"))).crossJoin(F.broadcast(count(unlike, "unlike_versions"))).crossJoin(F.broadcast(events)).crossJoin(F.broadcast(scores.agg(F.coalesce(F.max("accuracy"), F.lit(0.0)).alias("accuracy"))))
    off = F.col("accuracy") - usual_accuracy
    lost = sum((F.when(when, F.lit(DEDUCTIONS[k])).otherwise(0) for k, when in (("ledger", F.col("broken_links") > 0), ("checksums", F.col("changed_days") > 0), ("reproducibility", F.col("unlike_versions") > 0), ("drift", F.col("open_drift") > 3), ("recent", F.col("recent") > 5), ("accuracy", off < -0.10), ("accuracy_slightly", (off < -0.05) & (off >= -0.10)))), F.lit(0))
    rows = rows.withColumn("health_score", F.greatest(F.lit(0), 100 - lost))
    return rows.withColumn("status", F.when(F.col("health_score") >= 80, "healthy").when(F.col("health_score") >= 50, "degraded").otherwise("critical"))
