"""Queries and DuckDB oracles of the operating loop, audits, trust and table maintenance."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admeridian.functions.config import resolve_thresholds
from admeridian.operators import audit, changes, detectors, ledger, operate, simulate, trust
from admeridian.plans.learn_queries import _ALL, _BASE, _CAT, _ROWS, Learned, _held, _w, rounded
from admeridian.sources import store
from admeridian.sources.adapters import Tables, ctes
from admeridian.sources.tables import as_it_lies, dealt, insert_ignore, materialised, shared_dir, upsert_columns, upsert_replace
from admeridian.streaming import resolver


class Operated(Learned):
    @cached_property
    def predictions(self) -> DataFrame:
        return dealt(operate.register(self.rows, self.catalogue, self.baseline), "predictions", "campaign_id")

    @cached_property
    def resolutions(self) -> DataFrame:
        with as_it_lies(self.spark):
            return materialised(operate.resolve(self.predictions, self.days), "resolutions")

    @cached_property
    def told(self) -> DataFrame:
        """What is entered of a prediction."""
        return self.predictions.select("prediction_id", "template_id", "episode_id", "recommendation", "registered_at")

    @cached_property
    def ledger(self) -> ledger.Ledger:
        return _grown(self)

    @cached_property
    def found(self) -> DataFrame:
        d = self.facts
        found = changes.run_all(d)
        for more in (detectors.cpa_spike(d, recent_cpa_multiplier=1.5), detectors.cvr_drop(d), detectors.budget_capped(d, avg_budget_lost_is_min=0.2, min_days_capped=3), detectors.budget_limited_is(d, avg_budget_lost_is_min=0.25)):
            found = found.unionByName(more)
        return materialised(found, "signals")

    @cached_property
    def tests(self) -> DataFrame:
        of = lambda k: self.found.filter(F.col("signal_type") == k)
        kinds = ("cpa_change", "cpa_spike", "cvr_drop", "cvr_change", "budget_capped", "budget_limited_is")
        return materialised(audit.run({k: of(k) for k in kinds}, self.facts, self.change_events), "tests")


def _q(make, *columns: str):
    return lambda spark, sf_dir: (lambda d: rounded(d.select(*columns) if columns else d))(make(Operated(spark, sf_dir)))


def _grown(t) -> ledger.Ledger:
    """The ledger of all predictions, entered in three runs; the last one repeats ids of the first two with other contents."""
    rows = t.told
    first = ledger.append(rows.filter("prediction_id < '6'"))
    second = ledger.append(rows.filter("prediction_id >= '6'"), first)
    return ledger.append(rows.filter("prediction_id < '8'").withColumn("recommendation", F.lit("changed")), second)


def _chained(t) -> DataFrame:
    """Each day's tree and head, and how many of its hashes a check finds broken."""
    bad = ledger.broken(t.ledger, t.told).groupBy(F.col("day").alias("bad_day")).agg(F.count("*").alias("broken"))
    heads = t.ledger.heads
    return heads.join(bad, heads["day"].eqNullSafe(bad["bad_day"]), "left").fillna(0, ["broken"]).select("day", "n", "root", "head", "broken")


def _faults(t) -> DataFrame:
    """Predictions that were changed or removed after they had been entered, by day and kind."""
    now = t.told.filter("prediction_id NOT LIKE '%7'").withColumn("recommendation", F.expr("CASE WHEN prediction_id LIKE '%3' THEN 'EDITED' ELSE recommendation END"))
    return ledger.broken(t.ledger, now).groupBy("day", "reason").agg(F.count("*").alias("n"))


def _proofs(t) -> DataFrame:
    """Inclusion proofs of the predictions of one week, checked against the heads alone; some of them have been edited."""
    asked = t.told.filter("registered_at >= DATE '2024-02-12' AND registered_at < DATE '2024-02-19'")
    proofs = materialised(ledger.proof(t.ledger, asked), "proofs")
    edited = asked.withColumn("recommendation", F.expr("CASE WHEN prediction_id LIKE '%3' THEN 'EDITED' ELSE recommendation END"))
    return ledger.proven(edited, proofs, t.ledger.heads).join(proofs.groupBy("prediction_id").agg(F.count("*").alias("n_hashes")), "prediction_id")


def _halves(t):
    """The daily facts as an old load and a correction of its second half."""
    d = t.daily_metrics.select("account_id", "campaign_id", "date", "clicks", "status")
    old = d.withColumn("loaded", F.lit(1))
    new = d.filter("date >= DATE '2024-02-12'").withColumns({"clicks": F.col("clicks") + 1, "loaded": F.lit(2)})
    return old, new


def _dated(t) -> dict:
    """The four tables whose days are summed up, each with its date."""
    return {
        "daily_metrics": (t.daily_metrics.select("account_id", "campaign_id", "date", "clicks", "cost_micros"), "date"),
        "change_events": (t.change_events.select("account_id", "change_id", "actor", "resource_type", F.to_date("change_timestamp").alias("date")), "date"),
        "search_terms": (t.search_terms.select("account_id", "search_term", "clicks", "cost_micros", "window_end"), "window_end"),
        "ga4_landing_pages": (t.ga4_landing_pages.select("account_id", "date", "landing_page", "device", "sessions"), "date"),
    }


def _changed(t) -> DataFrame:
    """A second run after facts of some days have been corrected, events of one account have been lost and pages have come."""
    tables = _dated(t)
    before = {k: v for k, v in tables.items()} | {"ga4_landing_pages": (tables["ga4_landing_pages"][0].filter("date < DATE '2024-02-01'"), "date")}
    after = dict(tables)
    after["daily_metrics"] = (tables["daily_metrics"][0].withColumn("clicks", F.expr("clicks + CASE WHEN date IN (DATE '2024-02-20', DATE '2024-03-02') AND account_id = 'a3' THEN 1 ELSE 0 END")), "date")
    after["change_events"] = (tables["change_events"][0].filter("account_id <> 'a5'"), "date")
    return trust.flagged(trust.checksums_of(before), trust.checksums_of(after)).groupBy("table_name", "changed").agg(F.count("*").alias("days"), F.sum("n_rows").alias("n_rows"), F.sum("n_before").alias("n_before"))


def _stored(spark, sf_dir, load):
    """The first load of daily facts as a stored table, and what ``load`` makes of it; the rows as they are stored."""
    old, new = _halves(Tables(spark, sf_dir))
    table = store.create(spark, old.schema, ("account_id", "campaign_id"), buckets=8)
    table.replace(old.filter("date < DATE '2024-03-01'"), "loaded")
    load(table, old, new)
    rows = materialised(table.read(), "stored")
    spark.sql(f"DROP TABLE {table.name}")
    return rounded(rows.select("account_id", "campaign_id", "date", "clicks", "loaded"))


def _streamed(t) -> DataFrame:
    """Predictions and facts as loads of three spans of days, taken in by three runs of the stream; facts of every 50th day and campaign
    come five days late. The verdicts equal those of the batch over all facts."""
    late = F.pmod(F.crc32(F.concat("account_id", "campaign_id", F.col("date").cast("string")).cast("binary")), F.lit(50)) == 0
    last = t.facts.agg(F.max("date").alias("_last"))
    known = t.facts.crossJoin(F.broadcast(last)).withColumn("known_on", F.when(late, F.least(F.date_add("date", 5), F.col("_last"))).otherwise(F.col("date")))
    feed = materialised(resolver.events(t.predictions, known, "known_on"), "feed")
    folder = f"{shared_dir(t.spark)}/admeridian/stream-{uuid.uuid4().hex}"
    target = resolver.table(t.spark)
    for first, after in (("2000-01-01", "2024-02-10"), ("2024-02-10", "2024-03-02"), ("2024-03-02", "2100-01-01")):
        feed.filter(f"as_of >= DATE '{first}' AND as_of < DATE '{after}'").repartition(2).write.mode("append").parquet(f"{folder}/loads")
        resolver.run(t.spark, f"{folder}/loads", target, f"{folder}/state")
    out = materialised(resolver.resolutions(target, t.predictions), "streamed")
    t.spark.sql(f"DROP TABLE {target.name}")
    return out


QUERIES = {
    "ops06_stream": _q(_streamed, "prediction_id", "window_days", "actual_magnitude", "actual_direction", "direction_correct", "magnitude_score", "recommendation_correct"),
    "snk01_stored_days": lambda spark, sf_dir: _stored(spark, sf_dir, lambda table, old, new: table.replace(new.filter("date < DATE '2024-03-08'"), "loaded")),
    "snk02_stored_insert": lambda spark, sf_dir: _stored(spark, sf_dir, lambda table, old, new: table.add(new)),
    "ops01_register": _q(lambda t: t.predictions, "prediction_id", "template_id", "episode_id", "state", "prediction_direction", "prediction_magnitude", "natural_magnitude", "action_cost", "recommendation"),
    "ops02_resolve": _q(lambda t: t.resolutions, "prediction_id", "window_days", "actual_magnitude", "actual_direction", "direction_correct", "magnitude_score", "recommendation_correct"),
    "ops03_health": _q(lambda t: operate.health(t.resolutions, t.catalogue)),
    "ops04_accuracy": _q(lambda t: operate.accuracy(t.resolutions)),
    "ops06_daily_cycle": _q(lambda t: operate.daily_cycle(t, F.lit("2024-03-01").cast("date"))["resolutions"].groupBy("window_days", "recommendation").agg(F.count("*").alias("n"))),
    "ops07_alerts": _q(lambda t: operate.alerts(t.facts, operate.accuracy(t.resolutions), F.lit("2024-04-01").cast("date"))),
    "bkt01_rolling_origin": _q(lambda t: simulate.rolling_origin(t.rows)),
    "ver01_02_ledger": _q(lambda t: _chained(t)),
    "ver02_faults": _q(_faults),
    "ver02_proofs": _q(_proofs),
    "ver06_spot_check": _q(lambda t: trust.spot_check(t.rows)),
    "ver07_checksums": _q(lambda t: trust.checksums_of(_dated(t))),
    "ver07_changed_days": _q(_changed),
    "obs05_inventory": _q(lambda t: trust.inventory({n: getattr(t, n) for n in ("accounts", "daily_metrics", "change_events", "keyword_metrics", "conversion_actions")})),
    "obs05_firing": _q(lambda t: trust.firing(t.found, ["cpa_change", "cvr_change", "cpa_spike", "tracking_break"])),
    "obs06_busiest": _q(lambda t: t.episodes.groupBy("account_id", "campaign_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "account_id", "campaign_id").limit(15)),
    "snk01_upsert_replace": lambda spark, sf_dir: upsert_replace(*_halves(Tables(spark, sf_dir)), ["account_id", "campaign_id", "date"], "loaded").groupBy("loaded").agg(F.count("*").alias("n"), F.sum("clicks").alias("clicks")),
    "snk02_insert_ignore": lambda spark, sf_dir: (lambda old, new: insert_ignore(old.filter("date < DATE '2024-03-01'"), new, ["account_id", "campaign_id", "date"]).groupBy("loaded").agg(F.count("*").alias("n"), F.sum("clicks").alias("clicks")))(*_halves(Tables(spark, sf_dir))),
    "snk03_upsert_columns": lambda spark, sf_dir: (lambda a: upsert_columns(a.select("account_id", "vertical", "first_seen", "mcc_id"), a.select(F.concat(F.lit("a"), (F.substring("account_id", 2, 9).cast("int") + 3).cast("string")).alias("account_id"), F.nullif("vertical", F.lit("")).alias("vertical"), F.lit("2024-05-01").cast("date").alias("first_seen"), F.lit("m2").alias("mcc_id")), ["account_id"], ["vertical"]).withColumn("first_seen", F.col("first_seen").cast("string")))(Tables(spark, sf_dir).accounts),
    "src06_thresholds": lambda spark, sf_dir: resolve_thresholds(Tables(spark, sf_dir).accounts).groupBy("detector", "name", "value", "skip").agg(F.count("*").alias("n")),
}

_PRED = f"""{_CAT}, {_BASE}, nat AS (SELECT state, median(chg0) AS nm FROM ba GROUP BY ALL), act AS (SELECT tid, mode, med FROM cat WHERE status IN ('ACTIVE', 'PROVISIONAL')),
cand AS (SELECT episode_id, account_id, campaign_id, change_date, pre_state, unnest([1, 2, 3, 4]) AS lv, unnest([concat_ws('__', change_category, m, business_type, vertical, spend_tier, pre_state), concat_ws('__', change_category, m, business_type, vertical, pre_state), concat_ws('__', change_category, m, business_type, pre_state), concat_ws('__', change_category, m, pre_state)]) AS tid FROM tr),
bst AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY lv) AS rn FROM cand JOIN act USING (tid)),
pred AS (SELECT substr(sha256(episode_id || '|' || tid), 1, 16) AS prediction_id, tid, episode_id, account_id, campaign_id, change_date, pre_state AS state, mode, med, nm, med - nm AS cost, CASE WHEN med - nm >= 0.2 THEN 'DO_NOT_ACT' WHEN med - nm >= 0.1 THEN 'WAIT' WHEN med - nm <= -0.1 THEN 'ACT' ELSE 'EITHER' END AS rec FROM bst JOIN nat ON nat.state = pre_state WHERE rn = 1)"""
_RES = f"""{_PRED}, ops AS (SELECT p.*, w.w FROM pred p, (SELECT unnest([7, 14, 30]) AS w) w, (SELECT max(date) AS d FROM daily_metrics) z WHERE campaign_id <> '' AND change_date + w.w <= d),
rs0 AS (SELECT o.prediction_id, o.w, sum(x.cost_micros) FILTER (x.date < o.change_date) / 1e6 / nullif(sum(x.conversions) FILTER (x.date < o.change_date), 0) AS pre, sum(x.cost_micros) FILTER (x.date >= o.change_date) / 1e6 / nullif(sum(x.conversions) FILTER (x.date >= o.change_date), 0) AS post
  FROM ops o JOIN daily_metrics x ON x.account_id = o.account_id AND x.campaign_id = o.campaign_id AND x.date >= o.change_date - 7 AND x.date < o.change_date + o.w GROUP BY ALL),
rs1 AS (SELECT o.*, greatest(-1, least(3, (post - pre) / pre)) AS actual FROM rs0 JOIN ops o USING (prediction_id, w) WHERE pre > 0 AND post IS NOT NULL),
res AS (SELECT *, CASE WHEN actual <= -0.1 THEN 'improved' WHEN actual >= 0.1 THEN 'degraded' ELSE 'neutral' END AS adir, abs(med - actual) AS err, actual - nm AS acost FROM rs1),
rsv AS (SELECT *, mode = adir AS dok, CASE rec WHEN 'DO_NOT_ACT' THEN acost > 0.1 WHEN 'ACT' THEN acost < -0.1 WHEN 'EITHER' THEN NOT (acost < -0.1) AND NOT (acost > 0.1) ELSE NOT (acost < -0.1) END AS rok FROM res)"""
def _merkle(rows: str) -> str:
    """The trees and heads over a table of (day, prediction_id, payload)."""
    out = f"lf AS (SELECT day, prediction_id, sha256(prediction_id) AS key, sha256('leaf' || sha256(prediction_id) || sha256(payload)) AS hash FROM {rows}), n6 AS (SELECT day, key AS prefix, 1 AS n, hash FROM lf)"
    for level in range(ledger.DEPTH, -1, -1):
        out += f", n{level} AS (SELECT day, substr(prefix, 1, {level}) AS prefix, sum(n) AS n, CASE count(*) WHEN 1 THEN any_value(hash) ELSE sha256('node' || string_agg(prefix || hash, ',' ORDER BY prefix)) END AS hash FROM n{level + 1} GROUP BY day, substr(prefix, 1, {level}))"
    return out + ", hd AS (SELECT day, n, hash AS root, list_reduce(list_prepend('genesis', list(hash) OVER (ORDER BY day)), lambda a, x: sha256(a || x)) AS head FROM n0)"


_TOLD = f"""{_PRED}, told AS (SELECT change_date AS day, prediction_id, to_json({{'episode_id': episode_id, 'prediction_id': prediction_id, 'recommendation': rec, 'registered_at': change_date, 'template_id': tid}}) AS payload FROM pred), {_merkle('told')}"""
_SIBLINGS = " + ".join(f"(count(DISTINCT substr(key, 1, {level + 1 if level < ledger.DEPTH else 64})) OVER (PARTITION BY day, substr(key, 1, {level})) - 1)" for level in range(ledger.DEPTH, -1, -1))
def _part(*columns: str) -> str:
    fields = " || ".join(f"coalesce(len(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in sorted(columns))
    return f"('0x' || substr(md5({fields}), 1, 15))::BIGINT AS part"


_DATED = f"""{ctes('daily_metrics', 'change_events', 'search_terms', 'ga4_landing_pages')}, dated AS (
SELECT 'daily_metrics' AS table_name, date, {_part('account_id', 'campaign_id', 'date', 'clicks', 'cost_micros')} FROM daily_metrics
UNION ALL SELECT 'change_events', date, {_part('account_id', 'change_id', 'actor', 'resource_type', 'date')} FROM (SELECT *, CAST(change_timestamp AS DATE) AS date FROM change_events)
UNION ALL SELECT 'search_terms', window_end, {_part('account_id', 'search_term', 'clicks', 'cost_micros', 'window_end')} FROM search_terms
UNION ALL SELECT 'ga4_landing_pages', date, {_part('account_id', 'date', 'landing_page', 'device', 'sessions')} FROM ga4_landing_pages)"""
_DM = "WITH " + ctes("daily_metrics")
ORACLES = {
    "ops01_register": _w(_ALL, f"{_PRED} SELECT prediction_id, tid AS template_id, episode_id, state, mode AS prediction_direction, round(med, 6) AS prediction_magnitude, round(nm, 6) AS natural_magnitude, round(cost, 6) AS action_cost, rec AS recommendation FROM pred"),
    "ops02_resolve": _w(_ALL, f"{_RES} SELECT prediction_id, w AS window_days, round(actual, 6) AS actual_magnitude, adir AS actual_direction, dok AS direction_correct, CASE WHEN err <= 0.05 THEN 'exact' WHEN err <= 0.1 THEN 'close' WHEN err <= 0.2 THEN 'ballpark' ELSE 'miss' END AS magnitude_score, rok AS recommendation_correct FROM rsv"),
    "ops06_stream": _w(_ALL, f"{_RES} SELECT prediction_id, w AS window_days, round(actual, 6) AS actual_magnitude, adir AS actual_direction, dok AS direction_correct, CASE WHEN err <= 0.05 THEN 'exact' WHEN err <= 0.1 THEN 'close' WHEN err <= 0.2 THEN 'ballpark' ELSE 'miss' END AS magnitude_score, rok AS recommendation_correct FROM rsv"),
    "ops03_health": _w(_ALL, f"{_RES}, h AS (SELECT tid, count(*) AS n, avg(dok::INT) AS live, avg(rok::INT) AS lr, avg(err) AS e FROM rsv WHERE w = 14 GROUP BY tid) SELECT h.tid AS template_id, h.n AS n_resolved, round(live, 6) AS live, round(lr, 6) AS live_recommendation, round(e, 6) AS mae, round(acc, 6) AS backtest, CASE WHEN h.n >= 10 AND live < acc - 0.15 THEN 'DRIFT' WHEN h.n >= 10 AND live > acc + 0.05 THEN 'IMPROVING' ELSE '' END AS drift_flag, CASE WHEN h.n >= 10 AND live > 0.55 THEN 'ACTIVE' WHEN h.n < 10 OR live BETWEEN 0.45 AND 0.55 THEN 'SHADOW_ONLY' ELSE 'RETIRED' END AS status FROM h JOIN cat USING (tid)"),
    "ops04_accuracy": _w(_ALL, f"{_RES} SELECT coalesce(w::VARCHAR, 'all') AS window_days, coalesce(rec, 'all') AS recommendation, count(*) AS n, round(avg(rok::INT), 6) AS accuracy, round(avg(dok::INT), 6) AS direction_accuracy, round(avg((rec = 'EITHER')::INT), 6) AS abstention FROM rsv GROUP BY CUBE (w, rec)"),
    "ver01_02_ledger": _w(_ALL, f"{_TOLD} SELECT CAST(day AS VARCHAR) AS day, CAST(n AS BIGINT) AS n, root, head, 0 AS broken FROM hd"),
    "bkt01_rolling_origin": _w(_ALL, f"{_ROWS}, cu AS (SELECT CAST(unnest(generate_series(lo + 7, hi, INTERVAL 7 DAY)) AS DATE) AS cutoff FROM (SELECT min(change_date) AS lo, max(change_date) AS hi FROM tr)), ctr AS (SELECT cutoff, tr.* FROM tr, cu WHERE change_date < cutoff), en AS (SELECT cutoff FROM ctr GROUP BY ALL HAVING count(*) >= 50), btr AS (SELECT ctr.* FROM ctr SEMI JOIN en USING (cutoff)), bte AS (SELECT cutoff, tr.* FROM tr, en WHERE change_date >= cutoff AND change_date < cutoff + 7), {_held('cutoff', 'btr', 'bte')} SELECT CAST(cutoff AS VARCHAR) AS cutoff, count(*) AS matched, round(avg(ok), 6) AS accuracy FROM told GROUP BY ALL"),
    "ver02_faults": _w(_ALL, f"{_PRED} SELECT CAST(change_date AS VARCHAR) AS day, CASE WHEN prediction_id LIKE '%7' THEN 'gone' ELSE 'payload' END AS reason, count(*) AS n FROM pred WHERE prediction_id LIKE '%7' OR prediction_id LIKE '%3' GROUP BY ALL"),
    "ver02_proofs": _w(_ALL, f"{_TOLD} SELECT prediction_id, prediction_id NOT LIKE '%3' AS proven, 1 + {_SIBLINGS} AS n_hashes FROM lf WHERE day >= DATE '2024-02-12' AND day < DATE '2024-02-19'"),
    "ver07_checksums": f"WITH {_DATED} SELECT table_name, CAST(date AS VARCHAR) AS date, count(*) AS n_rows, CAST(sum(part) AS VARCHAR) AS content FROM dated GROUP BY ALL",
    "ver07_changed_days": f"""WITH {_DATED}, ev AS (SELECT CAST(change_timestamp AS DATE) AS date, count(*) AS n, count(*) FILTER (account_id <> 'a5') AS n1 FROM change_events GROUP BY ALL),
d AS (SELECT 'daily_metrics' AS table_name, date, count(*) AS n_rows, count(*) AS n_before, count(*) FILTER (account_id = 'a3' AND date IN (DATE '2024-02-20', DATE '2024-03-02')) > 0 AS changed FROM daily_metrics GROUP BY date
  UNION ALL SELECT 'change_events', date, CASE WHEN n1 > 0 THEN n1 END, n, n1 < n FROM ev UNION ALL SELECT 'search_terms', window_end, count(*), count(*), FALSE FROM search_terms GROUP BY window_end
  UNION ALL SELECT 'ga4_landing_pages', date, count(*), CASE WHEN date < DATE '2024-02-01' THEN count(*) END, FALSE FROM ga4_landing_pages GROUP BY date)
SELECT table_name, changed, count(*) AS days, CAST(sum(n_rows) AS BIGINT) AS n_rows, CAST(sum(n_before) AS BIGINT) AS n_before FROM d GROUP BY ALL""",
    "obs05_inventory": f"WITH {ctes('accounts', 'daily_metrics', 'change_events', 'keyword_metrics', 'conversion_actions')} " + " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows, count(DISTINCT account_id) AS n_accounts FROM {n}" for n in ("accounts", "daily_metrics", "change_events", "keyword_metrics", "conversion_actions")),
    "snk01_stored_days": f"{_DM} SELECT account_id, campaign_id, CAST(date AS VARCHAR) AS date, clicks + (date >= DATE '2024-02-12')::INT AS clicks, 1 + (date >= DATE '2024-02-12')::INT AS loaded FROM daily_metrics WHERE date < DATE '2024-03-08'",
    "snk02_stored_insert": f"{_DM} SELECT account_id, campaign_id, CAST(date AS VARCHAR) AS date, clicks + (date >= DATE '2024-03-01')::INT AS clicks, 1 + (date >= DATE '2024-03-01')::INT AS loaded FROM daily_metrics",
    "snk01_upsert_replace": f"{_DM} SELECT CASE WHEN date >= DATE '2024-02-12' THEN 2 ELSE 1 END AS loaded, count(*) AS n, CAST(sum(clicks + CASE WHEN date >= DATE '2024-02-12' THEN 1 ELSE 0 END) AS BIGINT) AS clicks FROM daily_metrics GROUP BY 1",
    "snk02_insert_ignore": f"{_DM} SELECT CASE WHEN date >= DATE '2024-03-01' THEN 2 ELSE 1 END AS loaded, count(*) AS n, CAST(sum(clicks + CASE WHEN date >= DATE '2024-03-01' THEN 1 ELSE 0 END) AS BIGINT) AS clicks FROM daily_metrics GROUP BY 1",
    "snk03_upsert_columns": f"WITH {ctes('accounts')}, b AS (SELECT 'a' || CAST(CAST(substr(account_id, 2) AS INT) + 3 AS VARCHAR) AS account_id, nullif(vertical, '') AS vertical FROM accounts) SELECT coalesce(a.account_id, b.account_id) AS account_id, coalesce(b.vertical, a.vertical) AS vertical, CAST(coalesce(a.first_seen, DATE '2024-05-01') AS VARCHAR) AS first_seen, coalesce(a.mcc_id, 'm2') AS mcc_id FROM accounts a FULL JOIN b ON a.account_id = b.account_id",
}
