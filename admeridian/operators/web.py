"""Landing-page and segment detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from admeridian.functions.signals import signals, text
from admeridian.functions.windows import anchored, div, since, sum_if, within
from admeridian.operators.detectors import BIDDING, CREATIVE, LANDING
from admeridian.sources.tables import by_keys

RECENT, BASELINE = 7, 21


# --- campaign segments ---


def segment_features(segments: DataFrame, strength: DataFrame) -> DataFrame:
    """One row per campaign: shares and gaps by device, network, hour, weekday, place and ad strength; null where unknown. Segments
    are dealt by campaign once; what lies so already is not moved."""
    keys = ["account_id", "campaign_id"]
    dim, val = F.col("dimension"), F.col("segment_value")
    is_ = lambda d, extra=None: (dim == d) if extra is None else (dim == d) & extra
    mobile, partner, search = val == "MOBILE", val.contains("PARTNER"), val.isin("SEARCH", "GOOGLE_SEARCH")
    total = F.sum("cost_micros").over(Window.partitionBy(*keys, "dimension"))
    rows = by_keys(segments, *keys).withColumn("dead", (F.col("conversions") == 0) & (div("cost_micros", total) >= 0.05)).withColumn("geo_cpa", F.when((dim == "geo") & (F.col("conversions") > 0) & (F.col("cost_micros") > 0), F.col("cost_micros") / 1e6 / F.col("conversions")))
    pick = lambda name, cond, c: sum_if(cond, c).alias(name)
    g = rows.groupBy(*keys).agg(
        pick("dev_clicks", is_("device"), "clicks"), pick("mob_clicks", is_("device", mobile), "clicks"), pick("mob_conv", is_("device", mobile), "conversions"), pick("non_clicks", is_("device", ~mobile), "clicks"), pick("non_conv", is_("device", ~mobile), "conversions"),
        pick("net_cost", is_("network"), "cost_micros"), pick("par_cost", is_("network", partner), "cost_micros"), pick("par_conv", is_("network", partner), "conversions"), pick("sea_cost", is_("network", search), "cost_micros"), pick("sea_conv", is_("network", search), "conversions"),
        pick("hour_cost", is_("hour"), "cost_micros"), pick("hour_dead", is_("hour", F.col("dead")), "cost_micros"), pick("dow_cost", is_("dow"), "cost_micros"), pick("dow_dead", is_("dow", F.col("dead")), "cost_micros"),
        F.count("geo_cpa").alias("geos"), F.avg("geo_cpa").alias("geo_mean"), F.stddev_pop("geo_cpa").alias("geo_std"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    known = lambda c, x: F.when(F.col(c).isNotNull(), x)
    mob, non = zero(div("mob_conv", "mob_clicks")), zero(div("non_conv", "non_clicks"))
    g = g.select(
        *keys, known("dev_clicks", zero(div("mob_clicks", "dev_clicks"))).alias("mobile_traffic_share"), known("dev_clicks", F.when(mob > 0, non / mob)).alias("mobile_cvr_gap"),
        known("net_cost", zero(div("par_cost", "net_cost"))).alias("search_partners_spend_share"), div(div("par_cost", "par_conv"), div("sea_cost", "sea_conv")).alias("partners_cpa_ratio"),
        known("hour_cost", zero(div("hour_dead", "hour_cost"))).alias("hour_dead_zone_spend_share"), known("dow_cost", zero(div("dow_dead", "dow_cost"))).alias("dow_dead_zone_spend_share"),
        F.when(F.col("geos") >= 3, zero(div("geo_std", "geo_mean"))).alias("geo_cpa_variance"),
    )
    share = lambda *kinds: (F.count_if(F.col("ad_strength").isin(*kinds)) / F.count("*"))
    ads = strength.groupBy(*keys).agg(share("POOR", "AVERAGE").alias("poor_ad_share"), share("EXCELLENT").alias("excellent_ad_share"), F.count("*").alias("n_rsa"))
    out = g.join(ads, keys, "full_outer")
    return out.withColumn("has_dead_zones", (zero(F.col("hour_dead_zone_spend_share")) > 0.10) | (zero(F.col("dow_dead_zone_spend_share")) > 0.10))


def segment_attributes(features: DataFrame) -> DataFrame:
    """The features as categories, 'unknown' where there is no data."""
    b = lambda c, cond, yes, no: F.when(F.col(c).isNull(), "unknown").when(cond, yes).otherwise(no)
    f = F.col
    return features.select(
        "account_id", "campaign_id", b("mobile_traffic_share", f("mobile_traffic_share") > 0.5, "mobile_heavy", "desktop_heavy").alias("device_profile"), b("mobile_cvr_gap", f("mobile_cvr_gap") >= 1.5, "mobile_drag", "no_drag").alias("mobile_cvr_drag"),
        b("search_partners_spend_share", f("search_partners_spend_share") > 0.10, "partners", "no_partners").alias("partners_exposed"), F.when(f("has_dead_zones"), "dead_zones").otherwise("no_dead_zones").alias("dead_zones"),
        b("geo_cpa_variance", f("geo_cpa_variance") > 0.5, "high_geo_var", "low_geo_var").alias("geo_variance"), b("n_rsa", f("poor_ad_share") > 0.5, "weak_ads", "ok_ads").alias("ad_quality"),
    )


def segment_signals(features: DataFrame, mobile_share: float = 0.6, gap: float = 2.0, partners_share: float = 0.15, partners_ratio: float = 1.5, geo_cv: float = 1.0, weak: float = 0.5) -> DataFrame:
    """One signal per campaign and kind that holds; the features are read once for all kinds."""
    f = F.col
    one = lambda cond, kind, domain, severity, value, limit: F.when(cond, F.struct(F.lit(kind).alias("kind"), F.lit(domain).alias("domain"), F.lit(severity).alias("severity"), value.alias("value"), F.lit(float(limit)).alias("limit")))
    dead = F.greatest(F.coalesce("hour_dead_zone_spend_share", F.lit(0.0)), F.coalesce("dow_dead_zone_spend_share", F.lit(0.0)))
    kinds = F.array(
        one((f("mobile_traffic_share") > mobile_share) & (f("mobile_cvr_gap") >= gap), "device_mobile_drag", BIDDING, "warning", f("mobile_cvr_gap"), gap),
        one((f("search_partners_spend_share") > partners_share) & (f("partners_cpa_ratio") >= partners_ratio), "search_partners_waste", BIDDING, "warning", f("partners_cpa_ratio"), partners_ratio),
        one(f("has_dead_zones"), "dead_zone_spend", BIDDING, "info", dead, 0.10),
        one(f("geo_cpa_variance") > geo_cv, "geo_cpa_outlier", BIDDING, "info", f("geo_cpa_variance"), geo_cv),
        one((f("n_rsa") >= 3) & (f("poor_ad_share") > weak), "weak_ad_strength", CREATIVE, "warning", f("poor_ad_share"), weak),
    )
    rows = features.select("account_id", "campaign_id", F.explode(F.array_compact(kinds)).alias("_s")).select("account_id", "campaign_id", "_s.*")
    return signals(rows, f("kind"), f("domain"), f("severity"), f("value"), f("limit"), text("%s in campaign %s", "kind", "campaign_id"), {"value": "value"})


# --- landing pages ---


def _named_pages(pages: DataFrame) -> DataFrame:
    return pages.filter("landing_page NOT IN ('(not set)', '')")


def page_windows(pages: DataFrame, keys: tuple[str, ...] = ("account_id", "landing_page")) -> DataFrame:
    """Sessions, engaged sessions and weighted duration of the recent week (r_) and of the three weeks before it (b_)."""
    rows = anchored(pages)
    rows = _named_pages(rows).filter(F.col("date") > F.date_sub("anchor", RECENT + BASELINE))
    recent = within(RECENT)
    out = rows.groupBy(*keys).agg(*[sum_if(c, v).alias(f"{p}_{n}") for p, c in (("r", recent), ("b", ~recent)) for n, v in (("s", F.col("sessions")), ("e", F.col("engaged_sessions")), ("d", F.col("avg_session_duration") * F.col("sessions")))])
    return out.withColumns({f"{p}_{n}": div(f"{p}_{c}", f"{p}_s") for p in ("r", "b") for n, c in (("eng", "e"), ("dur", "d"))})


def _page(rows: DataFrame, kind: str, severity, value: Column, threshold: Column, data: dict) -> DataFrame:
    return signals(rows, kind, LANDING, severity, value, threshold, text("%s on %s", F.lit(kind), "landing_page"), {"landing_page": "landing_page"} | data, campaign=False, key=("landing_page",))


def engagement_drop(pages: DataFrame, min_sessions: int = 200, drop: float = 0.15, critical: float = 0.25) -> DataFrame:
    rows = page_windows(pages).filter((F.col("r_s") >= min_sessions // 4) & (F.col("b_s") >= min_sessions // 2) & (F.col("b_eng") > 0)).withColumn("fall", F.col("b_eng") - F.col("r_eng"))
    hit = rows.filter(F.col("fall") >= drop)
    return _page(hit, "ga4_engagement_drop", F.when(F.col("fall") >= critical, F.lit("critical")).otherwise("warning"), F.col("r_eng"), F.col("b_eng") - drop, {"recent_sessions": "r_s"})


def duration_collapse(pages: DataFrame, min_sessions: int = 200, drop: float = 0.50) -> DataFrame:
    rows = page_windows(pages).filter((F.col("r_s") >= min_sessions // 4) & (F.col("b_s") >= min_sessions // 2) & (F.col("b_dur") > 0)).withColumn("fall", div(F.col("b_dur") - F.col("r_dur"), "b_dur"))
    hit = rows.filter(F.col("fall") >= drop)
    return _page(hit, "ga4_session_duration_collapse", F.when(F.col("fall") >= 0.75, F.lit("warning")).otherwise("info"), F.col("r_dur"), F.col("b_dur") * (1 - drop), {"recent_duration_s": F.round("r_dur", 1)})


def mobile_engagement_gap(pages: DataFrame, min_sessions: int = 100, gap: float = 0.25) -> DataFrame:
    dev = lambda d, c: sum_if(F.col("device") == d, c)
    rows = _named_pages(pages).groupBy("account_id", "landing_page").agg(*[dev(d, c).alias(f"{p}_{n}") for d, p in (("mobile", "m"), ("desktop", "d")) for c, n in (("sessions", "s"), ("engaged_sessions", "e"))])
    rows = rows.withColumns({"m_eng": div("m_e", "m_s"), "d_eng": div("d_e", "d_s")})
    hit = rows.filter((F.col("m_s") >= min_sessions) & (F.col("d_s") >= min_sessions) & (F.col("d_eng") - F.col("m_eng") >= gap))
    return _page(hit, "ga4_mobile_engagement_gap", "warning", F.col("m_eng"), F.col("d_eng") - gap, {"mobile_sessions": "m_s"})


def mobile_bounce_regression(pages: DataFrame, min_sessions: int = 100, rise: float = 0.15, stable: float = 0.05) -> DataFrame:
    rows = page_windows(pages, ("account_id", "landing_page", "device")).withColumns({"r_b": 1 - F.col("r_eng"), "b_b": 1 - F.col("b_eng")})
    of = lambda d, p: rows.filter(F.col("device") == d).select("account_id", "landing_page", *[F.col(c).alias(f"{p}_{c}") for c in ("r_b", "b_b", "r_s")])
    both = of("mobile", "m").join(of("desktop", "d"), ["account_id", "landing_page"])
    hit = both.filter((F.col("m_r_s") >= min_sessions // 2) & (F.col("m_r_b") - F.col("m_b_b") >= rise) & (F.abs(F.col("d_r_b") - F.col("d_b_b")) <= stable))
    return _page(hit, "ga4_mobile_bounce_regression", "warning", F.col("m_r_b"), F.col("m_b_b") + rise, {"desktop_bounce_recent": "d_r_b"})


def paid_organic_gap(channels: DataFrame, min_sessions: int = 200, gap: float = 0.20) -> DataFrame:
    of = lambda name, p: channels.filter((F.col("channel") == name) & (F.col("sessions") >= min_sessions)).select("account_id", F.col("engagement_rate").alias(p))
    hit = of("Paid Search", "paid").join(of("Organic Search", "organic"), "account_id").filter(F.col("organic") - F.col("paid") >= gap)
    return signals(hit, "ga4_paid_organic_gap", LANDING, "info", F.col("paid"), F.col("organic") - gap, text("Paid engagement %.2f vs organic %.2f", "paid", "organic"), {"paid_engagement": "paid"}, campaign=False)


FUNNEL = [("view_item", "add_to_cart"), ("add_to_cart", "begin_checkout"), ("begin_checkout", "purchase")]


def funnel_dropoff(events: DataFrame, min_events: int = 50, drop: float = 0.20) -> DataFrame:
    """The step whose rate fell most, the first of equals; isolated if no other step fell as far."""
    rows = anchored(events).filter(F.col("date") > F.date_sub("anchor", RECENT + 21))
    recent = within(RECENT)
    names = [x for pair in FUNNEL for x in pair]
    wide = rows.groupBy("account_id").agg(*[F.coalesce(sum_if(c & (F.col("event_name") == n), "event_count"), F.lit(0)).alias(f"{p}_{n}") for p, c in (("r", recent), ("b", ~recent)) for n in dict.fromkeys(names)])
    steps = []
    for i, (up, down) in enumerate(FUNNEL):
        r, b = div(f"r_{down}", f"r_{up}"), div(f"b_{down}", f"b_{up}")
        ok = (b > 0) & r.isNotNull() & (F.col(f"b_{up}") >= min_events)
        steps.append(F.when(ok, F.struct(((b - r) / b).alias("fall"), F.lit(-i).alias("first"), F.lit(f"{up}->{down}").alias("step"), r.alias("r"), b.alias("b"))))
    rows = wide.select("account_id", F.array_compact(F.array(*steps)).alias("steps")).filter(F.size("steps") > 0).withColumn("worst", F.array_max("steps"))
    hit = rows.filter(F.col("worst.fall") >= drop).withColumn("isolated", F.size(F.filter("steps", lambda s: s["fall"] >= drop)) == 1)
    severity = F.when(F.col("worst.step").endswith("purchase"), F.lit("critical")).otherwise("warning")
    return signals(hit, "ga4_funnel_dropoff", LANDING, severity, F.col("worst.r"), F.col("worst.b") * (1 - drop), text("Funnel step %s fell %.0f%%", "worst.step", F.col("worst.fall") * 100), {"step": "worst.step", "isolated": "isolated"}, campaign=False)


def page_evidence(pages: DataFrame, days: int = 28) -> DataFrame:
    """Engagement of each page on mobile and desktop and in its recent and earlier time."""
    rows = _named_pages(anchored(pages)).filter(within(days))
    part = lambda name, c: div(sum_if(c, "engaged_sessions"), sum_if(c, "sessions")).alias(name)
    return rows.groupBy("account_id", "landing_page").agg(F.sum("sessions").alias("sessions"), part("mobile_engagement", F.col("device") == "mobile"), part("desktop_engagement", F.col("device") == "desktop"), part("recent_engagement", within(RECENT)), part("base_engagement", ~within(RECENT)))


def normalised_path(url: Column) -> Column:
    """Path without host, query and trailing slash, lower-cased; '/' if nothing is left."""
    path = F.regexp_replace(F.split_part(F.regexp_replace(F.coalesce(url, F.lit("")), "^[a-zA-Z]+://[^/]*", ""), F.lit("?"), F.lit(1)), "/+$", "")
    return F.coalesce(F.nullif(F.lower(path), F.lit("")), F.lit("/"))


def cross_platform_upgrades(found: DataFrame, urls: DataFrame, evidence: DataFrame, drop: float = 0.15, gap: float = 0.25) -> DataFrame:
    """Conversion-rate signals whose busiest landing page shows the same loss of engagement become CONFIRMED."""
    paths = urls.select("account_id", "campaign_id", normalised_path(F.col("final_url")).alias("landing_page")).distinct()
    rows = found.filter(F.col("signal_type").isin("cvr_drop", "cvr_change", "cpa_spike", "cpa_change")).select("signal_id", "account_id", "campaign_id", "signal_type")
    joined = rows.join(paths, ["account_id", "campaign_id"]).join(evidence, ["account_id", "landing_page"])
    busiest = joined.withColumn("_rank", F.row_number().over(Window.partitionBy("signal_id").orderBy(F.desc("sessions"), "landing_page"))).filter("_rank = 1").drop("_rank")
    chain = F.when(F.col("base_engagement") - F.col("recent_engagement") >= drop, "engagement_drop").when(F.col("desktop_engagement") - F.col("mobile_engagement") >= gap, "mobile_gap")
    return busiest.withColumn("chain", chain).filter("chain IS NOT NULL").withColumn("confidence_tier", F.lit("CONFIRMED"))


def url_coverage(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """Distinct (account, path) of campaigns, and how many of them have page data."""
    paths = urls.select("account_id", normalised_path(F.col("final_url")).alias("landing_page")).distinct()
    known = pages.select("account_id", "landing_page", F.lit(1).alias("hit")).distinct()
    return paths.join(known, ["account_id", "landing_page"], "left").agg(F.count("*").alias("paths"), F.count("hit").alias("matched"))


def page_trends(pages: DataFrame, min_days: int = 10, min_sessions: int = 200) -> DataFrame:
    from admeridian.functions.stats import trend

    days = _named_pages(pages).groupBy("account_id", "landing_page", "date").agg(F.sum("sessions").alias("sessions"), F.sum("engaged_sessions").alias("engaged"))
    enough = days.groupBy("account_id", "landing_page").agg(F.count("*").alias("days"), F.sum("sessions").alias("total")).filter((F.col("days") >= min_days) & (F.col("total") >= min_sessions))
    points = days.join(enough, ["account_id", "landing_page"], "left_semi").withColumn("value", div("engaged", "sessions"))
    return trend(points, ["account_id", "landing_page"], F.lit("cvr"), min_days).drop("metric")


def with_trajectory(found: DataFrame, trends: DataFrame, column: str = "note") -> DataFrame:
    """Engagement signals with the course of their page in ``column``: a fall that goes on, or a weakness that has long been
    there. Notes that already hold one stay as they are; other signals pass unchanged."""
    kinds = F.col("signal_type").isin("ga4_engagement_drop", "ga4_mobile_engagement_gap")
    old = F.coalesce(F.col(column), F.lit("")) if column in found.columns else F.lit("")
    of = trends.select("account_id", F.col("landing_page").alias("_page"), F.col("classification").alias("_course"))
    rows = found.withColumn("_page", F.col("data")["landing_page"]).join(of, ["account_id", "_page"], "left")
    course = F.col("_course")
    meaning = F.when(course == "declining", " (still falling)").when(course.isin("stable", "volatile"), " (not new)").otherwise("")
    new = F.when(kinds & course.isNotNull() & ~F.contains(old, F.lit("[trend]")), F.concat(old, F.lit(" [trend] "), course, meaning)).otherwise(old)
    return rows.withColumn(column, new).drop("_page", "_course")


def audit_targets(upgrades: DataFrame, urls: DataFrame, properties: DataFrame) -> DataFrame:
    """Addresses of the pages behind confirmed signals: by the campaigns' own host, else by the account's property.
    ``upgrades``: account_id, landing_page; ``urls``: account_id, norm_path, domain; ``properties``: account_id, ga4_url."""
    own = urls.groupBy("account_id", F.col("norm_path").alias("landing_page")).agg(F.max("domain").alias("_own"))
    mapped = properties.groupBy("account_id").agg(F.max("ga4_url").alias("_mapped"))
    rows = upgrades.select("account_id", "landing_page").distinct().join(own, ["account_id", "landing_page"], "left").join(mapped, "account_id", "left")
    host = F.coalesce("_own", "_mapped")
    return rows.filter(host.isNotNull()).groupBy(F.concat(F.lit("https://"), host, "landing_page").alias("url")).agg(F.min("account_id").alias("account_id"))


def addressable(found: DataFrame) -> DataFrame:
    """How many signals more data about the pages could settle; one row."""
    n = lambda *kinds: F.count_if(F.col("signal_type").isin(*kinds))
    cvr, cpa = n("cvr_drop", "cvr_change"), n("cpa_spike", "cpa_change")
    return found.agg(cvr.alias("cvr_signals"), cpa.alias("cpa_signals"), n("device_mobile_drag").alias("device_mobile_drag"), n("weak_ad_strength").alias("weak_ad_strength"), (cvr + cpa).alias("total_addressable"))


def linkage_coverage(daily: DataFrame, accounts: DataFrame, actions: DataFrame) -> DataFrame:
    """How far active accounts can be linked to their sites: address, imported goals, any and all steps of the funnel; one row."""
    active = daily.select("account_id").distinct()
    up = lambda c: F.upper(F.coalesce(F.col(c), F.lit("")))
    imported = F.contains(up("category"), F.lit("IMPORT")) | F.contains(up("action_type"), F.lit("ANALYT")) | F.contains(up("action_name"), F.lit("GA4")) | F.contains(up("action_name"), F.lit("ANALYTICS"))
    steps = F.countDistinct(F.when(F.col("category").isin("ADD_TO_CART", "BEGIN_CHECKOUT", "PURCHASE"), F.col("category")))
    per = actions.groupBy("account_id").agg(F.max(imported).alias("imported"), steps.alias("steps"))
    sites = accounts.filter("website_url IS NOT NULL AND website_url <> ''").join(active, "account_id", "left_semi").agg(F.count("*").alias("with_website_url"))
    linked = per.agg(F.count_if("imported").alias("imported_goals"), F.count_if(F.col("steps") > 0).alias("any_funnel_step"), F.count_if(F.col("steps") == 3).alias("whole_funnel"))
    return active.agg(F.count("*").alias("active_accounts")).crossJoin(F.broadcast(sites)).crossJoin(F.broadcast(linked))
