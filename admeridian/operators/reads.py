"""Filtered reads of the learned tables, newest or strongest first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _filtered(df: DataFrame, order: list, **wanted: str | None) -> DataFrame:
    for column, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df.orderBy(*order)


def signals(found: DataFrame, account_id: str | None = None, domain: str | None = None, at: str | None = None) -> DataFrame:
    """``at`` names the column that says when a signal was found, where there is one."""
    return _filtered(found, [*([F.desc(at)] if at else []), "signal_id"], account_id=account_id, domain=domain)


def patterns(found: DataFrame, domain: str | None = None, min_confidence: float = 0.0) -> DataFrame:
    return _filtered(found.filter(F.col("confidence") >= min_confidence), [F.desc("confidence"), "pattern_id"], domain=domain)


def episodes(found: DataFrame, account_id: str | None = None, outcome: str | None = None) -> DataFrame:
    return _filtered(found, [F.desc("change_date"), "episode_id"], account_id=account_id, outcome=outcome)


def template_conditions(template_id: Column) -> Column:
    """The conditions that a template's id spells out; the parts between action and state are known by their place."""
    body = F.regexp_replace(template_id, "^mag:", "")
    parts = F.split(body, "__")
    magnitude = F.try_element_at(F.filter(parts, lambda p: F.startswith(p, F.lit("mag="))), F.lit(1))
    plain = F.filter(parts, lambda p: ~F.startswith(p, F.lit("mag=")))
    segment = lambda i: F.when(F.size(plain) > i + 1, F.get(plain, F.lit(i)))
    return F.struct(
        F.get(plain, F.lit(0)).alias("change_category"), F.substring(magnitude, 5, 40).alias("magnitude_bucket"),
        (F.get(plain, F.lit(1)) == "multi").alias("is_multi_action"), segment(2).alias("business_type"), segment(3).alias("vertical"), segment(4).alias("spend_tier"), F.element_at(plain, -1).alias("pre_state"),
    )
