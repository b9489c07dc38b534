"""The common shape of detector output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["signal_id", "account_id", "campaign_id", "domain", "signal_type", "severity", "value", "threshold", "message", "data"]


def identifier(*parts: Column | str, length: int = 12) -> Column:
    """A reproducible id: the first hex digits of a hash of the key."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]), 256), 1, length)


def signals(rows: DataFrame, kind: str | Column, domain: str | Column, severity: str | Column, value: Column, threshold: Column, message: Column, data: dict[str, Column | str], campaign: bool = True, key: tuple[str, ...] = ()) -> DataFrame:
    """One signal per row; ``data`` becomes a map of strings; ``key`` adds columns to the id."""
    kind, domain, severity = (F.lit(x) if isinstance(x, str) else x for x in (kind, domain, severity))
    items = [x for k, v in data.items() for x in (F.lit(k), (F.col(v) if isinstance(v, str) else v).cast("string"))]
    out = rows.withColumns({"_campaign": F.col("campaign_id") if campaign else F.lit(""), "_kind": kind})
    return out.select(
        identifier("_kind", "account_id", "_campaign", *key).alias("signal_id"), "account_id", F.col("_campaign").alias("campaign_id"), domain.alias("domain"), F.col("_kind").alias("signal_type"),
        severity.alias("severity"), value.cast("double").alias("value"), threshold.cast("double").alias("threshold"), message.alias("message"), F.create_map(*items).alias("data"),
    )


def text(pattern: str, *values: Column | str) -> Column:
    return F.format_string(pattern, *values)
