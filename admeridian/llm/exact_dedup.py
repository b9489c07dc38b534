"""Exact dedup by a heavy-hitter split.

A Misra-Gries style summary (Spark's mergeable frequent-items sketch) names the digests that may hold more than
``min_share`` of all rows. Their groups are then counted exactly, and the verified winners, at most ``1 / min_share`` rows,
are broadcast, so that the copies of frequent texts are settled on the map side. All other digests, each with few rows by
the sketch's guarantee, take an ordinary shuffle.

Defined results: a null text counts as empty; texts are equal when identical after lower-casing A-Z only; of equal texts the
row with the largest id stays, a null id being less than any other; of rows that repeat an id and a text exactly one stays;
an empty table gives an empty table; other columns, whatever their names, pass through ``exact_dedup`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from admeridian.llm.common import ascii_lower, fresh_name, staged, text_or_empty

#: Digests with at least this share of the rows are settled by broadcast; so at most 1 / MIN_SHARE rows are broadcast.
MIN_SHARE = 0.001
#: Counters of the summary: it overlooks no digest with over about 3.5 / TRACKED of the rows.
TRACKED = 8192


def text_digest(text: Column) -> Column:
    return F.sha2(ascii_lower(text_or_empty(text)), 256)


def heavy_digests(keyed: DataFrame, digest: str, min_share: float = MIN_SHARE, tracked: int = TRACKED) -> DataFrame:
    """(digest, estimate): a superset of the digests with more than ``min_share`` of the rows, at most ``1 / min_share``."""
    summary = keyed.agg(F.expr(f"approx_top_k(`{digest}`, {int(1 / min_share)}, {tracked})").alias("top"), F.count("*").alias("n_rows"))
    return (
        summary.select(F.explode("top").alias("hit"), "n_rows")
        .filter(F.col("hit.count") >= F.greatest(F.lit(2.0), F.col("n_rows") * min_share / 2))
        .select(F.col("hit.item").alias(digest), F.col("hit.count").alias("estimate"))
    )


def dedup_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_share: float = MIN_SHARE, tracked: int = TRACKED) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    keyed = docs.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("text_sha256"))
    # the row number, fixed by the written table, settles which of several rows with one id stays
    keyed = staged(keyed.withColumn("row", F.monotonically_increasing_id()), "digests")
    best = F.max(F.struct("doc_id", "row"))
    heavy = heavy_digests(keyed, "text_sha256", min_share, tracked).select("text_sha256")
    winners = keyed.join(F.broadcast(heavy), "text_sha256").groupBy("text_sha256").agg(best.alias("best"), F.count("*").alias("group_size"))
    winners = staged(winners, "heavy")
    by_winner = keyed.join(F.broadcast(winners), "text_sha256")
    group = Window.partitionBy("text_sha256")
    by_shuffle = keyed.join(F.broadcast(winners), "text_sha256", "left_anti").withColumns({"best": best.over(group), "group_size": F.count("*").over(group)})
    columns = ["doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256"]
    return by_winner.select(*columns).unionByName(by_shuffle.select(*columns))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_share: float = MIN_SHARE, tracked: int = TRACKED) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    digest, rank, best = (fresh_name(docs, x) for x in ("digest", "rank", "best"))
    keyed = docs.withColumn(digest, text_digest(F.col(text_col)))
    slim = keyed.select(F.col(id_col).alias("doc_id"), digest)
    heavy = heavy_digests(slim, digest, min_share, tracked).select(digest)
    winners = slim.join(F.broadcast(heavy), digest).groupBy(digest).agg(F.max("doc_id").alias(best))
    winners = staged(winners, "heavy")
    frequent = keyed.join(F.broadcast(winners), digest).filter(F.col(id_col).eqNullSafe(F.col(best))).drop(best)
    rest = keyed.join(F.broadcast(winners), digest, "left_anti")
    order = Window.partitionBy(digest).orderBy(F.col(id_col).desc_nulls_last())
    rest = rest.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) == 1).drop(rank)
    return frequent.dropDuplicates([digest]).unionByName(rest).select(*[F.col(f"`{c}`") for c in docs.columns])
