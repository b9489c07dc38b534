"""Trainings that differ only in what they leave out, from counts alone.

What a template says depends on how many episodes of each direction its cell holds, and on how many accounts. So episodes are counted
once per finest cell, fold and direction, and every training is a sum of such counts: all before a date is a running sum over days,
all but one account is the whole less that account. No episode is copied for a training. Folds go by a hash of the episode's id, so
an episode is in the same fold in every training.

That at least ``MIN_ACCOUNTS`` accounts share a cell is told from a few accounts of each finest cell: the union of their lists has so
many exactly if the cell has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from admeridian.operators import templates as T
from admeridian.sources.tables import materialised

DIRECTIONS = ("degraded", "improved", "neutral")
COUNTS = [f"{d}_{k}" for d in DIRECTIONS for k in range(T.FOLDS)]
CELLS = [f"cell{i}" for i in range(len(T.LEVELS))]


def fold(episode_id: Column) -> Column:
    return F.conv(F.substring(F.md5(episode_id), 1, 8), 16, 10).cast("long") % T.FOLDS


def with_cells(rows: DataFrame) -> DataFrame:
    """``rows`` with the id of the cell that holds it at each level of the cascade, sharpest first."""
    return rows.withColumns({c: T.template_id(keys) for c, keys in zip(CELLS, T.LEVELS, strict=True)})


def counted(rows: DataFrame, *more: str) -> DataFrame:
    """Episodes per finest cell (and ``more``), fold and direction."""
    one = {f"{d}_{k}": F.count_if((F.col("direction") == d) & (F.col("_fold") == k)) for d in DIRECTIONS for k in range(T.FOLDS)}
    return with_cells(rows).withColumn("_fold", fold(F.col("episode_id"))).groupBy(*CELLS, *more).agg(*[v.alias(k) for k, v in one.items()])


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in COUNTS]


def _total(names=COUNTS) -> Column:
    return reduce(lambda x, y: x + y, [F.col(c) for c in names])


def _few(lists: str, most: int) -> Column:
    """The first of the accounts in several short lists."""
    return F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(lists)))), 1, most).alias("accounts")


def _big(minimum: int = T.MIN_EPISODES, accounts: int = T.MIN_ACCOUNTS) -> Column:
    return (_total() >= minimum) & (F.size("accounts") >= accounts)


def verdicts(cells: DataFrame, cell: str, keys: list[str]) -> DataFrame:
    """``keys``, template_id, prediction_direction of the cells that make active templates: what each fold holds against what the
    others say."""
    of = lambda d: _total([f"{d}_{k}" for k in range(T.FOLDS)])
    right = F.lit(0)
    for k in range(T.FOLDS):
        said = T._first_most(lambda d, k=k: of(d) - F.col(f"{d}_{k}"))
        right = right + F.when(said == "degraded", F.col(f"degraded_{k}")).when(said == "improved", F.col(f"improved_{k}")).otherwise(F.col(f"neutral_{k}"))
    rows = cells.withColumns({"prediction_direction": T._first_most(of), "status": T.status(right / _total(), _total())})
    return T.active(rows).select(*keys, F.col(cell).alias("template_id"), "prediction_direction")


def settled(cells: DataFrame, by: list[str], most: int = T.MIN_ACCOUNTS) -> DataFrame:
    """The active templates of each training in ``by``, from its finest cells: what sharper cells leave is summed up level by level."""
    out, left = None, cells
    for i, cell in enumerate(CELLS):
        sums = left.groupBy(*by, *CELLS[i:]).agg(*_sums(), _few("accounts", most))
        found = verdicts(sums.filter(_big()), cell, by)
        out = found if out is None else out.unionByName(found)
        left = sums.filter(~_big())
    return out


def predicted(test: DataFrame, active: DataFrame, by: list[str]) -> DataFrame:
    """``test`` with the id and direction of the sharpest active template of its training; rows without one are dropped."""
    for i, cell in enumerate(CELLS):
        one = active.select(*by, F.col("template_id").alias(cell), F.struct("template_id", "prediction_direction").alias(f"_t{i}"))
        test = test.join(one, [*by, cell], "left")
    said = F.coalesce(*[F.col(f"_t{i}") for i in range(len(CELLS))])
    return test.withColumn("_t", said).drop(*[f"_t{i}" for i in range(len(CELLS))]).filter("_t IS NOT NULL").select("*", "_t.*").drop("_t")


def hits() -> Column:
    """Of a row of counts, how many episodes have the predicted direction."""
    of = lambda d: _total([f"{d}_{k}" for k in range(T.FOLDS)])
    return F.when(F.col("prediction_direction") == "degraded", of("degraded")).when(F.col("prediction_direction") == "improved", of("improved")).otherwise(of("neutral"))


# --- all but one account ---


def transfer(rows: DataFrame, minimum: int = 20) -> DataFrame:
    """Leave one account out: for each account with ``minimum`` episodes and each of its finest cells, what templates trained on all
    others say of it: account_id, the keys of the cell, template_id, prediction_direction, n, n_correct.

    Without an account only the cells that hold episodes of it differ. At each level these pairs of account and cell are summed up
    anew: from the cells one level sharper, as they are left in the whole training, or as they are left without the account where
    it has part in them. So work grows with the pairs of accounts and cells, however many episodes there are."""
    keys = T.LEVELS[0]
    own = materialised(counted(rows, "account_id", *keys), "held-out-counts")
    first = Window.partitionBy(CELLS[0]).orderBy("account_id")
    few = own.select(CELLS[0], "account_id").withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= T.MIN_ACCOUNTS + 1).groupBy(CELLS[0]).agg(F.array_sort(F.collect_list("account_id")).alias("accounts"))
    whole = materialised(own.groupBy(*CELLS).agg(*_sums()).join(few, CELLS[0]), "held-out-cells")
    large = own.groupBy("account_id").agg(F.sum(_total()).alias("_n")).filter(F.col("_n") >= minimum).select("account_id")
    own = own.join(large, "account_id")
    # without the account itself
    less = whole.withColumnsRenamed({c: f"all_{c}" for c in COUNTS})
    world = own.join(less, CELLS).select("account_id", *CELLS, *[(F.col(f"all_{c}") - F.col(c)).alias(c) for c in COUNTS], F.array_remove("accounts", F.col("account_id")).alias("accounts"))
    out, left = None, whole
    for i, cell in enumerate(CELLS):
        if i:
            parts = own.select("account_id", *CELLS[i - 1 :]).distinct()
            asked = parts.select("account_id", cell).distinct()
            others = asked.join(left, cell).join(parts.select("account_id", CELLS[i - 1]), ["account_id", CELLS[i - 1]], "left_anti")
            world = world.drop(*CELLS[: i - 1]).unionByName(others.select("account_id", *CELLS[i - 1 :], *COUNTS, "accounts"))
            world = world.groupBy("account_id", *CELLS[i:]).agg(*_sums(), _few("accounts", T.MIN_ACCOUNTS + 1))
        world = materialised(world, "held-out-world")
        sums = left.groupBy(*CELLS[i:]).agg(*_sums(), _few("accounts", T.MIN_ACCOUNTS + 1)) if i else left
        found = verdicts(world.filter(_big()), cell, ["account_id"])
        out = found if out is None else out.unionByName(found)
        world, left = world.filter(~_big()), materialised(sums.filter(~_big()), "held-out-left")
    told = predicted(own, materialised(out, "held-out-active"), ["account_id"])
    return told.select("account_id", *keys, "template_id", "prediction_direction", _total().alias("n"), hits().alias("n_correct"))


# --- all before a date ---


def predicted_ranges(rows: DataFrame, ranges: DataFrame, min_train: int) -> DataFrame:
    """``range_id, matched, accuracy``: how templates trained on all before ``lo`` predict the episodes of [lo, hi). Ranges with too few
    episodes before them are left out.

    The counts of a finest cell are summed up over days once; a range takes the sum it finds at its first day. So a training is one
    row per finest cell, of which there are few."""
    daily = materialised(counted(rows, "change_date"), "daily-counts")
    seen = with_cells(rows).groupBy(CELLS[0], "account_id").agg(F.min("change_date").alias("since"))
    first = Window.partitionBy(CELLS[0]).orderBy("since", "account_id")
    few = seen.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= T.MIN_ACCOUNTS).groupBy(CELLS[0]).agg(F.collect_list(F.struct("since", "account_id")).alias("few"))
    marks = daily.select(*CELLS).distinct().crossJoin(F.broadcast(ranges.select("range_id", F.col("lo").alias("change_date"))))  # cells x ranges
    both = daily.withColumn("range_id", F.lit(None).cast(ranges.schema["range_id"].dataType)).unionByName(marks, allowMissingColumns=True)
    # a day's own episodes come after the ranges that begin on it
    before = Window.partitionBy(CELLS[0]).orderBy("change_date", F.col("range_id").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    trained = both.select("range_id", "change_date", *CELLS, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in COUNTS]).filter("range_id IS NOT NULL")
    trained = trained.filter(_total() > 0).join(few, CELLS[0])
    known = F.transform(F.filter("few", lambda x: x["since"] < F.col("change_date")), lambda x: x["account_id"])
    trained = materialised(trained.withColumn("accounts", known).drop("few", "change_date"), "trained-counts")
    enough = trained.groupBy("range_id").agg(F.sum(_total()).alias("n_train")).filter(F.col("n_train") >= min_train).select("range_id")
    active = settled(trained.join(enough, "range_id", "left_semi"), ["range_id"])
    spans = ranges.join(enough, "range_id", "left_semi").withColumnRenamed("lo", "_lo").withColumnRenamed("hi", "_hi")
    test = daily.join(F.broadcast(spans), (F.col("change_date") >= F.col("_lo")) & (F.col("change_date") < F.col("_hi")))
    told = predicted(test, active, ["range_id"])
    return told.groupBy("range_id").agg(F.sum(_total()).alias("matched"), (F.sum(hits()) / F.sum(_total())).alias("accuracy"))
