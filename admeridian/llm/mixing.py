"""Mixing sources to target weights.

Words are aggregated per source; the budget is shared out by weight, no source above its cap (water filling in closed form);
each source's repetition rate is target / size; a document is emitted floor(rate) times, plus one more with probability equal to
the fraction.

The coins of a source are drawn together, so that small sources come near their target too: its documents stand in order of size
(by classes of the leading bits, then by hash), one start in [0, 1) is drawn by a hash of seed and source, and the document of rank
r takes the extra copy when a whole number lies between start + (r - 1) * fraction and start + r * fraction. Each document has the
copy with probability equal to the fraction, and the words taken miss the target by about the largest document at most. Ranks
come from counts of cells (source, size class, part of the hash), so a source of any share is ranked in many tasks.

Defined results: a null or empty text has size 0; a null source is a source of its own, last in order; a source without
words gets target 0 and none of its documents; null ids are ordered by their texts; rows that agree in id and text are documents
of their own, of which some may take the extra copy; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from admeridian.llm.common import WORD, fresh_name, staged, text_or_empty

#: Weights of the sources in code-point order, repeating; the share of all words the mix takes; the most it takes of a source.
WEIGHTS, SHARE, CAP, SEED = (5, 2, 1), 1.5, 2.0, "mix-1"


def word_count(text: Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, source_col: str = "source", size_col: str = "size", weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(of, source_size, target) of each source; the windows run over one row per source.

    With the sources ordered by cap / weight, those up to some point are capped and all later ones get one level times their
    weight; the level after k capped sources is (budget - their caps) / (the other weights).
    """
    per = sizes.groupBy(F.col(source_col).alias("source")).agg(F.sum(size_col).alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    place = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    per = per.withColumn("most", cap * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    by_ratio = everything.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    budget = share * F.sum("source_size").over(everything)
    left = budget - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    others = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left / others)
    # the level of the first source that is not capped holds for all later ones
    level = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "source", "level"))).over(everything)["level"]
    per = per.withColumn("common", level)
    target = F.when(F.col("common").isNull() | (F.col("ratio") <= F.col("common")), F.col("most")).otherwise(F.col("weight") * F.col("common"))
    return per.select(F.col("source").alias("of"), "source_size", target.alias("target"))


def draw(text: Column) -> Column:
    """A number in [0, 1) from 52 bits of a hash."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def size_class(size: Column) -> Column:
    """Sizes that agree in length and in their four leading bits are of one class; larger ones have larger classes."""
    bits = F.length(F.bin(size))
    return bits * 16 + F.call_function("shiftright", size, F.greatest(F.lit(0), bits - 4)).cast("int")


def mix_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **shares) -> DataFrame:
    """``docs`` with ``size, source_size, target, copies``; Spark chooses how the tables of cells and sources are joined."""
    names = {x: fresh_name(docs, x) for x in ("size", "source_size", "target", "copies")}
    own = {x: fresh_name(docs, f"mix_{x}") for x in ("source", "class", "part", "order", "rank", "before")}
    size, cell = F.col(names["size"]), [own["source"], own["class"], own["part"]]
    order = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.md5(text_or_empty(F.col(text_col))))))
    sized = docs.withColumn(names["size"], word_count(F.col(text_col))).withColumn(own["order"], order)
    keys = {own["source"]: F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")), own["class"]: size_class(size), own["part"]: F.substring(own["order"], 1, 2)}
    sized = sized.withColumns(keys)
    cells = sized.groupBy(F.col(source_col).alias("source"), *cell).agg(F.count("*").alias("n"), F.sum(size).alias("size"))
    cells = staged(cells, "cells")
    targets = source_targets(cells.select("source", "size"), **shares)
    earlier = Window.partitionBy(own["source"]).orderBy(F.desc(own["class"]), own["part"]).rowsBetween(Window.unboundedPreceding, -1)  # at most 256 rows a class
    cells = cells.withColumn(own["before"], F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(targets, F.col("source").eqNullSafe(F.col("of")))
    cells = cells.select(*cell, own["before"], F.col("source_size").alias(names["source_size"]), F.col("target").alias(names["target"]))
    in_cell = Window.partitionBy(*cell).orderBy(F.desc(names["size"]), own["order"], F.xxhash64(text_col))
    ranked = sized.withColumn(own["rank"], F.row_number().over(in_cell)).join(cells, cell)
    rate = F.when(F.col(names["source_size"]) > 0, F.col(names["target"]) / F.col(names["source_size"])).otherwise(0.0)
    fraction, start, rank = rate - F.floor(rate), draw(F.concat(F.lit(seed + ":"), F.col(own["source"]))), F.col(own["before"]) + F.col(own["rank"])
    copies = F.floor(rate) + F.floor(start + rank * fraction) - F.floor(start + (rank - 1) * fraction)
    return ranked.withColumn(names["copies"], copies.cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns], *names.values())


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    copies = fresh_name(docs, "copies")
    again = fresh_name(docs, "again")
    taken = mix_decisions(docs, **options)
    repeats = F.explode(F.array_repeat(F.lit(True), F.col(copies).cast("int")))
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns], repeats.alias(again)).drop(again)
