"""The trie of conversation prefixes by ROLLUP over positional turn-id columns.

Conversations are laid out in blocks of ``BLOCK`` columns, one turn id a column. One ``GROUP BY prior, ROLLUP (t1, ..., t8)`` then
aggregates all prefixes together; ``grouping_id`` tells how many columns a group has, so its depth. A conversation longer than a
block goes on in further rows, whose ``prior`` names the node at which its block before ends; blocks of all numbers are rolled up
at once, never one after another. A node is named by a sum of two 64-bit hashes per block of the path, taken of the block's number
and turn ids; sums of earlier blocks are running sums, so that names need no chain of hashes however long a conversation is.

What a node needs of its subtree comes from one of its members at a time: a node is charged to its smallest member ("owner"), and
an owner of a node belongs to all its ancestors. So leaves and tokens of a subtree are sums over members, of what they own at this
depth or below, and a second rollup of the same rows adds them up. (Owner, depth) names a node as well.

Turn ids are 128 bits of a SHA-256 of role and text with the text's length in bytes. Ends of a node are numbered, joined to strings
of ``CHUNK`` ids each, and hashed as a stream of those strings, as SHA-256 can only be taken in order.

Defined results: turns go by turn number (null first), ties by turn id; a null role or text counts as empty; repeated rows are
turns of their own; rows without a conversation id belong to no conversation; a conversation may be left without turns, it ends at
the root; an empty table gives an empty table; other columns, whatever their names, are not read. Ids are integers from 0.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admeridian.llm.common import staged
from admeridian.llm.ranking import in_order

BLOCK = 8
CHUNK = 1024
#: Turns that the first conversation of five gives to the others at most, plus one; fixed by the contract.
SHARED, FAMILY = 9, 5
_COLUMNS = [f"t{j}" for j in range(1, BLOCK + 1)]


def turn_id(role: Column, text: Column) -> Column:
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.substring(F.sha2(whole, 256), 1, 32), F.lit(":"), F.octet_length(text).cast("string"))


def rebuilt(table: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, place`` (from 0), ``tid`` of every turn of the rebuilt conversations: the first h turns of the first conversation
    of the family, then the conversation's own after its first h."""
    rows = table.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), turn_id(F.col(role_col), F.col(text_col)).alias("tid")).filter("conv_id is not null")
    turns = staged(in_order(rows, ["conv_id"], ["turn", "tid"], "place").select("conv_id", "place", "tid"), "turns")
    convs = conversations(turns)
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select(F.col("conv_id").alias("first_id"), "n")
    plans = convs.withColumns({"first_id": F.col("conv_id") - F.col("conv_id") % FAMILY, "h": shared_turns(F.col("conv_id"))})
    plans = plans.join(lengths, "first_id", "left").select("conv_id", "first_id", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("taken"))
    own = turns.join(plans.select("conv_id", "h", "taken"), "conv_id").filter("place >= h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "tid")
    # a first conversation has at most five takers, of at most eight turns each
    heads = turns.filter(F.col("place") < SHARED - 1).select(F.col("conv_id").alias("first_id"), "place", "tid")
    taken = plans.join(heads, "first_id").filter("place < taken").select("conv_id", "place", "tid")
    return own.unionByName(taken)


def conversations(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id").distinct()


def shared_turns(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % SHARED).cast("int")


def _name(lane: int, prior: str, block: str, columns: list[str]) -> Column:
    own = F.xxhash64(F.lit(lane), F.col(block), *[F.col(c) for c in columns]).cast("decimal(38,0)")
    return (F.col(prior) + own).cast("decimal(38,0)")


def blocks(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per block of a conversation, one at least: ``conv_id, block, t1 .. t8`` (null beyond its end), ``prior_a, prior_b``
    (the node before it) and ``last`` (it is the last one)."""
    at = (F.col("place") % BLOCK).cast("int")
    wide = turns.withColumn("block", F.expr(f"place div {BLOCK}")).groupBy("conv_id", "block").agg(*[F.max(F.when(at == j, F.col("tid"))).alias(c) for j, c in enumerate(_COLUMNS)])
    # a conversation without turns has one empty block
    bare = convs.join(turns.select("conv_id").distinct(), "conv_id", "left_anti").select("conv_id", F.lit(0).cast("long").alias("block"), *[F.lit(None).cast("string").alias(c) for c in _COLUMNS])
    wide = wide.unionByName(bare).withColumns({"zero": F.lit(0).cast("decimal(38,0)")})
    wide = wide.withColumns({f"own_{x}": _name(k, "zero", "block", _COLUMNS) for k, x in enumerate("ab")}).drop("zero")
    placed = in_order(wide, ["conv_id"], ["block"], "number", {"prior_a": "own_a", "prior_b": "own_b"})
    last = wide.groupBy("conv_id").agg(F.max("block").alias("last_block"))
    return placed.join(last, "conv_id").select("conv_id", "block", *_COLUMNS, *[F.col(f"prior_{x}").cast("decimal(38,0)").alias(f"prior_{x}") for x in "ab"], (F.col("block") == F.col("last_block")).alias("last"))


def rolled(rows: DataFrame, measures: str) -> DataFrame:
    """One row per node with ``measures``, and with its names ``node_a, node_b``, those of its parent and its ``depth``."""
    columns = ", ".join(_COLUMNS)
    sql = f"""
        SELECT block, prior_a, prior_b, {columns}, {BLOCK} - CAST(round(log2(grouping_id() + 1)) AS INT) AS level, {measures}
        FROM {{rows}} GROUP BY block, prior_a, prior_b, ROLLUP ({columns})"""
    groups = rows.sparkSession.sql(sql, rows=rows)
    reached = F.element_at(F.array(*_COLUMNS), F.greatest("level", F.lit(1)))
    # a group that ends in a missing turn is no node; without columns, only the one of the first block is: the root
    nodes = groups.filter(F.when(F.col("level") == 0, F.col("block") == 0).otherwise(reached.isNotNull()))

    def name(lane: int, x: str, up: int) -> Column:
        at, out = F.col("level") - up, F.col(f"prior_{x}")
        for j in range(1, BLOCK + 1):
            padded = [*_COLUMNS[:j], *["gone"] * (BLOCK - j)]
            out = F.when(at == j, _name(lane, f"prior_{x}", "block", padded)).otherwise(out)
        return out

    named = nodes.withColumn("gone", F.lit(None).cast("string"))
    up = {f"up_{x}": F.when((F.col("level") == 0), F.lit(None)).otherwise(name(k, x, 1)) for k, x in enumerate("ab")}
    return named.withColumns({f"node_{x}": name(k, x, 0) for k, x in enumerate("ab")} | up | {"depth": F.col("block") * BLOCK + F.col("level"), "bytes": F.coalesce(F.substring_index(reached, ":", -1).cast("long"), F.lit(0))})


def prefix_trie(table: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    turns = staged(rebuilt(table, id_col, turn_col, role_col, text_col), "rebuilt")
    convs = conversations(table.select(F.col(id_col).cast("long").alias("conv_id")).filter("conv_id is not null"))
    laid = staged(blocks(turns, convs), "blocks")
    nodes = rolled(laid, "count(*) AS n_convs, min(conv_id) AS conv_id")
    nodes = staged(nodes.select("conv_id", "depth", "level", "block", "n_convs", "bytes", "node_a", "node_b", "up_a", "up_b"), "nodes")

    children = nodes.filter("depth > 0").groupBy(F.col("up_a").alias("node_a"), F.col("up_b").alias("node_b")).agg(F.count("*").alias("n_children"))
    known = nodes.join(children, ["node_a", "node_b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    known = staged(known, "known")

    # what each owner has at each place of a block, and in the blocks after it
    saved = (F.col("n_convs") - 1) * F.col("bytes")
    mine = known.groupBy("conv_id", "block").agg(*[F.sum(F.when(F.col("level") == j, saved)).alias(f"own{j}") for j in range(1, BLOCK + 1)], F.sum(saved).alias("held"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    totals = mine.groupBy("conv_id").agg(F.sum("held").alias("all_held"), F.max("leaf").alias("leaf"))
    before = in_order(mine.drop("leaf"), ["conv_id"], ["block"], "number", {"earlier": "held"}).drop("number")
    # an owner owns its path from some depth to the end, so blocks before its first one come before all it has
    filled = laid.join(before, ["conv_id", "block"], "left").join(totals, "conv_id", "left")
    after = F.when(F.col("held").isNull(), F.coalesce("all_held", F.lit(0))).otherwise(F.col("all_held") - F.col("earlier") - F.col("held"))
    filled = filled.select("conv_id", *[c for c in laid.columns if c != "conv_id"], *[F.coalesce(f"own{j}", F.lit(0)).alias(f"own{j}") for j in range(1, BLOCK + 1)], after.alias("after"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    sums = ", ".join(f"sum(own{j}) AS own{j}" for j in range(1, BLOCK + 1))
    below = rolled(filled, f"min(conv_id) AS conv_id, sum(leaf) AS n_leaves, sum(after) AS after, {sums}")
    inside = sum((F.when(F.col("level") <= j, F.col(f"own{j}")).otherwise(0) for j in range(1, BLOCK + 1)), F.col("after"))
    below = below.select("conv_id", "depth", F.col("n_leaves").cast("long").alias("n_leaves"), inside.cast("long").alias("saved_tokens"))

    parents = known.select(F.col("node_a").alias("up_a"), F.col("node_b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    out = known.join(parents, ["up_a", "up_b"], "left").join(below, ["conv_id", "depth"]).join(_ends(laid, known), ["conv_id", "depth"], "left")
    nothing = hashlib.sha256().hexdigest()
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


def _ends(laid: DataFrame, known: DataFrame) -> DataFrame:
    """``conv_id, depth`` of the nodes at which conversations end, with the hash of those conversations' ids."""
    # a block is hashed with nulls in place of missing turns, as is its last node; only an empty block stands for the node before
    some = F.col("t1").isNotNull()
    last = laid.filter("last").select(F.col("conv_id").alias("member"), *[F.when(some, _name(k, f"prior_{x}", "block", _COLUMNS)).otherwise(F.col(f"prior_{x}")).alias(f"node_{x}") for k, x in enumerate("ab")])
    ends = staged(last.join(known.select("node_a", "node_b", "conv_id", "depth"), ["node_a", "node_b"]).select("conv_id", "depth", "member"), "ends")
    placed = in_order(ends, ["conv_id", "depth"], ["member"], "place").withColumn("chunk", F.expr(f"place div {CHUNK}"))
    chunks = placed.groupBy("conv_id", "depth", "chunk").agg(F.array_join(F.transform(F.sort_array(F.collect_list("member")), lambda x: x.cast("string")), ",").alias("ids"))
    chunks = chunks.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "chunk")

    def of(batches):
        now, digest = None, None
        for batch in batches:
            done = []
            owners, depths, ids = (batch.column(i) for i in (0, 1, 3))
            for i in range(batch.num_rows):
                key = owners[i].as_py(), depths[i].as_py()
                if key != now:
                    if now is not None:
                        done.append((*now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256(ids[i].as_py().encode())
                else:
                    digest.update(b"," + ids[i].as_py().encode())
            yield _hashes(done)
        yield _hashes([(*now, digest.hexdigest())] if now is not None else [])

    return chunks.mapInArrow(of, "conv_id long, depth long, ends_sha256 string")


def _hashes(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["conv_id", "depth", "ends_sha256"])
