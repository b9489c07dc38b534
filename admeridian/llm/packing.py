"""Best-fit packing of token pieces by linear grouping.

Lengths are integers up to the capacity, so all decisions are taken on histograms with at most ``capacity`` entries:

1. large lengths (over ``capacity / SMALL``) are sorted and cut into ``GROUPS`` groups of equal cardinality, each rounded up to
   its longest member; full pieces are sequences of their own;
2. configurations of the few rounded sizes are optimised one after another: the longest size left, completed by a bounded
   subset-sum over all sizes left, used as often as the counts allow;
3. actual pieces take the slots of their group in order of rank; each fits, as none is longer than its group's size;
4. what is then really free in each sequence is a histogram again; small lengths, longest first, go best-fit into it.

Pieces learn their sequence from their rank alone, by tables of the plan (bounded by the capacity, not by the data). The
number of pieces never meets in one task: ranks come from per-task counts, offsets from windows over one sequence.

Defined results: a null text counts as empty and is the single end id; a document longer than the capacity is cut into full
pieces of which only the first may be shorter; repeated rows are packed each for itself; ids may be null; an empty table
gives an empty table. The plan depends on lengths only; which of two pieces of one length takes which slot is arbitrary.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from admeridian.llm.common import fresh_name, one_by_one, staged, text_or_empty, tidy
from admeridian.llm.ranking import ranked
from admeridian.llm.segments import encoder

CAPACITY, END_ID, SMALL, GROUPS = 2048, 0, 8, 96
#: A sequence is named by (its class, its number in the class).
CLASS = 1 << 48


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids`` (little-endian, 4 bytes each)."""
    path = path or tokenizer_path()
    slim = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        encode, end = encoder(path, False, 4).encode, int(end_id).to_bytes(4, "little")
        for batch in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(one_by_one(batch.column(1))):
                payload = encode(text) + end
                n = len(payload) // 4
                at, k = 0, 0
                while at < n:
                    size = (n - at) % capacity or capacity
                    part = payload[4 * at : 4 * (at + size)]
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
                    at, k = at + size, k + 1
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        tidy()

    return slim.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length int, ids_crc32 long" + ", ids binary" * with_ids)


def best_fill(room: int, sizes: list[int], counts: list[int]) -> dict[int, int]:
    """Which sizes, at most so many of each, fill ``room`` best: {place in ``sizes``: number}."""
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for i, (size, count) in enumerate(zip(sizes, counts, strict=True)):
        left, chunk = min(count, room // size), 1
        while left > 0:
            take = min(chunk, left)
            steps.append((i, take, reach))
            reach |= (reach << (size * take)) & mask
            left, chunk = left - take, 2 * chunk
    at, out = reach.bit_length() - 1, {}
    for i, take, before in reversed(steps):
        if not before >> at & 1:
            out[i] = out.get(i, 0) + take
            at -= take * sizes[i]
    return out


@dataclass
class LargePlan:
    """Where large pieces go. ``longer[l]``: how many large pieces are longer than ``l``; ``cuts``: first rank of each group;
    ``runs[g]``: (first rank in the group, first sequence, pieces of the group in each sequence, slot of the first)."""

    longer: np.ndarray
    cuts: np.ndarray
    runs: list[np.ndarray] = field(default_factory=list)
    n_sequences: int = 0

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.longer[lengths] + ranks
        group = np.searchsorted(self.cuts, at, side="right") - 1
        sequence, slot = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        for g in np.unique(group):
            rows = (group == g).nonzero()[0]
            rank, runs = at[rows] - self.cuts[g], self.runs[g]
            run = runs[np.searchsorted(runs[:, 0], rank, side="right") - 1]
            sequence[rows] = run[:, 1] + (rank - run[:, 0]) // run[:, 2]
            slot[rows] = run[:, 3] + (rank - run[:, 0]) % run[:, 2]
        return sequence, slot


def plan_large(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> LargePlan:
    """Linear grouping and configurations. ``histogram``: number of pieces of each large length below the capacity."""
    lengths = sorted(histogram, reverse=True)
    longer, total = np.zeros(capacity + 1, np.int64), 0
    for x in lengths:
        longer[x] = total
        total += histogram[x]
    firsts = sorted({total * g // groups for g in range(groups)} - {total})
    cuts = np.array(firsts, np.int64)
    if not total:
        return LargePlan(longer, cuts)
    starts = np.array([longer[x] for x in lengths], np.int64)
    sizes = [lengths[int(np.searchsorted(starts, c, side="right")) - 1] for c in firsts]
    counts = [b - a for a, b in zip(firsts, [*firsts[1:], total], strict=True)]
    runs: list[list[tuple[int, int, int, int]]] = [[] for _ in sizes]
    taken, sequence = [0] * len(sizes), 0
    for g in range(len(sizes)):
        while left := counts[g] - taken[g]:
            others = [counts[i] - taken[i] - (i == g) for i in range(len(sizes))]
            fill = best_fill(capacity - sizes[g], sizes, others)
            fill[g] = fill.get(g, 0) + 1
            times = min((counts[i] - taken[i]) // n for i, n in fill.items())
            assert times and left
            slot = 0
            for i, n in sorted(fill.items()):
                runs[i].append((taken[i], sequence, n, slot))
                taken[i] += n * times
                slot += n
            sequence += times
    return LargePlan(longer, cuts, [np.array(x, np.int64).reshape(-1, 4) for x in runs], sequence)


@dataclass
class SmallPlan:
    """Where small pieces go. ``runs[l]``: (first rank, class, first number in the class, pieces in each sequence, offset)."""

    runs: dict[int, np.ndarray]

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for x in np.unique(lengths):
            rows = (lengths == x).nonzero()[0]
            runs = self.runs[int(x)]
            run = runs[np.searchsorted(runs[:, 0], ranks[rows], side="right") - 1]
            rank = ranks[rows] - run[:, 0]
            sequence[rows] = run[:, 1] * CLASS + run[:, 2] + rank // run[:, 3]
            offset[rows] = run[:, 4] + rank % run[:, 3] * x
        return sequence, offset


def plan_small(histogram: dict[int, int], free: dict[int, int], capacity: int = CAPACITY) -> SmallPlan:
    """Best fit, longest first. ``free``: number of sequences with so much room; further ones are opened with all of it."""
    room: dict[int, list[list[int]]] = {r: [[r, 0, n]] for r, n in free.items() if r and n}  # room: (class, first number, how many)
    opened, runs = 0, {}
    for x in sorted(histogram, reverse=True):
        left, at, own = histogram[x], 0, []
        while left:
            r = min((k for k, v in room.items() if k >= x and v), default=None)
            if r is None:
                per = capacity // x
                n = -(-left // per)
                room.setdefault(capacity, []).append([capacity, opened, n])
                opened += n
                continue
            kind, first, n = room[r].pop()
            per = min(r // x, left)
            used = min(n, left // per)
            own.append((at, kind, first, per, capacity - r))
            at, left = at + used * per, left - used * per
            if used < n:
                room[r].append([kind, first + used, n - used])
            if r > per * x:
                room.setdefault(r - per * x, []).append([kind, first, used])
        runs[x] = np.array(own, np.int64).reshape(-1, 5)
    return SmallPlan(runs)


def _placed(plan, names: str):
    """A column of structs by ``plan.place(length, rank)``; the plan's size is bounded by the capacity."""
    a, b = names.split()

    @F.pandas_udf(f"{a} long, {b} long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        x, y = plan.place(length.to_numpy().astype(np.int64), rank.to_numpy().astype(np.int64))
        return pd.DataFrame({a: x, b: y})

    return place


def _histogram(df: DataFrame, key: str) -> dict[int, int]:
    return {int(k): int(n) for k, n in df.groupBy(key).agg(F.count("*")).collect()}  # at most capacity + 1 rows


def pack(pieces: DataFrame, capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS) -> DataFrame:
    """``pieces`` (with a ``length`` from 1 to ``capacity``, without these two columns) with ``sequence_id`` and ``offset``."""
    rank, to, order, slot, room, number = (fresh_name(pieces, x) for x in ("length_rank", "to", "sequence", "slot", "room", "number"))
    rows = ranked(pieces, "length", capacity, rank, "pieces")
    histogram = _histogram(rows, "length")
    columns = [F.col(f"`{c}`") for c in pieces.columns]
    limit = capacity // small
    full = rows.filter(F.col("length") == capacity).select(*columns, (F.lit((capacity + 1) * CLASS) + F.col(rank)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    large_plan = plan_large({x: n for x, n in histogram.items() if limit < x < capacity}, capacity, groups)
    place = _placed(large_plan, "sequence slot")
    large = rows.filter((F.col("length") > limit) & (F.col("length") < capacity))
    large = large.select(*columns, place("length", rank).alias(to)).select(*columns, F.col(to)["sequence"].alias(order), F.col(to)["slot"].alias(slot))
    sequence = Window.partitionBy(order)
    before = sequence.orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    large = large.withColumns({"offset": F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"), room: (capacity - F.sum("length").over(sequence)).cast("int")})
    large = staged(large, "large")
    rooms = ranked(large.filter(F.col(slot) == 0).select(order, room), room, capacity, number, "rooms")
    named = rooms.select(order, (F.col(room).cast("long") * CLASS + F.col(number)).alias("sequence_id"))
    large = large.join(named, order).select(*columns, "sequence_id", "offset")

    small_plan = plan_small({x: n for x, n in histogram.items() if x <= limit}, _histogram(rooms, room), capacity)
    spot = _placed(small_plan, "sequence_id offset")
    little = rows.filter(F.col("length") <= limit).select(*columns, spot("length", rank).alias(to)).select(*columns, F.col(to)["sequence_id"].alias("sequence_id"), F.col(to)["offset"].alias("offset"))
    return full.unionByName(large).unionByName(little)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, **options) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    pieces = token_pieces(docs, id_col, text_col, with_ids=with_ids, **options)
    return pack(staged(pieces, "cut"))  # written, so that no task needs two Python workers at once
