"""SimHash near-duplicates through a byte-position index with count filtering.

Fingerprints have 64 bits, i.e. 8 positional bytes. Two that differ in at most ``MAX_BITS`` = 3 bits differ in at most 3 bytes,
so they share at least 8 - 3 = 5 positional bytes: the guaranteed minimum. A list of the inverted index for a single positional
byte holds every 256th fingerprint, and a tally over all its pairs would grow with the square of the input; so each list is
split at once by further positional bytes. The sets of bytes are chosen so that every 5 of the 8 positions contain one of them: a
pair that reaches the minimum meets in some list. The more distinct fingerprints, the wider the sets (2, 3 or 5 bytes), so lists
stay short at any size and no width misses a pair. Within a list the shared positional bytes of each pair are tallied, pairs with
fewer than 5 are dropped, and only the rest are verified on their bits. A list yields its links
as stars of its connected classes, never all pairs of a class. Lists over ``LONG`` are split by further shared bytes, and
what is still dense after 5 bytes is probed by the few bit patterns left: exact and linear in the list.

Equal fingerprints are one node from the start. Links of different nodes are joined to classes by alternating large-star and
small-star rounds, each written to the shared folder; once at most ``FEW`` links are left, one task joins them.

Defined results: null, empty and blank texts have fingerprint zero, which links like any other; texts of fewer words than a
shingle are one shingle; a class is named by its smallest id (null only if it has no other); rows that share an id are one
document for ``near_dedup``; an empty table gives an empty table; other columns pass through ``near_dedup`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admeridian.llm.common import drop_staged, fresh_name, staged, text_or_empty, tidy

WORDS, SEED, MAX_BITS, LONG, BLOCK = 3, 42, 3, 4096, 1 << 16
MIN_BYTES = 8 - MAX_BITS
#: Links that one task joins to classes.
FEW = 1 << 17


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The unsigned fingerprint of a whole text; A-Z count as a-z."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(x) + 1 for x in parts])
    starts = (ends - [len(x) + 1 for x in parts]).tolist()
    ends = (ends - 1).tolist()[min(words, len(parts)) - 1 :]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(ends), BLOCK):
        block = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=False)], "<u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(ends), bitorder="little").view("<u8")[0])


def fingerprints(text: Column, words: int = WORDS) -> Column:
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([fingerprint(x, words) for x in batch], np.uint64).view(np.int64))

    return F.pandas_udf(of, "long")(text_or_empty(text))


# --- the index ---


def byte_sets(n: int) -> list[tuple[int, ...]]:
    """Sets of positions such that any 5 of the 8 positions contain one: pairs, triples within either half, or all fives."""
    if n <= 1 << 16:
        return [(0, 1), (2, 3), (4, 5), (6, 7)]
    if n <= 1 << 24:
        return [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
    return list(combinations(range(8), 5))


def _mask(positions) -> int:
    return sum(0xFF << (8 * p) for p in positions)


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def linked(a: np.ndarray, b: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Which pairs are links: the positional bytes they share are tallied, pairs under the guaranteed minimum go, and only those
    that are left are verified on their bits."""
    x = np.ascontiguousarray(a ^ b)
    good = np.count_nonzero(x.view(np.uint8).reshape(-1, 8) == 0, axis=1) >= 8 - max_bits
    good[good] = _bits(x[good]) <= max_bits
    return good


def _walk(f: np.ndarray) -> list[tuple[int, int]]:
    """Stars (member, smallest member) of the classes of a short list of distinct fingerprints."""
    left, out = np.sort(f), []
    while len(left):
        root, left, front = left[0], left[1:], [left[0]]
        while front and len(left):
            hit = linked(left, front.pop())
            found = left[hit]
            left = left[~hit]
            out += [(int(x), int(root)) for x in found]
            front += list(found)
    return out


def _probe(f: np.ndarray, free: int) -> list[tuple[int, int]]:
    """The same for a dense list that differs only in the bits of ``free``: looks up every pattern of up to 3 free bits."""
    f = np.sort(f)
    label = np.arange(len(f))
    bits = [np.uint64(1 << i) for i in range(64) if free >> i & 1]
    patterns = [sum(c, np.uint64(0)) for k in range(1, MAX_BITS + 1) for c in combinations(bits, k)]
    while True:
        before = label.copy()
        for m in patterns:
            other = f ^ m
            at = np.minimum(np.searchsorted(f, other), len(f) - 1)
            hit = f[at] == other
            low = np.minimum(label[hit], label[at[hit]])
            np.minimum.at(label, np.nonzero(hit)[0], low)
            np.minimum.at(label, at[hit], low)
        label = label[label]
        if (label == before).all():
            return [(int(a), int(b)) for a, b in zip(f, f[label], strict=True) if a != b]


def classes_of_list(f: np.ndarray, shared: tuple[int, ...]) -> list[tuple[int, int]]:
    """Stars that join all fingerprints of a list which are linked; ``shared``: positions in which all agree."""
    if len(f) <= LONG:
        return _walk(f)
    if len(shared) >= MIN_BYTES:
        return _probe(f, ~_mask(shared) & (2**64 - 1))
    out = []
    others = [p for p in range(8) if p not in shared]
    for more in combinations(others, MIN_BYTES - len(shared)):
        keys = f & np.uint64(_mask(more))
        order = np.argsort(keys, kind="stable")
        cuts = np.flatnonzero(np.diff(keys[order])) + 1
        for part in np.split(order, cuts):
            if len(part) > 1:
                out += classes_of_list(f[part], tuple(sorted((*shared, *more))))
    return out


def links(nodes: DataFrame, fp: str = "fp") -> DataFrame:
    """(u, v), u > v: links of distinct fingerprints that join exactly what is linked, directly or through others."""
    n = nodes.count()
    sets = byte_sets(n)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = F.explode(F.array(*[F.struct(F.lit(i).cast("byte").alias("set"), F.col(fp).bitwiseAND(F.lit(signed(_mask(s)))).alias("key")) for i, s in enumerate(sets)]))
    postings = nodes.select(F.col(fp).alias("fp"), keys.alias("k")).select("k.set", "k.key", "fp").repartition("set", "key").sortWithinPartitions("set", "key")

    def pairs(batches):
        pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def settle(kinds, keys, fps):
            out = []
            cuts = np.flatnonzero((np.diff(keys) != 0) | (np.diff(kinds) != 0)) + 1
            bounds = np.concatenate([[0], cuts, [len(fps)]])
            for at in np.flatnonzero(np.diff(bounds) > 1):
                a, b = bounds[at], bounds[at + 1]
                if b - a == 2:
                    if linked(fps[a:b][:1], fps[a + 1 : b])[0]:
                        out.append((int(fps[a]), int(fps[a + 1])))
                else:
                    out += classes_of_list(fps[a:b], sets[kinds[a]])
            table = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(table.max(axis=1) if len(table) else []).cast(pa.int64()), pa.array(table.min(axis=1) if len(table) else []).cast(pa.int64())], names=["u", "v"])

        for batch in batches:
            own = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64))
            if not len(own[0]):
                continue
            # the last list of a batch may go on in the next one
            new = np.flatnonzero((own[0] != own[0][-1]) | (own[1] != own[1][-1]))
            cut = new[-1] + 1 if len(new) else 0
            if cut or (pending and (pending[-1][0][-1], pending[-1][1][-1]) != (own[0][0], own[1][0])):
                pending.append(tuple(x[:cut] for x in own))
                yield settle(*(np.concatenate(x) for x in zip(*pending, strict=True)))
                pending = []
            pending.append(tuple(x[cut:] for x in own))
        if pending:
            yield settle(*(np.concatenate(x) for x in zip(*pending, strict=True)))
        pending = []
        tidy()

    return postings.mapInArrow(pairs, "u long, v long").distinct()


# --- classes ---


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 999_983)).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each node of ``edges`` that is not the smallest of its component, with the smallest."""
    edges = staged(edges, "edges")
    now = _signature(edges)
    while now[0]:
        if now[0] <= FEW:
            return _joined(edges)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lower.select("u", F.col("m").alias("v")))
        after = staged(small.distinct(), "edges")
        before, now = now, _signature(after)
        drop_staged(edges)
        edges = after
        if now == before:
            break
    return edges


def _joined(edges: DataFrame) -> DataFrame:
    """The same of a few links, in one task."""

    def of(batches):
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not held:
            return
        nodes, ends = np.unique(np.stack([np.concatenate(x) for x in zip(*held, strict=True)]), return_inverse=True)
        above = list(range(len(nodes)))

        def top(x):
            while above[x] != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        for a, b in ends.reshape(2, -1).T.tolist():
            a, b = top(a), top(b)
            above[max(a, b)] = min(a, b)
        root = nodes[[top(x) for x in range(len(nodes))]]
        other = root != nodes
        yield pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(root[other])], names=["u", "v"])
        tidy()

    return staged(edges.select("u", "v").repartition(1).mapInArrow(of, "u long, v long"), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row per row: ``doc_id, fp`` (the fingerprint as a signed long) and ``component_id``."""
    table = staged(docs.select(F.col(id_col).alias("doc_id"), fingerprints(F.col(text_col), words).alias("fp")), "fingerprints")
    nodes = staged(table.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
    roots = components(links(nodes)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    named = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = staged(named, "named")
    class_id = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_node = staged(named.join(class_id, "root").select("fp", "component_id"), "classes")
    return table.join(of_node, "fp").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """The rows of ``docs`` whose id names their class, with all their columns."""
    found = near_duplicates(docs, id_col, text_col, words)
    key = fresh_name(docs, "kept_id")
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(key)), "left_semi")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
