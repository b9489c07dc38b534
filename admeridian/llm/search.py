"""Ranked lexical search: many items against all documents, with the sums that items share worked out once.

A document's score for an item is a sum over the item's terms, so items that have terms in common have parts of their sums in
common. The items are taken in blocks (``BLOCK_ITEMS`` items or ``BLOCK_TERMS`` words of them, whichever is reached first; an item
is never split). For each block:

1. One pass over the whole texts keeps of each document the number of its terms and how often it holds each term of the block;
   the counts of documents and terms of the corpus, and of documents with a term, come from sums of per-task counts.
2. Sets of terms that items share are mined (``sharing_dag``): in each round the pairs of partial sums that stand together in
   most items become partial sums of their own, until no two items have two in common. The result is a graph in levels.
3. The partial sums ("accumulators") of a batch of documents are filled level by level, each once for all items that use it, and
   an item's scores are the sum of what is left of it. Each task keeps the best of each item; two small windows merge them.

Mining looks at pairs among ``WINDOW`` partial sums at a time, the most frequent first; this bounds its cost and changes no score.

Defined results: terms are runs of ASCII letters and digits and of characters beyond ASCII, only A-Z lower-cased; a null text has
no terms; each row of the items is an item and each row of the documents a document, repeated or not; items without terms or
without a document above 0 give no rows; of equal scores the smaller id goes first, a null id last; empty tables give an empty
table; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from admeridian.llm.common import one_by_one, staged, tidy

TOP = 10
BLOCK_ITEMS, BLOCK_TERMS = 4096, 1 << 16
#: Partial sums of an item among which pairs are mined together.
WINDOW = 64
#: Bytes of a text that are split into terms at a time; numbers that a batch of accumulators holds at most.
PART, CELLS = 1 << 20, 1 << 21
#: Shares into which the candidates of an item are dealt before they meet.
SHARES = 8
#: What each byte of a text becomes: part of a term (A-Z as a-z), or a blank.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def term_lists(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a whole text in order, in lists from about ``PART`` bytes each."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(TERM_BYTES)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PART)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def term_counts(text: str | None) -> Counter:
    found: Counter = Counter()
    for part in term_lists(text):
        found.update(part)
    return found


# --- the items ---


@dataclass(frozen=True)
class Dag:
    """Rows 0 to ``n_terms`` are the terms. Each level adds rows, each the sum of two earlier ones; ``rows`` cut at ``starts`` are
    those that an item sums up in the end."""

    n_terms: int
    levels: list[tuple[np.ndarray, np.ndarray]]
    rows: np.ndarray
    starts: np.ndarray

    @property
    def n_rows(self) -> int:
        return self.n_terms + sum(len(left) for left, _ in self.levels)

    def additions(self) -> int:
        return self.n_rows - self.n_terms + len(self.rows) - len(self.starts)


def sharing_dag(items: list[dict[int, int]], n_terms: int) -> Dag:
    """The graph for items that hold each of their terms so many times; every item has a term."""
    nodes: dict[tuple[int, int], int] = {}
    # the second occurrence of a term is another summand with the same value
    sets = [{nodes.setdefault((term, k), len(nodes)) for term, times in own.items() for k in range(times)} for own in items]
    row_of = [term for term, _ in nodes]
    levels: list[tuple[np.ndarray, np.ndarray]] = []
    n_rows = n_terms
    while True:
        holders: dict[int, set[int]] = {}
        for i, own in enumerate(sets):
            for x in own:
                holders.setdefault(x, set()).add(i)
        pairs: Counter = Counter()
        for own in sets:
            shared = sorted((x for x in own if len(holders[x]) > 1), key=lambda x: (-len(holders[x]), x))
            for at in range(0, len(shared), WINDOW):
                pairs.update(combinations(sorted(shared[at : at + WINDOW]), 2))
        left, right = [], []
        for _, x, y in sorted((-n, x, y) for (x, y), n in pairs.items() if n > 1):
            both = holders[x] & holders[y]
            if len(both) > 1:
                new = len(row_of)
                row_of.append(n_rows + len(left))
                left.append(row_of[x])
                right.append(row_of[y])
                holders[x] -= both
                holders[y] -= both
                for i in both:
                    sets[i] -= {x, y}
                    sets[i].add(new)
        if not left:
            break
        levels.append((np.array(left), np.array(right)))
        n_rows += len(left)
    ends = np.cumsum([len(own) for own in sets])
    return Dag(n_terms, levels, np.array([row_of[x] for own in sets for x in sorted(own)], np.int64), np.concatenate([[0], ends[:-1]]).astype(np.int64))


def scores(dag: Dag, values: np.ndarray) -> np.ndarray:
    """Items by documents, from what each term (row) adds to each document (column)."""
    sums = np.empty((dag.n_rows, values.shape[1]), np.int64)
    sums[: dag.n_terms] = values
    at = dag.n_terms
    for left, right in dag.levels:
        np.add(sums[left], sums[right], out=sums[at : at + len(left)])
        at += len(left)
    return np.add.reduceat(sums[dag.rows], dag.starts, axis=0)


def item_blocks(rows: Iterable[tuple[object, str | None]]) -> Iterator[list[tuple[object, Counter]]]:
    """The items that have terms, in blocks; one block at a time is held."""
    block, size = [], 0
    for name, text in rows:
        own = term_counts(text)
        if own:
            if block and (len(block) == BLOCK_ITEMS or size + own.total() > BLOCK_TERMS):
                yield block
                block, size = [], 0
            block.append((name, own))
            size += own.total()
    if block:
        yield block


# --- the documents ---


def postings(docs: DataFrame, id_col: str, text_col: str, terms: list[bytes]) -> DataFrame:
    """``doc_id, n, terms, times``: documents that have terms, with those of ``terms`` they hold (32-bit numbers) and how often."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast({x: k for k, x in enumerate(terms)})

    def of(batches):
        number = held.value.get
        for batch in batches:
            keep, sizes, found, times = [], [], [], []
            for i, text in enumerate(one_by_one(batch.column(1))):
                n, own = 0, Counter()
                for part in term_lists(text):
                    n += len(part)
                    own.update(map(number, part))
                if n:
                    own.pop(None, None)
                    keep.append(i)
                    sizes.append(n)
                    found.append(np.fromiter(own.keys(), np.int32, len(own)).tobytes())
                    times.append(np.fromiter(own.values(), np.int32, len(own)).tobytes())
            ids = batch.column(0).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(found, pa.binary()), pa.array(times, pa.binary())], names=["doc_id", "n", "terms", "times"])
        tidy()

    return slim.mapInArrow(of, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n long, terms binary, times binary")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of 32-bit lists, and how many each row has."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]].view(np.int32), np.diff(ends) // 4


def statistics(held: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with terms, all terms, and documents that hold each of the block's terms."""

    def count(batches):
        total, with_term = np.zeros(2, np.int64), np.zeros(n_terms, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += [batch.num_rows, batch.column(0).to_numpy().sum()]
                with_term += np.bincount(_flat(batch.column(1))[0], minlength=n_terms)
        some = np.flatnonzero(with_term)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], some])), pa.array(np.concatenate([total, with_term[some]]))], names=["what", "n"])

    found = {r["what"]: r["n"] for r in held.select("n", "terms").mapInArrow(count, "what long, n long").groupBy("what").agg(F.sum("n").alias("n")).collect()}
    return found.get(-2, 0), found.get(-1, 0), np.array([found.get(k, 0) for k in range(n_terms)], np.int64)


def best_of_tasks(held: DataFrame, dag: Dag, weights: np.ndarray, n_docs: int, all_terms: int, top: int) -> DataFrame:
    """``item, doc_id, score``: the best documents of each item (by number) in each task."""
    sent = held.sparkSession.sparkContext.broadcast((dag, weights))

    def of(batches):
        dag, weights = sent.value
        n_items = len(dag.starts)
        best: list[list[tuple]] = [[] for _ in range(n_items)]
        least = np.ones(n_items, np.int64)
        step = max(16, CELLS // (dag.n_rows + len(dag.rows)))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                terms, sizes = _flat(batch.column(2))
                times = _flat(batch.column(3))[0].astype(np.int64)
                of_doc = np.repeat(np.arange(batch.num_rows), sizes)
                m = 25 + (75 * batch.column(1).to_numpy() * n_docs) // all_terms
                values = np.zeros((dag.n_terms, batch.num_rows), np.int64)
                values[terms, of_doc] = weights[terms] * ((1_000_000_000 * times) // (1000 * times + 8 * m[of_doc]))
                found = scores(dag, values)
                ids = batch.column(0).to_pylist()
                for i in np.flatnonzero(found.max(axis=1) >= least).tolist():
                    own = found[i]
                    some = np.flatnonzero(own >= least[i])
                    if len(some) > top:
                        some = some[own[some] >= np.partition(own[some], -top)[-top]]
                    best[i] = heapq.nsmallest(top, best[i] + [(-s, ids[k] is None, ids[k]) for k, s in zip(some.tolist(), own[some].tolist(), strict=True)])
                    if len(best[i]) == top:
                        least[i] = -best[i][-1][0]
        rows = [(i, doc, -s) for i, own in enumerate(best) for s, _, doc in own]
        columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "score"])
        tidy()

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(held.schema["doc_id"].dataType)
    return held.mapInArrow(of, f"item int, doc_id {held.schema['doc_id'].dataType.simpleString()}, score long")


def ranked(found: DataFrame, top: int) -> DataFrame:
    """The ``top`` rows of each item with their ``rank``; an item's rows are dealt into shares first."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    shares = Window.partitionBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(SHARES))).orderBy(*order)
    some = found.withColumn("rank", F.row_number().over(shares)).filter(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of each item."""
    spark = docs.sparkSession
    slim = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    kind, doc_kind = slim.schema["item_id"].dataType, docs.schema[id_col].dataType
    out = spark.createDataFrame([], T.StructType([T.StructField("item_id", kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", doc_kind), T.StructField("score", T.LongType())]))
    for block in item_blocks((r["item_id"], r["text"]) for r in slim.toLocalIterator()):
        terms = sorted({x for _, own in block for x in own})
        number = {x: k for k, x in enumerate(terms)}
        held = staged(postings(docs, id_col, text_col, terms), "postings")
        n_docs, all_terms, with_term = statistics(held, len(terms))
        if n_docs:
            weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in with_term.tolist()], np.int64)
            dag = sharing_dag([{number[x]: n for x, n in sorted(own.items())} for _, own in block], len(terms))
            names = spark.createDataFrame([(k, name) for k, (name, _) in enumerate(block)], T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", kind)]))
            found = ranked(best_of_tasks(held.filter("octet_length(terms) > 0"), dag, weights, n_docs, all_terms, top), top)
            out = out.unionByName(found.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return out
