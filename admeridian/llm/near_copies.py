"""Near copies by the similarity of their five-word shingles: the pipeline's stage.

Two texts are linked when the Jaccard similarity of their sets of ``WORDS``-word shingles is 4/5 or more; classes are what is
linked directly or through others. No bound on the bits of a 64-bit SimHash reaches that similarity (about 10 bits differ at
0.8), so candidates come from two indexes and every link is verified on the whole sets:

1. SimHash: fingerprints over the same shingles go through the byte-position index of ``simhash``; with it, each member of a long
   posting list is held against the smallest of the list, and then, round by round, against a few ``HUBS`` of the list that are
   not yet of its class: those with the fewest shingles that are not common, so the least altered of a group of copies, which are
   near to more of the others than any. The verified links join large groups at a cost linear in their size.
2. Completion: under one order of all shingles, two sets of similarity 4/5 share ``need(smaller)`` shingles among the first
   ``n // 5 + need(n)`` of each. These prefixes are indexed, the shared shingles of each pair that is not yet in one class are
   tallied, and pairs that reach the minimum are verified: of two classes first the few that share most, then all pairs of classes
   that are still apart. No pair is missed, whatever the order is.

The order puts common shingles, which many texts hold, last (by a sample; it decides the cost only), then goes by hash. A prefix
that reaches the common ones holds all the others of its set: two such sets that share none of the others share common ones at
most, so in the list of a common shingle they meet only if those can make up 4/5.

Defined results: A-Z count as a-z; texts of fewer words than a shingle are one shingle; null, empty and blank texts are copies of
each other; sets and shingles are named by 64-bit hashes; a class is named by its smallest id (null only if it has no other);
rows that share an id are one document; an empty table gives an empty table; all columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from admeridian.llm.common import drop_staged, fresh_name, staged, text_or_empty, tidy_all
from admeridian.llm.simhash import SEED, components, links

WORDS = 5
#: Rows of a posting list from which it is long; share of sets sampled for common shingles, how often one is seen to be common, most of them.
LONG, SAMPLE, COMMON, MOST = 64, 16, 4, 1 << 17
#: Pairs of two classes that are verified first; whatever they leave open is verified afterwards.
TRIED = 4
#: Members of a long list that all others are held against, in each round.
HUBS = (4, 16)
#: Bytes that a worker turns into shingles, and shingles that it hands on, at a time.
PART = 1 << 18


def shingle_set(text: str | None, words: int = WORDS) -> tuple[np.ndarray, int]:
    """The sorted distinct shingle hashes of a text and the SimHash over all its shingles."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, "<u8"), 0
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    sizes = np.array([len(x) + 1 for x in parts])
    ends = np.cumsum(sizes)
    starts = (ends - sizes).tolist()
    ends = (ends - 1).tolist()[min(words, len(parts)) - 1 :]
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=False)], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.unique(hashes), int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _in_parts(rows, size, most: int = PART):
    """Lists of ``rows`` whose sizes add up to about ``most``: what a worker holds at a time."""
    part, held = [], 0
    for row in rows:
        part.append(row)
        held += size(row)
        if held >= most:
            yield part
            part, held = [], 0
    if part:
        yield part


def _binaries(column: pa.Array) -> list[np.ndarray]:
    """The hashes in each cell, as views of the column's own memory."""
    if not len(column):
        return []
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return [raw[a:b].view("<u8") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """One row per row: ``doc_id, node`` (a hash of the set), ``fp, n, hashes``."""
    slim = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))

    def of(batches):
        import xxhash

        for batch in batches:
            texts = batch.column(1)
            for part in _in_parts(range(batch.num_rows), lambda i: len(texts[i].as_buffer() or b"")):
                found = [shingle_set(texts[i].as_py(), words) for i in part]
                held = [s.tobytes() for s, _ in found]
                nodes = np.array([xxhash.xxh64_intdigest(b, SEED) for b in held], np.uint64).view(np.int64)
                prints = np.array([f for _, f in found], np.uint64).view(np.int64)
                columns = [batch.column(0).slice(part[0], len(part)), pa.array(nodes), pa.array(prints), pa.array(np.array([len(s) for s, _ in found], np.int32)), pa.array(held, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "fp", "n", "hashes"])
        tidy_all()

    return slim.mapInArrow(of, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, node long, fp long, n int, hashes binary")


def need(n):
    """Shingles that the prefixes of two similar sets share at least, by the size of the smaller."""
    return n // 20 + 1


def need_sql(n: str) -> str:
    return f"(floor({n} / 20) + 1)"


def _common(sets: DataFrame) -> np.ndarray:
    """Shingles that many sets hold, the most common last."""

    def shingles(batches):
        for batch in batches:
            for part in _in_parts(_binaries(batch.column(0)), len):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(part).view(np.int64))], names=["shingle"])
        tidy_all()

    seen = sets.filter(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0).select("hashes").mapInArrow(shingles, "shingle long")
    rows = seen.groupBy("shingle").count().filter(F.col("count") >= COMMON).orderBy(F.desc("count"), "shingle").limit(MOST).collect()
    return np.array([r["shingle"] for r in reversed(rows)], np.int64).view(np.uint64)


def prefix(hashes: np.ndarray, common: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, int]:
    """The first shingles of a set in the common order, and how many of the set are common; ``common`` sorted, ``places`` their order."""
    n = len(hashes)
    if not len(common):
        return hashes[: n // 5 + need(n)], 0
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    late = common[at] == hashes
    last = common[at[late]][np.argsort(places[at[late]])]
    return np.concatenate([hashes[~late], last])[: n // 5 + need(n)], len(last)


def _postings(sets: DataFrame) -> DataFrame:
    """(shingle, node, n, n_common, late, size, least): the prefixes in lists of two or more; ``late``: the shingle is common;
    ``size`` and ``least``: of the list, and its smallest node."""
    common = _common(sets)
    places = np.argsort(common)
    held = sets.sparkSession.sparkContext.broadcast((common[places], places))

    def of(batches):
        common, places = held.value
        for batch in batches:
            nodes, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            hashes = _binaries(batch.column(2))
            for part in _in_parts(range(batch.num_rows), lambda i: len(hashes[i])):
                own = [prefix(hashes[i], common, places) for i in part]
                times = [len(x) for x, _ in own]
                late = np.concatenate([np.arange(len(x)) >= n - c for n, (x, c) in zip(sizes[part], own, strict=True)])
                columns = [np.concatenate([x for x, _ in own]).view(np.int64), *(np.repeat(x, times) for x in (nodes[part], sizes[part], np.array([c for _, c in own], np.int32))), late]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["shingle", "node", "n", "n_common", "late"])
        tidy_all()

    lists = sets.select("node", "n", "hashes").mapInArrow(of, "shingle long, node long, n int, n_common int, late boolean")
    mine = Window.partitionBy("shingle")
    return staged(lists.withColumn("size", F.count("*").over(mine)).withColumn("least", F.min("node").over(mine)).filter("size > 1"), "postings")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets of shingles have similarity 4/5 or more."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 5 * both >= 4 * (len(x) + len(y) - both)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    pairs = staged(pairs, "candidates")
    asked = staged(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "asked")
    sets = sets.join(asked, "node", "left_semi")  # whole sets move only where a pair asks for them
    one = sets.select(F.col("node").alias("u"), F.col("hashes").alias("a"))
    other = sets.select(F.col("node").alias("v"), F.col("hashes").alias("b"))

    def of(batches):
        for batch in batches:
            good = [similar(x, y) for x, y in zip(_binaries(batch.column(2)), _binaries(batch.column(3)), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))
        tidy_all()

    return pairs.join(one, "u").join(other, "v").select("u", "v", "a", "b").mapInArrow(of, "u long, v long")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def similar_roots(sets: DataFrame) -> DataFrame:
    """(u, v): each node that is not the smallest of its class, with the smallest; ``sets``: node, fp, n, hashes, one row a node."""
    postings = _postings(sets)
    first = staged(sets.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    same = sets.select("node", "fp").join(first, "fp").select(F.col("node").alias("u"), F.col("first").alias("v"))
    near = links(first).toDF("fu", "fv").join(first.toDF("fu", "u"), "fu").join(first.toDF("fv", "v"), "fv").select("u", "v")
    stars = postings.filter(F.col("size") > LONG).select(F.col("node").alias("u"), F.col("least").alias("v"))
    close = staged(_verified(_ordered(same.unionByName(near).unionByName(stars)), sets), "close")
    roots = components(close)
    fits = "a.shingle = b.shingle and a.root <> b.root and 5 * a.n >= 4 * b.n and 5 * b.n >= 4 * a.n"
    fits += " and (not a.late or 9 * least(a.n_common, b.n_common) >= 4 * (a.n + b.n))"
    long = postings.filter(F.col("size") > LONG)
    for k, many in enumerate(HUBS):
        lists = staged(_owned(long, roots), "long")
        # nodes are dealt to as many parts by hash, the same in all lists; the best of each part is a hub
        best = F.struct((F.col("n") - F.col("n_common")).alias("rare"), "node", "n", "n_common", "root")
        part = F.pmod(F.xxhash64(F.lit(k), "node"), F.lit(many))
        hubs = lists.groupBy("shingle", part.alias("part")).agg(F.min(best).alias("h")).select("shingle", "h.node", "h.n", "h.n_common", "h.root")
        pairs = lists.alias("a").join(hubs.alias("b"), F.expr(fits)).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
        roots = components(roots.select("u", "v").unionByName(_verified(_ordered(pairs), sets)).distinct())
    owned = staged(_owned(postings, roots), "owned")
    fits += " and a.node > b.node"
    least_need = need_sql("least(a.n, b.n)")
    reach = " and ".join(f"floor({x}.n / 5) + {need_sql(x + '.n')} > {x}.n - {x}.n_common" for x in "ab")
    pairs = owned.alias("a").join(owned.alias("b"), F.expr(fits)).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"), F.col("a.root").alias("root_u"), F.col("b.root").alias("root_v"), F.expr(f"a.late or ({reach})").alias("sure"), F.expr(least_need).alias("least_need"))
    tallied = pairs.groupBy("u", "v", "root_u", "root_v").agg(F.count("*").alias("n"), F.max("sure").alias("sure"), F.max("least_need").alias("least_need"))
    tallied = staged(tallied.filter("sure or n >= least_need").select("u", "v", "n", "root_u", "root_v"), "tallied")
    # one text may share shingles with every member of a large class: a few pairs of two classes settle most of them
    classes = F.least("root_u", "root_v"), F.greatest("root_u", "root_v")
    best = tallied.withColumn("place", F.row_number().over(Window.partitionBy(*classes).orderBy(F.desc("n"), "u", "v")))
    tried = staged(best.filter(F.col("place") <= TRIED).select("u", "v"), "tried")
    roots = components(roots.unionByName(_verified(tried, sets)).distinct())
    rest = _between_classes(tallied, roots).join(tried, ["u", "v"], "left_anti")
    return components(roots.unionByName(_verified(rest.select("u", "v"), sets)).distinct())


def _owned(postings: DataFrame, roots: DataFrame) -> DataFrame:
    """The postings with the class of each node."""
    rows = postings.join(roots.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left")
    return rows.select("shingle", "node", "n", "n_common", "late", F.coalesce("root", "node").alias("root"))


def _between_classes(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """(u, v) of the ``pairs`` of nodes in different classes; ``root_u`` and ``root_v`` are the classes of before."""
    before = pairs.select("root_u", "root_v").distinct()  # classes once apart, few beside the pairs
    of = lambda x: roots.select(F.col("u").alias(f"root_{x}"), F.col("v").alias(f"now_{x}"))
    now = before.join(of("u"), "root_u", "left").join(of("v"), "root_v", "left")
    apart = now.filter("coalesce(now_u, root_u) <> coalesce(now_v, root_v)").select("root_u", "root_v")
    return pairs.join(apart, ["root_u", "root_v"], "left_semi").select("u", "v")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row per row: ``doc_id, component_id``."""
    table = shingle_sets(docs, id_col, text_col, words)
    table = staged(table.withColumn("row", F.monotonically_increasing_id()), "shingles")  # fixes the row numbers
    again = table.groupBy("node").agg(F.min("row").alias("least_row"), F.count("*").alias("times")).filter("times > 1").select("node", "least_row")
    sets = table.join(staged(again, "repeated"), "node", "left").filter("least_row is null or least_row = row").select("node", "fp", "n", "hashes")
    roots = similar_roots(sets).select(F.col("u").alias("node"), F.col("v").alias("root"))
    named = table.select("doc_id", "node").join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root"))
    named = staged(named, "named")
    drop_staged(table)
    class_id = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(class_id, "root").select("doc_id", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """The rows of ``docs`` whose id names their class, with all their columns."""
    found = near_copies(docs, id_col, text_col, words)
    key = fresh_name(docs, "kept_id")
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(key)), "left_semi")
