"""Ranked lexical search against a plain loop over all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from admeridian.llm import search
from tests.llm.test_operators import lower, rows_of

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute(docs, items, top=10):
    counts = [(i, Counter(TERM.findall(lower(t or "")))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, all_terms = len(counts), sum(c.total() for _, c in counts)
    df = Counter(x for _, c in counts for x in c)
    out = []
    for item, text in items:
        asked = Counter(TERM.findall(lower(text or "")))
        found = []
        for i, c in counts:
            m = 25 + 75 * c.total() * n_docs // all_terms
            score = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * c[x] // (1000 * c[x] + 8 * m)) for x, n in asked.items() if c[x])
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, k, i, -s) for k, (s, _, i) in enumerate(sorted(found)[:top], 1)]
    return out


def got(docs, items, **more):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows_of(search.search(docs, items, **more))), key=repr)


def plain(df, key):
    return [(r[key], r["text"]) for r in df.collect()]


def test_tables(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "benchmark"))
    assert got(docs, items) == sorted(brute(plain(docs, "doc_id"), plain(items, "item_id")), key=repr)


@pytest.mark.parametrize("block_items, block_terms, cells", [(4096, 1 << 16, 1 << 21), (2, 1 << 16, 1), (4096, 5, 1 << 10)])
def test_edges(spark, edge_docs, monkeypatch, block_items, block_terms, cells):
    """Blocks of any size, nulls, repeated words and rows, ties, clashing columns; small parts of long texts."""
    for name, value in (("BLOCK_ITEMS", block_items), ("BLOCK_TERMS", block_terms), ("CELLS", cells), ("PART", 100)):
        monkeypatch.setattr(search, name, value)
    rows = [(1, "The of lantern, the gravel!"), (2, None), (3, ""), (None, "orchid pewter the THE the"), (4, "İß é s ﬁ"), (5, "absent"), (6, "the of lantern the gravel orchid"), (6, "the of lantern the gravel orchid"), (7, "7 bc 415 " + "lantern girder " * 40)]
    items = spark.createDataFrame([(*r, 1, "x") for r in rows], "item_id long, text string, rank int, doc_id string")
    want = brute([(r["doc_id"], r["text"]) for r in edge_docs.select("doc_id", "text").collect()], rows)
    assert got(edge_docs, items) == sorted(want, key=repr) and len(want) > 30
    assert got(edge_docs, items, top=3) == sorted(brute([(r["doc_id"], r["text"]) for r in edge_docs.select("doc_id", "text").collect()], rows, 3), key=repr)


def test_empty_tables_and_other_ids(spark, empty_docs, edge_docs):
    items = spark.createDataFrame([("a", "lantern gravel")], "item_id string, text string")
    assert got(empty_docs, items) == [] and got(edge_docs, items.limit(0)) == [] and search.search(empty_docs, items).columns == ["item_id", "rank", "doc_id", "score"]
    docs = spark.createDataFrame([("x", "lantern"), (None, "lantern"), ("b", "gravel lantern")], "doc_id string, text string")
    assert got(docs, items) == sorted(brute(plain(docs, "doc_id"), plain(items, "item_id")), key=repr)


def test_many_copies_tie_by_id(spark):
    docs = spark.createDataFrame([(i * 7919 % 3001, "amber lantern" if i % 3 else f"word{i}") for i in range(3001)], "doc_id long, text string").repartition(7)
    items = spark.createDataFrame([(1, "lantern amber")], "item_id int, text string")
    assert got(docs, items) == sorted(brute(plain(docs, "doc_id"), plain(items, "item_id")), key=repr)


def test_dag_sums_and_shares():
    rng = random.Random(2)
    for window in (2, 64):
        search.WINDOW, usual = window, search.WINDOW
        items = [{t: rng.choice([1, 1, 1, 3]) for t in rng.sample(range(40), rng.randint(1, 25))} for _ in range(30)]
        dag = search.sharing_dag(items, 40)
        search.WINDOW = usual
        values = np.array([[rng.randrange(10**6) for _ in range(5)] for _ in range(40)])
        want = np.array([sum(values[t] * n for t, n in own.items()) for own in items])
        assert (search.scores(dag, values) == want).all()
        assert dag.additions() < sum(sum(own.values()) - 1 for own in items)
    same = [{1: 1, 2: 1, 3: 2}] * 8
    assert search.sharing_dag(same, 4).additions() == 3  # worked out once for all
