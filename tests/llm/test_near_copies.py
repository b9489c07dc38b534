"""The pipeline's near-dedup stage against brute-force similarity of five-word shingles."""

import random
from fractions import Fraction

import corpus_pipeline
import pytest

from admeridian.llm import near_copies, simhash
from tests.llm.test_operators import WORD, key, lower


def brute_kept(rows):
    """Ids that name a class, under links of similarity 4/5 or more."""

    def shingles(text):
        w = WORD.findall(lower(text or ""))
        return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    held = {}
    for i, text in rows:
        held.setdefault(shingles(text), []).append(i)
    sets = list(held)
    root = {s: s for s in sets}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for k, a in enumerate(sets):
        for b in sets[:k]:
            if a and b and Fraction(len(a & b), len(a | b)) >= Fraction(4, 5):
                root[find(a)] = find(b)
    classes = {}
    for s in sets:
        classes.setdefault(id(find(s)), []).extend(held[s])
    return {min((i for i in ids if i is not None), default=None) for ids in classes.values()}


def reworded():
    """Copies with a few changed words at all similarities about 4/5, a common passage, and a large group of near copies."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    passage = [word() for _ in range(60)]
    rows = []
    for _ in range(60):
        base = [word() for _ in range(rng.choice([1, 4, 6, 30, 120, 400]))] + (passage if rng.random() < 0.4 else [])
        rows.append(base)
        for _ in range(3):
            copy = list(base)
            for _ in range(max(1, round(len(base) * rng.uniform(0.005, 0.05)))):
                copy[rng.randrange(len(copy))] = word()
            rows.append(copy)
    base = [word() for _ in range(200)]
    for k in range(150):
        rows.append(base[:k] + [word()] + base[k + 1 :])
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("long, common, few", [(64, 4, 1 << 17), (4, 1, 0), (64, 10**9, 100)])
def test_stage_keeps_one_of_each_similar_class(spark, sf_dir, monkeypatch, long, common, few):
    monkeypatch.setattr(simhash, "FEW", few)
    monkeypatch.setattr(near_copies, "LONG", long)
    monkeypatch.setattr(near_copies, "COMMON", common)
    rows = reworded()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = corpus_pipeline.drop_near_copies(spark, docs, sf_dir)
    assert {r["doc_id"] for r in got.collect()} == brute_kept(rows)


def test_stage_on_edge_rows_and_tables(spark, sf_dir, edge_docs, empty_docs):
    for docs in (edge_docs, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        kept = corpus_pipeline.drop_near_copies(spark, docs, sf_dir)
        assert kept.columns == docs.columns
        want = brute_kept([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
        assert sorted({(r["doc_id"],) for r in kept.collect()}, key=key) == sorted({(i,) for i in want}, key=key)
    assert corpus_pipeline.drop_near_copies(spark, empty_docs, sf_dir).collect() == []
