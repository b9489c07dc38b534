"""The stages of the corpus pipeline, each against what it must do to its own input."""

from collections import Counter

import corpus_pipeline
from admeridian.llm import exact_dedup, toxicity
from tests.llm.test_near_copies import brute_kept
from tests.llm.test_operators import lower


def test_stages(spark, sf_dir):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "SimHash near-dedup", "mixing", "best-fit packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "best-fit packing":
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.toPandas(), out.schema)
        tables.append(docs.toPandas())
    start, clean, exact, near, mixed, packed = tables
    scores = toxicity.score_documents(spark.createDataFrame(start), spark.read.parquet(f"{sf_dir}/labels.parquet")).toPandas()
    assert set(clean.doc_id) == set(scores.doc_id[scores.predicted == 0])
    assert set(exact.doc_id) == set(clean.assign(key=clean.text.map(lower)).groupby("key").doc_id.max())
    assert set(near.doc_id) == brute_kept(list(zip(exact.doc_id, exact.text)))
    assert set(mixed.doc_id) <= set(near.doc_id) and max(Counter(mixed.doc_id).values()) <= 2
    firsts = packed[packed.piece == 0]
    assert Counter(firsts.doc_id) == Counter(mixed.doc_id)


def test_stages_on_edge_rows(spark, sf_dir, edge_docs, empty_docs):
    """Nulls, empty texts, repeated rows and columns with clashing names go through every stage."""
    for start in (edge_docs, empty_docs):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            if name == "best-fit packing":
                assert (out.count() > 0) == (start is edge_docs)
            else:
                assert out.columns == docs.columns
                docs = spark.createDataFrame(out.collect(), out.schema)
    assert docs.columns == edge_docs.columns


def test_run_leaves_tables_of_others_alone(spark, sf_dir):
    earlier = exact_dedup.dedup_decisions(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    before = earlier.count()
    corpus_pipeline.run(spark, sf_dir).count()
    assert earlier.count() == before > 0


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    parts = got.sort_values(["sequence_id", "offset"])
    begins = parts.groupby("sequence_id")["length"].cumsum() - parts["length"]
    assert len(got) and (begins == parts["offset"]).all() and parts.groupby("sequence_id")["length"].sum().max() <= 2048
