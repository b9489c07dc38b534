"""Ids of any type, equal hashes, very long texts without white space, clashing columns."""

import random
import zlib

import numpy as np
import pytest

from admeridian.llm import exact_dedup, mixing, near_copies, packing, pii, quality, sharding, simhash, token_counts, token_files, toxicity
from tests.llm.test_operators import BYTE, WORDPIECE, rows_of


@pytest.fixture(scope="module")
def named_docs(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = [" ".join(word() for _ in range(n)) for n in (3, 60, 200, 60)]
    rows = [("1", texts[0], "s"), ("2", texts[1], "s"), (None, texts[2], None), ("null", texts[3], "s"), (None, texts[2], None), ("b", None, "s"), ("long", texts[2] * 120, "t")]
    return spark.createDataFrame(rows, "doc_id string, text string, source string").repartition(3)


def test_ids_keep_their_type(spark, named_docs):
    labels = spark.createDataFrame([("1", 1), ("2", 0), ("b", 1), ("long", 0)], "doc_id string, toxic int")
    frames = [
        packing.pack_documents(named_docs), quality.ledger(named_docs), simhash.near_duplicates(named_docs), near_copies.near_copies(named_docs), pii.personal_data_digest(named_docs), toxicity.score_documents(named_docs, labels),
        sharding.shard_documents(named_docs), mixing.mix_decisions(named_docs), token_files.stored_documents(named_docs), token_counts.token_counts(named_docs), exact_dedup.dedup_decisions(named_docs),
    ]
    for df in frames:
        assert dict(df.dtypes)["doc_id"] == "string"
        assert {r["doc_id"] for r in df.select("doc_id").collect()} == {"1", "2", None, "null", "b", "long"}


def test_token_files_tell_null_from_its_name(named_docs):
    got = sorted((r["doc_id"] or "", r["n_tokens"], r["ids_crc32"]) for r in rows_of(token_files.stored_documents(named_docs, file_bytes=500)))
    want = []
    for r in named_docs.collect():
        ids = np.array([*WORDPIECE.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r["doc_id"] or "", len(ids), zlib.crc32(ids.tobytes())))
    assert got == sorted(want)


def test_keys_with_equal_hashes_are_listed(spark, named_docs, monkeypatch):
    own = token_files._hashed

    def crowded(keys, blocks):
        return own(keys, blocks).withColumn("h", simhash.F.col("h") % 2).withColumn("mark", simhash.F.lit(5).cast("long")).withColumn("block", simhash.F.lit(0))

    monkeypatch.setattr(token_files, "_hashed", crowded)
    files = token_files.write_files(named_docs)
    found = rows_of(token_files.lookup(files.entries.select("doc_id", "ordinal"), files))
    assert sorted((r["start"], r["n_tokens"]) for r in found) == sorted((r["start"], r["n_tokens"]) for r in rows_of(files.entries)) and len(found) == 7


@pytest.mark.parametrize("file_bytes", [1, 100, 1 << 20])
def test_ordinals_over_many_files(spark, file_bytes):
    rows = [(i if i % 3 else None, "x" * (i % 5)) for i in range(60)] + [(7, "again")] * 20
    files = token_files.write_files(spark.createDataFrame(rows, "doc_id long, text string"), file_bytes=file_bytes)
    seen = {}
    for r in sorted(rows_of(files.entries), key=lambda r: (r["shard"], r["start"])):
        assert r["ordinal"] == seen.get(r["doc_id"], 0)
        seen[r["doc_id"]] = r["ordinal"] + 1
    assert seen[None] == 20 and seen[7] == 21


def test_counts_of_long_unbroken_texts(spark):
    rng = random.Random(5)
    texts = ["a" * 5_000_000, "".join(rng.choice("abcdefghij") for _ in range(300_000)), "".join(rng.choice("ab1,'s<|é漢字。") for _ in range(200_000)), "ab12" * 50_000 + "<|endoftext|>" + "-" * 70_000, " " * 100_000 + "x"]
    got = {r["doc_id"]: r["n_tokens"] for r in rows_of(token_counts.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")))}
    assert got == {i: len(BYTE.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(i, i % 7, "x", 1) for i in range(50)], "number int, length int, before string, shard int").filter("length > 0")
    out = sharding.shards_of(rows, ["number"], 5)
    assert out.columns == [*rows.columns, "_shard", "slot"] and {(r["before"], r["shard"]) for r in out.collect()} == {("x", 1)}
    pieces = rows.withColumnsRenamed({"before": "to", "shard": "room"}).withColumn("slot", simhash.F.lit("s"))
    packed = packing.pack(pieces, capacity=16, small=4, groups=3)
    assert packed.columns == [*pieces.columns, "sequence_id", "offset"] and packed.count() == pieces.count()


def test_toxicity_fit_does_not_depend_on_the_order_of_rows(spark):
    rows = [(i % 90, f"plain words {'vile ' * (i % 90 % 3 == 0)}and {i}") for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    models = [toxicity.model_of(toxicity.train(spark.createDataFrame(r, "doc_id long, text string").repartition(k), labels)) for r, k in ((rows, 1), (rows[::-1], 5))]
    assert models[0].keys() == models[1].keys() and all(abs(models[0][k] - models[1][k]) < 1e-9 for k in models[0])
