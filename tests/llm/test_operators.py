"""Each operator against a plain brute-force version, on edge cases and on the smallest tables."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from admeridian.llm import exact_dedup, mixing, oracles, packing, pii, quality, queries, sharding, simhash, token_counts, token_files, toxicity

os.environ["TOKENIZERS_PARALLELISM"] = "false"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BYTE, WORDPIECE = (Tokenizer.from_file(public_tokenizers.path(x)) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def rows_of(df, order=None):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module", params=["edge", "table"])
def docs(request, spark, sf_dir, edge_docs):
    return edge_docs if request.param == "edge" else spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def plain(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def key(x):
    return tuple((v is None, "" if v is None else v) for v in x)


def same(got, want):
    assert sorted(got, key=key) == sorted(want, key=key)


def test_packing(docs, plain):
    got = rows_of(packing.pack_documents(docs))
    want = []
    for i, t in plain:
        ids = np.array([*BYTE.encode(t, add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or min(2048, len(ids)), len(ids) + 1, 2048)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    same([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got], want)
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in got)
    assert len(by) <= 1.02 * total / 2048 + 2


def test_packing_plans_place_everything_once():
    rng = np.random.default_rng(3)
    for _ in range(20):
        cap = 64
        hist = {int(x): int(n) for x, n in zip(rng.choice(np.arange(9, 64), 12, replace=False), rng.integers(1, 40, 12))}
        plan = packing.plan_large(hist, cap, 5)
        used, slots = Counter(), set()
        for x, n in hist.items():
            seq, slot = plan.place(np.full(n, x), np.arange(n))
            for a, b in zip(seq, slot):
                used[a] += x
                assert (a, b) not in slots
                slots.add((a, b))
        assert max(used.values()) <= cap and len(used) == plan.n_sequences
        free = Counter(cap - v for v in used.values())
        small = {int(x): int(n) for x, n in zip(range(1, 9), rng.integers(0, 60, 8)) if n}
        places = packing.plan_small(small, free, cap)
        spots = defaultdict(list)
        for x, n in small.items():
            for s, o in zip(*places.place(np.full(n, x), np.arange(n))):
                spots[s].append((o, x))
        for s, parts in spots.items():
            at = cap - s // packing.CLASS
            for o, x in sorted(parts):
                assert o == at
                at += x
            assert at <= cap
            assert s // packing.CLASS == cap or s % packing.CLASS < free[s // packing.CLASS]


def test_quality(docs, plain):
    want = []
    for i, t in plain:
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        windows = Counter(zip(w, w[1:], w[2:]))
        cover = {j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)))
    table = quality.apply_policy(quality.ledger(docs), "base-v1")
    same([(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], not r["kept"]) for r in rows_of(table)], want)
    web = rows_of(quality.apply_policy(quality.ledger(docs), "web-v1").withColumn("sole", quality.sole_rule("web-v1")))
    same([(r["doc_id"], r["kept"], r["sole"]) for r in web], [(i, *brute_web(t)) for i, t in plain])
    mask = quality.policy_mask("web-v1")
    for r in rows_of(quality.ablation(quality.ledger(docs), "web-v1")):
        bit = 1 << [n for n, _ in quality.rules()].index(r["rule"])
        assert r["n_failed"] == sum(bool(x["failed_bits"] & bit) for x in web)
        assert r["n_failed_alone"] == sum(x["failed_bits"] & mask == bit for x in web)
        assert r["n_kept_without"] == sum(not x["failed_bits"] & mask & ~bit for x in web)


def brute_web(t):
    """Whether the whole policy keeps a text, and the rule that alone rejects it."""
    w = WORD.findall(t)
    chars, lines = sum(map(len, w)), [x for x in t.split("\n") if WORD.search(x)]
    windows = Counter(zip(w, w[1:], w[2:]))
    cover = {j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    upper, letters = sum("A" <= c <= "Z" for c in t), sum(c.isascii() and c.isalpha() for c in t)
    failed = {
        "few_words": len(w) < 50, "repeated_windows": 100 * len(cover) > 50 * len(w), "word_length": chars < 2 * len(w) or chars > 20 * len(w), "symbols": 10 * sum(c in "#*$%&|<>" for c in t) > len(w),
        "duplicate_lines": 2 * (len(lines) - len(set(lines))) > len(lines), "shouting": letters >= 20 and 10 * upper > 6 * letters, "exclamations": 10 * t.count("!") > 3 * len(w), "digits": 2 * sum(c in "0123456789" for c in t) > chars,
    }
    bad = [k for k, v in failed.items() if v]
    return not bad, bad[0] if len(bad) == 1 else None


def brute_fingerprint(text):
    w = WORD.findall(lower(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(prints):
    roots = {f: f for f in prints}

    def root(x):
        while roots[x] != x:
            x = roots[x]
        return x

    p = sorted(roots)
    for i, a in enumerate(p):
        for b in p[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                roots[root(b)] = root(a)
    return {x: root(x) for x in p}


def test_simhash(docs, plain):
    prints = [brute_fingerprint(t) for _, t in plain]
    roots = brute_components(prints)
    least = {}
    for (i, _), f in zip(plain, prints):
        if i is not None:
            least[roots[f]] = min(i, least.get(roots[f], i))
    got = simhash.near_duplicates(docs).select("doc_id", simhash.as_hex(simhash.F.col("fp")).alias("fingerprint"), "component_id")
    same([(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows_of(got)], [(i, f"{f:016x}", least.get(roots[f])) for (i, _), f in zip(plain, prints)])
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} <= set(least.values()) | {None}


@pytest.mark.parametrize("width", [1, 1 << 20, 1 << 30])
def test_simhash_index_at_every_width(spark, monkeypatch, width):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 20, np.uint64)
    prints = {0}
    for c in centres:
        x = int(c)
        for _ in range(30):
            x ^= 1 << int(rng.integers(0, 64)) | 1 << int(rng.integers(0, 64))
            prints.add(x)
    sets = simhash.byte_sets(width)
    monkeypatch.setattr(simhash, "byte_sets", lambda n: sets)
    monkeypatch.setattr(simhash, "LONG", 8)
    nodes = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in prints], "fp long").repartition(3)
    got = {int(np.int64(r["u"]).view(np.uint64)): int(np.int64(r["v"]).view(np.uint64)) for r in simhash.components(simhash.links(nodes)).collect()}
    want = brute_components(prints)
    groups = lambda roots: sorted(sorted(x for x in prints if roots.get(x, x) == r) for r in {roots.get(x, x) for x in prints})
    assert groups(got) == groups(want)


def test_probe_of_dense_lists():
    rng = np.random.default_rng(9)
    f = np.unique(rng.integers(0, 1 << 12, 300).astype(np.uint64))
    want = brute_components([int(x) for x in f])
    got = dict(simhash._probe(f, (1 << 24) - 1))
    assert all(got.get(a, a) == got.get(b, b) for a in want for b in want if want[a] == want[b])
    assert len({got.get(int(x), int(x)) for x in f}) == len(set(want.values()))


def brute_spans(t):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_personal_data(docs, plain):
    want = []
    for i, t in plain:
        spans = brute_spans(t) if len(t) < 45_000 else linear_spans(t)
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        n = Counter(k for _, k, _ in spans)
        want.append((i, n[0], n[1], n[2], n[3], hashlib.sha256(text.encode()).hexdigest()))
    got = [(r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in rows_of(pii.personal_data_digest(docs))]
    same(got, want)


def linear_spans(t):
    """The plain patterns are quadratic on very long runs: a pattern is tried only where a run of its characters starts and, where
    no match can start inside a run that failed, the rest of the run is left out."""
    out = []
    for run in re.finditer(r"[A-Za-z0-9._%+@-]+", t):  # an address lies within one such run
        if "@" in run[0]:
            out += [(run.start() + a, k, run.start() + b) for a, k, b in brute_spans_of(run[0], 0)]
    for run in re.finditer(r"[0-9.]+", t):
        if run[0].count(".") >= 3:
            out += [(run.start() + a, k, run.start() + b) for a, k, b in brute_spans_of(run[0], 1)]
    for k in (2, 3):
        out += brute_spans_of(t, k)
    return sorted(out)


def brute_spans_of(t, kind):
    if kind == 0:
        out, at = [], 0
        while (sign := t.find("@", at)) >= 0:
            start = sign
            while start > at and re.match(r"[A-Za-z0-9._%+-]", t[start - 1]):
                start -= 1
            tail = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+").match(t, sign + 1)
            if start < sign and tail:
                out.append((start, 0, tail.end()))
                at = tail.end()
            else:
                at = sign + 1
        return out
    return [s for s in brute_spans(t) if s[1] == kind]


def test_personal_data_guards_match_plain_patterns(spark):
    texts = ["a@b.c_d@e.f", "x@y.z..q@w.e-r", "1.2.3.4.5.6.7.8", "01.002.0003.255 256.1.1.1 1.1.1.0000255", "4111-1111 1111--1111 5500 0000 0000 0004", "+1+12345678 9-", "é+49 (30) 1234 5678.", "@", "a@b", "4111111111111111" * 3, "00000000000000 +123456789"]
    got = rows_of(pii.personal_data_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for r in got:
        assert r["spans"] == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in brute_spans(texts[r["doc_id"]])), texts[r["doc_id"]]


def test_personal_data_terms_and_sanitised_text(spark):
    rows = [(i, f"note {i} plain words here without any thing") for i in range(200)]
    rows += [(1000 + i, f"report owner Zephyrine mails z{i}@corp.example today") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows_of(pii.personal_data_digest(docs))}
    text = dict(rows)[1000]
    at = text.index("Zephyrine")
    assert f"term:{at}:{at + 9}" in got[1000]["spans"] and "email:" in got[1000]["spans"]
    assert all(not got[i]["spans"] for i in range(200))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert "Zephyrine" not in clean[1000] and "[EMAIL]" in clean[1000] and clean[5] == dict(rows)[5]


def test_toxicity(spark, sf_dir, docs, plain):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.model_of(toxicity.train(docs, labels))
    want = []
    for i, t in plain:
        keep = 1.0
        for sentence in re.split(r"[.!?\n]+", t.lower()):
            words = set(re.findall(r"[^\W\d_]+", sentence))
            known = words | {"4" + w[:4] for w in words if len(w) > 4} | {"5" + w[:5] for w in words if len(w) > 5}
            if sentence.strip():
                keep *= 1 - 1 / (1 + math.exp(-max(-30, min(30, model[""] + sum(model.get(w, 0) for w in known)))))
        keep *= 1 if t.strip(" \t\n\r\x0b\x0c.!?") else 1 - 1 / (1 + math.exp(-model[""]))
        want.append((i, zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0, 1 - keep))
    got = rows_of(toxicity.score_documents(docs, labels))
    for a, b in zip(sorted(((r["doc_id"], r["held_out"], r["score"]) for r in got), key=key), sorted(want, key=key), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_toxicity_learns_from_document_labels_and_finds_the_sentence(spark):
    rng = np.random.default_rng(1)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        sentences = [" ".join(rng.choice(words, 8)) for _ in range(10)]
        if bad:
            k = int(rng.integers(10))
            sentences[k] = f"{sentences[k]} {rng.choice(['vile', 'scum'])} {sentences[k]}"
        rows.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    held = [r for r in rows_of(toxicity.score_documents(docs, marks)) if r["held_out"]]
    assert len(held) > 80
    right = sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held)
    assert right >= 0.97 * len(held)
    assert all(re.search("vile|scum", r["worst"]) for r in held if r["predicted"] and r["doc_id"] % 4 == 0)
    kept = toxicity.without_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.count() < 480


def test_sharding(docs, plain):
    got = rows_of(sharding.shard_documents(docs))
    same([(r["doc_id"], r["size"], r["text_crc32"]) for r in got], [(i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in plain])
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    counts = [len(slots[s]) for s in range(24)]
    assert max(counts) - min(counts) <= 1
    again = [(r["doc_id"], r["size"], r["shard"], r["slot"]) for r in rows_of(sharding.shard_documents(docs.repartition(3)))]
    same(again, [(r["doc_id"], r["size"], r["shard"], r["slot"]) for r in got])


@pytest.mark.parametrize("n", [1, 2, 3, 24, 1000, 4097])
def test_permutation(n):
    p = sharding.permute(np.arange(n), n)
    assert sorted(p) == list(range(n))
    assert n < 24 or (p != np.arange(n)).any()


def brute_targets(sizes, share=1.5, cap=2.0):
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    left = share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > cap * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixing(docs):
    got = rows_of(mixing.mix_decisions(docs.select("doc_id", "text", "source")))
    sizes = Counter()
    for r in docs.select("text", "source").collect():
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    targets = brute_targets(sizes)
    for r in got:
        assert r["size"] == len(WORD.findall(r["text"] or "")) and r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - targets[r["source"]]) < 1e-6 * (1 + r["target"])
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert r["copies"] in (math.floor(rate + 1e-9), math.ceil(rate - 1e-9)) and r["copies"] <= 2
    of = {s: [r for r in got if r["source"] == s] for s in sizes}
    for source, rows in of.items():
        assert abs(sum(r["copies"] * r["size"] for r in rows) - targets[source]) <= 1.1 * max(r["size"] for r in rows)
    again = rows_of(mixing.mix_decisions(docs.select("doc_id", "text", "source").repartition(3)))
    same([(r["doc_id"], r["size"], r["copies"]) for r in again], [(r["doc_id"], r["size"], r["copies"]) for r in got])
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got)


def test_token_files(docs, plain):
    got = sorted(rows_of(token_files.stored_documents(docs, file_bytes=40_000)), key=lambda r: r["start"])
    at = 0
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    stored = Counter()
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        stored[r["doc_id"], r["n_tokens"], r["ids_crc32"]] += 1
    want = Counter()
    for i, t in plain:
        x = np.array([*WORDPIECE.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want[i, len(x), zlib.crc32(x.tobytes())] += 1
    assert stored == want


def test_perfect_hash():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 100, 3000):
        h = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        pilots, remap, slots = token_files.build_block(h)
        assert sorted(slots) == list(range(len(h)))
        assert (token_files.slots_of(h, len(h), pilots, remap) == slots).all()


def test_index_knows_foreign_keys(spark, edge_docs):
    files = token_files.write_files(edge_docs)
    keys = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (777_777, 0), (5, 0)], "doc_id long, ordinal int")
    assert sorted(r["doc_id"] for r in token_files.lookup(keys, files).collect()) == [0, 0, 5]


@pytest.mark.parametrize("chunk", [50, 1 << 16])
def test_token_counts(docs, plain, chunk):
    plain = [(i, t) for i, t in plain if chunk > 50 or len(t) < 60_000]
    rows = docs.filter("octet_length(text) < 60000 or text is null") if chunk == 50 else docs
    got = [(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows_of(token_counts.token_counts(rows, chunk=chunk))]
    plain = [(r["doc_id"], r["text"] or "") for r in rows.select("doc_id", "text").collect()]
    same(got, [(i, len(t.encode()), n, n > 1024) for i, t in plain for n in [len(BYTE.encode(t, add_special_tokens=False).ids)]])


@pytest.mark.parametrize("file, drops, width, library", [("byte_bpe_50k.json", False, 4, BYTE), ("word_bpe_49k.json", True, 2, WORDPIECE)])
def test_segments_agree_with_the_library(file, drops, width, library):
    from admeridian.llm.segments import SegmentEncoder

    own = SegmentEncoder(public_tokenizers.path(file), drops, width)
    rng = np.random.default_rng(8)
    texts = [t for c in [*range(0x300), *range(0x1680, 0x1690), *range(0x2000, 0x2070), 0x3000, 0xFEFF, 0x180E] for t in (f"ab{chr(c)}cd", f"ab {chr(c)}{chr(c)} Cd", chr(c), f"x{chr(c)}<|endoftext|>{chr(c)}", f"'S{chr(c)}'ll")]
    letters = "aaeeiioouutnrsldABCéßñü'.,!?-_0123456789 \n\t"
    texts += ["".join(rng.choice(list(letters), rng.integers(1, 80))) for _ in range(4000)]
    for t in texts:
        assert list(np.frombuffer(own.encode(t), f"<u{width}")) == library.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("file, drops, width, library", [("byte_bpe_50k.json", False, 4, BYTE), ("word_bpe_49k.json", True, 2, WORDPIECE)])
def test_segments_agree_with_the_library_on_whole_documents(spark, sf_dir, file, drops, width, library):
    from admeridian.llm.segments import SegmentEncoder

    own = SegmentEncoder(public_tokenizers.path(file), drops, width)
    for r in spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").select("text").collect():
        t = r["text"] or ""
        assert list(np.frombuffer(own.encode(t), f"<u{width}")) == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("file, drops, width, library", [("byte_bpe_50k.json", False, 4, BYTE), ("word_bpe_49k.json", True, 2, WORDPIECE)])
def test_segments_merge_a_frequent_word_once(file, drops, width, library):
    from admeridian.llm.segments import SegmentEncoder

    own = SegmentEncoder(public_tokenizers.path(file), drops, width, memo=40)
    merge, merged = own.merge, Counter()

    def counted(word):
        merged[word] += 1
        return merge(word)

    own.merge = counted
    for i in range(300):
        text = f" often, often. often; often-often{i} x{chr(97 + i % 26)}{chr(97 + i // 26)}"
        assert list(np.frombuffer(own.encode(text), f"<u{width}")) == library.encode(text, add_special_tokens=False).ids
    # whatever stands beside it, and however many other words have come
    assert max(n for word, n in merged.items() if b"often" in word) == 1


def test_tokens_side_by_side():
    machine = token_counts.transducer(*token_counts.default_tokenizer())
    rng, ids = np.random.default_rng(4), sorted(machine.whole)
    common = ids[:3000]
    for a, b in [*rng.choice(ids, (3000, 2)), *rng.choice(common, (6000, 2))]:
        x, y = machine.bytes_of[int(a)], machine.bytes_of[int(b)]
        assert machine._stay(int(a), int(b)) == (machine._merged(x + y) == [x, y]), (x, y)


def test_exact_dedup(docs, plain):
    groups = defaultdict(list)
    for i, t in plain:
        groups[lower(t)].append(i)
    best = {g: max((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    got = rows_of(exact_dedup.dedup_decisions(docs))
    same([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], [(i, best[lower(t)], len(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in plain])
    for r in got:
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert sum(r["kept"] for r in got) == len(groups)
    for share in (0.001, 0.2):
        kept = exact_dedup.exact_dedup(docs, min_share=share)
        assert kept.columns == docs.columns
        same([(lower(r["text"] or ""), r["doc_id"]) for r in kept.collect()], list(best.items()))


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_oracles(spark, sf_dir, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(oracles.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, sf_dir).toPandas()
    order = sorted(want.columns)
    assert sorted(got.columns) == order and len(got) == len(want)
    got, want = (x[order].sort_values(order).reset_index(drop=True) for x in (got, want))
    for c in order:
        assert ((got[c] - want[c]).abs() < 1e-6).all() if got[c].dtype == float else (got[c] == want[c]).all()


def test_empty_tables(spark, sf_dir, empty_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    frames = [
        packing.pack_documents(empty_docs), quality.ledger(empty_docs), simhash.near_duplicates(empty_docs), simhash.near_dedup(empty_docs),
        pii.personal_data_digest(empty_docs), pii.sanitised(empty_docs), toxicity.score_documents(empty_docs, labels), sharding.shard_documents(empty_docs),
        mixing.mix_decisions(empty_docs), mixing.mix(empty_docs), token_files.stored_documents(empty_docs), token_counts.token_counts(empty_docs),
        exact_dedup.dedup_decisions(empty_docs), exact_dedup.exact_dedup(empty_docs),
    ]
    for df in frames:
        assert df.collect() == []
