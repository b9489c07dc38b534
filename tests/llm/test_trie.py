"""The trie of conversation prefixes against a dictionary of all prefixes."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from admeridian.llm import ranking, trie
from tests.llm.test_operators import rows_of


def brute(rows):
    convs = defaultdict(list)
    for c, n, r, x in rows:
        if c is not None:
            convs[c].append((n is not None, n or 0, trie_id(r or "", x or ""), r or "", x or ""))
    turns = {c: [t[3:] for t in sorted(v)] for c, v in convs.items()}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = turns.get(c - c % 5, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    kids, leaves, saved = Counter(k[:-1] for k in members if k), Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
            leaves[k[:d]] += not kids[k]
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], sha(c for c in m if len(paths[c]) == len(k))) for k, m in members.items())


def trie_id(role, text):
    whole = f"{len(role.encode())}:{role}{text}"
    return hashlib.sha256(whole.encode()).hexdigest()[:32]


def got(df):
    return sorted((tuple(r.values()) for r in rows_of(trie.prefix_trie(df))), key=lambda r: r[:2])


def test_tables(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert got(table) == brute([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize("most", [100_000, 5])
def test_long_shared_and_odd_conversations(spark, monkeypatch, most):
    """Conversations over several blocks, equal ones, missing first ones, turnless ones, nulls and ties; keys over and under the
    length that one window numbers."""
    for module in (trie,):
        monkeypatch.setattr(module, "in_order", lambda *a, **k: ranking.in_order(*a, **k, most=most))
    monkeypatch.setattr(trie, "CHUNK", 3)
    rng = random.Random(4)
    rows = []
    for c in [*range(60), 1001, 1002, 5003, 77777]:
        base = rng.randrange(3)
        for k in range(rng.choice([1, 2, 3, 8, 9, 16, 17, 40]) if c % 7 else 25):
            rows.append((c, k, "user" if k % 2 else "assistant", f"é{base} {min(k, 30)}" if rng.random() < 0.97 else rng.choice(["", None])))
    rows += [(3, None, None, None), (3, None, None, None), (4, 0, "user", "tie"), (4, 0, "user", "eit"), (None, 0, "user", "nobody")]
    rows += [(c, 0, "user", "alike") for c in range(200, 240)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, place int, block string").repartition(6)
    assert got(table) == brute(rows)


def test_empty_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").limit(0)
    assert got(table) == [] and len(trie.prefix_trie(table).columns) == 8


def test_numbers_and_sums_by_ranges(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, 1, 1, 1, 2]), rng.choice([None, *range(40)]), rng.randrange(9)) for _ in range(500)]
    df = spark.createDataFrame(rows, "k long, o long, v long").repartition(5)
    for most in (1000, 10):
        seen = defaultdict(list)
        for r in rows_of(ranking.in_order(df, ["k"], ["o", "v"], "at", {"sum": "v"}, most)):
            seen[r["k"]].append((r["at"], r["o"], r["v"], r["sum"]))
        for k, own in seen.items():
            want = sorted(((o, v) for key, o, v in rows if key == k), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
            assert [(o, v) for _, o, v, _ in sorted(own)] == want and [a for a, *_ in sorted(own)] == list(range(len(want)))
            assert [s for *_, s in sorted(own)] == [sum(v for _, v in want[:i]) for i in range(len(want))]
