"""Chat formatting: exact round trips, spans against what was put in, templates that rewrite history."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from admeridian.llm import chat
from tests.llm.test_operators import rows_of

HARD = st.lists(st.sampled_from([*"<>s/[]\\ \n\x01\x02aé", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "INST]", "SYS>>", "<\\"]), max_size=12).map("".join)
TURNS = st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), HARD), HARD), max_size=7)


@settings(max_examples=400, deadline=None)
@given(HARD)
def test_escapes_round_trip(text):
    out = chat.escaped(text)
    assert chat.unescaped(out) == text and not any(c in out for c in chat.CONTROL)
    if not any(c[0] + "\\" * k + c[1:] in text for c in chat.CONTROL for k in range(9)):
        assert out == text


@settings(max_examples=400, deadline=None)
@given(TURNS)
def test_spans_and_reading_back(turns):
    (s,) = chat.samples(chat.INST, turns)
    assert s.exact and not s.rewrites and list(chat.read_inst(s.formatted)) == turns
    assert [chat.unescaped(s.formatted[a:b]) for a, b in s.loss] == [t for r, t in turns if r == "assistant"]
    assert "".join(s.formatted[a:b] for a, b in s.spans) == s.formatted[3:]
    whole = [list(chat.read_inst("<s>" + s.formatted[a:b])) for a, b in s.spans]
    assert whole == [[t] for t in turns]


def test_rewritten_history_gives_a_sample_per_turn():
    turns = [("user", "a"), ("assistant", "<think>x</think>one"), ("user", "b"), ("assistant", "<think>y</think>two"), ("user", "c")]
    found = chat.samples(chat.Template("latest", chat.latest_reasoning), turns)
    assert all(s.rewrites for s in found) and [s.n_turns for s in found] == [2, 4, 5]
    assert [[s.formatted[a:b] for a, b in s.loss] for s in found] == [["<think>x</think>one"], ["<think>y</think>two"], []]
    assert "x" not in found[1].formatted and all(s.exact for s in found)
    plain = [("user", "a"), ("assistant", "one"), ("user", "b")]
    assert [s.rewrites for s in chat.samples(chat.Template("latest", chat.latest_reasoning), plain)] == [False]


def test_a_template_that_changes_texts_is_told():
    loud = chat.Template("loud", lambda turns: "".join(f"{r}: {t.upper()}\n" for r, t in turns))
    assert [s.exact for s in chat.samples(loud, [("user", "a"), ("assistant", "Bc")])] == [False]


def digest(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def brute(rows):
    convs = {}
    for c, n, r, t in rows:
        convs.setdefault(c, []).append((n is not None, n or 0, r or "", t or ""))
    return {c: digest([(r, t) for _, _, r, t in sorted(v)]) for c, v in convs.items()}


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, None, "system", "first"), (1, 1, "assistant", "</s>[INST] ok [/INST]"),
    (2, 5, None, None), (2, 5, "assistant", None), (None, 1, "user", "no id"), (None, 0, "assistant", "\\<\\s>"), (3, 0, "tool</s>", "x" * 50_000), (3, 1, "assistant", "y" * 300_000), (-1, 0, "user", "kept apart"),
]


@pytest.mark.parametrize("turns, chars, most", [(64, 1 << 24, 100_000), (64, 10, 100_000), (3, 1 << 24, 100_000), (2, 30, 4)])
def test_tables(spark, monkeypatch, turns, chars, most):
    from admeridian.llm import ranking

    monkeypatch.setattr(chat, "TURNS", turns)
    monkeypatch.setattr(chat, "CHARS", chars)
    monkeypatch.setattr(chat, "in_order", lambda *a: ranking.in_order(*a, most=most))
    rows = ROWS + [(9, k % 50, "assistant" if k % 2 else "user", f"t{k} " * 5) for k in range(200)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, segment int, whole string").repartition(5)
    out = chat.format_conversations(table)
    assert all(r["exact"] and not r["rewrites"] for r in rows_of(out))
    got = rows_of(chat.digests(out))
    assert len(got) == len({r[0] for r in rows})
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == brute(rows)
    assert {r["conv_id"]: r["formatted_chars"] for r in got} == {k: sum(len(r["formatted"]) for r in rows_of(out) if r["conv_id"] == k) for k in {r[0] for r in rows}}


def test_query_and_empty_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = rows_of(chat.digests(chat.format_conversations(chat.with_hostile(table))))
    want = brute([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    want[-1] = digest([("user", chat.HOSTILE), ("assistant", chat.HOSTILE)])
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == want
    assert rows_of(chat.digests(chat.format_conversations(table.limit(0)))) == []
