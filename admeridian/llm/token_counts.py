"""Token counts by a compiled finite-state tokenizer.

``TokenTransducer`` compiles a byte-level BPE vocabulary into a deterministic transducer over bytes: an Aho-Corasick machine
names the vocabulary entries that end at each byte, and the state inside a pretoken adds the last tokens of the prefixes read
so far; reading a byte moves to the next state and emits the change of the token count. (The last token of a prefix is the
one entry that ends there and that BPE leaves beside the last token of what precedes it; every prefix has exactly one.)
Between pretokens the machine is back in its start state; paths from start to start are kept as macro transitions with their
emitted counts.

A long text is cut into chunks of ``CHUNK`` characters, wherever that falls, in one pass over it. Each chunk gives a map of
states: what it does to the pending fragment it is entered with (``head``), what it emits by itself, and the fragment it leaves
pending (``tail``). A fragment reaches to the next place at which every pretoken ends, whatever came before: in front of white
space, and where a run of letters or of digits ends. These maps are associative; each level of a tree composes ``FAN`` neighbours,
by groups of (row, chunk number / FAN), so no task ever meets all chunks of a text. Only a run of one class of characters that
is longer than a chunk is carried as text; the machine reads it in one go, in time linear in its length.

Defined results: a null text counts as empty and has 0 tokens; strings of special tokens inside a text count as the one token
the library makes of them; repeated rows are counted alike; an empty table gives an empty table; ids may be null and of any
type, which they keep.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admeridian.llm.common import drop_staged, staged, text_or_empty
from admeridian.llm.segments import SEGMENT, WHITE, byte_of_char

#: Characters of a chunk, the token limit, entries of a memo, chunk maps that one task composes.
CHUNK, LIMIT, MEMO, FAN, NEVER = 1 << 16, 1024, 400_000, 16, 1 << 60


class TokenTransducer:
    def __init__(self, path: str, pattern: str, memo: int = MEMO):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        chars = byte_of_char()
        self.special = [x["content"] for x in model["added_tokens"]]
        as_bytes = lambda token: bytes(chars[c] for c in token)
        self.ids = {as_bytes(t): i for t, i in model["model"]["vocab"].items() if t not in self.special}
        self.bytes_of = {i: b for b, i in self.ids.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        self.rank = {(as_bytes(a), as_bytes(b)): r for r, (a, b) in enumerate(pairs)}
        self.machine = ahocorasick.Automaton()
        for b, i in self.ids.items():
            self.machine.add_word(b.decode("latin-1"), i)
        self.machine.make_automaton()
        self.size = {i: len(b) for b, i in self.ids.items()}
        self.pretokens = regex.compile(pattern).findall
        # where every pretoken ends; the characters of special strings other than letters are left out
        marks = regex.escape("".join(sorted({c for x in self.special for c in x if not c.isalnum()})) or " ")
        self.resets = regex.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])|(?<=\\p{{L}})(?=[^\\p{{L}}{marks}])|(?<=\\p{{N}})(?=[^\\p{{N}}{marks}])").finditer
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else None
        self.beside: dict[int, bool] = {}
        self.spines: dict[int, tuple[list, list]] = {}
        self.macro: dict[str, int] = {}
        self.paths: dict[str, int] = {}
        self.limit = memo
        self.whole = {i for b, i in self.ids.items() if self._merged(b) == [b]}

    def _merged(self, word: bytes) -> list[bytes]:
        """Plain BPE; only applied to vocabulary entries, at compile time."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min((self.rank.get(p, NEVER), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == NEVER:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _spines(self, token: int) -> tuple[list, list]:
        """The first and the last parts of a token while BPE builds it, each with the rank of the merge that absorbs it."""
        known = self.spines.get(token)
        if known is None:
            word = self.bytes_of[token]
            parts = [word[i : i + 1] for i in range(len(word))]
            first, last = [], []
            while len(parts) > 1:
                rank, i = min((self.rank.get(p, NEVER), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
                if rank == NEVER:
                    break
                if i == 0:
                    first.append((parts[0], rank))
                if i == len(parts) - 2:
                    last.append((parts[-1], rank))
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            known = self.spines[token] = ([*first, (parts[0], NEVER)], [*last, (parts[-1], NEVER)])
        return known

    def _stay(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens side by side: no merge across the seam comes before those beside it."""
        if len(self.beside) > 8 * self.limit:
            self.beside.clear()
        rank, known = self.rank.get, True
        for a, a_gone in self._spines(left)[1]:
            for b, b_gone in self._spines(right)[0]:
                r = rank((a, b))
                if r is not None and r < a_gone and r <= b_gone:
                    known = False
        self.beside[left << 20 | right] = known
        return known

    def path(self, word: bytes) -> int:
        """Runs the machine over one pretoken; the emitted count. Entries that end at a byte come longest first."""
        last, count = [-1] * (len(word) + 1), [0] * (len(word) + 1)
        size, whole, beside, found = self.size, self.whole, self.beside, -1
        for end, token in self.machine.iter(word.decode("latin-1")):
            if end != found:
                start = end + 1 - size[token]
                if start:
                    good = beside.get(last[start] << 20 | token)
                    if good is None:
                        good = self._stay(last[start], token)
                else:
                    good = token in whole
                if good:
                    found = end
                    last[end + 1] = token
                    count[end + 1] = count[start] + 1
        return count[-1]

    def _plain(self, text: str) -> int:
        total = 0
        for word in self.pretokens(text):
            n = self.paths.get(word)
            if n is None:
                if len(self.paths) > self.limit:
                    self.paths.clear()
                n = self.path(word.encode("utf-8", "surrogatepass"))
                if len(word) < 64:
                    self.paths[word] = n
            total += n
        return total

    def fragment(self, text: str) -> int:
        """The count of a text that is entered in, and left in, the start state."""
        if not text:
            return 0
        if not self.special_split or not any(s in text for s in self.special):
            return self._plain(text)
        return sum(1 if i % 2 else self._plain(part) for i, part in enumerate(self.special_split(text)) if part)

    def count(self, text: str) -> int:
        pieces = SEGMENT.findall(text)
        try:
            return sum(map(self.macro.__getitem__, pieces))
        except KeyError:
            total, macro = 0, self.macro
            for piece in pieces:
                n = macro.get(piece)
                if n is None:
                    if len(macro) > self.limit:
                        macro.clear()
                    n = self.fragment(piece)
                    if len(piece) < 64:
                        macro[piece] = n
                total += n
            return total

    def chunk_map(self, text: str) -> tuple[str, int, str, bool]:
        """(head, count, tail, resets): without a reset the whole chunk stays pending, as its head."""
        places = [m.start() for m in self.resets(text)]
        if not places:
            return text, 0, "", False
        return text[: places[0]], self.count(text[places[0] : places[-1]]), text[places[-1] :], True

    def combine(self, a: tuple, b: tuple) -> tuple:
        """The map of ``a`` followed by ``b``; associative."""
        if not b[3]:
            return (a[0], a[1], a[2] + b[0], True) if a[3] else (a[0] + b[0], 0, "", False)
        if not a[3]:
            return a[0] + b[0], b[1], b[2], True
        return a[0], a[1] + self.count(a[2] + b[0]) + b[1], b[2], True

    def emitted(self, m: tuple) -> int:
        """The count of a whole text, entered in the start state."""
        return self.count(m[0]) + m[1] + self.count(m[2])

    def scan(self, maps: list[tuple]) -> tuple:
        """Composes maps in order, pairs first, as a parallel scan does: no fragment is copied more than log n times."""
        while len(maps) > 1:
            maps = [self.combine(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]


@lru_cache(maxsize=2)
def transducer(path: str, pattern: str) -> TokenTransducer:
    return TokenTransducer(path, pattern)


def default_tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit``."""
    own_path, own_pattern = default_tokenizer()
    path, pattern = path or own_path, pattern or own_pattern

    @F.pandas_udf("long")
    def counts(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = transducer(path, pattern)
        for batch in texts:
            yield pd.Series([machine.count(x) for x in batch], dtype="int64")

    @F.pandas_udf("head string, n long, tail string, resets boolean")
    def maps(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine = transducer(path, pattern)
        for batch in texts:
            yield pd.DataFrame([machine.chunk_map(x) for x in batch], columns=["head", "n", "tail", "resets"])

    def cut(batches):
        for batch in batches:
            for k, text in enumerate(batch.column(1).to_pylist()):
                for i in range(0, len(text), chunk):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([i // chunk], pa.int32()), pa.array([text[i : i + chunk]])], names=["row", "chunk", "part"])

    def composed(rows: pd.DataFrame) -> pd.DataFrame:
        machine = transducer(path, pattern)
        rows = rows.sort_values("chunk")
        whole = machine.scan(list(zip(rows["head"], rows["n"], rows["tail"], rows["resets"], strict=True)))
        return pd.DataFrame([[rows["row"].iloc[0], rows["chunk"].iloc[0] // FAN, *whole]], columns=["row", "chunk", "head", "n", "tail", "resets"])

    @F.pandas_udf("long")
    def emitted(head: pd.Series, n: pd.Series, tail: pd.Series, resets: pd.Series) -> pd.Series:
        machine = transducer(path, pattern)
        return pd.Series([machine.emitted(m) for m in zip(head, n, tail, resets, strict=True)], dtype="int64")

    text = text_or_empty(F.col(text_col))
    slim = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    short = slim.filter(F.col("n_bytes") <= chunk).select("doc_id", "n_bytes", counts("text").alias("n_tokens"))
    long = staged(slim.filter(F.col("n_bytes") > chunk).withColumn("row", F.monotonically_increasing_id()), "long")  # fixes the row numbers
    parts = long.select("row", "text").mapInArrow(cut, "row long, chunk int, part string").repartition("row", "chunk")
    level = staged(parts.select("row", "chunk", maps("part").alias("m")).select("row", "chunk", "m.*"), "maps")
    last = level.agg(F.max("chunk")).first()[0] or 0
    while last:
        above = staged(level.groupBy("row", F.floor(F.col("chunk") / FAN).alias("part")).applyInPandas(composed, "row long, chunk int, head string, n long, tail string, resets boolean"), "maps")
        drop_staged(level)
        level, last = above, last // FAN
    counted = level.select("row", emitted("head", "n", "tail", "resets").alias("n_tokens"))
    long = long.select("row", "doc_id", "n_bytes").join(counted, "row").select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(long).withColumn("over_limit", F.col("n_tokens") > limit)
