"""Token ids of whole texts through a memo of segments.

Neither public tokenizer ever joins the end of a non-blank run to a blank that follows it, so a text may be cut in front of
every run of white space and the ids of the pieces follow one another. A text of common Latin characters without special strings
is cut further, by the vocabulary's own pattern, into the words that are merged one by one: there are fewer distinct words than
pieces, and a new one costs a merge and no search. Each distinct word or piece is encoded once per worker as long as it is
remembered. Common characters are merged by ``tiktoken`` from the ranks of the same vocabulary file, several times as fast; pieces
with others, or with special strings, by the ``tokenizers`` library. Both give the same ids; the tests hold them against each other.
"""

from __future__ import annotations

import gc
import json
import re
import unicodedata
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from admeridian.llm.common import kept_tables, tidy

#: White space as Unicode and both libraries have it (Python's own notion also holds U+001C to U+001F).
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SEGMENT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
NON_BLANK = re.compile(f"[^{WHITE}]+")
#: Characters on whose classes, case and composition all libraries agree.
UNCOMMON = re.compile("[^\\x09-\\x0d\\x20-\\x7e\\xa0-\\xff\\u0100-\\u017f]")
#: Distinct words, and as many pieces of texts with uncommon characters, a worker remembers: about 130 bytes each, so 26 MB.
MEMO = 200_000
#: Stands for the end of a word in the ranks; no UTF-8 text has this byte.
WORD_END = b"\xff"


def byte_of_char() -> dict[str, int]:
    """The vocabulary files write bytes as characters: printable ones as themselves, the others from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _common(*categories: str) -> str:
    """The common characters of the categories (L: letters, N: numbers), as the inside of a character class."""
    found = [c for c in map(chr, range(0x180)) if not UNCOMMON.search(c) and unicodedata.category(c)[0] in categories]
    return "".join(f"\\u{ord(c):04x}" for c in found)


def words_pattern(drops_white: bool) -> re.Pattern:
    """The pattern of a vocabulary's pretokenizer (fixed values), on common characters."""
    letter, number = _common("L"), _common("N")
    if drops_white:
        return re.compile(f"[{letter}]+|'(?:s|t|re|ve|m|ll|d)|[{number}]|[^{WHITE}{letter}{number}]+")
    return re.compile(f" ?[{letter}]+|'(?:s|t|re|ve|m|ll|d)| ?[{number}]+| ?[^{WHITE}{letter}{number}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


class Memo(dict):
    """What ``learn`` gives for a text. Half of ``limit`` fills up, then replaces the other half, in which what is looked up again is
    still found: frequent texts stay."""

    def __init__(self, learn: Callable[[str], bytes], limit: int):
        self.learn, self.half, self.last = learn, max(1, limit // 2), {}

    def __missing__(self, text: str) -> bytes:
        code = self.last.get(text)
        if code is None:
            code = self.learn(text)
            if len(text) >= 64:
                return code
        if len(self) >= self.half:
            self.last = dict(self)
            self.clear()
        self[text] = code
        return code


class SegmentEncoder:
    """``encode(text)``: its ids as bytes of little-endian unsigned integers of ``width`` bytes."""

    def __init__(self, path: str, drops_white: bool, width: int, memo: int = MEMO):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = [x["content"] for x in model["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)").search
        suffix = model["model"].get("end_of_word_suffix") or ""
        chars = byte_of_char()
        ranks = {}
        for token, i in model["model"]["vocab"].items():
            if token not in special:
                ended = bool(suffix) and token.endswith(suffix)
                ranks[bytes(chars[c] for c in (token[: -len(suffix)] if ended else token)) + WORD_END * ended] = i
        suffix_end = WORD_END if suffix else b""
        del model
        core = tiktoken.Encoding("own", pat_str=".", mergeable_ranks=ranks, special_tokens={})
        self.merge = core._core_bpe.encode_single_piece
        del core, ranks  # the tables of the file and of the ranks are large
        tidy()
        self.words = words_pattern(drops_white).findall
        self.lower, self.end = drops_white, suffix_end
        self.cut = (NON_BLANK if drops_white else SEGMENT).findall
        self.code, self.dtype = ("H" if width == 2 else "I"), f"<u{width}"
        self.known_words, self.known_pieces = Memo(self.word, memo), Memo(self.piece, memo)

    def word(self, word: str) -> bytes:
        return array(self.code, self.merge(word.encode() + self.end)).tobytes()

    def piece(self, piece: str) -> bytes:
        if UNCOMMON.search(piece) or self.special(piece):
            return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, self.dtype).tobytes()
        return b"".join(map(self.known_words.__getitem__, self.words(piece.lower() if self.lower else piece)))

    def encode(self, text: str) -> bytes:
        if UNCOMMON.search(text) or self.special(text):
            return b"".join(map(self.known_pieces.__getitem__, self.cut(text)))
        return b"".join(map(self.known_words.__getitem__, self.words(text.lower() if self.lower else text)))


@lru_cache(maxsize=4)
def encoder(path: str, drops_white: bool, width: int) -> SegmentEncoder:
    """One encoder per worker process, kept from task to task."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return SegmentEncoder(path, drops_white, width)


def _forget() -> None:
    encoder.cache_clear()
    gc.collect()  # an encoder and its memos hold each other


kept_tables.append(_forget)
