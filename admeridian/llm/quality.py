"""Quality rules as a bitmask ledger.

Every rule is evaluated once per text: the ledger holds the measurements and one integer whose bit i says that rule i failed.
A policy is a named, versioned set of rules; applying one, or any other later, is a bitwise AND over the ledger and needs no
text. Ablations (how many rows a rule rejects, and rejects alone) are aggregates over the bits.

Defined results: a null, empty or blank text has no words and fails ``few_words``; words are runs of bytes other than space,
tab, newline, vertical tab, form feed and carriage return; repeated rows are judged alike; an empty table gives an empty one;
ledger columns are returned beside the id only, so no name of the input can clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admeridian.llm.common import small_batches

BLANK = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"

#: What is measured of a text; all are longs.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_exclaims", "n_digits")


def measure_text(text: str | None) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of ``MEASURES``; the letters counted are A-Z and a-z."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()  # bytes split at exactly the six blanks
    n_chars = len(raw) - int(seen[0x80:0xC0].sum())
    lines = [x for x in raw.split(b"\n") if x.strip(BLANK)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        covered = np.zeros(len(words) + 3, np.bool_)
        first = np.fromiter((times[w] > 1 for w in windows), np.bool_, len(windows)).nonzero()[0]
        for shift in range(3):
            covered[first + shift] = True
        repeated = int(covered.sum())
    return (
        len(words),
        n_chars - int(seen[list(BLANK)].sum()),
        int(seen[list(SYMBOLS)].sum()),
        len(lines),
        len(lines) - len(set(lines)),
        repeated,
        int(seen[65:91].sum()),
        int(seen[65:91].sum() + seen[97:123].sum()),
        int(seen[ord("!")]),
        int(seen[48:58].sum()),
    )


def measured(text: Column) -> Column:
    def measure(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([measure_text(x) for x in batch], columns=list(MEASURES)).astype("int64")

    return F.pandas_udf(measure, ", ".join(f"{x} long" for x in MEASURES))(text)


def rules() -> list[tuple[str, Column]]:
    """(name, failed) of each rule; a rule's place is its bit. Append only: old ledgers keep their meaning."""
    c = F.col
    return [
        ("few_words", c("n_words") < 50),
        ("repeated_windows", 100 * c("n_repeat_words") > 50 * c("n_words")),
        ("word_length", (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 20 * c("n_words"))),
        ("symbols", 10 * c("n_symbols") > c("n_words")),
        ("duplicate_lines", 2 * c("n_dup_lines") > c("n_lines")),
        ("shouting", (10 * c("n_upper") > 6 * c("n_letters")) & (c("n_letters") >= 20)),
        ("exclamations", 10 * c("n_exclaims") > 3 * c("n_words")),
        ("digits", 2 * c("n_digits") > c("word_chars")),
    ]


#: Versioned policies: the rules whose failure rejects a text.
POLICIES = {
    "base-v1": ("few_words", "repeated_windows"),
    "web-v1": ("few_words", "repeated_windows", "word_length", "symbols", "duplicate_lines", "shouting", "exclamations", "digits"),
}


def policy_mask(policy: str) -> int:
    names = [name for name, _ in rules()]
    return sum(1 << names.index(x) for x in POLICIES[policy])


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the measurements and ``failed_bits`` of each row."""
    small_batches(docs.sparkSession)
    table = docs.select(F.col(id_col).alias("doc_id"), measured(F.col(text_col)).alias("m")).select("doc_id", "m.*")
    bits = sum((F.when(failed, F.lit(1 << i)).otherwise(0) for i, (_, failed) in enumerate(rules())), F.lit(0))
    return table.withColumn("failed_bits", bits.cast("long"))


def apply_policy(table: DataFrame, policy: str) -> DataFrame:
    """The ledger with ``kept`` by a policy, and the policy's name."""
    return table.withColumns({"policy": F.lit(policy), "kept": F.col("failed_bits").bitwiseAND(F.lit(policy_mask(policy))) == 0})


def sole_rule(policy: str) -> Column:
    """Over a ledger: the rule of the policy that alone rejects the row; null where none or several do."""
    names = [name for name, _ in rules()]
    own = F.col("failed_bits").bitwiseAND(F.lit(policy_mask(policy)))
    return F.coalesce(*[F.when(own == (1 << names.index(x)), F.lit(x)) for x in POLICIES[policy]])


def ablation(table: DataFrame, policy: str) -> DataFrame:
    """One row per rule of the policy: rows it fails, rows that it alone rejects, rows kept without it."""
    mask = policy_mask(policy)
    names = [name for name, _ in rules()]
    bits = F.col("failed_bits").bitwiseAND(F.lit(mask))
    per_mask = table.groupBy(bits.alias("bits")).agg(F.count("*").alias("n"))  # at most 2 ** rules rows
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("rule"), F.lit(1 << names.index(x)).alias("bit")) for x in POLICIES[policy]]))
    rows = per_mask.select("bits", "n", each.alias("r")).select("bits", "n", "r.*")
    count = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    return rows.groupBy("rule").agg(
        count(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        count(F.col("bits") == F.col("bit")).alias("n_failed_alone"),
        count(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_kept_without"),
    )
