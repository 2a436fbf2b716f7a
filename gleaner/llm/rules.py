"""Quality rules as a ledger of failure bits.

Every rule is evaluated once for each document. The ledger keeps what was
measured and one bit for each failed rule, and everything after it works on the
bits: a policy is a mask of the rules that reject, and an ablation is a count
over the distinct bit patterns, of which there are at most ``2 ** len(RULES)``.
Policies can change without reading a text again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.words import Texts, mixed, ngrams, spans_hashed, text_blocks, words_of

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals")

#: Rule, by bit, and the condition under which it fails. Integer arithmetic only, so that it is exact.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "repeated_lines": "n_dup_lines > 3 and 100 * n_dup_lines > 30 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "capitals": "100 * n_capitals > 50 * word_chars",
}
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "repeated_lines"),
    "v2": tuple(RULES),
}

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_CAPITALS = np.zeros(256, bool)
_CAPITALS[65:91] = True


def ledger(docs: DataFrame) -> DataFrame:
    """``doc_id``, the ``MEASURES`` and ``fail_bits`` of each row of ``docs``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored, and rows
    that repeat are measured as often as they occur. A null text has no words.
    A word is a run of characters other than space, tab and the characters from
    line feed to carriage return. ``n_lines`` counts lines with a word,
    ``n_dup_lines`` those equal to an earlier line, ``n_repeat_words`` the words
    in three-word windows that occur twice or more in the text.
    """
    kinds = ", ".join(f"{m} long" for m in MEASURES)
    measured = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        _measure, f"doc_id {dict(docs.dtypes)['doc_id']}, {kinds}")
    bits = sum((F.when(F.expr(test), F.lit(1 << i)).otherwise(F.lit(0)) for i, test in enumerate(RULES.values())), F.lit(0))
    return measured.withColumn("fail_bits", bits.cast("long"))


def mask(policy: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in POLICIES[policy])


def passes(policy: str) -> Column:
    """Whether no rule of the policy failed."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0


def ablations(ledger_rows: DataFrame) -> DataFrame:
    """What each rule of each policy does, from the bits alone.

    ``policy, rule, n_docs, n_rejected, n_failed, n_alone, n_rejected_without``:
    documents that fail the rule, that only this rule of the policy rejects, and
    that the policy would reject without it. An empty ledger gives no rows.
    """
    patterns = ledger_rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    names = list(RULES)
    cases = F.array(*[
        F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(mask(p)).alias("all_bits"), F.lit(1 << names.index(r)).alias("bit"))
        for p, rules in POLICIES.items() for r in rules])
    rows = patterns.select("fail_bits", "n", F.explode(cases).alias("c")).select("fail_bits", "n", "c.*")
    hit = F.col("fail_bits").bitwiseAND(F.col("all_bits"))
    others = hit.bitwiseAND(F.bitwise_not(F.col("bit")))
    counted = lambda test: F.sum(F.when(test, F.col("n")).otherwise(F.lit(0)))
    return rows.groupBy("policy", "rule").agg(
        F.sum("n").alias("n_docs"), counted(hit != 0).alias("n_rejected"),
        counted(F.col("fail_bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        counted(hit == F.col("bit")).alias("n_alone"), counted(others != 0).alias("n_rejected_without"))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in text_blocks(batch.column(1)):
            columns = [pa.array(c, pa.int64()) for c in _measures(texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(texts.first_row, len(texts)), *columns], names=["doc_id", *MEASURES])


def _measures(texts: Texts) -> list[np.ndarray]:
    data, bounds = texts.data, texts.bounds
    n = len(texts)
    words = words_of(texts)
    n_words = np.diff(words.first)
    text_of = np.repeat(np.arange(n), n_words)

    per_text = lambda flags, at: np.diff(np.concatenate([[0], np.cumsum(flags)])[at])
    inside = np.zeros(len(data) + 1, np.int8)
    inside[words.starts] = 1
    inside[words.ends] -= 1
    begins_character = (data & 0xC0) != 0x80
    word_chars = per_text(np.cumsum(inside[:-1]).astype(bool) & begins_character, bounds)

    # Lines with a word: the last line start at or before each word.
    line_starts = np.union1d(bounds[:-1], np.flatnonzero(data == 10) + 1)
    used = np.unique(np.searchsorted(line_starts, words.starts, "right") - 1)
    starts = line_starts[used]
    stops = np.concatenate([line_starts, [len(data)]])[used + 1]
    stops = stops - ((stops > starts) & (data[np.maximum(stops - 1, 0)] == 10) if len(data) else 0)
    line_text = np.searchsorted(bounds, starts, "right") - 1
    n_lines = np.bincount(line_text, minlength=n)
    salt = mixed(np.arange(n, dtype=np.uint64) + np.uint64(1))
    _, first = np.unique(spans_hashed(data, starts, stops) ^ salt[line_text], return_index=True)
    n_dup_lines = n_lines - np.bincount(line_text[first], minlength=n)

    grams = ngrams(words.hashes, 3)
    repeated = np.zeros(len(words.hashes), bool)
    if len(grams):
        within = np.flatnonzero(text_of[: len(grams)] == text_of[2:])
        _, group, count = np.unique(grams[within] ^ salt[text_of[within]], return_inverse=True, return_counts=True)
        at = within[count[group] > 1]
        for k in range(3):
            repeated[at + k] = True
    return [n_words, word_chars, per_text(_SYMBOLS[data], bounds), n_lines, n_dup_lines,
            per_text(repeated, words.first), per_text(_CAPITALS[data], bounds)]
