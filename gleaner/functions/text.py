"""Text to terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM_PATTERN = r"[\p{L}\p{N}_]{2,}"
WORD_PATTERN = r"[^ \t\r\n]+"


def words(text: Column) -> Column:
    """Whitespace-separated words."""
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def terms(text: Column, ngrams: tuple[int, int], stop_words: list[str] | None) -> Column:
    """Lower-cased terms of two or more word characters, then word n-grams.

    Stop words go before the n-grams are formed, so a bigram may bridge one.
    """
    unigrams = F.regexp_extract_all(F.lower(text), F.lit(TERM_PATTERN), F.lit(0))
    if stop_words:
        unigrams = F.filter(unigrams, lambda t: ~t.isin(*stop_words))
    low, high = ngrams
    parts = []
    for size in range(low, high + 1):
        parts.append(unigrams if size == 1 else _ngrams(unigrams, size))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def _ngrams(tokens: Column, size: int) -> Column:
    shifted = [F.slice(tokens, i + 1, F.greatest(F.size(tokens) - size + 1, F.lit(0))) for i in range(size)]
    return F.transform(
        F.arrays_zip(*[s.alias(f"g{i}") for i, s in enumerate(shifted)]),
        lambda z: F.concat_ws(" ", *[z[f"g{i}"] for i in range(size)]),
    )


def english_stop_words() -> list[str]:
    """The English list that ships with Spark ML; needs a running session."""
    from pyspark.ml.feature import StopWordsRemover

    return list(StopWordsRemover.loadDefaultStopWords("english"))
