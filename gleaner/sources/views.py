"""Sentence views for selection and for sub-word models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner import UNKNOWN
from gleaner.functions.arrays import before, computed
from gleaner.functions.tags import decode, required_pos


def text_view(sentences: DataFrame, tags: list[str], proper_nouns_only: bool = False) -> DataFrame:
    """``(sid, text, ner_tags, pos_tags)``, each joined by single spaces.

    With ``proper_nouns_only``, only tokens whose part of speech contains
    ``NNP``, which fails where those tags are missing. Otherwise ``pos_tags`` is
    empty for a sentence without them.
    """
    has_pos = "pos_tags_text" in sentences.columns
    if proper_nouns_only and not has_pos:
        raise ValueError("choosing proper nouns needs part-of-speech tags (column pos_tags_text)")
    none = F.array().cast("array<string>")
    pos = none if not has_pos else required_pos() if proper_nouns_only else F.coalesce("pos_tags_text", none)
    zipped = F.arrays_zip(F.col("tokens").alias("w"), F.col("ner_tags").alias("t"), pos.alias("p"))
    if proper_nouns_only:
        zipped = F.filter(zipped, lambda z: z["p"].contains("NNP"))
    view = sentences.select("sid", zipped.alias("z"))
    return view.select(
        "sid",
        F.array_join("z.w", " ").alias("text"),
        F.array_join(F.transform("z.t", lambda t: decode(t, tags)), " ").alias("ner_tags"),
        F.array_join("z.p", " ").alias("pos_tags"),
    )


def align_labels(rows: DataFrame) -> DataFrame:
    """Add ``labels``, one tag per sub-token, from ``word_ids`` and ``ner_tags``.

    The first piece of a word takes the word's tag; later pieces and special
    tokens (NULL word id) take -100.
    """
    rows = computed(rows, ner_tags=F.col("ner_tags"))
    ids = F.col("word_ids")
    zipped = F.arrays_zip(ids.alias("w"), before(ids, F.lit(None).cast("int")).alias("b"))
    labels = F.transform(
        zipped, lambda z: F.when(z["w"].isNull() | (z["w"] == z["b"]), UNKNOWN).otherwise(F.get("ner_tags", z["w"])))
    return rows.withColumn("labels", labels)
