"""Label vocabularies and the parts of a tag name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published tag and part-of-speech vocabularies of the corpora.
CONLL_TAGS = ["O", "B-PER", "I-PER", "B-ORG", "I-ORG", "B-LOC", "I-LOC", "B-MISC", "I-MISC"]

CONLL_POS = [
    '"', "''", "#", "$", "(", ")", ",", ".", ":", "``", "CC", "CD", "DT", "EX", "FW", "IN",
    "JJ", "JJR", "JJS", "LS", "MD", "NN", "NNP", "NNPS", "NNS", "NN|SYM", "PDT", "POS", "PRP",
    "PRP$", "RB", "RBR", "RBS", "RP", "SYM", "TO", "UH", "VB", "VBD", "VBG", "VBN", "VBP", "VBZ",
    "WDT", "WP", "WP$", "WRB",
]

ONTONOTES_TYPES = [
    "PERSON", "NORP", "FAC", "ORG", "GPE", "LOC", "PRODUCT", "DATE", "TIME", "PERCENT", "MONEY",
    "QUANTITY", "ORDINAL", "CARDINAL", "EVENT", "WORK_OF_ART", "LAW", "LANGUAGE",
]

ONTONOTES_POS = [
    "XX", "``", "$", "''", ",", "-LRB-", "-RRB-", ".", ":", "ADD", "AFX", "CC", "CD", "DT", "EX",
    "FW", "HYPH", "IN", "JJ", "JJR", "JJS", "LS", "MD", "NFP", "NN", "NNP", "NNPS", "NNS", "PDT",
    "POS", "PRP", "PRP$", "RB", "RBR", "RBS", "RP", "SYM", "TO", "UH", "VB", "VBD", "VBG", "VBN",
    "VBP", "VBZ", "WDT", "WP", "WP$", "WRB",
]


def bio_tags(types: list[str]) -> list[str]:
    """``O`` and then the begin and inside tag of every type."""
    return ["O"] + [f"{p}-{t}" for t in types for p in "BI"]


ONTONOTES_TAGS = bio_tags(ONTONOTES_TYPES)


def decode(tag_id: Column, names: list[str]) -> Column:
    """Class number to class name, by position in a literal array."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), (tag_id + 1).cast("int"))


def encode(tag: Column, names: list[str]) -> Column:
    """Class name to class number; NULL for a name that is not in the list."""
    position = F.array_position(F.array(*[F.lit(n) for n in names]), tag)
    return F.when(position > 0, (position - 1).cast("int"))


def is_entity(tag: Column) -> Column:
    return tag != F.lit("O")


def has_prefix(tag: Column, letter: str) -> Column:
    return F.substring(tag, 1, 2) == F.lit(letter + "-")


def entity_type(tag: Column) -> Column:
    """Type of a BIO tag, or the whole name of an IO tag; NULL for ``O``."""
    return F.when(tag == "O", F.lit(None).cast("string")).when(
        F.substring(tag, 1, 2).isin("B-", "I-"), F.substr(tag, F.lit(3))
    ).otherwise(tag)


def required_pos(column: str = "pos_tags_text", kind: str = "array<string>") -> Column:
    """The part-of-speech column; a row without a value fails the job instead of dropping out of the result."""
    return F.coalesce(F.col(column), F.raise_error(F.lit(f"this needs part-of-speech tags, and {column} is null")).cast(kind))
