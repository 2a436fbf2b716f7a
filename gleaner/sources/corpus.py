"""Corpora to ``sentences(sid, tokens, pos_tags, pos_tags_text, ner_tags, split)``.

``split`` is one of train, validation and test as read; ``holdout`` then turns
train into train and val_train. A corpus comes as one DataFrame, read from
Parquet or JSON lines with a fixed schema.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import tags as G
from gleaner.functions.hashing import uniform
from gleaner.operators.skew import CHUNK_ROWS, cut_lineage, positions
from gleaner.operators.topk import By, first_k

FLAT_SCHEMA = (
    "id string, tokens array<string>, pos_tags array<int>, ner_tags array<int>, "
    "fine_ner_tags array<int>, split string"
)
NESTED_SCHEMA = (
    "document_id string, "
    "sentences array<struct<words: array<string>, pos_tags: array<int>, named_entities: array<int>>>, "
    "split string"
)

HOLDOUT_SEED = 1
HOLDOUT_SHARE = 0.01


@dataclass(frozen=True)
class Corpus:
    sentences: DataFrame
    tags: list[str]
    pos: list[str] | None = field(default=None)

    @property
    def label_to_id(self) -> dict[str, int]:
        return {t: i for i, t in enumerate(self.tags)}

    @property
    def id_to_label(self) -> dict[int, str]:
        return dict(enumerate(self.tags))


def read_flat(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """One sentence per row. Columns a corpus lacks come back as NULL."""
    return spark.read.schema(FLAT_SCHEMA).format(fmt).load(path)


def read_nested(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """One document per row, with an array of sentences."""
    return spark.read.schema(NESTED_SCHEMA).format(fmt).load(path)


def conll2003(rows: DataFrame, full: bool = False) -> Corpus:
    """Flat rows with part-of-speech tags and four BIO types."""
    shaped = split_train(rows, "id", full).select(
        "id", "tokens", "pos_tags", _names("pos_tags", G.CONLL_POS).alias("pos_tags_text"), "ner_tags", "split")
    return Corpus(shaped, G.CONLL_TAGS, G.CONLL_POS)


def ontonotes(rows: DataFrame, full: bool = False) -> Corpus:
    """Nested documents; the holdout takes whole documents before they are opened."""
    flat = flatten_documents(split_train(rows, "document_id", full))
    shaped = flat.withColumn("pos_tags_text", _names("pos_tags", G.ONTONOTES_POS))
    return Corpus(shaped, G.ONTONOTES_TAGS, G.ONTONOTES_POS)


def fewnerd(rows: DataFrame, names: list[str], fine: bool = False, full: bool = False) -> Corpus:
    """Flat rows with IO tags, coarse or fine; there are no columns for part-of-speech tags.

    ``names`` are the class names in the order of their ids; they are kept in
    upper case.
    """
    tags = F.col("fine_ner_tags" if fine else "ner_tags").alias("ner_tags")
    shaped = split_train(rows, "id", full).select(
        "id", "tokens", tags, "split")
    return Corpus(shaped, [n.upper() for n in names])


def _names(column: str, names: list[str]):
    return F.transform(column, lambda p: G.decode(p, names))


def flatten_documents(rows: DataFrame) -> DataFrame:
    """One row per nested sentence, identified by document and position."""
    return rows.select("document_id", "split", F.posexplode("sentences").alias("position", "s")).select(
        "document_id", "position",
        F.col("s.words").alias("tokens"),
        F.col("s.pos_tags").alias("pos_tags"),
        F.col("s.named_entities").alias("ner_tags"),
        "split",
    )


def split_train(rows: DataFrame, id_column: str, full: bool = False) -> DataFrame:
    """Carve ``val_train`` out of train, or reuse the validation rows for it.

    In full-data mode train stays whole and ``val_train`` is a second copy of
    validation, as the two are read by different stages.
    """
    if full:
        again = rows.where(F.col("split") == "validation").withColumn("split", F.lit("val_train"))
        return rows.unionByName(again)
    return holdout(rows, id_column)


def holdout(
    rows: DataFrame, id_column: str, share: float = HOLDOUT_SHARE, seed: int = HOLDOUT_SEED,
    direct_rows: int | None = None,
) -> DataFrame:
    """Relabel ``ceil(share * n)`` hash-chosen train rows as ``val_train``.

    The seed is fixed, so every run sees the same holdout. The last held-out
    row gives a cut; whether a row is held out is then a comparison within the
    row and neither part is joined or shuffled.
    """
    drawn = rows.withColumn("_u", uniform(seed, id_column))
    # Draws are stored, so that counting them and looking for the cut don't read and build the rows again.
    train = cut_lineage(drawn.where(F.col("split") == "train").select("_u", F.col(id_column).alias("_id")))
    n = train.count()
    k = -int(-n * share // 1)
    if k == 0:
        return rows
    options = {} if direct_rows is None else {"direct_rows": direct_rows}
    cut = first_k(train, [By("_u"), By("_id")], k, **options).agg(F.max(F.struct("_u", "_id"))).first()[0]
    id_type = rows.schema[id_column].dataType
    held = F.struct(F.col("_u"), F.col(id_column).alias("_id")) <= F.struct(
        F.lit(cut["_u"]).alias("_u"), F.lit(cut["_id"]).cast(id_type).alias("_id"))
    is_train = F.col("split") == "train"
    return drawn.withColumn("split", F.when(is_train & held, "val_train").otherwise(F.col("split"))).drop("_u")


def dense_ids(rows: DataFrame, order: list[str], out: str = "sid", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Number the rows of each split 0, 1, 2... by ``order``, of any types.

    A split is a hot key by nature; ``positions`` numbers it in ranges.
    """
    return positions(rows, ["split"], order, out, chunk_rows)


def to_tokens(sentences: DataFrame, tags: list[str]) -> DataFrame:
    """One row per token: ``(sid, tid, token, pos, tag_id, tag)``."""
    pos = F.col("pos_tags_text").alias("pos") if "pos_tags_text" in sentences.columns else \
        F.lit(None).cast("array<string>").alias("pos")
    zipped = F.arrays_zip(F.col("tokens").alias("token"), F.col("ner_tags").alias("tag_id"))
    exploded = sentences.select("sid", pos, F.posexplode(zipped).alias("tid", "z"))
    return exploded.select(
        "sid", F.col("tid").cast("long").alias("tid"), "z.token",
        F.get("pos", F.col("tid")).alias("pos"), "z.tag_id", G.decode(F.col("z.tag_id"), tags).alias("tag"))
