"""The benchmark tables read as corpora, predictions and annotations.

Every function reads whole tables. Line items play the tokens of an order,
documents play sentences (one per line) or texts, events play the tag sequence
of a user, and embeddings play class scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import UNKNOWN
from gleaner.functions import scores as S
from gleaner.functions.arrays import before, computed
from gleaner.functions.hashing import before_place, uniform
from gleaner.functions.tags import bio_tags
from gleaner.functions.text import words
from gleaner.operators.skew import positions

LINE_TAGS = bio_tags(["PER", "ORG"])
TEXT_TAGS = bio_tags(["PER", "ORG", "LOC"])
POS_NAMES = ["NN", "NNP", "IN"]
PREPOSITIONS = ["of", "in", "by", "with", "de"]
STOP_WORDS = ["the", "and", "of", "in", "to", "is", "on", "that", "it", "an", "for", "with"]
LINES_PER_DOCUMENT = 1 << 32

# Event types as two-part entity names, next one in the list as the wrong guess.
EVENT_NAMES = {
    "click": "PAGE-CLICK", "error": "PAGE-ERROR", "purchase": "SHOP-PURCHASE",
    "signup": "SHOP-SIGNUP", "view": "O",
}


KEYS = {
    "documents": "doc_id", "lineitem": "l_orderkey", "events": "user_id", "embeddings": "vec_id",
    "orders": "o_orderkey", "benchmark": "item_id",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as read, or spread over the cores when it comes in too few pieces.

    A file of one row group is one task, which would then do all work up to
    the first shuffle. Tables of many files are left as they are.
    """
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if rows.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        return rows.repartition(KEYS[name])
    return rows


# --- line items as tokens ---------------------------------------------------


def line_tokens(spark: SparkSession, sf_dir: str, *extra: Column) -> DataFrame:
    """``(sid, tid, tag)`` and ``extra`` columns over the line items of an order."""
    rows = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "PER").when(F.col("l_returnflag") == "R", "ORG")
    prefix = F.when(F.col("l_linestatus") == "F", "B-").otherwise("I-")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    rows = rows.select(
        F.col("l_orderkey").alias("sid"),
        *order,
        F.coalesce(F.concat(prefix, kind), F.lit("O")).alias("tag"),
        *extra,
    )
    return positions(rows, ["sid"], order).drop(*order)


def _line_logits() -> Column:
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
    return F.array(
        quantity / 10, F.col("l_discount") * 40, F.col("l_tax") * 50, price / 25000,
        (F.col("l_suppkey") % 100).cast("double") / 20,
    ).alias("logits")


def line_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(sid, tid, scores, tag)``: softmax over five measures of a line item."""
    return line_tokens(spark, sf_dir, _line_logits()).select(
        "sid", "tid", S.softmax("logits").alias("scores"), "tag")


def labelled_tokens(tokens: DataFrame) -> DataFrame:
    """A hashed fifth of the tokens, as labelled so far."""
    return tokens.where(uniform(11, "sid", "tid") < 0.2).select("sid", "tid", "tag")


def labelled_sentences(tokens: DataFrame) -> DataFrame:
    """All tokens of a hashed tenth of the sentences."""
    return tokens.where(uniform(12, "sid") < 0.1).select("sid", "tid", "tag")


def seeds(tokens: DataFrame) -> DataFrame:
    """A hashed fiftieth of the tokens."""
    return tokens.where(uniform(14, "sid", "tid") < 0.02).select("sid", "tid")


# --- documents --------------------------------------------------------------


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sid"), "text")


def _pos(word: Column) -> Column:
    first = F.substring(word, 1, 1)
    return F.when(F.lower(first) != first, "NNP").when(word.isin(*PREPOSITIONS), "IN").otherwise("NN")


def _with_tags(rows: DataFrame) -> DataFrame:
    """Add ``pos_tags_text``, ``pos_tags`` and ``ner_tags`` to rows with ``tokens``."""
    rows = computed(rows, pos_tags_text=F.transform("tokens", _pos))
    number = lambda p: F.when(p == "NNP", 1).when(p == "IN", 2).otherwise(0)

    def tag(z: Column) -> Column:
        kind = (F.length(z["word"]) % 3) * 2
        return F.when(z["pos"] == "NNP", F.when(z["left"] == "NNP", kind + 2).otherwise(kind + 1)).otherwise(0)

    pos = F.col("pos_tags_text")
    zipped = F.arrays_zip(F.col("tokens").alias("word"), pos.alias("pos"), before(pos, F.lit("")).alias("left"))
    return computed(rows, pos_tags=F.transform(pos, number), ner_tags=F.transform(zipped, tag))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents: ``(sid, tokens, pos_tags_text, pos_tags, ner_tags)``."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    lines = lines.select((F.col("doc_id") * LINES_PER_DOCUMENT + F.col("line")).alias("sid"), "text")
    rows = computed(lines, tokens=words(F.col("text"))).drop("text")
    return _with_tags(rows.where(F.size("tokens") > 0))


def partly_annotated(spark: SparkSession, sf_dir: str, share: float = 0.85) -> DataFrame:
    """Sentences with ``al_tags``: a hashed share of the tags is known."""
    rows = computed(sentences(spark, sf_dir), _head=F.concat(F.concat_ws(":", F.lit("13"), F.col("sid").cast("string")), F.lit(":")))
    known = lambda t, i: F.when(before_place(F.col("_head"), i, share), t).otherwise(UNKNOWN)
    return rows.withColumn("al_tags", F.transform("ner_tags", known)).drop("_head")


def raw_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(sid, logits, label_ids)`` per line; the first word and long words are masked."""
    rows = sentences(spark, sf_dir)
    label = lambda z, i: F.when((i == 0) | (F.length(z["w"]) > 8), UNKNOWN).otherwise(z["t"])
    pairs = F.arrays_zip(F.col("tokens").alias("w"), F.col("ner_tags").alias("t"))
    # All there are, by length and place: looked up, not worked out for each class of each word.
    made = F.array(*[F.array(*[
        F.lit(((n * (7 * (c + 3)) + i * (5 * (c + 1))) % 17) / 4) for c in range(len(TEXT_TAGS))]) for n in range(17) for i in range(17)])
    logits = lambda w, i: F.get(made, F.length(w) % 17 * 17 + i % 17)
    return rows.select(
        "sid", F.transform("tokens", logits).alias("logits"), F.transform(pairs, label).alias("label_ids"))


def nested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the nested form: an array of sentences per row."""
    docs = table(spark, sf_dir, "documents")
    sentence = lambda line: F.struct(
        words(line).alias("words"),
        F.transform(words(line), lambda w: F.when(F.lower(F.substring(w, 1, 1)) != F.substring(w, 1, 1), 1)
                    .when(w.isin(*PREPOSITIONS), 2).otherwise(0)).alias("pos_tags"),
        F.transform(words(line), lambda w: F.length(w) % 5).alias("named_entities"),
    )
    return docs.select(
        F.col("doc_id").alias("document_id"),
        F.transform(F.split("text", "\n"), sentence).alias("sentences"),
        F.lit("train").alias("split"),
    )


# --- events -----------------------------------------------------------------


def event_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(sid, tid, gold, pred)``: a user's events in time order; a fifth is mistaken."""
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("sid"), "ts", "event_id", "event_type")
    kinds = list(EVENT_NAMES)
    following = {k: kinds[(i + 1) % len(kinds)] for i, k in enumerate(kinds)}
    name = lambda mapping: F.coalesce(*[
        F.when(F.col("event_type") == k, F.lit(v)) for k, v in mapping.items()])
    gold = name(EVENT_NAMES)
    wrong = name({k: EVENT_NAMES[following[k]] for k in kinds})
    rows = rows.withColumn("gold", gold).withColumn(
        "pred", F.when(uniform(15, "event_id") < 0.2, wrong).otherwise(gold))
    placed = positions(rows, ["sid"], ["ts", "event_id"])
    return placed.select("sid", "tid", "gold", "pred")


# --- embeddings -------------------------------------------------------------


def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, scores)``: softmax of the scaled embedding."""
    logits = F.transform("embedding", lambda v: v.cast("double") * 10)
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), S.softmax(logits).alias("scores"))


def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(sid, tid, logits)``: eight embeddings make one sentence."""
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 8).cast("long").alias("sid"),
        (F.col("vec_id") % 8).alias("tid"),
        F.transform("embedding", lambda v: v.cast("double")).alias("logits"),
    )
