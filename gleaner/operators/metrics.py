"""Span scores and annotation statistics.

``pairs(sid, tid, gold, pred)`` holds the gold and predicted tag names of every
token. Spans are matched by equi-joins on their position, a key that stays
distinct however long a sentence is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import UNKNOWN
from gleaner.functions.tags import entity_type, has_prefix
from gleaner.operators import spans

EPSILON = 1e-8


def side(pairs: DataFrame, column: str) -> DataFrame:
    return pairs.select("sid", "tid", F.col(column).alias("tag"))


# --- identical-tag spans ----------------------------------------------------


def _sides(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Both taggings in one table ``(*by, sid, side, tid, tag)``, reading the pairs once."""
    each = F.array(
        F.struct(F.lit("g").alias("side"), F.col("gold").alias("tag")),
        F.struct(F.lit("p").alias("side"), F.col("pred").alias("tag")),
    )
    return pairs.select(*by, "sid", "tid", F.inline(each))


def _matched(spans_of_sides: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per place and type, whether a span is in the prediction, the gold set or both.

    Each side has a span at most once, so one aggregation does for a join.
    """
    has = lambda side: F.max((F.col("side") == side).cast("long"))
    return spans_of_sides.groupBy(*by, "sid", "start", "end", "type").agg(
        has("p").alias("n_pred"), has("g").alias("n_gold"),
    ).withColumn("n_correct", F.least("n_pred", "n_gold"))


def _io_spans(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return spans.runs(_sides(pairs, by), spans.io_break, keys=(*by, "sid", "side")).withColumnRenamed("tag", "type")


def io_counts(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``(*by, n_pred, n_gold, n_correct)`` of identical-tag spans, one row for each value of ``by`` that has a span."""
    return _matched(_io_spans(pairs, by), by).groupBy(*by).agg(*[
        F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_pred", "n_gold", "n_correct")])


def _ratio(correct: str, total: str, epsilon: float) -> Column:
    if epsilon:
        return F.col(correct) / (F.col(total) + epsilon)
    return F.when(F.col(total) > 0, F.col(correct) / F.col(total)).otherwise(0.0)


def _with_scores(counts: DataFrame, epsilon: float) -> DataFrame:
    p, r = _ratio("n_correct", "n_pred", epsilon), _ratio("n_correct", "n_gold", epsilon)
    scored = counts.withColumn("precision", p).withColumn("recall", r)
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def io_scores(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Precision, recall and F1 of identical-tag spans, one row; with ``by``, such as a split, one for each of its values."""
    if not by:
        return _with_scores(io_counts(pairs), EPSILON)
    nothing = pairs.select(*by).distinct()
    counts = nothing.join(io_counts(pairs, by), list(by), "left").na.fill(0, ["n_pred", "n_gold", "n_correct"])
    return _with_scores(counts, EPSILON)


def type_errors(pairs: DataFrame) -> DataFrame:
    """Spans found at the right place but with the wrong type, one row.

    ``within`` counts right coarse and wrong fine types, ``outer`` wrong coarse
    types, ``same_span`` the spans at the right place whatever their type (plus
    1e-6, so that it can be divided by). The coarse type is the part of the
    name before the first hyphen.
    """
    # One side has one span at a place, so a place is a row with up to two types.
    tag_of = lambda side: F.max(F.when(F.col("side") == side, F.col("type")))
    places = _io_spans(pairs).groupBy("sid", "start", "end").agg(tag_of("g").alias("g"), tag_of("p").alias("p"))
    coarse = lambda c: F.substring_index(c, "-", 1)
    wrong = F.col("g") != F.col("p")
    same = coarse(F.col("g")) == coarse(F.col("p"))
    return places.where(F.col("g").isNotNull() & F.col("p").isNotNull()).agg(
        F.count_if(wrong & same).alias("within"),
        F.count_if(wrong & ~same).alias("outer"),
        (F.count(F.lit(1)) + F.lit(1e-6)).alias("same_span"),
    )


# --- BIO entities -----------------------------------------------------------


COUNTS = ("n_pred", "n_gold", "n_correct", "n_tokens", "n_equal")


def bio_counts(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``(*by, type, n_pred, n_gold, n_correct, n_tokens, n_equal)``: entities of each type, and one row without a type for the tokens.

    One scan for all values of ``by``; sums of such tables over parts of a
    corpus are the table of the whole.
    """
    entities = spans.runs(_sides(pairs, by), spans.bio_break, keys=(*by, "sid", "side")).withColumn(
        "type", entity_type(F.col("tag")))
    none = F.lit(0).cast("long")
    of_types = _matched(entities, by).groupBy(*by, "type").agg(
        *[F.sum(c).alias(c) for c in COUNTS[:3]], none.alias("n_tokens"), none.alias("n_equal"))
    of_tokens = pairs.groupBy(*by).agg(
        F.lit(None).cast("string").alias("type"), *[none.alias(c) for c in COUNTS[:3]],
        F.count(F.lit(1)).alias("n_tokens"), F.count_if(F.col("gold") == F.col("pred")).alias("n_equal"))
    return of_types.unionByName(of_tokens)


def bio_from_counts(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Scores of ``bio_counts``, also of several, put together: ``(*by, type, precision, recall, f1, number, accuracy)``."""
    known = counts.select(*by, "type", *COUNTS, F.col("type").isNull().alias("_tokens"))
    sums = known.groupingSets([[*by, "type", "_tokens"], [*by]], *by, "type", "_tokens").agg(
        F.grouping("_tokens").alias("all"), *[F.sum(c).alias(c) for c in COUNTS])
    overall = F.col("all") == 1
    return _with_scores(sums.where(overall | ~F.col("_tokens")), 0.0).select(
        *by, F.when(overall, "overall").otherwise(F.col("type")).alias("type"),
        "precision", "recall", "f1", F.col("n_gold").cast("long").alias("number"),
        F.when(overall & (F.col("n_tokens") > 0), F.col("n_equal") / F.col("n_tokens")).alias("accuracy"))


def bio_scores(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Entity scores per type and overall: ``(*by, type, precision, recall, f1, number, accuracy)``.

    The overall row has type ``overall`` and carries the token accuracy. With
    ``by``, such as a split, there are such rows for each of its values.
    """
    return bio_from_counts(bio_counts(pairs, by), by)


# --- annotation statistics --------------------------------------------------


def annotation_stats(tokens: DataFrame, labelled: DataFrame) -> DataFrame:
    """Volume of annotation, one row: counts and the share of all tokens."""
    none = F.lit(None)
    rows = tokens.select(F.lit(False).alias("done"), none.cast("string").alias("tag"), none.cast("long").alias("sid"))
    rows = rows.unionByName(labelled.select(F.lit(True).alias("done"), "tag", F.col("sid").cast("long").alias("sid")))
    return rows.agg(
        F.count_if("done").alias("n_annotated"),
        F.count_if(F.col("done") & (F.col("tag") != "O")).alias("n_non_o"),
        F.count_distinct("sid").alias("n_sentences"),
        F.count_if(~F.col("done")).alias("n_tokens"),
    ).withColumn("percentage", F.col("n_annotated") / F.col("n_tokens") * 100)


def tag_distribution(labelled: DataFrame) -> DataFrame:
    """Annotated tokens per tag, ordered by type, then prefix, ``O`` last."""
    counts = labelled.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    prefix = F.when(has_prefix(F.col("tag"), "B"), 0).otherwise(1)
    return counts.orderBy(F.col("tag") == "O", entity_type(F.col("tag")), prefix)


def training_stats(training: DataFrame) -> DataFrame:
    """Training rows and the tokens in them that are not masked, one row."""
    unmasked = F.size(F.filter("ner_tags", lambda t: t != UNKNOWN))
    return training.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(unmasked), F.lit(0)).cast("long").alias("n_unmasked"),
    )
