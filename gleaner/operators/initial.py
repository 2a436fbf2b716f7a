"""Initial sets that need one pass over the data.

Each function returns the chosen ids as a DataFrame ``(sid, ...)`` with the
number they were ranked on. ``size`` is the exact number of rows wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import scores as S
from gleaner.functions.hashing import race_key, uniform
from gleaner.functions.tags import entity_type, required_pos
from gleaner.operators.skew import at_most, cut_lineage, join_hot
from gleaner.operators.tfidf import Vectorizer, text_scores
from gleaner.operators.topk import By, first_k

_BY_SCORE_DOWN = [By("score", descending=True), By("sid")]
_BY_SCORE_UP = [By("score"), By("sid")]


def random(rows: DataFrame, size: int, seed: int = 1) -> DataFrame:
    return first_k(rows.select("sid", uniform(seed, "sid").alias("score")), _BY_SCORE_UP, size)


def longest(texts: DataFrame, size: int) -> DataFrame:
    """Most tokens, counted between single spaces."""
    length = F.size(F.split("text", " ")).cast("long")
    return first_k(texts.select("sid", length.alias("score")), _BY_SCORE_DOWN, size)


def tfidf_top_mean(texts: DataFrame, size: int, top_k: int = 5, how: Vectorizer = Vectorizer()) -> DataFrame:
    return first_k(text_scores(texts, top_k, how), _BY_SCORE_DOWN, size)


def tfidf_sampled(
    texts: DataFrame, size: int, top_k: int = 5, how: Vectorizer = Vectorizer(stop_words="english"), seed: int = 1
) -> DataFrame:
    """Drawn without replacement with probabilities ``softmax(score / 5)``."""
    scored = text_scores(texts, top_k, how)
    keyed = scored.select("sid", race_key(uniform(seed, "sid"), F.col("score") / 5).alias("score"))
    return first_k(keyed, _BY_SCORE_UP, size)


def by_type_quota(tokens: DataFrame, size: int) -> DataFrame:
    """``size div n_types`` sentences richest in each type, then the richest overall.

    Types are served in name order and a sentence is taken once. The loop over
    types is a loop over the label vocabulary; each step is one small top-k job
    on per-sentence counts that are computed once.
    """
    tagged = tokens.select("sid", entity_type(F.col("tag")).alias("type"))
    per_type = cut_lineage(
        tagged.groupBy("sid", "type").agg(F.count(F.lit(1)).alias("score")))
    types = [r[0] for r in per_type.where(F.col("type").isNotNull()).select("type").distinct().orderBy("type").collect()]
    picked: DataFrame | None = None
    quota = size // len(types) if types else 0
    everyone = per_type.select("sid").distinct()

    def take(pool: DataFrame, k: int) -> DataFrame:
        if picked is not None:
            pool = pool.join(at_most(picked.select("sid"), size), "sid", "left_anti")
        return cut_lineage(first_k(pool.select("sid", "score"), _BY_SCORE_DOWN, k))

    for t in types:
        counts = per_type.where(F.col("type") == t)
        # A sentence without the type counts 0 and still fills the quota.
        zero = everyone.join(counts.select("sid"), "sid", "left_anti").withColumn("score", F.lit(0).cast("long"))
        chosen = take(counts.select("sid", "score").unionByName(zero), quota).withColumn("reason", F.lit(t))
        picked = chosen if picked is None else picked.unionByName(chosen)
    overall = per_type.groupBy("sid").agg(
        F.sum(F.when(F.col("type").isNotNull(), F.col("score")).otherwise(0)).alias("score"))
    rest = take(overall, size - quota * len(types)).withColumn("reason", F.lit("any"))
    return rest if picked is None else picked.unionByName(rest)


def static(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose ids are listed in ``ids(sid)``."""
    return rows.select("sid").join(ids.select("sid").distinct(), "sid", "left_semi")


def nnp_frequency(tokens: DataFrame, size: int) -> DataFrame:
    """``tokens(sid, tid, token, pos)``: mean share of proper-noun uses of a sentence's nouns.

    Of every token text, the share of its uses tagged ``NNP``; a sentence
    scores the mean share over its tokens whose tag contains ``NNP``, else 0.
    A token without part of speech is an error.
    """
    tokens = tokens.withColumn("pos", required_pos("pos", "string"))
    shares = tokens.groupBy("token").agg(
        (F.count_if(F.col("pos") == "NNP") / F.count(F.lit(1))).alias("share"),
        F.count_if(F.col("pos").contains("NNP")).alias("uses"),
    )
    nouns = tokens.where(F.col("pos").contains("NNP")).select("sid", "tid", "token")
    valued = join_hot(nouns, shares.where(F.col("uses") > 0).select("token", "share"), "token")
    scored = valued.groupBy("sid").agg(F.avg("share").alias("score"))
    everyone = tokens.select("sid").distinct()
    ranked = everyone.join(scored, "sid", "left").select(
        "sid", F.round(F.coalesce("score", F.lit(0.0)), 9).alias("score"))
    return first_k(ranked, _BY_SCORE_DOWN, size)


def passes_nnp_filter(n_nnp: Column, length: Column, alpha: float) -> Column:
    """More proper nouns than ``alpha * ln(length)``; an empty sentence passes."""
    return F.when(length == 0, F.lit(True)).otherwise(n_nnp > F.lit(float(alpha)) * F.log(length.cast("double")))


def nnp_filter(sentences: DataFrame, size: int, alpha: float = 2.0, seed: int = 1) -> DataFrame:
    """Random among sentences rich in proper nouns: ``sentences(sid, tokens, pos_tags_text)``."""
    if "pos_tags_text" not in sentences.columns:
        raise ValueError("this strategy needs part-of-speech tags (column pos_tags_text)")
    n_nnp = F.size(F.filter(required_pos(), lambda p: p.contains("NNP")))
    kept = sentences.where(passes_nnp_filter(n_nnp, F.size("tokens"), alpha))
    return random(kept, size, seed)


def lm_breaking_ties(lm_scores: DataFrame, size: int) -> DataFrame:
    """``lm_scores(sid, tid, logits)``: smallest raw-logit margin of a sentence first."""
    margins = lm_scores.select("sid", S.margin("logits").alias("m"))
    scored = margins.groupBy("sid").agg(F.round(F.min("m"), 9).alias("score"))
    return first_k(scored, _BY_SCORE_UP, size)
