"""Query strategies: which sentences, entities or tokens to annotate next.

Inputs are long tables: ``predictions(sid, tid, scores)``, gold
``tokens(sid, tid, tag)`` and ``labelled(sid, tid, tag)``. Every strategy
scores the pool, leaves out what is labelled, keeps the first ``k`` and reveals
the gold tags of its picks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import scores as S
from gleaner.functions.hashing import race_key, uniform
from gleaner.operators import annotate, predictions as P, spans
from gleaner.operators.skew import at_most, cut_lineage
from gleaner.operators.topk import By, direct_most, first_k

RANDOM = "random"
ENTROPY = "entropy"
BREAKING_TIES = "breaking_ties"
LEAST_CONFIDENCE = "least_confidence"
STOCHASTIC_BREAKING_TIES = "stochastic_breaking_ties"
STRATEGIES = [RANDOM, ENTROPY, BREAKING_TIES, LEAST_CONFIDENCE, STOCHASTIC_BREAKING_TIES]

SENTENCE, ENTITY, TOKEN = "sentence", "entity", "token"
LEVELS = [SENTENCE, ENTITY, TOKEN]


@dataclass(frozen=True)
class QueryOutput:
    """What a query strategy returns."""

    selections: DataFrame
    """Picks: ``(sid)`` at sentence level, otherwise ``(sid, tid)``."""

    labelled_so_far: DataFrame
    """The labelled tokens before the query."""

    labelled: DataFrame
    """The labelled tokens with the picks revealed."""


def _token_score(strategy: str) -> Column:
    if strategy == ENTROPY:
        return S.entropy("scores")
    if strategy in (BREAKING_TIES, STOCHASTIC_BREAKING_TIES):
        return S.margin("scores")
    if strategy == LEAST_CONFIDENCE:
        return S.confidence("scores")
    raise ValueError(f"unknown strategy {strategy!r}")


def _ranked(scored: DataFrame, strategy: str, ids: list[str], seed: int) -> DataFrame:
    """Replace ``raw`` by the rounded number that the pool is sorted on."""
    if strategy == RANDOM:
        value = uniform(seed, *ids)
    elif strategy == STOCHASTIC_BREAKING_TIES:
        # 12 digits, so that a margin of float noise counts as a tie in any engine.
        value = race_key(uniform(seed, *ids), S.inverse_margin_log_weight(F.round("raw", 12)))
    else:
        value = F.round("raw", 9)
    return scored.withColumn("score", value).drop("raw")


def _order(strategy: str, ids: list[str]) -> list[By]:
    return [By("score", descending=strategy == ENTROPY), *[By(i) for i in ids]]


def rank_tokens(pred: DataFrame, labelled: DataFrame, strategy: str, k: int, seed: int = 1, spare: int = 0) -> DataFrame:
    """The first ``k`` unlabelled tokens as ``(sid, tid, score)``.

    Scores are computed before the anti join, so arrays are never shuffled.
    With ``spare`` above ``k`` the pool is not shuffled at all, where that many
    of its first tokens, labelled or not, can be gathered by sort and limit and
    hold ``k`` unlabelled ones: these come first among all unlabelled ones, too.
    It pays where ``labelled`` is stored and the pool is large.
    """
    if strategy == RANDOM:
        pool = pred.select("sid", "tid")
    else:
        pool = pred.select("sid", "tid", _token_score(strategy).alias("raw"))
    ids, order = ["sid", "tid"], _order(strategy, ["sid", "tid"])
    some = min(spare, direct_most(pool.sparkSession))
    if k < some:
        best = cut_lineage(first_k(_ranked(pool, strategy, ids, seed), order, some))
        taken = labelled.select(*ids).join(at_most(best.select(*ids), some), ids, "left_semi").distinct()
        free = cut_lineage(best.join(at_most(taken, some), ids, "left_anti"))
        if free.count() >= k or best.count() < some:
            return first_k(free, order, k)
    return first_k(_ranked(P.without_labelled_tokens(pool, labelled), strategy, ids, seed), order, k)


def rank_sentences(
    pred: DataFrame,
    labelled: DataFrame,
    strategy: str,
    k: int,
    seed: int = 1,
    aggregate: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """The first ``k`` sentences without any annotation as ``(sid, score)``.

    ``aggregate`` turns the token scores of a sentence into one number; by
    default the most uncertain token speaks for its sentence. The built-in
    aggregates combine on the map side, so a long sentence is no hot spot.
    """
    if strategy == RANDOM:
        pool = pred.select("sid").distinct()
    else:
        agg = aggregate or (F.max if strategy == ENTROPY else F.min)
        pool = pred.select("sid", _token_score(strategy).alias("t")).groupBy("sid").agg(agg(F.col("t")).alias("raw"))
    pool = P.without_labelled_sentences(pool, labelled)
    return first_k(_ranked(pool, strategy, ["sid"], seed), _order(strategy, ["sid"]), k)


def rank_rows(pred: DataFrame, strategy: str, k: int, seed: int = 1, lowest_class: bool = True) -> DataFrame:
    """The first ``k`` rows of a sentence-classification pool ``(id, scores)``.

    Least confidence ranks by the smallest class score when ``lowest_class`` is
    set, which is what users of this measure have relied on, and by the largest
    otherwise. Nothing is left out: the pool is taken as given.
    """
    if strategy == RANDOM:
        pool = pred.select("id")
    elif strategy == LEAST_CONFIDENCE and lowest_class:
        pool = pred.select("id", S.lowest("scores").alias("raw"))
    else:
        pool = pred.select("id", _token_score(strategy).alias("raw"))
    return first_k(_ranked(pool, strategy, ["id"], seed), _order(strategy, ["id"]), k)


def query(
    level: str,
    strategy: str,
    pred: DataFrame,
    tokens: DataFrame,
    labelled: DataFrame,
    k: int,
    seed: int = 1,
    aggregate: Callable[[Column], Column] | None = None,
    guard: bool = True,
    expected: tuple[int, int] | None = None,
    spare: int = 0,
) -> QueryOutput:
    """Run one query strategy at one cost level.

    ``k`` counts sentences, seed tokens or tokens. At entity level a seed
    reveals the whole run of entity tokens around it, so more than ``k`` tokens
    may be annotated and two seeds in one run count once. The picks are used
    several times over, so they are computed and stored first: the pool is
    scored once.

    Unless ``guard`` is off, predictions must be there for exactly the positions
    of ``tokens``; their keys are summed up in the job that scores the pool.
    ``expected`` is ``key_sum(tokens)`` where the caller knows it already;
    ``spare`` is that of ``rank_tokens``.
    """
    if level not in LEVELS:
        raise ValueError(f"unknown level {level!r}")
    watched, seen = pred, None
    if guard:
        expected = expected or P.key_sum(tokens)
        watched, seen = P.watched(pred.select("sid", "tid") if strategy == RANDOM else pred)
    if level == SENTENCE:
        picks = cut_lineage(rank_sentences(watched, labelled, strategy, k, seed, aggregate).select("sid"))
    else:
        seeds = cut_lineage(rank_tokens(watched, labelled, strategy, k, seed, spare).select("sid", "tid"))
    if seen is not None and k > 0:
        P.require_same_tokens(seen, pred, tokens, expected)
    if level == SENTENCE:
        return QueryOutput(picks, labelled, annotate.sentences(tokens, labelled, picks, k))
    if level == TOKEN:
        return QueryOutput(seeds, labelled, annotate.tokens(tokens, labelled, seeds))
    picks = cut_lineage(spans.expand_runs(seeds, tokens, k))
    return QueryOutput(picks, labelled, annotate.tokens(tokens, labelled, picks))
