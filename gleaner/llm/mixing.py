"""Sources mixed to target weights by iterative proportional fitting.

Documents are summed up to cells, one for each combination of source, language
and topic. Token weights of the cells are scaled to each marginal in turn until
all fit; then each document is kept with the probability that its cell calls
for, so that the kept tokens meet the budget in expectation. Documents are read
to be counted and to be drawn; all fitting happens on the cells.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.hashing import uniform
from gleaner.llm.store import stored
from gleaner.operators.skew import at_most

DIMENSIONS = ("source", "lang", "topic")
TEMPERATURES = {"source": 0.7, "lang": 0.5, "topic": 0.7}
"""Exponent of a value's share of tokens in its target share: 1 keeps it, 0 makes all values equal."""
ROUNDS = 8
BUDGET = 0.5
"""Share of all tokens to keep."""
CALIBRATIONS = 12
SEED = 8
UNKNOWN = "unknown"

#: Topic by the shape of a text, first match counts; ``n_tokens`` are its words.
TOPICS = (
    ("instr(text, ' | ') > 0", "table"),
    ("instr(text, '@') > 0 or instr(text, 'http') > 0", "contact"),
    ("n_tokens < 100", "short"),
    ("n_tokens > 1000", "long"),
)


SMALL_CELLS = 10_000
"""Up to so many cells, as counted, are fitted on the driver; beyond by joins, with the same result."""


def features(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``topic``; null sources, languages and texts count as unknown and empty.

    Columns of the same names are replaced.
    """
    topic = F.lit("prose")
    for test, name in reversed(TOPICS):
        topic = F.when(F.expr(test), F.lit(name)).otherwise(topic)
    counted = docs.withColumn("n_tokens", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"))
    filled = {c: F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)) for c in ("source", "lang")}
    return counted.withColumns({"topic": topic, **filled})


def tempered(cells: DataFrame, dimension: str, exponent: float) -> DataFrame:
    """Target shares ``dimension, target``: each value's share of tokens, raised to ``exponent`` and scaled to 1."""
    sums = cells.groupBy(dimension).agg(F.sum("tokens").cast("double").alias("s")).where("s > 0").withColumn("s", F.pow("s", F.lit(exponent)))
    return sums.crossJoin(F.broadcast(sums.agg(F.sum("s").alias("all")))).select(dimension, (F.col("s") / F.col("all")).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """Cells (dimensions and ``tokens``) with ``weight``, their share of tokens after fitting.

    A value without a target keeps no weight; targets of values without tokens
    can't be met and leave the others as they are. Each round is one job over
    the cells; sums add up before they are shuffled, and the way back is a join
    that Spark can split, so a value that most cells share is no bottleneck.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    now = cells.withColumn("weight", F.col("tokens") / F.lit(float(total)))
    for _ in range(rounds):
        for dimension, target in targets.items():
            sums = now.groupBy(dimension).agg(F.sum("weight").alias("_sum")).join(target, dimension, "left")
            factor = sums.select(dimension, F.when(F.col("_sum") > 0, F.coalesce("target", F.lit(0.0)) / F.col("_sum")).otherwise(0.0).alias("_factor"))
            now = now.join(factor, dimension).withColumn("weight", F.col("weight") * F.col("_factor")).drop("_factor")
        now = stored(now)
    return now


def calibrated(raked: DataFrame, budget: float = BUDGET, steps: int = CALIBRATIONS) -> DataFrame:
    """Raked cells with ``prob``, the probability with which each of their documents is kept.

    It is ``min(1, c * weight / share of tokens)``, with ``c`` such that the
    expected tokens are ``budget`` of all. Cells that reach 1 are set and ``c``
    is found again from the rest; this only ever grows and ends when no more
    cells reach 1. Cells without tokens or weight have probability 0.
    """
    total = float(raked.agg(F.sum("tokens")).first()[0] or 1)
    rows = raked.withColumn("_ratio", F.when(F.col("tokens") > 0, F.col("weight") * F.lit(total) / F.col("tokens")).otherwise(0.0))
    c, before = 0.0, None
    for _ in range(steps):
        full = F.col("_ratio") * F.lit(c) >= 1
        row = rows.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("set"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("rest"),
                       F.count_if(full).alias("n")).first()
        if row["n"] == before or not row["rest"]:
            break
        c, before = max(c, (budget - row["set"] / total) / row["rest"]), row["n"]
    return rows.withColumn("prob", F.least(F.lit(1.0), F.round(F.col("_ratio") * F.lit(c), 9))).drop("_ratio")


def fitted(rows: DataFrame, exponents: dict[str, float] | None = None, budget: float = BUDGET) -> DataFrame:
    """Cells of ``rows`` (with dimensions and ``n_tokens``) with ``tokens, weight`` and ``prob``."""
    exponents = exponents or TEMPERATURES
    cells = stored(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")))
    if cells.count() <= SMALL_CELLS:
        return _fitted_here(cells, exponents, budget)
    return stored(calibrated(rake(cells, {d: stored(tempered(cells, d, e)) for d, e in exponents.items()}), budget))


def _fitted_here(cells: DataFrame, exponents: dict[str, float], budget: float) -> DataFrame:
    """``fitted`` for a counted, small number of cells: the same steps on the driver, in place of a job with joins for each."""
    found = sorted(cells.collect(), key=lambda r: tuple(r[d] for d in DIMENSIONS))
    tokens = np.array([float(r["tokens"] or 0) for r in found])
    total = tokens.sum() or 1.0
    weight = tokens / total
    dealt = {}
    for d, exponent in exponents.items():
        _, at = np.unique([r[d] for r in found], return_inverse=True) if found else (None, np.zeros(0, np.int64))
        sums = np.bincount(at, tokens)
        powers = np.where(sums > 0, np.maximum(sums, 1e-300) ** exponent, 0.0)
        dealt[d] = at, powers / (powers.sum() or 1.0)
    for _ in range(ROUNDS):
        for at, target in dealt.values():
            sums = np.bincount(at, weight)
            weight = weight * np.where(sums > 0, target / np.where(sums > 0, sums, 1.0), 0.0)[at]
    ratio = np.where(tokens > 0, weight * total / np.where(tokens > 0, tokens, 1.0), 0.0)
    c, before = 0.0, None
    for _ in range(CALIBRATIONS):
        full = ratio * c >= 1
        rest = weight[~full].sum()
        if full.sum() == before or not rest:
            break
        c, before = max(c, (budget - tokens[full].sum() / total) / rest), full.sum()
    rows = [(*[r[d] for d in DIMENSIONS], r["tokens"], float(w), float(q * c)) for r, w, q in zip(found, weight, ratio, strict=True)]
    schema = ", ".join(f"{n} {t}" for n, t in cells.select(*DIMENSIONS, "tokens").dtypes) + ", weight double, prob double"
    made = cells.sparkSession.createDataFrame(rows, schema)
    return stored(made.withColumn("prob", F.least(F.lit(1.0), F.round("prob", 9))))


def drawn() -> Column:
    """Whether a document with ``doc_id``, ``prob`` and ``n_tokens`` is kept; the same on every run and retry.

    One without words adds nothing to the mix and is not.
    """
    return (uniform(SEED, "doc_id") < F.col("prob")) & (F.col("n_tokens") > 0)


def mixed(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """``rows`` with the ``tokens, weight, prob`` of their cell and ``sampled``.

    Repeated ids are drawn alike; a null id counts as one id.
    """
    return rows.join(at_most(cells, cells.count()), list(DIMENSIONS)).withColumn("sampled", drawn())
