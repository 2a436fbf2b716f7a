"""Uncertainty of one score vector (an ``ARRAY<DOUBLE>`` column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARGIN_FLOOR = 1e-12


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def _each(values: Column, one: Column) -> Column:
    """``one`` repeated for every element, for use with ``zip_with``.

    A lambda would evaluate an outer expression again for each element.
    """
    return F.array_repeat(one, F.size(values))


def softmax(logits: Column | str) -> Column:
    """Softmax, shifted by the largest logit so that ``exp`` cannot overflow."""
    logits = _col(logits).cast("array<double>")
    powers = F.zip_with(logits, _each(logits, F.array_max(logits)), lambda v, top: F.exp(v - top))
    return F.zip_with(powers, _each(logits, _total(powers)), lambda p, total: p / total)


def entropy(scores: Column | str) -> Column:
    """Shannon entropy in nats of the scores scaled to sum 1; ``0 ln 0`` is 0, and so is that of zeros only.

    Written as ``ln s - sum(p ln p) / s``, which needs the sum only once at
    the end.
    """
    scores = _col(scores)
    total = _total(scores)
    weighted = F.aggregate(
        scores,
        F.lit(0.0),
        lambda acc, p: acc + F.when(p > 0, p * F.log(p)).otherwise(F.lit(0.0)),
    )
    return F.when(total > 0, F.log(total) - weighted / total).when(total <= 0, 0.0)


def margin(scores: Column | str) -> Column:
    """Largest score minus the second largest; null with fewer than two.

    The second largest is the largest of what stands before and behind the
    first: a few passes of compiled code, however long the vector.
    """
    scores = _col(scores)
    top = F.array_max(scores)
    at = F.array_position(scores, top).cast("int")
    left = F.array_max(F.slice(scores, F.lit(1), at - 1))
    right = F.array_max(F.slice(scores, at + 1, F.size(scores) - at))
    return top - F.greatest(left, right)


def confidence(scores: Column | str) -> Column:
    """Largest score."""
    return F.array_max(_col(scores))


def lowest(scores: Column | str) -> Column:
    """Smallest score."""
    return F.array_min(_col(scores))


def inverse_margin_log_weight(margin_value: Column) -> Column:
    """``ln(1 / margin)``, finite when two classes tie exactly."""
    return -F.log(F.greatest(margin_value, F.lit(MARGIN_FLOOR)))


def argmax(scores: Column | str) -> Column:
    """0-based position of the largest score, the first one on a tie."""
    scores = _col(scores)
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
