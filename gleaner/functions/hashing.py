"""Seeded pseudo-random columns.

A draw is a function of the seed and the row's identity alone, so it is the
same under any partitioning, after a task retry and on every re-read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *ids: Column | str) -> Column:
    """A number strictly inside (0, 1), from 52 bits of ``md5(seed:id:id...)``."""
    parts = [F.lit(str(seed))]
    for i in ids:
        parts.append((F.col(i) if isinstance(i, str) else i).cast("string"))
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(2**52))


def before_place(head: Column, place: Column, share: float) -> Column:
    """``uniform(...) < share`` of ids that end with ``place``: ``head`` is the text ``seed:id:`` before it.

    Compares hexadecimal digits as text, which for many draws in a row costs a
    part of turning them into numbers.
    """
    bound = math.ceil(share * 2**52 - 0.5)  # both products are exact
    digits = F.substring(F.md5(F.concat(head, place.cast("string")).cast("binary")), 1, 13)
    return F.lit(True) if bound >= 2**52 else digits < F.lit(f"{max(bound, 0):013x}")


def race_key(u: Column, log_weight: Column) -> Column:
    """Sort key for weighted sampling without replacement: keep the smallest.

    The rows with the k smallest ``-ln(u) / w`` are a draw of k rows without
    replacement with probabilities proportional to ``w`` (Efraimidis and
    Spirakis, 2006). The logarithm of that key gives the same order and takes
    the weight in log form, so softmax weights need neither a maximum nor a
    sum over the table.
    """
    return F.round(F.log(-F.log(u)) - log_weight, 9)
