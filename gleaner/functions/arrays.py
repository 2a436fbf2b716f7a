"""Arrays inside a row.

Spark folds chained projections into one expression, and the body of a lambda
is evaluated once per element. A lambda that looks into a computed array would
therefore compute that array again for every element. Two ways around it:
look at neighbours by zipping shifted arrays, or compute the array first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def before(values: Column, fill: Column) -> Column:
    """The array moved one place to the right: each element's predecessor."""
    return F.slice(F.concat(F.array(fill), values), 1, F.size(values))


def after(values: Column, fill: Column) -> Column:
    """The array moved one place to the left: each element's successor."""
    return F.slice(F.concat(values, F.array(fill)), 2, F.size(values))


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add or replace columns that are evaluated exactly once per row."""
    kept = [c for c in df.columns if c not in columns]
    entry = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*kept, F.inline(F.array(entry)))
