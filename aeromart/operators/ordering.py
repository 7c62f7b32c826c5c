"""Sorting and top-n with the reference's null placement (N9-N11).

Ties are broken by the grouping keys (ascending, nulls first) so that a
top-n list is repeatable.  ``orderBy(...).limit(n)`` plans as
``TakeOrderedAndProject``: a per-partition top-n and a merge of n rows per
partition, never a full sort of the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def desc_first(c: str) -> Column:
    """Descending, nulls first: the reference's default placement."""
    return F.desc_nulls_first(c)


def desc_last(c: str) -> Column:
    return F.desc_nulls_last(c)


def asc_first(c: str) -> Column:
    return F.asc_nulls_first(c)


def sort_with_ties(df: DataFrame, primary: Sequence[Column], tie_keys: Sequence[str]) -> DataFrame:
    return df.orderBy(*primary, *[asc_first(k) for k in tie_keys if k in df.columns])


def top_n(df: DataFrame, n: int | None) -> DataFrame:
    """TOP1: a falsy n keeps every row; a negative n is rejected (N11)."""
    if not n:
        return df
    if n < 0:
        raise ValueError("top_n must be positive, zero or None")
    return df.limit(n)


def with_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Number rows of an already limited list in the given order.

    Only for short lists (after ``top_n``): the window has no partition
    key and therefore runs in one task.
    """
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
