"""A fact dealt out once, for its join onto a large dimension and for what
follows the join.

A join that shuffles the fact by the dimension's key, then a layout that
shuffles it again, move every row twice.  Here the fact goes once to parts of
(group, range of keys), and each row of the dimension to the parts of its
range, one in each group: the join runs where rows then stay.  This pays as
long as ``groups`` rows of the dimension for each of its rows cost less than
moving the fact once more.  Where groups follow from another dimension's key
(``key_group``), its rows go to their group in every range, and one move of
the fact serves both joins.

Ranges and groups have about as many rows each: they are cut at quantiles of a
sample of the fact.  A value that fills several ranges is spread over them by
a hash of the row, with the dimension's rows in all of them, so neither a hot
key nor a hot group is one task's alone.  The sample decides where rows lie,
never which rows there are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import groupby
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeromart.operators.joins import join_dimension

#: Number of a row's part; there only between the join and what follows it.
PART = "_part"
#: Rows of the fact by which ranges and groups are cut.
SAMPLE_ROWS = 20_000
#: Ranges of keys; where more parts are asked for, each is dealt on by a hash of the key.
MOST_RANGES = 64


def cuts(values: Sequence[Any], parts: int) -> list:
    """``parts`` - 1 values, in order, that cut ``values`` into parts of as many rows."""
    known = sorted(v for v in values if v is not None)
    # half a part further where each value may fill one: the cuts fall inside values
    shift = 0.5 if len(set(known)) <= parts else 0.0
    return [known[int((i + shift) * len(known) / parts)] for i in range(1, parts)] if known else []


def _found(c: Column, at: Sequence[Any], leaf: Callable[[int, int], Column], none: Column) -> Column:
    """``leaf(first, last)`` of the parts between the cuts ``at`` that a
    value belongs to; a value that is equal to n > 1 cuts has n parts."""
    runs = [(v, len(list(same))) for v, same in groupby(at)]
    ends = [0]
    for _, n in runs:
        ends.append(ends[-1] + n)

    def between(k: int) -> Column:
        value, n = runs[k - 1] if k else (None, 0)
        plain = leaf(ends[k], ends[k])
        return F.when(c == F.lit(value), leaf(ends[k] - n + 1, ends[k])).otherwise(plain) if n > 1 else plain

    def search(low: int, high: int) -> Column:
        if low == high:
            return between(low)
        middle = (low + high) // 2
        return F.when(c < F.lit(runs[middle][0]), search(low, middle)).otherwise(search(middle + 1, high))

    return F.when(c.isNull(), none).otherwise(search(0, len(runs)))


def place(c: Column, at: Sequence[Any], spread: Column) -> Column:
    """The part of a row; rows of a value with several parts, and rows without
    a value, are dealt to them by ``spread``."""
    return _found(
        c, at, lambda first, last: F.lit(first) if first == last else F.lit(first) + F.pmod(spread, F.lit(last - first + 1)).cast("int"), F.pmod(spread, F.lit(len(at) + 1)).cast("int")
    )


def places(c: Column, at: Sequence[Any]) -> Column:
    """All parts in which ``place`` may put rows of a value (none: no value)."""
    return _found(c, at, lambda first, last: F.array(*[F.lit(i) for i in range(first, last + 1)]), F.array().cast("array<int>"))


@dataclass(frozen=True)
class Dealing:
    """How rows of a fact are dealt by ranges of ``key`` and by ``group``."""

    key: str
    group: Column
    ranges: int
    groups: int
    dealt_on: int
    by_key: list
    by_group: list

    @classmethod
    def of(cls, sample: DataFrame, key: str, group: Column, groups: int, parts: int) -> Dealing:
        """About ``parts`` parts; ``sample`` has columns (key, group) of all rows of the fact."""
        rows = sample.toDF("key", "group").orderBy(F.rand(7)).limit(SAMPLE_ROWS).collect()
        wanted = max(1, -(-parts // groups))
        ranges = min(wanted, MOST_RANGES)
        return cls(key, group, ranges, groups, -(-wanted // ranges), cuts([r["key"] for r in rows], ranges), cuts([r["group"] for r in rows], groups))

    @property
    def total(self) -> int:
        return self.ranges * self.dealt_on * self.groups

    def _first(self, range_: Column) -> Column:
        """First part of a range; equal keys have the same remainder."""
        rest = F.pmod(F.xxhash64(self.key), F.lit(self.dealt_on)).cast("int")
        return (range_ * self.dealt_on + rest) * self.groups

    def fact(self, fact: DataFrame) -> DataFrame:
        spread = F.xxhash64(*fact.columns)
        part = self._first(place(F.col(self.key), self.by_key, spread)) + place(self.group, self.by_group, F.shiftright(spread, 20))
        return fact.withColumn(PART, part).repartitionById(self.total, PART)

    def for_keys(self, dim: DataFrame) -> DataFrame:
        """Rows of a dimension in all parts that hold rows of their ``key``; those without one join nothing."""
        ranges = dim.withColumn(PART, F.explode(places(F.col(self.key), self.by_key)))
        first = self._first(F.col(PART))
        return ranges.withColumn(PART, F.explode(F.sequence(first, first + F.lit(self.groups - 1)))).repartitionById(self.total, PART)

    def for_groups(self, dim: DataFrame) -> DataFrame:
        """The same by ``group``, which follows from a dimension's own key."""
        groups = dim.withColumn(PART, F.explode(places(self.group, self.by_group)))
        return groups.withColumn(PART, F.explode(F.sequence(F.col(PART), F.lit(self.total - 1), F.lit(self.groups)))).repartitionById(self.total, PART)


def key_group(key: str) -> Column:
    """Groups of a dimension's key by its hash; cuts part them into as many rows."""
    return F.when(F.col(key).isNotNull(), F.pmod(F.xxhash64(key), F.lit(1 << 20)).cast("int"))


def join_dealt(fact: DataFrame, dim: DataFrame, dealing: Dealing) -> DataFrame:
    """``join_dimension`` on the dealing's key, and ``PART`` of each row."""
    fact = fact if PART in fact.columns else dealing.fact(fact)
    return join_dimension(fact, dealing.for_keys(dim), [dealing.key, PART])


def join_dealt_group(fact: DataFrame, dim: DataFrame, dealing: Dealing, on: str) -> DataFrame:
    """``join_dimension`` on the key that the dealing's group follows from."""
    fact = fact if PART in fact.columns else dealing.fact(fact)
    return join_dimension(fact, dealing.for_groups(dim), [on, PART])
