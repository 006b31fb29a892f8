"""Decision tables over pairs: ordered rows of a condition and a value, compiled to one expression.

A pair has the fingerprints ``a`` and ``c`` of its anchor and candidate (map
of axis to values) and the kinds ``a_kind``, ``c_kind``.  Tables are read by
first match, added up, or taken as refusals; a table of any length is one
projection, without a join or a Python worker.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F



def _values(side: str, axis: str) -> Column:
    none = F.expr("cast(array() as array<string>)")
    of = lambda c: F.coalesce(F.try_element_at(c, F.lit(axis)), none)
    return F.array_intersect(of("a"), of("c")) if side == "shared" else of("a" if side == "anchor" else "c")


class Condition:
    def column(self) -> Column:
        raise NotImplementedError

    def __and__(self, other: Condition) -> Condition:
        return All((self, other))

    def __or__(self, other: Condition) -> Condition:
        return Any((self, other))

    def __invert__(self) -> Condition:
        return Not(self)


@dataclass(frozen=True)
class Has(Condition):
    """Whether ``side`` (anchor, candidate, shared) has one of the values on an axis; without values, anything at all."""

    side: str
    axis: str
    values: tuple[str, ...] = ()

    def column(self) -> Column:
        found = _values(self.side, self.axis)
        return F.arrays_overlap(found, F.array(*map(F.lit, self.values))) if self.values else F.size(found) > 0


@dataclass(frozen=True)
class Kind(Condition):
    """Whether the kind of ``side`` (anchor, candidate) is one of these."""

    side: str
    kinds: tuple[str, ...]

    def column(self) -> Column:
        return F.coalesce(F.col("a_kind" if self.side == "anchor" else "c_kind").isin(*self.kinds), F.lit(False))


@dataclass(frozen=True)
class Flag(Condition):
    """A boolean column of the pairs; null is false."""

    name: str

    def column(self) -> Column:
        return F.coalesce(F.col(self.name), F.lit(False))


@dataclass(frozen=True)
class All(Condition):
    parts: tuple[Condition, ...]

    def column(self) -> Column:
        return reduce(lambda x, y: x & y, [p.column() for p in self.parts], F.lit(True))


@dataclass(frozen=True)
class Any(Condition):
    parts: tuple[Condition, ...]

    def column(self) -> Column:
        return reduce(lambda x, y: x | y, [p.column() for p in self.parts], F.lit(False))


@dataclass(frozen=True)
class Not(Condition):
    part: Condition

    def column(self) -> Column:
        return ~self.part.column()


@dataclass(frozen=True)
class AtLeast(Condition):
    """Whether so many of the parts hold."""

    least: int
    parts: tuple[Condition, ...]

    def column(self) -> Column:
        return hits(self.parts) >= self.least


@dataclass(frozen=True)
class Rule:
    """A named row; ``value`` is a name in tables that are read by first match and hundredths in those that are added up."""

    name: str
    when: Condition
    value: str | int | None = None


def hits(parts: tuple[Condition, ...]) -> Column:
    """How many of the conditions hold."""
    return sum((F.when(p.column(), 1).otherwise(0) for p in parts), F.lit(0))


def first(rules: list[Rule], otherwise: str | None = None) -> Column:
    """The value of the first row that holds."""
    out = F.lit(otherwise).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.when.column(), F.lit(rule.value)).otherwise(out)
    return out


def total(rules: list[Rule]) -> Column:
    """The sum of the values, in hundredths, of all rows that hold; whole numbers, so that order doesn't matter."""
    return sum((F.when(r.when.column(), F.lit(r.value)).otherwise(0) for r in rules), F.lit(0))


def reasons(rules: list[Rule]) -> Column:
    """The names of the rows that hold, in the table's order."""
    return F.filter(F.array(*[F.when(r.when.column(), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())


def adjustment(tables: list[list[Rule]]) -> Column:
    """What each table's first row that holds gives, added up over the tables, as a number: a table of one row is a plain addition."""
    each = [reduce(lambda rest, r: F.when(r.when.column(), F.lit(r.value)).otherwise(rest), reversed(rows), F.lit(0)) for rows in tables]
    return sum(each, F.lit(0)).cast("double") / 100


def lane_fit(refusals: list[Rule], weights: dict[str, int], bonuses: list[Rule]) -> Column:
    """How well a candidate fits a lane: tenths for each shared value of an axis, and the bonuses; null if a refusal holds."""
    shared = sum((F.size(_values("shared", axis)) * w for axis, w in weights.items()), F.lit(0))
    fit = (shared * 10 + total(bonuses)).cast("double") / 100
    return F.when(~Any(tuple(r.when for r in refusals)).column(), fit) if refusals else fit
