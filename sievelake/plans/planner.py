"""Conjunctions over one or many columns, most selective predicate first.

Catalyst keeps the order of conjuncts and generated code stops at the first that fails, so ordering them here is the
whole of the strategy. Equal scores keep the order in which they were given.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions.pattern import Analysis, Pattern, analyze
from sievelake.functions.predicate import ilike, like

#: The four operators by number and name.
OPERATORS = {1: "LIKE", 2: "NOT LIKE", 3: "ILIKE", 4: "NOT ILIKE"}


@dataclass(frozen=True)
class Predicate:
    """column OPERATOR pattern; the column is a name or any string expression. A null pattern lets no row pass."""

    column: str | Column
    operator: str
    pattern: str | None
    escape: str | None = "\\"

    def __post_init__(self) -> None:
        if self.operator not in OPERATORS.values():
            raise ValueError(f"unknown operator {self.operator!r}")

    @property
    def negated(self) -> bool:
        return self.operator.startswith("NOT")

    @property
    def ignores_case(self) -> bool:
        return self.operator.endswith("ILIKE")

    @property
    def parsed(self) -> Pattern | None:
        return None if self.pattern is None else Pattern.parse(self.pattern, self.escape)

    @property
    def analysis(self) -> Analysis | None:
        return None if self.pattern is None else analyze(self.parsed, self.negated)

    def condition(self) -> Column:
        found = (ilike if self.ignores_case else like)(self.column, self.pattern, escape=self.escape)
        return ~found if self.negated else found


def ordered(predicates: Iterable[Predicate]) -> list[Predicate]:
    """Most selective first; a null pattern, which nothing passes, before all."""
    return sorted(predicates, key=lambda p: -1.0 if p.pattern is None else p.analysis.selectivity)


def conjunction(predicates: Iterable[Predicate]) -> Column:
    """All predicates in planned order as one condition; none: true."""
    return reduce(lambda a, b: a & b, [p.condition() for p in ordered(predicates)]) if (predicates := list(predicates)) else F.lit(True)


def explain(predicates: Iterable[Predicate]) -> list[dict]:
    """The plan as rows: place, column, operator, pattern, kind and scores."""
    return [
        {
            "place": i, "column": str(p.column), "operator": p.operator, "pattern": p.pattern, "kind": p.parsed.kind if p.parsed else "null",
            "selectivity": p.analysis.selectivity if p.parsed else 0.0, "anchor_strength": p.analysis.anchor_strength if p.parsed else 0,
        }
        for i, p in enumerate(ordered(predicates))
    ]


def where(df: DataFrame, predicates: Iterable[Predicate], *companions: Column) -> DataFrame:
    """Rows that pass all predicates and companion conditions; cheap companions (=, <, BETWEEN) go first."""
    return df.where(reduce(lambda a, b: a & b, [*companions, conjunction(predicates)]))
