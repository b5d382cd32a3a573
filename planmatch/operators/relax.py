"""Constraint relaxation for one request.

Wanted: give up the conditions on the least relevant column, then the next, and
so on, only until some row qualifies. A row's *level* is the highest relevance
rank among the conditions it violates, so the smallest level over the catalog is
the number of steps needed, and one aggregate over the constrained columns
replaces the whole retry loop.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planmatch.functions.predicates import Condition, conjunction, violated


def label_ranks(labels: Sequence[str]) -> dict[str, int]:
    """1-based rank per label, ascending relevance; a repeat keeps its first place."""
    ranks: dict[str, int] = {}
    for place, label in enumerate(labels, start=1):
        ranks.setdefault(label, place)
    return ranks


def row_level(conds: Sequence[Condition], labels: Sequence[str]) -> Column:
    """Steps after which a row qualifies; null when it never does."""
    ranks = label_ranks(labels)
    level = F.lit(0)
    fixed = F.lit(True)
    for cond in conds:
        if cond.column in ranks:
            level = F.greatest(level, F.when(violated(cond), ranks[cond.column]).otherwise(0))
        else:
            fixed = fixed & ~violated(cond)
    return F.when(fixed, level)


@dataclass(frozen=True)
class Relaxed:
    """Outcome for one request."""

    rows: DataFrame
    level: int
    dropped: tuple[str, ...]
    kept: tuple[Condition, ...]
    is_empty: bool


def relax_single(
    catalog: DataFrame, conds: Sequence[Condition], labels: Sequence[str]
) -> Relaxed:
    """`labels` come least relevant first.

    Two passes: a one-row aggregate reading only the constrained columns, then a
    plain filter with the surviving conditions, which reaches the file scan.
    """
    conds, labels = tuple(conds), tuple(labels)
    best = catalog.agg(F.min(row_level(conds, labels)).alias("best")).first()["best"]
    level = len(labels) if best is None else best
    dropped = labels[:level]
    kept = drop_conditions_on(conds, dropped)
    return Relaxed(catalog.where(conjunction(kept)), level, dropped, kept, best is None)


def drop_conditions_on(
    conds: Sequence[Condition], dropped: Sequence[str]
) -> tuple[Condition, ...]:
    """Every condition on a dropped column goes, the rest stays in order."""
    gone = set(dropped)
    return tuple(c for c in conds if c.column not in gone)
