"""Conditions on catalog columns, built as Columns and never as query text."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numbers that mean "unlimited" in a catalog's numeric columns.
UNLIMITED = (99999999,)

OPS = ("=", "<=", ">=", "<", ">", "between", "in", "~")


def named(name: str) -> Column:
    """A column by its literal name; blanks, dots and brackets are fine."""
    escaped = name.replace("`", "``")
    return F.col(f"`{escaped}`")


@dataclass(frozen=True)
class Condition:
    """One conjunct: `column op value`; `between` and `in` take a sequence. `folded`: case,
    outer blanks and runs of blanks of a text column and of the wanted texts do not count."""

    column: str
    op: str
    value: object
    folded: bool = False

    def __post_init__(self) -> None:
        if self.op not in OPS:
            raise ValueError(f"unknown operator {self.op!r}")


def predicate(cond: Condition) -> Column:
    """The condition as a Column. A text column compared with numbers is compared as a
    number, and what is no number is missing; the column's type is known when the plan is
    made, so no choice is left in it."""
    col, value = named(cond.column), cond.value
    if cond.folded:
        return _folded(col, cond.op, value)
    if cond.op == "~":
        return close_to(col, str(value))
    values = [v for v in (value if cond.op in ("in", "between") else [value]) if v is not None]
    numbers = [v for v in values if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool)]
    plain = _compared(col, cond.op, value)
    if not values or len(numbers) < len(values):
        return plain
    as_number = _compared(col.try_cast("double"), cond.op, value)
    return F.when(F.typeof(col) == "string", as_number).otherwise(plain)


def _folded(col: Column, op: str, value: object) -> Column:
    col = normalise_category(col)
    several = op in ("in", "between")
    texts = [None if v is None else str(v) for v in (value if several else [value])]
    if op == "~":
        return close_to(col, " ".join(texts[0].split()))
    plain = [normalise_category(F.lit(t)) for t in texts]
    if op == "in":
        return reduce(lambda a, b: a | b, [col == t for t in plain], F.lit(False))
    return col.between(*plain) if several else _compared(col, op, plain[0])


def _compared(col: Column, op: str, value: object) -> Column:
    match op:
        case "=":
            return col == F.lit(value)
        case "<=":
            return col <= F.lit(value)
        case ">=":
            return col >= F.lit(value)
        case "<":
            return col < F.lit(value)
        case ">":
            return col > F.lit(value)
        case "between":
            low, high = value
            return col.between(F.lit(low), F.lit(high))
        case _:
            return col.isin(list(value))


def conjunction(conds: Iterable[Condition]) -> Column:
    """All conditions together; no condition keeps every row."""
    return reduce(lambda a, b: a & b, (predicate(c) for c in conds), F.lit(True))


def violated(cond: Condition) -> Column:
    """True unless the condition holds; a null comparison does not hold."""
    return ~F.coalesce(predicate(cond), F.lit(False))


def normalise_category(col: Column) -> Column:
    """Case, outer blanks and runs of blanks do not tell categories apart."""
    return F.lower(F.trim(F.regexp_replace(col, r"\s+", " ")))


def closeness_limit(text: str) -> int:
    """Edits allowed for a wanted category: a quarter of its length, at least one."""
    return max(1, len(text) // 4)


def close_to(col: Column, text: str) -> Column:
    """Approximate category match: few edits away, or containing the wanted text.

    The wanted side is a literal and the edit distance stops at its limit, so
    this stays a narrow filter; no distinct-then-join round trip is needed.
    """
    wanted = text.strip(" ").lower()
    limit = closeness_limit(wanted)
    have = F.lower(F.trim(col))
    distance = F.levenshtein(have, F.lit(wanted), limit)
    return distance.between(0, limit) | F.contains(have, F.lit(wanted))


def limited(col: Column, sentinels: Sequence[int] = UNLIMITED) -> Column:
    """Null where the value means "unlimited": for averages, not for comparisons."""
    return F.when(~col.isin(list(sentinels)), col)
