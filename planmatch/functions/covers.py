"""Intervals as short lists of tree nodes, so that "between" becomes "equal".

Cells 0 .. 2^depth-1 are the leaves of a binary tree, node numbers as in a heap
(root 1, children 2x and 2x+1). Any interval of cells is the disjoint union of at
most two nodes per level, and a cell lies in the interval exactly when one of its
ancestors is among them. A range join turns into an equi-join on node numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def depth_for(cells: int) -> int:
    """Smallest depth that leaves at least one leaf beyond the last cell."""
    return max(1, cells.bit_length())


def _shift(value: Column, steps: Column) -> Column:
    return F.call_function("shiftright", value, steps)


def leaf(cell: Column, depth: int) -> Column:
    return cell + F.lit(1 << depth)


def ancestors(cell: Column, depth: int) -> Column:
    """The leaf of a cell and every node above it."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(depth)), lambda j: _shift(leaf(cell, depth), j)
    )


def interval_cover(low: Column, high: Column, depth: int) -> Column:
    """Disjoint nodes that together hold the cells low..high; empty when low > high.

    Starting from cell 0 only even nodes are used; ending at the last leaf only
    odd ones.
    """

    def on_level(j: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(1), j)
        left = _shift(leaf(low, depth) + width - 1, j)
        right = _shift(leaf(high, depth) + 1, j)
        open_ = left < right
        return F.filter(
            F.array(
                F.when(open_ & (left % 2 == 1), left),
                F.when(open_ & (right % 2 == 1), right - 1),
            ),
            lambda node: node.isNotNull(),
        )

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(depth)), on_level))
