"""First rows by price for many requests at once: bitmaps over cells in price order.

Where many numeric columns are constrained together, cells are neither listed under tree
nodes nor compared with every probe. They are put into ranges of price, and every task
indexes its cells, in order, in chunks: per column the values are cut into at most BINS
bins, and a bitmap per bin boundary holds the cells at or below it. The AND of two boundary
bitmaps per constrained column is a superset of the cells that a probe meets, in price
order; only these are compared with the probe itself, and only until it has its rows. A
probe that has its rows is left out of the dearer chunks of the task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Cells of a chunk; bins per column; cells that are looked at first.
CHUNK = 1 << 16
BINS = 64
FIRST = 1 << 12


@dataclass(frozen=True)
class Wish:
    """What a probe asks of one column: cells low..high and, where given, one of `points`
    (cell numbers, or texts of a column without order)."""

    axis: int
    low: int | None
    high: int | None
    points: tuple | None


def _bitmap(hits: np.ndarray) -> np.ndarray:
    packed = np.packbits(hits, bitorder="little")
    return np.pad(packed, (0, -len(packed) % 8)).view(np.uint64)


class CellIndex:
    """Cells in price order. `columns[axis]` are cell numbers, -1 where there is none, or
    texts (None where there is none)."""

    def __init__(self, size: int, columns: dict[int, np.ndarray]):
        self.size, self.columns = size, columns
        self.words = -(-self.size // 64)
        self.compared = 0  # cells that were compared with a probe one by one
        self._bins: dict[int, tuple] = {}
        self._held: dict[tuple, np.ndarray] = {}

    def _bin(self, axis: int) -> tuple:
        """(upper ends of bins, bitmaps of the cells up to each, whether bins are single
        values)."""
        if axis not in self._bins:
            column = self.columns[axis]
            values = np.unique(column[column >= 0])
            exact = len(values) <= BINS
            ends = values if exact else np.unique(values[np.linspace(0, len(values) - 1, BINS + 1).astype(int)[1:]])
            place = np.where(column >= 0, np.searchsorted(ends, column), len(ends))
            self._bins[axis] = ends, [_bitmap(place <= b) for b in range(len(ends))], exact
        return self._bins[axis]

    def _between(self, axis: int, low: int, high: int) -> tuple[np.ndarray, bool]:
        """(bitmap of a superset of the cells in low..high, whether it is exact)."""
        ends, upto, exact = self._bin(axis)
        first = int(np.searchsorted(ends, low))
        last = min(int(np.searchsorted(ends, high)), len(ends) - 1)
        if exact and last >= 0 and ends[last] > high:
            last -= 1
        if low > high or last < first:
            return np.zeros(self.words, np.uint64), True
        key = axis, first, last
        if key not in self._held:
            self._held[key] = upto[last] & ~upto[first - 1] if first else upto[last]
        return self._held[key], exact

    def _superset(self, wish: Wish) -> tuple[np.ndarray, bool]:
        if wish.low is None:  # texts
            key = wish.axis, wish.points
            if key not in self._held:
                hits = np.zeros(self.size, bool)
                for text in wish.points:
                    hits |= self.columns[wish.axis] == text
                self._held[key] = _bitmap(hits)
            return self._held[key], True
        if wish.points is None:
            return self._between(wish.axis, wish.low, wish.high)
        found, exact = np.zeros(self.words, np.uint64), True
        for point in wish.points:
            if wish.low <= point <= wish.high:
                cells, sure = self._between(wish.axis, point, point)
                found, exact = found | cells, exact and sure
        return found, exact

    def _meets(self, wish: Wish, at: np.ndarray) -> np.ndarray:
        have = self.columns[wish.axis][at]
        inside = (have >= wish.low) & (have <= wish.high)
        return inside if wish.points is None else inside & np.isin(have, wish.points)

    def first(self, probe: list[Wish], n: int) -> list[int]:
        """Places of the first `n` cells that meet every wish."""
        met = [(self._superset(w), w) for w in probe]
        open_ = [w for (_, exact), w in met if not exact]
        found: list[int] = []
        begin = 0
        for end in (FIRST // 64, self.words):
            if begin >= self.words or len(found) >= n:
                break
            if met:
                words = met[0][0][0][begin:end]
                for (bits, _), _ in met[1:]:
                    words = words & bits[begin:end]
                at = np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")) + 64 * begin
            else:
                at = np.arange(64 * begin, min(64 * end, self.size))
            begin = end
            if not open_:
                found += at[: n - len(found)].tolist()
                continue
            step = 16 * n
            for i in range(0, len(at), step):
                part = at[i : i + step]
                self.compared += len(part)
                for wish in open_:
                    part = part[self._meets(wish, part)]
                found += part[: n - len(found)].tolist()
                if len(found) >= n:
                    break
        return found


def probe_of(row, axes) -> list[Wish]:
    """Wishes of a collected probe row with a struct `w{i}` per axis."""
    probe = []
    for a in axes:
        wish = row[f"w{a.index}"]
        if wish is not None:
            points = None if wish["pts"] is None else tuple(wish["pts"])
            low, high = (wish["lo"], wish["hi"]) if a.numeric else (None, None)
            probe.append(Wish(a.index, low, high, points))
    return probe


def _column(cells: pa.Table, axis) -> np.ndarray:
    column = cells.column(f"c{axis.index}").combine_chunks()
    if axis.numeric:
        return np.asarray(column.fill_null(-1)).astype(np.int64)
    return np.array(column.to_pylist(), object)


def first_rows(cells: DataFrame, probes: list[tuple[bytes, list[Wish]]], axes, n: int) -> DataFrame:
    """(id, _price, _key, row) of the first `n` cells of every task that meet a probe.
    `cells` come in ranges of price, sorted; `probes` are a weighed block."""
    struct = T.StructType(
        [T.StructField("id", T.BinaryType()), *[cells.schema[c] for c in ("_price", "_key", "row")]]
    )
    arrow = to_arrow_schema(struct)

    def chunks(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= CHUNK:
                yield pa.Table.from_batches(held)
                held, size = [], 0
        if size:
            yield pa.Table.from_batches(held)

    def run(batches):
        left = [(number, n) for number in range(len(probes))]
        for table in chunks(batches):
            index = CellIndex(table.num_rows, {a.index: _column(table, a) for a in axes})
            at, who, still = [], [], []
            for number, wanted in left:
                found = index.first(probes[number][1], wanted)
                at += found
                who += [number] * len(found)
                if len(found) < wanted:
                    still.append((number, wanted - len(found)))
            left = still
            if at:
                rows = table.select(["_price", "_key", "row"]).take(pa.array(at, pa.int64()))
                ids = pa.chunked_array([pa.array([probes[i][0] for i in who], pa.binary())])
                full = pa.Table.from_arrays([ids, *rows.columns], names=arrow.names).cast(arrow)
                yield from full.combine_chunks().to_batches()
            if not left:
                # The rest of the task's cells are dearer: they are read and left.
                for _ in batches:
                    pass

    return cells.mapInArrow(run, struct)
