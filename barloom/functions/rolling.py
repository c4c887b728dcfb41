"""Sliding aggregates whose cost per row does not grow with the window.

Spark evaluates a bounded ROWS frame by visiting every row of the frame again for each
row. A frame of n rows is therefore put together from short tiles: the tile aggregate is
evaluated once per row, and earlier tiles of the same frame are read back with `lag`.
All steps use one window specification, so they share one exchange and one sort.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.schema import DATE, SYMBOL

TILE = 20


class Rolling:
    """Collects the tiles that a set of sliding aggregates needs.

    Ask for aggregates first, then call `attach` and use the returned columns on its result.
    `skip` moves a frame back by that many rows.
    """

    def __init__(self, by: str = SYMBOL, order: str = DATE, tile: int = TILE):
        self.window = Window.partitionBy(by).orderBy(order)
        self.tile = tile
        self._tiles: dict[str, Column] = {}
        self._lags: dict[str, Column] = {}
        self._means: dict[str, Column] = {}

    def attach(self, df: DataFrame) -> DataFrame:
        # means are columns of their own, so that a deviation does not repeat their formula
        for columns in (self._tiles, self._lags, self._means):
            df = df.withColumns(columns) if columns else df
        return df

    @property
    def scratch_columns(self) -> list[str]:
        return [*self._tiles, *self._lags, *self._means]

    def _part(self, kind: str, column: str, size: int, skip: int) -> Column:
        """The aggregate over `size` rows that end `skip` rows back."""
        aggregate = {
            "max": F.max,
            "min": F.min,
            "sum": F.sum,
            "count": F.count,
            "avg": F.avg,
            "var": F.var_pop,
        }[kind]
        name = f"_tile_{kind}_{column}_{size}"
        if name not in self._tiles:
            tile = aggregate(column).over(self.window.rowsBetween(1 - size, 0))
            self._tiles[name] = tile if kind in ("max", "min", "count") else F.coalesce(tile, F.lit(0.0))
        empty = {"max": None, "min": None, "count": 0}.get(kind, 0.0)
        return self.back(name, skip, empty)

    def back(self, column: str, skip: int, empty: float | None = None) -> Column:
        """A column `skip` rows earlier, `empty` before the first row."""
        if skip == 0:
            return F.col(column)
        name = f"_lag{skip}_{column}"
        if name not in self._lags:
            self._lags[name] = F.lag(column, skip, empty).over(self.window)
        return F.col(name)

    def _running(self, kind: str, column: str, rows: int, skip: int) -> Column:
        name = f"_run_{kind}_{column}"
        if name not in self._tiles:
            total = (F.count if kind == "count" else F.sum)(column)
            so_far = total.over(self.window.rowsBetween(Window.unboundedPreceding, 0))
            self._tiles[name] = F.coalesce(so_far, F.lit(0))
        return self.back(name, skip, 0) - self.back(name, skip + rows, 0)

    def _pieces(self, rows: int, skip: int) -> list[tuple[int, int]]:
        """Disjoint (size, skip) parts that cover `rows` rows ending `skip` rows back."""
        whole, rest = divmod(rows, self.tile)
        parts = [(self.tile, skip + k * self.tile) for k in range(whole)]
        return parts + ([(rest, skip + whole * self.tile)] if rest else [])

    def _overlapping(self, rows: int, skip: int) -> list[tuple[int, int]]:
        """Like `_pieces`, in tiles of one size, which max and min may count twice."""
        if rows <= self.tile:
            return [(rows, skip)]
        starts = [*range(0, rows - self.tile, self.tile), rows - self.tile]
        return [(self.tile, skip + start) for start in starts]

    def _extreme(self, kind: str, column: str, rows: int, skip: int) -> Column:
        parts = [self._part(kind, column, *p) for p in self._overlapping(rows, skip)]
        combine = F.greatest if kind == "max" else F.least
        return combine(*parts) if len(parts) > 1 else parts[0]

    def highest(self, column: str, rows: int, skip: int = 0) -> Column:
        return self._extreme("max", column, rows, skip)

    def lowest(self, column: str, rows: int, skip: int = 0) -> Column:
        return self._extreme("min", column, rows, skip)

    def count(self, column: str, rows: int, skip: int = 0) -> Column:
        """How many of the rows are not NULL, from one running count."""
        return self._running("count", column, rows, skip)

    def hits(self, flag: str, rows: int, skip: int = 0) -> Column:
        """How often a 0/1 column is 1, from one running sum."""
        return self._running("sum", flag, rows, skip)

    def mean(self, column: str, rows: int, skip: int = 0) -> Column:
        total = reduce(add, [self._part("sum", column, *p) for p in self._pieces(rows, skip)])
        seen = self.count(column, rows, skip)
        return F.when(seen > 0, total / seen)

    def full_mean(self, column: str, rows: int, skip: int = 0) -> Column:
        """The mean where all rows of the frame exist and hold a value, else NULL."""
        return F.when(self.count(column, rows, skip) == rows, self.mean(column, rows, skip))

    def std(self, column: str, rows: int, skip: int = 0, sample: bool = False) -> Column:
        """Standard deviation, merged from count, mean and variance of the tiles."""
        pieces = self._pieces(rows, skip)
        sizes, means, spreads = (
            [self._part(kind, column, *p) for p in pieces] for kind in ("count", "avg", "var")
        )
        seen = reduce(add, sizes)
        name = f"_mean_{column}_{rows}_{skip}"
        weighted = reduce(add, [n * m for n, m in zip(sizes, means)])
        self._means[name] = F.when(seen > 0, weighted / seen)
        mean = F.col(name)
        squares = reduce(
            add, [n * (v + (m - mean) * (m - mean)) for n, m, v in zip(sizes, means, spreads)]
        )
        divisor = seen - 1 if sample else seen
        return F.when(divisor > 0, F.sqrt(squares / divisor))
