"""A simple cost model of plans, and measured times."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Shape:
    """Rows and columns of an intermediate table, and what it has cost so far."""

    rows: float
    columns: int
    cost: float = 0.0

    def select(self) -> Shape:
        """Reads every cell and keeps half the rows."""
        return Shape(self.rows / 2, self.columns, self.cost + self.rows * self.columns)

    def project(self, columns: int) -> Shape:
        """Writes the kept columns of every row."""
        return Shape(self.rows, columns, self.cost + self.rows * columns)

    def join(self, other: Shape) -> Shape:
        """Reads both sides once and writes the smaller number of rows, all columns wide."""
        rows, columns = min(self.rows, other.rows), self.columns + other.columns
        return Shape(rows, columns, self.cost + other.cost + self.rows + other.rows + rows * columns)


def shape_of(df: DataFrame) -> Shape:
    return Shape(df.count(), len(df.columns))


def ratio(first: Shape, second: Shape) -> float:
    return first.cost / second.cost


def mean_seconds(make: Callable[[], DataFrame], repeats: int = 3) -> float:
    """Mean time to compute all rows, which go nowhere."""
    began = time.perf_counter()
    for _ in range(repeats):
        make().write.format("noop").mode("overwrite").save()
    return (time.perf_counter() - began) / max(1, repeats)
