"""What makes a table a panel of series."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SeriesSpec:
    """keys name a series, order (unique within a series) its rows; every operator on one spec shares one exchange and one sort."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    features: tuple[str, ...] = ()

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)

    def reverse(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*[F.col(c).desc() for c in self.order])

    def rows(self, first: int, last: int) -> WindowSpec:
        return self.window().rowsBetween(first, last)

    def numbered(self, df: DataFrame, name: str = "rn") -> DataFrame:
        """Position from 0."""
        return df.withColumn(name, (F.row_number().over(self.window()) - 1).cast("bigint"))

    def length(self) -> Column:
        return F.count(F.lit(1)).over(self.whole())


def r6(c: Column) -> Column:
    return F.round(c, 6)
