"""The total order that every result depends on: columns whose values together are unique."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Order:
    """Rows go by time, then by the custom columns, then by what tells rows of one time apart (front, lineage ...).

    Give an expression such as F.desc("value") for a falling column.
    """

    time: Sequence[str | Column]
    custom: Sequence[str | Column] = field(default_factory=tuple)
    lineage: Sequence[str | Column] = field(default_factory=tuple)

    @property
    def columns(self) -> list[Column]:
        return [F.col(c) if isinstance(c, str) else c for c in (*self.time, *self.custom, *self.lineage)]

    def within(self, keys: Sequence[str | Column]) -> WindowSpec:
        """The window of a key's rows in this order; without keys, of all rows."""
        return Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*self.columns)

    def ties(self, df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        """The keys and order values that more than one row has: empty if the order is total."""
        named = [c.alias(f"order_{k}") for k, c in enumerate(Order(*[[x for x in part if isinstance(x, str)] for part in (self.time, self.custom, self.lineage)]).columns)]
        return df.select(*keys, *named).groupBy(*keys, *[f"order_{k}" for k in range(len(named))]).count().where("count > 1")
