"""Count-based windows of each key over a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sequenza.functions.names import salted
from sequenza.operators.order import Order

#: The window that never ends.
UNBOUNDED = 2**31 - 1


def _item(item: str | Column) -> Column:
    return F.col(item) if isinstance(item, str) else item


def grouping(df: DataFrame, keys: Sequence[str | Column], order: Order, item: str | Column, window: int, undo_partial: bool = False, into: str = "window") -> DataFrame:
    """df with a column of the last `window` items of the row's key up to this row.

    With undo_partial only whole windows stay, but a key that never fills one has a single row, its last, with all its items.
    The list and the columns are those of the last item of each window.
    """
    rows = order.within(keys)
    if undo_partial and window >= UNBOUNDED:
        return last_of_group(df, keys, order, item, into)
    start = Window.unboundedPreceding if window >= UNBOUNDED else 1 - window
    out = df.withColumn(into, F.collect_list(_item(item)).over(rows.rowsBetween(start, Window.currentRow)))
    if not undo_partial:
        return out
    place, size = F.row_number().over(rows), F.count(F.lit(1)).over(Window.partitionBy(*(keys or [F.lit(0)])))
    at, of = salted(out.columns, "place", "size")
    marked = out.withColumns({at: place, of: size})
    return marked.where((F.col(at) >= window) | ((F.col(of) < window) & (F.col(at) == F.col(of)))).drop(at, of)


def last_of_group(df: DataFrame, keys: Sequence[str | Column], order: Order, item: str | Column, into: str) -> DataFrame:
    """One row for each finished group with all its items in order: an aggregation, with partial lists made before the shuffle."""
    ordering = [c.alias(f"o{k}") for k, c in enumerate(order.columns)]
    named = [F.col(k) if isinstance(k, str) else k for k in keys]
    lists = F.sort_array(F.collect_list(F.struct(*ordering, _item(item).alias("x"))))
    return df.groupBy(*named).agg(F.transform(lists, lambda s: s["x"]).alias(into))


def global_group(df: DataFrame, order: Order, item: str | Column, window: int, **options) -> DataFrame:
    """grouping with all rows in one group. The order is total over one key, so a single task holds it: meant for small or windowed streams."""
    return grouping(df, [], order, item, window, **options)
