"""Label scopes: rows carry the key of the row that began their scope, and a marker follows the last of a scope's rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = "label_"


def labels_of(df: DataFrame) -> set[str]:
    return {c for c in df.columns if c.startswith(PREFIX)}


def spawn_label(df: DataFrame, name: str, key: str | Column) -> DataFrame:
    """df with the label `name`: the row's unique key, which all that is made from the row carries along."""
    return df.withColumn(PREFIX + name, F.col(key) if isinstance(key, str) else key)


def require_labels(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df, if it carries the labels; raises ValueError if a column is missing, and at run time if a row has a null label."""
    if missing := [n for n in names if PREFIX + n not in df.columns]:
        raise ValueError(f"rows don't carry the labels {missing}")
    for n in names:
        df = df.withColumn(PREFIX + n, F.when(F.col(PREFIX + n).isNull(), F.raise_error(F.lit(f"a row without the label {n}"))).otherwise(F.col(PREFIX + n)))
    return df


def label_markers(items: DataFrame, spawned: DataFrame, name: str, marker: dict[str, Column] | None = None) -> DataFrame:
    """items, and after all items of each label one marker: rows with is_marker true, of every label that was spawned, even if nothing came of it.

    marker: what the marker's other columns hold; null unless named. Sort by (label, is_marker, ...) to read a scope whole.
    """
    label = PREFIX + name
    ends = spawned.select(label).distinct()
    columns = {c: (marker or {}).get(c, F.lit(None).cast(dict(items.dtypes)[c])) for c in items.columns if c != label}
    return items.withColumn("is_marker", F.lit(False)).unionByName(ends.withColumns(columns).withColumn("is_marker", F.lit(True)))
