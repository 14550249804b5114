"""Key and hash expressions. Hashes decide placement or bucket only, so their values never reach a result unless they are defined here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform_hash(*columns: str | Column) -> Column:
    return F.hash(*columns)


def placed(df: DataFrame, *keys: str) -> DataFrame:
    """df placed by the hash of keys, in as many parts as the session shuffles into. Texts are placed so before they are split: what is then grouped by these keys and more stays where it is."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def constant_key(value: int = 0) -> Column:
    return F.lit(value)


def bucketed(value: Column, buckets: int) -> Column:
    """value % buckets, with the sign of value."""
    return value % F.lit(buckets)


def labelled_key(*columns: str | Column, labels: list[str] = ()) -> Column:
    """A key of columns and labels together: equal only where all are."""
    return F.struct(*columns, *[f"label_{n}" for n in labels])


def wrapped32(value: Column) -> Column:
    """A long reduced to a signed 32-bit value, as integer arithmetic that overflows would leave it."""
    return F.shiftright(F.shiftleft(value.cast("long"), 32), 32)


def list_hash(items: Column) -> Column:
    """31 * h + x over the list from h = 1, wrapped to 32 bits after each item."""
    return F.aggregate(items, F.lit(1).cast("long"), lambda h, x: wrapped32(h * 31 + x.cast("long")))
