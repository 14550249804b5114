"""Latencies of outputs, their percentiles, and checks of outputs against what is expected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latencies(outputs: DataFrame, group: str, started: str | Column, ended: str | Column) -> DataFrame:
    """(group, latency): the longest time from a group's start to one of its outputs, in microseconds."""
    start, end = (F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp")) for c in (started, ended))
    return outputs.groupBy(group).agg((F.max(end) - F.min(start)).alias("latency"))


def percentiles(values: DataFrame, value: str, order: str, skip: int = 0, points: tuple[float, ...] = (0.5, 0.75, 0.9, 0.99), exact: bool = False) -> DataFrame:
    """One row (p50, p75, ...) over all but the first `skip` values by order: approximate, within 1/10,000 of a rank and in bounded memory, unless exact, which holds all distinct values in one task."""
    kept = values if not skip else values.join(values.select(order).orderBy(order).limit(skip), order, "left_anti")
    name = lambda p: f"p{round(p * 100)}"
    return kept.agg(*[(F.percentile(value, p) if exact else F.percentile_approx(value, p, 10_000)).cast("double").alias(name(p)) for p in points])


def missing(expected: DataFrame, outputs: DataFrame, on: list[str]) -> DataFrame:
    """What was expected and never came; a run is valid if this is empty."""
    return expected.join(outputs, on, "left_anti")


def arrival_gap(uniform: Column, mean_ms: float) -> Column:
    """An exponential gap between arrivals, in ms, from a uniform value below 1."""
    return -F.log(1 - uniform) * mean_ms
