"""Ordered folds: one (state, output) step for each row of a key, in the total order.

Algebraic folds are window aggregates or, over all rows at once, two-pass prefix sums; other folds run in Python over rows that Spark has sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegralType, LongType, StringType, StructField, StructType

from sequenza.functions.keys import placed
from sequenza.functions.names import salted
from sequenza.operators.lineage import cut
from sequenza.operators.order import Order


def scan(df: DataFrame, keys: Sequence[str | Column], order: Order, into: str, aggregate: Column) -> DataFrame:
    """df with the running value of an aggregate (F.sum, F.count, F.max ...) over the key's rows so far."""
    return df.withColumn(into, aggregate.over(order.within(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def running_count(df: DataFrame, keys: Sequence[str], order: Order, into: str, segment: Column) -> DataFrame:
    """The place of each row among its key's rows, from 1, without sorting a frequent key in one task.

    segment: an integer that never falls along the order, null first; rows are counted within (key, segment), and the counts of earlier segments are
    added. Null keys are a key like any other. Rows are shuffled once, by (key, segment), and that shuffle is read twice: for the sizes of the segments and for the places.
    """
    own, before, all_ = salted([*df.columns, into], "segment", "before", "all")
    taken, heads, rebuilt, marked = [*df.columns, into, own, before, all_], [], {}, df.withColumn(own, F.coalesce(segment.cast("long"), F.lit(-(2**63))))
    for k in keys:  # columns that are never null, so that in the join both sides keep their place and order
        kind = df.schema[k].dataType
        value, null = salted(taken, f"key{len(taken)}", f"null{len(taken)}")
        taken += [value, null]
        if isinstance(kind, (StringType, IntegralType)):
            marked = marked.withColumns({value: F.coalesce(k, F.lit("" if isinstance(kind, StringType) else 0).cast(kind)), null: F.col(k).isNull()}).drop(k)
            rebuilt[k] = F.when(~F.col(null), F.col(value)).alias(k)
            heads += [value, null]
        else:
            marked = marked.withColumn(value, F.struct(k))
            heads.append(value)
    rows = placed(marked, *heads, own)
    sizes = rows.groupBy(*heads, own).agg(F.count(F.lit(1)).alias(before), F.max(F.xxhash64(*rows.columns)).alias(all_))  # of all columns, else this would need another shuffle than the places do
    earlier = F.sum(before).over(Window.partitionBy(*heads or [F.lit(0)]).orderBy(own).rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.withColumn(before, F.coalesce(earlier, F.lit(0)) + F.col(all_) * 0).drop(all_)
    local = rows.withColumn(into, F.row_number().over(order.within([*heads, own])))
    counted = local.join(starts, [*heads, own]).withColumn(into, F.col(into) + F.col(before))
    return counted.select(*[rebuilt.get(c, c) for c in df.columns], *([into] if into not in df.columns else []))


def running_sum(df: DataFrame, order: Sequence[str], value: str, into: str) -> DataFrame:
    """The running sum of an integer column over all rows, by range partitions and the sums of those before them, so no task holds more than its own range."""
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order))
    sums = sorted((r["p"], r["s"] or 0) for r in ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(value).alias("s")).collect())
    starts, total = {}, 0
    for part, own in sums:
        starts[part], total = total, total + own
    shared = df.sparkSession.sparkContext.broadcast(starts)
    names, at = [*ranged.columns, into], ranged.columns.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = shared.value.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            sums = total + np.cumsum(batch.column(at).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            total = int(sums[-1]) if len(sums) else total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums)], names=names)

    return ranged.mapInArrow(run, StructType([*ranged.schema.fields, StructField(into, LongType())]))


def _hashable(value: Any) -> Any:
    """A key's value that is equal to itself: NaN is a key as null is."""
    return "NaN" if isinstance(value, float) and value != value else value if isinstance(value, Hashable) else repr(value)


def stateful_flat_map(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], step: Callable[[dict, Any], tuple[Any, list[tuple]]], schema: str) -> DataFrame:
    """The rows that step(row, state) -> (state, rows) gives for each row of a key in order; state starts as None. schema: the keys and the rows' columns.

    Spark sorts, nulls first unless the order says otherwise; rows pass through a step in Arrow batches, so what a task holds is a batch and the state of one
    key. Values keep their types: nulls are None, and longs stay whole. Null keys are a key like any other; without keys all rows pass through one task.
    A step must give a new state instead of changing the one it gets, so that running it again gives the same.
    """
    fields = StructType.fromDDL(schema)
    placed = df.repartition(*keys) if keys else df.repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(fields)
        at, state = None, None
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                head = tuple(row[k] for k in keys)
                if (here := tuple(map(_hashable, head))) != at:
                    at, state = here, None
                state, rows = step(row, state)
                made += [(*head, *x) for x in rows]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in made], f.type) for k, f in enumerate(kinds)], schema=kinds)

    return placed.sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def stateful_map(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], step: Callable[[dict, Any], tuple[Any, tuple]], schema: str) -> DataFrame:
    """As stateful_flat_map, with one row out for each row in."""

    def one(row: dict, state: Any) -> tuple[Any, list[tuple]]:
        state, made = step(row, state)
        return state, [made]

    return stateful_flat_map(df, keys, order, one, schema)


def fold_pipeline(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], aggregate: Callable[[dict, Any], Any], release: Callable[[Any], tuple], schema: str) -> DataFrame:
    """release(state) after each aggregate(row, state): the state is folded by one function and turned into rows by another. Folds are chained by folding the result."""

    def step(row: dict, state: Any) -> tuple[Any, tuple]:
        now = aggregate(row, state)
        return now, release(now)

    return stateful_map(df, keys, order, step, schema)


def in_order(step: Callable[[dict, Any], tuple[Any, Any]], place: Callable[[dict], Any]) -> Callable[[dict, Any], tuple[Any, Any]]:
    """A step that raises ValueError where a row doesn't come after the one before it, by place(row); otherwise as step."""

    def guarded(row: dict, state: Any) -> tuple[Any, Any]:
        last, own = state if state is not None else (None, None)
        now = place(row)
        if last is not None and now <= last:
            raise ValueError(f"a row at {now} came after one at {last}")
        own, made = step(row, own)
        return (now, own), made

    return guarded
