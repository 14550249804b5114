"""A typed flow over DataFrames: maps, filters, flat maps, unions, forks, keyed folds and windows, and label scopes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sequenza.operators import fold, grouping, labels
from sequenza.operators.order import Order


@dataclass(frozen=True)
class Stream:
    """A DataFrame and the total order of its rows. Forking is using a stream twice."""

    df: DataFrame
    order: Order

    def map(self, **columns: Column) -> Stream:
        """Only these columns, and those of labels."""
        return Stream(self.df.select(*[c.alias(n) for n, c in columns.items()], *sorted(labels.labels_of(self.df) - set(columns))), self.order)

    def with_columns(self, **columns: Column) -> Stream:
        return Stream(self.df.withColumns(columns), self.order)

    def map_with(self, init: Callable[[], Any], step: Callable[[Any, dict], list[tuple]], schema: str) -> Stream:
        """The rows that step(resource, row) gives for each row, with a resource that init() makes once in each task, such as a loaded model. Labels pass along; schema: the rows' columns."""
        own = sorted(labels.labels_of(self.df) - set(StructType.fromDDL(schema).names))
        fields = StructType([*StructType.fromDDL(schema).fields, *[self.df.schema[c] for c in own]])

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            resource, kinds = init(), to_arrow_schema(fields)
            for batch in batches:
                made = [(*x, *[row[c] for c in own]) for row in batch.to_pylist() for x in step(resource, row)]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in made], f.type) for k, f in enumerate(kinds)], schema=kinds)

        return Stream(self.df.mapInArrow(apply, fields), self.order)

    def filter(self, condition: Column | str) -> Stream:
        return Stream(self.df.where(condition), self.order)

    def flat_map(self, items: Column, into: str = "item", child: str = "child") -> Stream:
        """A row for each element of an array, with its place, which orders the children of a row."""
        names = [c for c in self.df.columns if c not in (into, child)]
        return Stream(self.df.select(*names, F.posexplode(items).alias(child, into)), Order(self.order.time, self.order.custom, (*self.order.lineage, child)))

    def union(self, *others: Stream) -> Stream:
        """All rows of both, repeated ones too. Raises ValueError where one lacks a label that this stream carries."""
        out = self.df
        for other in others:
            labels.require_labels(other.df, [n.removeprefix(labels.PREFIX) for n in labels.labels_of(self.df)])
            out = out.unionByName(other.df)
        return Stream(out, self.order)

    def shuffled(self, *keys: str | Column) -> Stream:
        """Placed by the hash of keys before what follows; results never depend on it."""
        return Stream(self.df.repartition(*keys), self.order)

    def broadcast(self, copies: int, into: str = "replica") -> Stream:
        """Every row once for each of `copies` replicas."""
        return Stream(self.df.withColumn(into, F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))), Order(self.order.time, self.order.custom, (*self.order.lineage, into)))

    def key_by(self, *keys: str, labelled: Sequence[str] = (), order: Order | None = None) -> Keyed:
        """Keyed by columns and by labels; without any, all rows are one group."""
        labels.require_labels(self.df, labelled)
        return Keyed(self.df, [*keys, *[labels.PREFIX + n for n in labelled]], order or self.order)

    def spawn_label(self, name: str, key: str | Column) -> Stream:
        return Stream(labels.spawn_label(self.df, name, key), self.order)

    def label_markers(self, spawned: Stream, name: str, **marker: Column) -> Stream:
        return Stream(labels.label_markers(self.df, spawned.df, name, marker), self.order)


@dataclass(frozen=True)
class Keyed:
    df: DataFrame
    keys: list[str]
    order: Order

    def grouping(self, item: str | Column, window: int, undo_partial: bool = False, into: str = "window") -> Stream:
        return Stream(grouping.grouping(self.df, self.keys, self.order, item, window, undo_partial, into), self.order)

    def scan(self, into: str, aggregate: Column) -> Stream:
        return Stream(fold.scan(self.df, self.keys, self.order, into, aggregate), self.order)

    def stateful_map(self, step: Callable[[dict, Any], tuple[Any, tuple]], schema: str, order: Order | None = None) -> Stream:
        """One row for each row, by step(row, state) -> (state, row). schema: the keys, labels among them, and the rows' columns; order: that of the result, which defaults to this one's columns that it has."""
        return self._folded(fold.stateful_map, step, schema, order)

    def stateful_flat_map(self, step: Callable[[dict, Any], tuple[Any, list[tuple]]], schema: str, order: Order | None = None) -> Stream:
        return self._folded(fold.stateful_flat_map, step, schema, order)

    def aggregate(self, fold_: Callable[[dict, Any], Any], release: Callable[[Any], tuple], schema: str, order: Order | None = None) -> Stream:
        """release(state) after each row's fold_(row, state). What comes out is a stream, so stages chain."""
        return self._folded(lambda df, keys, order, step, schema: fold.fold_pipeline(df, keys, order, *step, schema), (fold_, release), schema, order)

    def _folded(self, how: Callable, step: Any, schema: str, order: Order | None) -> Stream:
        out = how(self.df, self.keys, self.order.columns, step, schema)
        kept = [[c for c in part if isinstance(c, str) and c in out.columns] for part in (self.order.time, self.order.custom, self.order.lineage)]
        return Stream(out, order or Order(*kept))


def run(flow: Callable[[Stream], Stream | DataFrame], source: Stream, init: Callable[[], None] | None = None) -> DataFrame:
    """The result of a flow over a source: a lazy plan, nothing runs until it is used. init: called once here before the flow is built."""
    if init:
        init()
    out = flow(source)
    return out.df if isinstance(out, Stream) else out
