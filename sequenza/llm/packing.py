"""Packing documents into token-budget batches inside optimal length buckets.

Padding is the sum, over documents, of the upper length of their bucket less their own length. A dynamic programme over
the histogram of all lengths finds the BUCKETS boundaries that make it least: with C and S the running counts and sums,
best[k][j] = min over i of best[k-1][i] + L_j * (C_j - C_i) - (S_j - S_i), which for rising L_j is a lower hull of lines
with falling slopes -C_i, so that each of the k rows costs time linear in the number of distinct lengths.

Inside a bucket of upper length L, batches take budget // L documents each, in the order of doc_id. Positions come from a
range partitioning and the counts of its partitions, so no bucket has to fit into one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequenza.llm.common import SPACE, pieces, spans, stable, text_buffer
from sequenza.llm.tokencount import build, count_texts

BUCKETS = 16
#: Tokens of a batch, padding included. A document that is longer is a batch of its own.
BUDGET = 16384

SCHEMA = "doc_id long, n_tokens long, padded_length long, batch long"


def boundaries(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """The upper lengths of at most `buckets` buckets that pad documents of these (rising) lengths least. Where several choices pad as little, the last bucket is the widest, then the one before it, and so on: the first of the least, as arg_min takes it."""
    n = len(lengths)
    if n <= buckets:
        return list(lengths)
    total, area = [0] * (n + 1), [0] * (n + 1)
    for j, (length, count) in enumerate(zip(lengths, counts), 1):
        total[j], area[j] = total[j - 1] + count, area[j - 1] + count * length
    best = [lengths[j - 1] * total[j] - area[j] if j else 0 for j in range(n + 1)]
    came = []
    for _ in range(1, buckets):
        hull: list[tuple[int, int, int]] = []  # slope, intercept, i
        at, now, cut = 0, [0] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            slope, intercept = -total[j - 1], best[j - 1] + area[j - 1]
            while len(hull) > 1 and (intercept - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - slope):
                hull.pop()
            hull.append((slope, intercept, j - 1))
            at, x = min(at, len(hull) - 1), lengths[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] < hull[at][0] * x + hull[at][1]:
                at += 1
            now[j], cut[j] = hull[at][0] * x + hull[at][1] + x * total[j] - area[j], hull[at][2]
        best = now
        came.append(cut)
    out, j = [], n
    for cut in reversed(came):
        out.append(lengths[j - 1])
        j = cut[j]
        if not j:
            break
    else:
        out.append(lengths[j - 1])
    return sorted(set(out))


def padding(lengths: list[int], counts: list[int], uppers: list[int]) -> int:
    """The padding that these buckets take."""
    at = np.searchsorted(uppers, lengths)
    return int(sum(c * (int(uppers[k]) - x) for x, c, k in zip(lengths, counts, at)))


def _lengths(automaton):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            if automaton:
                counts = count_texts(automaton.value, piece.column(1))[1]
            else:
                data, offsets = text_buffer(piece.column(1))
                counts = spans(~SPACE[data], offsets)[2]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return run


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, vocabulary: tuple[list[bytes], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_tokens, padded_length, batch), a row for each row of docs: (padded_length, batch) names its batch, numbered from 0.

    vocabulary: the first and later pieces that tokens are counted by, as in tokencount.token_counts; without one, tokens are words between white space.
    Null, empty and blank texts have 0 tokens, null padded_length and null batch: there is nothing to pack. A null doc_id comes first in its
    bucket; equal doc_ids go by length, and rows that agree in both take neighbouring places. Very long texts are whole: one of more than `budget` tokens is a
    batch of its own. An empty table gives no row. Other columns, whatever their names, aren't looked at.
    """
    automaton = docs.sparkSession.sparkContext.broadcast(build(*vocabulary)) if vocabulary else None
    lengths = stable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_lengths(automaton), "doc_id long, n_tokens long"))
    histogram = sorted((r["n_tokens"], r["n"]) for r in lengths.where("n_tokens > 0").groupBy("n_tokens").agg(F.count("*").alias("n")).toLocalIterator())
    uppers = boundaries([x for x, _ in histogram], [n for _, n in histogram], buckets)
    bounds = F.array(*[F.lit(int(u)) for u in uppers]).cast("array<long>")
    upper = F.when(F.col("n_tokens") > 0, F.element_at(F.filter(bounds, lambda u: u >= F.col("n_tokens")), 1)) if uppers else F.lit(None).cast("long")
    ordered = lengths.withColumn("padded_length", upper)
    ordered = stable(ordered.repartitionByRange("padded_length", "doc_id", "n_tokens").sortWithinPartitions("padded_length", "doc_id", "n_tokens"))
    before: dict[tuple[int, int], int] = {}
    seen: dict[int, int] = {}
    for r in sorted(ordered.where("padded_length IS NOT NULL").groupBy(F.spark_partition_id().alias("p"), "padded_length").agg(F.count("*").alias("n")).collect()):
        before[r["p"], r["padded_length"]] = seen.get(r["padded_length"], 0)
        seen[r["padded_length"]] = before[r["p"], r["padded_length"]] + r["n"]
    starts = docs.sparkSession.sparkContext.broadcast(before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, here = dict[int, int](), TaskContext.get().partitionId()
        for batch in batches:
            upper = batch.column(2).fill_null(0).to_numpy(zero_copy_only=False)
            out = np.zeros(len(upper), np.int64)
            for length in np.unique(upper[upper > 0]).tolist():
                at = np.flatnonzero(upper == length)
                place = own.get(length, starts.value.get((here, length), 0))
                out[at] = (place + np.arange(len(at))) // max(1, budget // length)
                own[length] = place + len(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, mask=upper == 0)], ["doc_id", "n_tokens", "padded_length", "batch"])

    return ordered.mapInArrow(run, SCHEMA)
