"""Repeated runs of lines, found by winnowing over line hashes.

A window begins at a line that isn't blank and takes as many of the next ones as it needs to have MIN_WORDS words, or MIN_LINES lines. Its fingerprint is its
least line hash (the rightmost of equals), so equal windows always have equal fingerprints: the winnowing guarantee. Only the selected lines, which are few
where windows are long, are counted by hash, and those at one place alone can't be in a repeat.

The positions of the others are joined. A selected line carries the windows that it stands for, those that reach from it to both sides; each of these, told by two hashes
of all its lines, is matched with its first occurrence. A match extends both ways as long as the windows before and after it match too, and the
runs that come of it are deleted, but for the first occurrence, by doc_id and then by line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sequenza.llm.common import NO_ID, SPACE, U64, Rolling, cut_ranges, mix, pieces, salted_names, stable, text_buffer

#: A repeated run has so many lines at least, or so many words.
MIN_LINES, MIN_WORDS = 3, 8

_MARKS = "mark long, doc long, copy long, place int, windows array<struct<one: bigint, two: bigint, top: int, bottom: int>>"


def all_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The row, the number in its row, the start and the end of each line; an empty row is one empty line."""
    breaks = np.flatnonzero(data == 10)
    row = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1])
    starts = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((starts, np.repeat([0, 1], [len(offsets) - 1, len(breaks)]), row))
    row, starts = row[order], starts[order]
    last = np.ones(len(row), bool)
    last[:-1] = row[1:] != row[:-1]
    return row, np.arange(len(row)) - np.searchsorted(row, row), starts, np.where(last, offsets[row + 1], np.append(starts[1:], 0) - 1)


def solid_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The row, the number in its row, the hash and the number of words of each line that isn't blank."""
    row, number, starts, ends = all_lines(data, offsets)
    solid = ~SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    begins[offsets[:-1][np.diff(offsets) > 0]] = solid[offsets[:-1][np.diff(offsets) > 0]]
    words = np.concatenate([[0], np.cumsum(begins)])
    count = words[ends] - words[starts]
    full = count > 0
    return row[full], number[full], Rolling(data)(starts[full], ends[full]), count[full]


def windows(row: np.ndarray, line: np.ndarray, count: np.ndarray, lines: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The first and the last line of each window, the line with its fingerprint, and two hashes of it."""
    n = len(row)
    size, total = np.full(n, lines), np.zeros(n, np.int64)
    for k in range(lines):  # the first number of lines with words enough
        total[: n - k] += count[k:]
        size = np.where((size == lines) & (total >= words), np.minimum(size, k + 1), size)
    first = np.arange(n)
    last = first + size - 1
    whole = np.flatnonzero(last < n)
    whole = whole[row[last[whole]] == row[whole]]
    first, last, size = first[whole], last[whole], size[whole]
    best, one, two = first.copy(), mix(line[first], 1), mix(line[first], 2)
    for k in range(1, lines):
        on = np.flatnonzero(size > k)
        at = first[on] + k
        less = line[at] <= line[best[on]]
        best[on[less]] = at[less]
        with np.errstate(over="ignore"):
            one[on], two[on] = (mix(h[on] * U64(31) + line[at], s + 2 * k) for h, s in ((one, 1), (two, 2)))
    return first, last, best, one, two


def _marks(lines: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            row, number, line, count = solid_lines(*text_buffer(piece.column(2)))
            first, last, best, one, two = windows(row, line, count, lines, words)
            if not len(first):
                continue
            heads = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))  # places never fall from window to window
            held = pa.StructArray.from_arrays([pa.array(x) for x in (one.view(np.int64), two.view(np.int64), number[first].astype(np.int32), number[last].astype(np.int32))], ["one", "two", "top", "bottom"])
            at, take = best[heads], pa.array(row[best[heads]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(line[at].view(np.int64)), piece.column(0).take(take), piece.column(1).take(take), pa.array(number[at].astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.append(heads, len(best)).astype(np.int32)), held)],
                ["mark", "doc", "copy", "place", "windows"],
            )

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.where("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("copy"), text.alias("text"))


def _runs(docs: DataFrame, lines: int, words: int) -> DataFrame:
    """(doc, copy, top, bottom): the deleted runs of lines."""
    marks = _keyed(docs).mapInArrow(_marks(lines, words), _MARKS)
    place = F.xxhash64("doc", "copy", "place")
    shared = marks.groupBy("mark").agg(F.min(place).alias("a"), F.max(place).alias("z")).where("a <> z").select("mark")
    likely = stable(marks.join(shared, "mark", "left_semi").select("doc", "copy", F.inline("windows")).select("one", "two", F.struct("doc", "copy", "top").alias("at"), "bottom"))
    first = likely.groupBy("one", "two").agg(F.min("at").alias("first"), F.max("at").alias("end")).where("first < end").drop("end")
    later = likely.join(first, ["one", "two"]).where("at > first").select("at.doc", "at.copy", "at.top", "bottom").distinct()
    own = Window.partitionBy("doc", "copy").orderBy("top")
    reach = F.max("bottom").over(own.rowsBetween(Window.unboundedPreceding, -1))
    marked = later.withColumn("begins", F.when(F.col("top") <= reach + 1, 0).otherwise(1))
    return marked.withColumn("run", F.sum("begins").over(own.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc", "copy", "run").agg(F.min("top").alias("top"), F.max("bottom").alias("bottom")).drop("run")


def repeated_runs(docs: DataFrame, lines: int = MIN_LINES, words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, first_line, last_line), from 0: runs of lines of which every window (blank lines aside) occurred earlier. A window is the shortest that begins at a line and has `words` words or `lines` lines.

    Earlier is by doc_id, nulls first, then by a hash of the text, then by line. Rows that agree in doc_id and text are one
    document and have their runs once. Null texts, empty ones and those without a window have none. Very long
    texts are whole. An empty table gives no row. The doc_id -2**63 counts as null. Other columns, whatever their names, aren't looked at.
    """
    return _runs(docs, lines, words).select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), F.col("top").alias("first_line"), F.col("bottom").alias("last_line"))


def _without(texts: pa.Array, tops: pa.Array, bottoms: pa.Array) -> pa.Array:
    """The texts without their lines of each range, the others joined by line breaks as they were: in time linear in lines and ranges."""
    data, offsets = text_buffer(texts)
    row, number, starts, ends = all_lines(data, offsets)
    base = np.searchsorted(row, np.arange(len(offsets)))  # each row's first line
    own = np.repeat(np.arange(len(texts)), np.diff(tops.offsets.to_numpy()))
    change = np.zeros(len(row) + 1, np.int32)
    np.add.at(change, base[own] + tops.flatten().to_numpy(), 1)
    np.add.at(change, base[own] + bottoms.flatten().to_numpy() + 1, -1)
    kept = np.cumsum(change)[:-1] == 0
    last = np.maximum.reduceat(np.where(kept, np.arange(len(row)), -1), base[:-1]) if len(texts) else base[:0]
    stop = np.minimum(ends + 1, offsets[row + 1])  # with the line break, which the last line that stays hasn't
    stop[last[last >= 0]] = ends[last[last >= 0]]
    keep = np.zeros(len(data) + 1, np.int32)
    np.add.at(keep, starts[kept], 1)
    np.add.at(keep, stop[kept], -1)
    keep = np.cumsum(keep)[:-1] > 0
    left = np.concatenate([[0], np.cumsum(keep)])[offsets]
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(left.astype(np.int64).tobytes()), pa.py_buffer(data[keep].tobytes())]).cast(pa.string())


def drop_repeated_runs(docs: DataFrame, lines: int = MIN_LINES, words: int = MIN_WORDS, keep_emptied: bool = True) -> DataFrame:
    """docs, all rows and columns, with the lines of the repeated runs cut out of text. Cases as in repeated_runs; other texts stay as they are, null and empty ones too.

    keep_emptied=False leaves out the rows whose text had a word and has none any more.
    """
    doc, copy, tops, bottoms = salted_names(docs.columns, "doc", "copy", "tops", "bottoms")
    runs = _runs(docs, lines, words).groupBy("doc", "copy").agg(F.collect_list(F.struct("top", "bottom")).alias(tops))
    runs = runs.select(F.col("doc").alias(doc), F.col("copy").alias(copy), F.col(f"{tops}.top").alias(tops), F.col(f"{tops}.bottom").alias(bottoms))
    return cut_ranges(docs, runs, [doc, copy, tops, bottoms], _without, keep_emptied)
