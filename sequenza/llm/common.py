"""What the corpus operators share: vectorised text primitives over Arrow batches and lineage cutting.

Every Python step here works on Arrow batches with numpy; no step handles one row, word or byte at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sequenza.functions.names import salted as salted_names  # noqa: F401
from sequenza.operators.lineage import cut

#: Text bytes that one vectorised step holds. A row that is longer is a step of its own.
CHUNK_BYTES = 2 << 20

U64 = np.uint64
_ODD = 0x9E3779B97F4A7C15  # multiplier of the rolling hash; odd, so it has an inverse modulo 2**64
_INVERSE = pow(_ODD, -1, 1 << 64)
_powers: list[np.ndarray] = []

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Letters, digits, underscore and every byte of a non-ASCII character.
WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (95, 96), (97, 123), (128, 256)):
    WORD[_a:_b] = True

SPACE_CLASS = "[ \\t\\n\\x0B\\f\\r]"
#: Stands for a null doc_id: before all others.
NO_ID = -(2**63)


def stable(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder that the session names in spark.checkpoint.dir, so that lost executors cost nothing twice."""
    return cut(df)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the len+1 offsets of its rows in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of at most `most` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < len(sizes):
            base = ends[start] - sizes[start]
            stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_ODD**i and its inverse's powers for i < n at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 2)
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.concatenate([[U64(1)], np.full(size - 1, U64(x), U64)])) for x in (_ODD, _INVERSE)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        h = h + U64((salt * 0xD1342543DE82EF95 + _ODD) & (2**64 - 1))
        h ^= h >> U64(30)
        h *= U64(0xBF58476D1CE4E5B9)
        h ^= h >> U64(27)
        h *= U64(0x94D049BB133111EB)
        h ^= h >> U64(31)
    return h


class Rolling:
    """Hashes of any range of a sequence of unsigned values, from one prefix sum."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.empty(len(values) + 1, U64)
            self.sums[0] = 0
            np.cumsum((values.astype(U64) + U64(1)) * up[: len(values)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[ends] - self.sums[starts]) * self.down[starts], 1) ^ (ends - starts).astype(U64)


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that don't cross a row's end: their starts, ends, and how many each row has."""
    n = len(inside)
    edges = np.zeros(n + 1, bool)
    edges[offsets] = True
    before = np.empty(n, bool)
    before[:1], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edges[:-1]))
    after = np.empty(n, bool)
    after[-1:], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edges[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of each row's values, 0 for an empty row."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def cut_ranges(docs: DataFrame, ranges: DataFrame, names: list[str], without: Callable[[pa.Array, pa.Array, pa.Array], pa.Array], keep_emptied: bool) -> DataFrame:
    """docs with ranges cut out of text by without(texts, starts, stops), all columns as they are.

    ranges: a row for each text that has some; names: its columns, which docs hasn't: the doc_id (NO_ID for null), the hash of the text, the starts and the stops.
    keep_emptied=False leaves out the rows whose text this empties of words.
    """
    doc, copy, starts, stops = names
    keyed = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), copy: F.xxhash64(F.col("text").cast("string")), "text": F.col("text").cast("string")})
    joined = keyed.join(ranges, [doc, copy], "left").select(*[F.col(f"`{c}`") for c in docs.columns], starts, stops)
    columns, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            own, keep = list(piece.columns[:-2]), None
            cut = np.flatnonzero(piece.column(piece.num_columns - 2).is_valid().to_numpy(zero_copy_only=False))
            if len(cut):
                take = pa.array(cut)
                new = without(*(c.take(take) for c in (own[at], piece.columns[-2], piece.columns[-1])))
                where = np.arange(piece.num_rows)
                where[cut] = piece.num_rows + np.arange(len(cut))
                own[at] = pa.concat_arrays([own[at].cast(pa.string()), new]).take(pa.array(where))
                if not keep_emptied:
                    data, offsets = text_buffer(new)
                    keep = np.ones(piece.num_rows, bool)
                    keep[cut] = row_sums(~SPACE[data], offsets) > 0
            out = pa.RecordBatch.from_arrays(own, names=columns)
            yield out if keep is None else out.filter(pa.array(keep))

    return joined.mapInArrow(run, docs.withColumn("text", F.col("text").cast("string")).schema)
