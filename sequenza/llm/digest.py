"""Locality-sensitive document digests from the quartiles of hashed byte-triplet counts.

A window of five bytes slides over the text; each of the six triplets that hold its last byte is hashed to one of 128
buckets. A bucket's two bits say in which quartile of the bucket counts its own count lies. Before these 32 bytes come a
check byte, the logarithm of the length, and the ratios of the quartiles. Two digests differ by a weighted sum of the
differences of their parts, at most MOST.

All near digests are found: every pair of a band of lengths is looked at whose heads, that is lengths and ratios, allow a difference of NEAR; what its
bodies differ by in the order of quartiles is a lower bound of the difference, which is worked out where the bound allows it.
Large bands are cut into pieces, and a task takes two of them, so that a task's rows and the copies of a digest both grow by the root of the band.
Equal digests are one class, and what leaves a task is a count and the nearest class of each digest, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from sequenza.llm.common import U64, mix, pieces, row_sums, stable, text_buffer

BUCKETS, WIDTH = 128, 35
#: Texts of fewer bytes have no digest.
LEAST_BYTES = 50
#: No difference is larger.
MOST = 600
#: Documents whose digests differ by so much at most are near each other.
NEAR = 30
#: Width of a length band, in times the length codes that near digests may be apart.
BANDS = 6
#: A band of PART_ROWS digests is one piece, one of k * k times as many has k; bits that the number of a piece takes.
PART_ROWS, PART_BITS = 1 << 14, 10
#: Pairs that a step compares at once, and the most partitions that the keys are spread over.
PAIRS, MOST_TASKS = 1 << 16, 1 << 14
#: Bits of a digest's rank by id among those of its key.
RANK_BITS = 40
_PAIR = "struct<difference: int, id: bigint>"

_TRIPLETS = ((1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4))
_codes = (np.arange(256)[:, None] >> (2 * np.arange(4))) & 3
_gap = np.abs(_codes[:, None, :] - _codes[None, :, :])
#: The difference of two digest bytes of four codes each; opposite quartiles count double.
_BODY = np.where(_gap == 3, 6, _gap).sum(2).astype(np.uint8)


def bucket_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The counts of the hashed triplets of each row."""
    n, rows = len(data), len(offsets) - 1
    inside = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets)) >= 4
    at = np.flatnonzero(inside)
    base = np.repeat(np.arange(rows), np.diff(offsets))[at] * BUCKETS
    wide = data.astype(np.uint32)
    total = np.zeros(rows * BUCKETS, np.int64)
    for salt, (second, third) in enumerate(_TRIPLETS):
        key = wide[at] | (wide[at - second] << np.uint32(8)) | (wide[at - third] << np.uint32(16)) | np.uint32((salt + 1) << 24)
        key *= np.uint32(0x9E3779B1)
        key ^= key >> np.uint32(15)
        key *= np.uint32(0x85EBCA77)
        total += np.bincount(base + (key >> np.uint32(25)), minlength=rows * BUCKETS)
    return total.reshape(rows, BUCKETS)


def digests(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The digests as rows of bytes, and which of them are valid: those of LEAST_BYTES bytes with counts above 0 in more than a quarter of the buckets."""
    data, offsets = text_buffer(texts)
    counts, sizes = bucket_counts(data, offsets), np.diff(offsets)
    ranked = np.sort(counts, axis=1)
    quartiles = [ranked[:, BUCKETS * k // 4 - 1] for k in (1, 2, 3)]
    codes = sum((counts > q[:, None]).astype(np.uint8) for q in quartiles)
    body = (codes.reshape(-1, BUCKETS // 4, 4) << np.arange(0, 8, 2, dtype=np.uint8)).sum(2).astype(np.uint8)
    low, mid, high = quartiles
    ratio = lambda q: (q * 100 // np.maximum(high, 1) % 16).astype(np.uint8)
    check = row_sums(data, offsets) & 255
    length = np.minimum(np.log(np.maximum(sizes, 1)) / np.log(1.1), 255).astype(np.uint8)
    out = np.hstack([check.astype(np.uint8)[:, None], length[:, None], (ratio(low) << 4 | ratio(mid))[:, None], body])
    return out, (sizes >= LEAST_BYTES) & (high > 0)


def differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The difference scores of digests, row by row (broadcasting): 0 for equal ones, MOST at most."""
    a, b = np.broadcast_arrays(a, b)
    length = np.abs(a[..., 1].astype(np.int32) - b[..., 1])
    total = (a[..., 0] != b[..., 0]) + np.where(length > 1, length * 12, length)
    for shift in (4, 0):
        gap = np.abs((a[..., 2] >> shift & 15).astype(np.int32) - (b[..., 2] >> shift & 15))
        gap = np.minimum(gap, 16 - gap)
        total = total + np.where(gap > 1, (gap - 1) * 12, gap)
    return np.minimum(total + _BODY[a[..., 3:], b[..., 3:]].sum(-1, dtype=np.int32), MOST)


def _matrix(values: pa.Array) -> np.ndarray:
    """Digest strings as rows of bytes."""
    return np.frombuffer(bytes.fromhex("".join(values.to_pylist())), np.uint8).reshape(-1, WIDTH)


def _strings(rows: np.ndarray, valid: np.ndarray) -> pa.Array:
    flat = rows.tobytes().hex()
    return pa.array([flat[k * 2 * WIDTH : (k + 1) * 2 * WIDTH] if ok else None for k, ok in enumerate(valid.tolist())], pa.string())


@F.pandas_udf(IntegerType())
def difference(a: pd.Series, b: pd.Series) -> pd.Series:
    """The difference score of two digest columns; null where one is null."""
    both = (a.notna() & b.notna()).to_numpy()
    out = pd.Series(pd.array([None] * len(a), "Int32"))
    if both.any():
        out[both] = differences(_matrix(pa.array(a[both], pa.string())), _matrix(pa.array(b[both], pa.string())))
    return out


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, digest), a row for each row of docs, repeated ones too; the digest is null for a text that is null, short or too uniform.

    A null key stays null; equal texts have equal digests. Very long texts are whole. An empty table gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([piece.column(0), _strings(*digests(piece.column(1)))], [key, "digest"])

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("text")).mapInArrow(run, f"{key} long, digest string")


def _blocks(reach: int, parts: dict[int, int] | None = None):
    """For each digest the rows that stand for it: a key, the head led by the length, whether it is of the key's second piece, the body, and what it stands for.

    A band is BANDS * reach length codes wide. A digest whose length is within reach of the next band is a guest there as well. A band is cut into
    parts[band] pieces by a hash of the digest, one where parts has none; a key is a band and two of its pieces, or one and the same twice.
    """
    wide = BANDS * reach

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch.column(0))
            length = rows[:, 1].astype(np.int32)
            guests = np.flatnonzero(length % wide >= wide - reach)
            own = np.concatenate([np.arange(len(rows)), guests])
            band = np.concatenate([length // wide, length[guests] // wide + 1])
            many = np.array([(parts or {}).get(k, 1) for k in range(256 // wide + 2)])[band]
            body, hashes = np.ascontiguousarray(rows[:, 3:]).view(np.int64), np.zeros(len(rows), U64)
            for word in body.T:
                hashes = mix(hashes ^ word.view(U64))
            piece = (hashes[own] % many.astype(U64)).astype(np.int64)
            other = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            own, band, piece = (np.repeat(x, many) for x in (own, band, piece))
            key = band.astype(np.int64) << 2 * PART_BITS | np.minimum(piece, other) << PART_BITS | np.maximum(piece, other)
            head = (rows[:, 1].astype(np.int32) << 16 | rows[:, 0].astype(np.int32) << 8 | rows[:, 2])[own]
            stands = [batch.column(k).to_numpy(zero_copy_only=False)[own] for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.astype(np.int32), head, piece > other, *stands, *body[own].T)], ["key", "head", "second", "id", "n", "a", "b", "c", "d"])

    return run


def _steps(most: int) -> list[tuple[int, int, int, int]]:
    """For each pair of steps between the ratios of two digests (circular): both steps, what of `most` they leave, and how far apart that lets the lengths be."""
    cost = lambda gap: (gap - 1) * 12 if gap > 1 else gap
    left = [(i, j, most - cost(min(i, 16 - i)) - cost(min(j, 16 - j))) for i in range(16) for j in range(16)]
    return [(i, j, rest, rest // 12 if rest >= 24 else min(rest, 1)) for i, j, rest in left if rest >= 0]


def _planes(words: np.ndarray) -> list[np.ndarray]:
    """Bodies as bits that say which codes are over 1, over 0 and over 2, each as two words: what of them differs is a lower bound of the difference, and is it but for opposite quartiles."""
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")
    low, high = bits[:, ::2], bits[:, 1::2]
    return [np.ascontiguousarray(w) for x in (high, low | high, low & high) for w in np.packbits(x, axis=1, bitorder="little").view(U64).T]


def _pairs(place: np.ndarray, starts: np.ndarray, first: np.ndarray, second: np.ndarray, most: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Pairs of rows (of first, of second) whose heads allow a difference of `most`, each once, and what they leave for the rest: PAIRS at a time.

    place: of each row the ratios, then the length. first, second: row numbers sorted by place; starts: how many of second are below each place. same: first is second.
    """
    cell, length = place[first] >> 8, place[first] & 255
    for i, j, rest, reach in _steps(most):
        target = (((cell >> 4) + i & 15) << 4 | (cell + j & 15)) << 8
        lo, hi = starts[target | np.maximum(length - reach, 0)], starts[(target | np.minimum(length + reach, 255)) + 1]
        if same:
            lo = np.maximum(lo, np.arange(len(first)) + 1)
        many = np.maximum(hi - lo, 0)
        rows = np.flatnonzero(many)
        lo, many = lo[rows], many[rows]
        ends, at = np.cumsum(many), 0
        while at < len(rows):
            base = ends[at] - many[at]
            stop = max(at + 1, int(np.searchsorted(ends, base + PAIRS, "right")))
            own = many[at:stop]
            yield np.repeat(first[rows[at:stop]], own), second[np.arange(ends[stop - 1] - base) + np.repeat(lo[at:stop] - (ends[at:stop] - own - base), own)], rest
            at = stop


def _links(columns: list[np.ndarray], most: int) -> Iterator[pa.RecordBatch]:
    """What the digests of a key have near them: for each one the documents that differ by at most `most`, and the nearest class and item."""
    key, head, second, ids, n, *words = columns
    body = np.ascontiguousarray(np.stack(words, 1))
    planes = _planes(body)
    length = head >> 16
    guest = length // (BANDS * max(1, most // 12)) != key >> 2 * PART_BITS
    rows = np.hstack([np.stack([head >> 8 & 255, length, head & 255], 1).astype(np.uint8), body.view(np.uint8)])
    place = (head & 255) << 8 | length
    same = bool(key[0] & (1 << PART_BITS) - 1 == key[0] >> PART_BITS & (1 << PART_BITS) - 1)
    order = np.argsort(place, kind="stable")
    one, two = (order, order) if same else (order[~second[order]], order[second[order]])
    starts = np.concatenate([[0], np.cumsum(np.bincount(place[two], minlength=1 << 16))])
    by_id = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[by_id] = np.arange(len(ids))
    links = np.zeros(len(key), np.int64)
    none = (MOST + 1) << RANK_BITS
    best = {item: np.full(len(key), none, np.int64) for item in (False, True)}
    for a, b, rest in _pairs(place, starts, one, two, most, same):
        apart = np.zeros(len(a), np.uint16)
        for k in (0, 2, 4):
            for plane in planes[k : k + 2]:
                apart += np.bitwise_count(plane[a] ^ plane[b])
            keep = np.flatnonzero(apart <= rest)
            a, b, apart = a[keep], b[keep], apart[keep]
        keep = ~(guest[a] & guest[b])  # two guests have met in the band before
        a, b = a[keep], b[keep]
        score = differences(rows[a], rows[b])
        keep = score <= most
        a, b, score = a[keep], b[keep], score[keep].astype(np.int64) << RANK_BITS
        for own, other in ((a, b), (b, a)):
            np.add.at(links, own, n[other])
            for item, least in best.items():
                of = (n[other] == 0) == item
                np.minimum.at(least, own[of], score[of] | rank[other[of]])
    found = np.flatnonzero((n > 0) & (np.minimum(best[False], best[True]) < none))
    for at in range(0, len(found), 1 << 16):
        some = found[at : at + (1 << 16)]
        pair = [pa.StructArray.from_arrays([pa.array((x >> RANK_BITS).astype(np.int32)), pa.array(ids[by_id[np.where(x < none, x & (1 << RANK_BITS) - 1, 0)]])], ["difference", "id"], mask=pa.array(x >= none)) for x in (best[False][some], best[True][some])]
        yield pa.RecordBatch.from_arrays([_strings(rows[some], np.ones(len(some), bool)), pa.array(links[some]), *pair], ["digest", "links", "near", "item"])


def _link_batches(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # the rows of the last key so far, which the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            ends = [*(np.flatnonzero(np.diff(own[0])) + 1).tolist(), len(own[0])]
            start = 0
            for end in ends:
                if held and held[-1][0][0] != own[0][start]:
                    yield from _links([np.concatenate(x) for x in zip(*held)], most)
                    held = []
                held.append([x[start:end] for x in own])
                start = end
        if held:
            yield from _links([np.concatenate(x) for x in zip(*held)], most)

    return run


def _parts(nodes: DataFrame, reach: int) -> dict[int, int]:
    """The number of pieces of each band that has digests, guests counted: the root of its number in units of PART_ROWS."""
    wide = BANDS * reach
    counts: dict[int, int] = {}
    for length, n in nodes.groupBy(F.conv(F.substring("digest", 3, 2), 16, 10).cast("int").alias("length")).count().collect():
        for band in {length // wide, (length + reach) // wide}:
            counts[band] = counts.get(band, 0) + n
    return {band: min(math.ceil(math.sqrt(n / PART_ROWS)), 1 << PART_BITS) for band, n in counts.items()}


def near_digests(nodes: DataFrame, most: int = NEAR) -> DataFrame:
    """(digest, links, near, item) for nodes (digest, id, n) with distinct digests: n documents of which id is the least, or with n = 0 the reference item id. nodes are read twice.

    links: how many documents have another digest that differs by at most `most`; near, item: the nearest class and item as (difference, id), least
    ids first, null without one. Every pair counts, once. A digest without any has no row.
    """
    reach = max(1, most // 12)
    parts = _parts(nodes, reach)
    keys = sum(k * (k + 1) // 2 for k in parts.values())
    blocks = nodes.mapInArrow(_blocks(reach, parts), "key int, head int, second boolean, id long, n long, a long, b long, c long, d long")
    met = blocks.repartition(min(2 * keys + 1, MOST_TASKS), "key").sortWithinPartitions("key").mapInArrow(_link_batches(most), f"digest string, links long, near {_PAIR}, item {_PAIR}")
    return met.groupBy("digest").agg(F.sum("links").alias("links"), F.min("near").alias("near"), F.min("item").alias("item"))


def fingerprints(docs: DataFrame, references: DataFrame, most: int = NEAR, key: str = "item_id") -> DataFrame:
    """(doc_id, digest, class_id, copies, links, near_class_id, near_difference, key, difference), a row for each row of docs.

    Documents with equal digests are a class: class_id is its least doc_id, copies its number of documents. links: how many other documents have a digest that
    differs by at most `most`, the own class included. near_class_id and near_difference: the nearest other class within `most`; key and
    difference: the nearest reference text within `most`; least ids first, null without one. All pairs count.

    A text that is null, short or too uniform has a null digest and nulls throughout. A row without doc_id has the class and links of a
    document with its digest, nulls if there is none, and is in no other's. Rows with the same doc_id and digest are one document; a doc_id with several digests is a document of each. References
    without a key or digest are left out. Very long texts are whole. An empty table gives no row.
    """
    own = stable(digest(docs))
    classes = own.where("digest IS NOT NULL AND doc_id IS NOT NULL").distinct().groupBy("digest").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n"))
    items = digest(references, key).where(f"digest IS NOT NULL AND {key} IS NOT NULL").groupBy("digest").agg(F.min(key).alias("id")).withColumn("n", F.lit(0).cast("long"))
    nodes = stable(classes.unionByName(items))
    found = nodes.where("n > 0").join(near_digests(nodes, most), "digest", "left")
    found = found.select("digest", F.col("id").alias("class_id"), F.col("n").alias("copies"), (F.coalesce("links", F.lit(0)) + F.col("n")).alias("links"), F.col("near.id").alias("near_class_id"), F.col("near.difference").alias("near_difference"), F.col("item.id").alias(key), F.col("item.difference").alias("difference"))
    return own.join(found, "digest", "left").withColumn("links", F.col("links") - F.col("doc_id").isNotNull().cast("long")).select("doc_id", "digest", "class_id", "copies", "links", "near_class_id", "near_difference", key, "difference")
