"""Near-duplicate documents by SimHash fingerprints, pigeonhole blocks and verified Hamming distance.

A fingerprint has two halves, both made from the document's distinct word pairs. Each of the first half's eight blocks of 16 bits
is a MinHash: it is made from the least product of a word pair with the block's own multiplier, so that documents whose word pairs have Jaccard
similarity j agree in it with probability j. The second half's 128 bits are signs of sums with equal weights, whose distance follows the angle between
the documents: it is what pairs are verified by.

Joining on each of the 28 pairs of blocks (32-bit keys) finds all pairs of which two of eight blocks are equal. The distance that is accepted also
goes with pairs that have a half of their word pairs in common or less, which may have one equal block. So documents are joined on further bands too: each of LEASTS more
multipliers gives a least product, and a band is three of these, no two of which are together in another band. Every pair that is found is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequenza.llm.common import U64, WORD, Rolling, mix, pieces, salted_names, spans, stable, text_buffer

BLOCKS, BLOCK_BITS = 8, 16
#: Least products of a document, and as many bands of three of them.
LEASTS = 64
#: Documents whose second halves differ in at most so many of the 128 bits are near copies.
MOST_BITS = 34
_SIGNS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1)  # of a byte's bits
_POPCOUNT = getattr(np, "bitwise_count")
_MULTIPLIERS = mix(np.arange(LEASTS + BLOCKS, dtype=U64), 300) | U64(1)


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of each text's distinct word pairs, their rows, and where each row's begin. A text without two words is one feature, its own bytes."""
    data, offsets = text_buffer(pc.utf8_lower(texts.cast(pa.string())))
    starts, ends, counts = spans(WORD[data], offsets)
    words = Rolling(data)(starts, ends)
    rows = np.repeat(np.arange(len(counts)), counts)
    with np.errstate(over="ignore"):
        pairs = mix(words[:-1] * U64(3) + mix(words[1:]))
    same = rows[:-1] == rows[1:]
    features, of = pairs[same], rows[:-1][same]
    alone = np.flatnonzero(counts < 2)
    whole = Rolling(data)(offsets[alone], offsets[alone + 1])
    features, of = np.concatenate([features, whole]), np.concatenate([of, alone])
    _, first = np.unique(mix(of.astype(U64), 9) ^ features, return_index=True)
    first = first[np.argsort(of[first], kind="stable")]
    features, of = features[first], of[first]
    return features, of, np.searchsorted(of, np.arange(len(counts)))


def _bands(features: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bands of each row, 32 bits of each."""
    with np.errstate(over="ignore"):
        least = np.stack([np.minimum.reduceat(features * m, at) for m in _MULTIPLIERS[:LEASTS]], 1)
        return (mix(least * U64(3) + mix(np.roll(least, -1, axis=1) * U64(3) + mix(np.roll(least, -9, axis=1)))) >> U64(32)).astype(np.uint32)


def _halves(features: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    halves = np.zeros((4, len(at)), U64)
    with np.errstate(over="ignore"):
        for block, m in enumerate(_MULTIPLIERS[LEASTS:]):
            halves[block // 4] |= (mix(np.minimum.reduceat(features * m, at)) & U64(0xFFFF)) << U64(block % 4 * 16)
    for block in range(BLOCKS, 2 * BLOCKS):
        signs = _SIGNS[mix(features, 200 + block).view(np.uint8).reshape(-1, 8)[:, :2]]
        bits = np.packbits(np.add.reduceat(signs, at, axis=0) > 0, axis=2)[..., 0].astype(U64)
        halves[block // 4] |= (bits[:, 0] | bits[:, 1] << U64(8)) << U64(block % 4 * 16)
    return tuple(halves)


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each text's fingerprint: the first half (blocks 0 to 3, 4 to 7) and the second as 64-bit values."""
    features, _, at = _features(texts)
    return _halves(features, at)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text"):
        features, _, at = _features(piece.column(1))
        bands = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * LEASTS), pa.array(_bands(features, at).view(np.int32).ravel()))
        yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(x.view(np.int64)) for x in _halves(features, at)), bands], ["doc_id", "high", "low", "first", "second", "bands"])


def _forest(bits: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Breadth-first trees over rows of which neighbours differ in at most `most` bits: parents and children."""
    left, parents, children = np.arange(1, len(bits)), [], []
    queue = [0]
    while queue or len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
        here = queue.pop()
        near = _POPCOUNT(bits[left] ^ bits[here]).sum(1) <= most
        found = left[near]
        parents.append(np.full(len(found), here))
        children.append(found)
        queue.extend(found)
        left = left[~near]
    return np.concatenate(parents or [np.zeros(0, int)]), np.concatenate(children or [np.zeros(0, int)])


def close_pairs(keys: np.ndarray, docs: np.ndarray, bits: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of docs with equal (sorted) keys that differ in at most `most` bits; of more than 64 docs with one key, a spanning forest of those pairs."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    large = sizes > 64
    left, right = [], []
    for s, n in zip(starts[large], sizes[large]):
        a, b = _forest(bits[s : s + n], most)
        left.append(s + a)
        right.append(s + b)
    small = np.repeat(~large, sizes)
    until = np.repeat(starts + sizes, sizes)
    at = np.flatnonzero(small)
    step = 0
    while len(at):
        step += 1
        at = at[at + step < until[at]]
        near = _POPCOUNT(bits[at] ^ bits[at + step]).sum(1) <= most
        left.append(at[near])
        right.append(at[near] + step)
    if not left:
        return docs[:0], docs[:0]
    return docs[np.concatenate(left)], docs[np.concatenate(right)]


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every value of the pairs (a, b) that isn't the least of its connected component: the value and that least one."""
    ids, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    root, before = np.arange(len(ids)), None
    while before is None or (root != before).any():
        before = root.copy()
        least = np.minimum(root[x], root[y])
        for side in (x, y):
            np.minimum.at(root, root[side], least)  # the tree's root learns it too
            np.minimum.at(root, side, least)
        root = root[root]
    own = np.flatnonzero(root != np.arange(len(ids)))
    return ids[own], ids[root[own]]


def _edges(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(keys, docs, bits):
            # Only what is connected matters: of all pairs of these keys, one edge for each document leaves the task.
            u, v = stars(*close_pairs(keys, docs, bits, most))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        held: list[np.ndarray] = []  # the rows of the last key so far, which the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            rows = [np.concatenate(x) for x in zip(held, own)] if held else own
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            if cut:
                yield found(rows[0][:cut], rows[1][:cut], np.stack([rows[2][:cut], rows[3][:cut]], 1).view(U64))
            held = [x[cut:] for x in rows]
        if held:
            yield found(held[0], held[1], np.stack(held[2:], 1).view(U64))

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v): root is the least node of its connected component.

    Alternates large and small stars until nothing changes, which takes a number of rounds logarithmic in the size of the
    components; each round is two aggregations over the edges, kept by a checkpoint.
    """
    edges, before = stable(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()), None
    least = lambda e: e.groupBy("u").agg(F.min("v").alias("m"))
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: every larger neighbour of u to the least of u and its neighbours; small star: every smaller one, and u, to the least. Joins split hot nodes.
        edges = both.join(least(both).select("u", F.least("u", "m").alias("m")), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        stars = edges.join(least(edges), "u")
        edges = stable(stars.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v"))))).where("u <> v").distinct())
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after


def near_duplicates(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """One row (doc_id, group_id, kept) for each document: group_id is the least doc_id that a chain of near copies reaches, kept says that it is the document's own.

    A row without doc_id or text is in no group: group_id is its doc_id, and it is kept. Empty texts are copies of each other.
    Rows with the same doc_id are one document with several texts: each of them takes the group that any of them has.
    Very long texts are whole, and a table without rows gives none.
    """
    marked = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = stable(marked.mapInArrow(_fingerprint_batches, "doc_id long, high long, low long, first long, second long, bands array<int>"))
    same = ["high", "low", "first", "second"]
    reps = stable(prints.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands")))
    blocks = [F.shiftrightunsigned(F.col("high" if j < 4 else "low"), j % 4 * 16).bitwiseAND(0xFFFF) for j in range(BLOCKS)]
    keys = [F.lit(k << 32).bitwiseOR(F.shiftleft(blocks[i], 16)).bitwiseOR(blocks[j]) for k, (i, j) in enumerate(combinations(range(BLOCKS), 2))]
    band_keys = F.transform("bands", lambda x, k: F.shiftleft((k + len(keys)).cast("long"), 32).bitwiseOR(x.cast("long").bitwiseAND(0xFFFFFFFF)))
    spread = reps.select(F.explode(F.concat(F.array(*keys), band_keys)).alias("key"), F.col("rep"), "first", "second")
    edges = prints.drop("bands").join(reps.drop("bands"), same).where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    edges = edges.union(spread.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(_edges(most_bits), "u long, v long"))
    groups = components(edges)
    node = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return node.join(groups, node.doc_id == groups.node, "left").select("doc_id", F.coalesce("root", "doc_id").alias("group_id"), F.coalesce(F.col("root").isNull() | (F.col("root") == F.col("doc_id")), F.lit(True)).alias("kept"))


def near_duplicate_groups(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, group_id) of the documents in groups of two or more. Cases as in near_duplicates; documents without copies have no row."""
    groups = near_duplicates(docs, most_bits)
    many = groups.where("NOT kept").select(F.col("group_id").alias("many")).distinct()
    # A group has a row that isn't kept, or several rows of one document.
    again = groups.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("many")).count().where("count > 1").select("many")
    return groups.where("doc_id IS NOT NULL").join(many.union(again).distinct(), F.col("group_id") == F.col("many"), "left_semi").select("doc_id", "group_id")


def drop_near_duplicates(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """docs with one document of each group of near copies, the one with the least doc_id; all its columns. Cases as in near_duplicates."""
    gone, = salted_names(docs.columns, "gone")
    drop = near_duplicates(docs, most_bits).where("NOT kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(drop, F.col("doc_id").cast("long") == F.col(gone), "left_anti")
