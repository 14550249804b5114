"""Repeated passages by blockwise suffix sorting with a difference cover.

A passage is LEAST words or more, compared word by word. A word range is deleted where every window of LEAST words in
it occurred earlier, by doc_id and then by position.

1. Copies. Of equal texts (128 bits of hash) the one with the least doc_id is looked into; the others repeat it from end to end.
2. Anchors. Among the hashes of the SEED-word seeds of a window of LEAST words, the least (rightmost of equals) is the
   window's anchor, so equal windows have equal anchors. Anchors that occur once can't be in a repeat and are dropped.
3. Buckets. A shared anchor's bucket holds, for each occurrence, its context: the words of all windows that it can anchor, 16 bits of
   each, and a 64-bit hash of each window. The suffixes of a bucket that begin such windows are what has to be sorted; contexts start at multiples of
   PERIOD in the bucket's text, padded with words of their own, so suffixes that can match have equal places modulo PERIOD.
4. Blocks. Buckets are sorted one block at a time, whatever the corpus holds; a bucket has BLOCK words at most. In a block, prefix doubling ranks
   all places by their first PERIOD words. The places whose remainder modulo PERIOD is in the difference cover are the sample: their ranks are doubled
   on until they tell apart all that differs. Suffixes sort by the rank of PERIOD words; long ties are resolved by the sample's rank at the
   next place that the cover holds. Neighbours that agree in LEAST words and in the hash of the window, which is made from whole
   words, form the groups of which the first occurrence stays.
5. Hot anchors. An anchor of more contexts than a block takes, such as a phrase of a banner, has no bucket. Its windows are a row each, and the first of
   those with equal hashes (128 bits) is an aggregation, made before the shuffle as well; so no task holds what grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sequenza.llm.common import NO_ID, SPACE, SPACE_CLASS, U64, Rolling, cut_ranges, mix, pieces, salted_names, spans, stable, text_buffer

#: Words of the shortest repeat, and of an anchor's seed.
LEAST, SEED = 50, 16
#: The period, and a difference cover of it: every difference modulo PERIOD is that of two of its members.
PERIOD, COVER = 32, (0, 1, 2, 3, 7, 11, 19)
#: Words of a block, and of a bucket at most.
BLOCK = 1 << 19

_CONTEXT = "anchor long, doc long, copy long, place int, lead int, words binary, checks binary"
_FOUND = "doc long, copy long, start int, stop int, source long"


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The hashes, starts and ends of all words, and the offsets of the rows in them."""
    starts, ends, counts = spans(~SPACE[data], offsets)
    return Rolling(data)(starts, ends), starts, ends, np.concatenate([[0], np.cumsum(counts)])


def anchored(words: np.ndarray, offsets: np.ndarray, least: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The begin of each window that is within a row, the begin of its anchor, and the hashes of all seeds."""
    n = len(words) - least + 1
    if n < 1:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, U64)
    at = np.arange(len(words) - seed + 1)
    value = Rolling(words)(at, at + seed)
    # A seed's low bits give way to its place, counted backwards: the least key of a window is its rightmost least seed.
    bits = U64(max(20, len(value).bit_length()))
    mask = (U64(1) << bits) - U64(1)
    key = (value & ~mask) | (mask - at.astype(U64))
    width = least - seed + 1  # minima of windows of seeds, from running minima forwards and backwards in blocks of that width
    blocks = np.concatenate([key, np.full(-len(key) % width, U64(2**64 - 1))]).reshape(-1, width)
    ahead, back = np.minimum.accumulate(blocks, 1).ravel(), np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    low = np.minimum(back[:n], ahead[width - 1 : width - 1 + n])
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = np.flatnonzero(row_of[:n] == row_of[least - 1 :])
    return whole, (mask - (low[whole] & mask)).astype(np.int64), value


def anchors(words: np.ndarray, offsets: np.ndarray, least: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row, the place in its row and the hash of each anchor."""
    _, at, value = anchored(words, offsets, least, seed)
    chosen = np.zeros(len(value), bool)
    chosen[at] = True
    found = np.flatnonzero(chosen)
    row = np.searchsorted(offsets, found, "right") - 1
    return row, found - offsets[row], value[found]


def _anchors(least: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            words, _, _, offsets = _words(*text_buffer(piece.column(2)))
            row, place, value = anchors(words, offsets, least, seed)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), piece.column(0).take(take), piece.column(1).take(take), pa.array(place.astype(np.int32))], ["anchor", "doc", "copy", "place"])

    return run


def _listed(piece: pa.RecordBatch, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows and places that column 3 lists, in order."""
    listed = piece.column(3)
    row = np.repeat(np.arange(piece.num_rows), np.diff(listed.offsets.to_numpy()))
    place = listed.flatten().to_numpy().astype(np.int64)
    order = np.lexsort((place, row))
    return row[order], place[order]


def _ragged(values: np.ndarray, begin: np.ndarray, count: np.ndarray) -> pa.Array:
    """values[begin : begin + count] of each row, as binary."""
    cuts = np.concatenate([[0], np.cumsum(count)])
    flat = values[np.repeat(begin - cuts[:-1], count) + np.arange(cuts[-1])]
    return pa.Array.from_buffers(pa.large_binary(), len(count), [None, pa.py_buffer((cuts * values.itemsize).astype(np.int64).tobytes()), pa.py_buffer(flat.tobytes())]).cast(pa.binary())


def _contexts(least: int, seed: int):
    reach = least - seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            words, _, _, offsets = _words(*text_buffer(piece.column(2)))
            windows = np.arange(max(0, len(words) - least + 1))
            seeds, checks, short = Rolling(words), Rolling(words)(windows, windows + least), (words >> U64(48)).astype(np.uint16)
            rows, places = _listed(piece, offsets)
            for k in range(0, len(rows), 1 << 16):
                row, place = rows[k : k + (1 << 16)], places[k : k + (1 << 16)]
                at = offsets[row] + place
                begin, end = np.maximum(at - reach, offsets[row]), np.minimum(at + seed + reach, offsets[row + 1])
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(seeds(at, at + seed).view(np.int64)), piece.column(0).take(take), piece.column(1).take(take), pa.array(place.astype(np.int32)), pa.array((at - begin).astype(np.int32)),
                        _ragged(short, begin, end - begin), _ragged(checks, begin, end - begin - least + 1),
                    ],
                    ["anchor", "doc", "copy", "place", "lead", "words", "checks"],
                )

    return run


def _windows(least: int, seed: int):
    """A row for each window whose anchor is listed: two hashes of it, and where it begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            words, _, _, offsets = _words(*text_buffer(piece.column(2)))
            row, place = _listed(piece, offsets)
            begin, at, _ = anchored(words, offsets, least, seed)
            begin = begin[np.isin(at, offsets[row] + place)]
            row = np.searchsorted(offsets, begin, "right") - 1
            take = pa.array(row)
            hashes = [Rolling(w)(begin, begin + least).view(np.int64) for w in (words, mix(words, 5))]
            yield pa.RecordBatch.from_arrays([*map(pa.array, hashes), piece.column(0).take(take), piece.column(1).take(take), pa.array((begin - offsets[row]).astype(np.int32))], ["one", "two", "doc", "copy", "start"])

    return run


def sort_block(bucket: np.ndarray, words: np.ndarray, lead: np.ndarray, width: np.ndarray, checks: np.ndarray, least: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of equal windows in a block of contexts.

    bucket: rising numbers of the contexts' buckets; words: the contexts' words one after another, which may be cut to few bits; lead, width: words of
    each before its anchor, and in all; checks: the hashes of all windows one after another. Gives the contexts and offsets of all windows, and for each
    the first context, in the order given, that has the same window: the same words and the same check.
    """
    reach = least - seed
    stride = -(-(seed + 2 * reach) // PERIOD) * PERIOD
    n, total = len(width), len(width) * stride
    own = np.repeat(np.arange(n), width)
    inside = np.arange(len(words)) - np.repeat(np.cumsum(width) - width, width)
    target = own * stride + inside + reach - lead[own]
    _, letters = np.unique(words, return_inverse=True)
    rank = np.arange(total, dtype=np.int64) + len(words) + 1  # padding differs from all else
    rank[target] = letters
    text = rank
    for step in (1, 2, 4, 8, 16):  # ranks by the first 2, 4, ... PERIOD words
        pair = rank.astype(U64) << U64(32)
        pair[:-step] |= rank[step:].astype(U64)
        _, rank = np.unique(pair, return_inverse=True)
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True
    ahead = np.array([next(d for d in range(PERIOD) if cover[(r + d) % PERIOD]) for r in range(PERIOD)])
    sample = np.flatnonzero(cover[np.arange(total) % PERIOD])
    deep, reached = np.full(total + stride, -1, np.int64), PERIOD
    deep[sample] = rank[sample]
    while reached < stride:
        _, finer = np.unique(((deep[sample] + 1).astype(U64) << U64(32)) | (deep[sample + reached] + 1).astype(U64), return_inverse=True)
        deep[sample], reached = finer, reached * 2
    # The windows of a context begin at its first reach + 1 places, where they are whole.
    begin = np.arange(reach + 1)
    context, offset = np.nonzero((begin >= (reach - lead)[:, None]) & (begin + least <= (reach - lead + width)[:, None]))
    at = context * stride + offset
    remainder = at % PERIOD
    order = np.lexsort((context, deep[at + ahead[remainder]], offset, rank[at], bucket[context]))
    s, c = at[order], context[order]
    far = least - PERIOD if least > PERIOD else 0
    fresh = np.ones(len(s), bool)
    fresh[1:] = (bucket[c[1:]] != bucket[c[:-1]]) | (offset[order][1:] != offset[order][:-1])
    if least >= PERIOD:
        fresh[1:] |= (rank[s[1:]] != rank[s[:-1]]) | (rank[s[1:] + far] != rank[s[:-1] + far])
    else:
        for k in range(least):
            fresh[1:] |= text[s[1:] + k] != text[s[:-1] + k]
    heads, check = np.flatnonzero(fresh), checks[order]
    if len(heads) and (check != np.repeat(check[heads], np.diff(np.append(heads, len(s))))).any():
        # Windows that agree in these bits of their words alone are parted by their checks.
        group = np.cumsum(fresh)
        parted = np.lexsort((c, check, group))
        order, c, check, group = order[parted], c[parted], check[parted], group[parted]
        heads = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (check[1:] != check[:-1])]))
    firsts = np.empty(len(s), np.int64)
    if len(heads):
        firsts[order] = np.repeat(np.minimum.reduceat(c, heads), np.diff(np.append(heads, len(s))))
    return context, offset, firsts


def _find(least: int, seed: int, block: int):
    reach = least - seed
    stride = -(-(seed + 2 * reach) // PERIOD) * PERIOD

    def flags(held: list[np.ndarray], known: int) -> tuple[pa.RecordBatch, np.ndarray]:
        """What repeats among the contexts, the first `known` of which were reported before, and which contexts have a first occurrence."""
        anchor, doc, copy, place, lead, width, words, checks = held
        bucket = np.cumsum(np.concatenate([[0], anchor[1:] != anchor[:-1]]))
        context, offset, first = sort_block(bucket, words, lead, width, checks, least, seed)
        later = first < context
        original = np.zeros(len(anchor), bool)
        original[context[~later]] = True
        c, o, f = (x[later & (context >= known)] for x in (context, offset, first))
        start = place[c] - reach + o
        cut = np.ones(len(c), bool)
        cut[1:] = (c[1:] != c[:-1]) | (o[1:] != o[:-1] + 1)
        heads = np.flatnonzero(cut)
        tails = np.append(heads[1:], len(c)) - 1 if len(heads) else heads
        source = np.minimum.reduceat(doc[f], heads) if len(heads) else doc[:0]
        found = pa.RecordBatch.from_arrays([pa.array(doc[c[heads]]), pa.array(copy[c[heads]]), pa.array(start[heads].astype(np.int32)), pa.array((start[tails] + least).astype(np.int32)), pa.array(source)], ["doc", "copy", "start", "stop", "source"])
        return found, original

    def chosen(held: list[np.ndarray], keep: np.ndarray) -> list[np.ndarray]:
        return [x[keep] for x in held[:6]] + [held[6][np.repeat(keep, held[5])], held[7][np.repeat(keep, held[5] - least + 1)]]

    def single(held: list[np.ndarray]) -> list[np.ndarray]:
        """held without the rows that say the same as the one before: those of documents that are there twice."""
        again = np.zeros(len(held[0]), bool)
        again[1:] = np.logical_and.reduce([x[1:] == x[:-1] for x in held[:4]])
        return chosen(held, ~again)

    def flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """The values of all rows of a binary column, and how many each has."""
        cuts = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        return np.frombuffer(column.buffers()[2], np.uint8)[cuts[0] : cuts[-1]].view(kind), np.diff(cuts) // np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        known = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            words, width = flat(batch.column(5), np.uint16)
            checks, _ = flat(batch.column(6), U64)
            cuts, new = np.concatenate([[0], np.cumsum(width)]), [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            # Rows go in by blocks, so that one batch never makes a larger one.
            for a in range(0, batch.num_rows, max(1, block // stride)):
                z = min(batch.num_rows, a + max(1, block // stride))
                part = [x[a:z] for x in (*new, width)] + [words[cuts[a] : cuts[z]], checks[cuts[a] - a * (least - 1) : cuts[z] - z * (least - 1)]]
                held = part if held is None else [np.concatenate(x) for x in zip(held, part)]
                if len(held[0]) - known < max(block // stride, known):
                    continue
                held = single(held)
                found, original = flags(held, known)
                yield found
                open_ = held[0] == held[0][-1]  # the last bucket may go on
                held = chosen(held, open_ & original)
                known = len(held[0])
        if held is not None and len(held[0]):
            yield flags(single(held), known)[0]

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.where("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("copy"), text.alias("text"))


def _copies(keyed: DataFrame) -> DataFrame:
    """(doc, copy, rep, n): the texts that a document of less doc_id, the least of which is rep, has whole, and their words."""
    same = ["copy", "other"]
    texts = keyed.select("doc", "copy", F.xxhash64(F.lit(1), "text").alias("other"), F.regexp_count("text", F.lit(f"[^{SPACE_CLASS[1:-1]}]+")).alias("n"))
    reps = texts.groupBy(*same).agg(F.min("doc").alias("rep"), F.max("doc").alias("last"), F.max("n").alias("n")).where("rep < last").drop("last")
    return texts.drop("n").join(reps, same).where("doc > rep").select("doc", "copy", "rep", "n").distinct()


def _passages(docs: DataFrame, least: int, seed: int) -> DataFrame:
    """(doc, copy, start, stop, source): the ranges of words to delete, and the least document that one of their windows occurred in first."""
    if not 8 < seed < least:
        raise ValueError(f"a seed of {seed} words for passages of {least}: 8 < seed < least")
    keyed = _keyed(docs)
    copies = stable(_copies(keyed))
    marks = keyed.mapInArrow(_anchors(least, seed), "anchor long, doc long, copy long, place int")
    # An anchor is shared if it is at two places, whatever copies of one text there are.
    at, most = F.xxhash64("copy", "place"), BLOCK // -(-(2 * least - seed) // PERIOD * PERIOD)
    shared = marks.groupBy("anchor").agg(F.min(at).alias("a"), F.max(at).alias("z"), F.count(F.lit(1)).alias("n")).where("a <> z").select("anchor", (F.col("n") > most).alias("hot"))
    listed = marks.join(shared, "anchor").groupBy("doc", "copy").agg(*[F.collect_set(F.when(F.col("hot") == hot, F.col("place"))).alias(name) for name, hot in (("places", False), ("hot", True))])
    listed = stable(listed.join(copies, ["doc", "copy"], "left_anti"))
    texts = lambda places: keyed.join(listed.where(F.size(places) > 0), ["doc", "copy"]).select("doc", "copy", "text", places)
    contexts = texts("places").mapInArrow(_contexts(least, seed), _CONTEXT).repartition("anchor").sortWithinPartitions("anchor", "doc", "copy", "place")
    ranges = contexts.mapInArrow(_find(least, seed, BLOCK), _FOUND)
    if not listed.where(F.size("hot") > 0).isEmpty():
        windows = stable(texts("hot").mapInArrow(_windows(least, seed), "one long, two long, doc long, copy long, start int")).withColumn("at", F.struct("doc", "copy", "start"))
        first = windows.groupBy("one", "two").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first < last").drop("last")
        again = windows.join(first, ["one", "two"]).where("at > first")
        ranges = ranges.unionByName(again.select("doc", "copy", "start", (F.col("start") + least).alias("stop"), F.col("first.doc").alias("source")))
    own = Window.partitionBy("doc", "copy").orderBy("start", "stop")
    reach = F.max("stop").over(own.rowsBetween(Window.unboundedPreceding, -1))
    cut = ranges.withColumn("begins", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("run", F.sum("begins").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    found = stable(cut.groupBy("doc", "copy", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("source").alias("source")).drop("run"))
    sources = found.groupBy(F.col("doc").alias("rep"), "copy").agg(F.min("source").alias("source"))
    whole = copies.where(F.col("n") >= least).join(sources, ["rep", "copy"], "left")
    return found.unionByName(whole.select("doc", "copy", F.lit(0).alias("start"), F.col("n").alias("stop"), F.least("source", "rep").alias("source")))


def repeated_passages(docs: DataFrame, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """(doc_id, first_word, last_word, source_doc_id), words from 0: ranges of which every window of `least` words occurred earlier, and the least doc_id in which one of those windows occurred first.

    Earlier is by doc_id, nulls first, then by a hash of the text, then by word. Rows that agree in doc_id and text are one
    document and have their ranges once. Null and empty texts, and those of fewer than `least` words, have none. Very long
    texts are whole. An empty table gives no row. The doc_id -2**63 counts as null. Raises ValueError unless 8 < seed < least.
    """
    found = _passages(docs, least, seed)
    return found.select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), F.col("start").alias("first_word"), (F.col("stop") - 1).alias("last_word"), F.nullif("source", F.lit(NO_ID)).alias("source_doc_id"))


def _without(texts: pa.Array, starts: pa.Array, stops: pa.Array) -> pa.Array:
    """The texts without the bytes from the first of each range of words to the end of its last and the space after it."""
    data, offsets = text_buffer(texts)
    _, begin, end, rows = _words(data, offsets)
    row = np.repeat(np.arange(len(texts)), np.diff(starts.offsets.to_numpy()))
    a, z = (x.flatten().to_numpy().astype(np.int64) + rows[row] for x in (starts, stops))
    after = np.append(begin, 0)[z]
    last = z == rows[row + 1]
    after[last] = offsets[row[last] + 1]
    gone = np.zeros(len(data) + 1, np.int32)
    np.add.at(gone, begin[a], 1)
    np.add.at(gone, after, -1)
    keep = np.cumsum(gone)[:-1] == 0
    left = np.concatenate([[0], np.cumsum(keep)])[offsets]
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(left.astype(np.int64).tobytes()), pa.py_buffer(data[keep].tobytes())]).cast(pa.string())


def drop_repeated_passages(docs: DataFrame, least: int = LEAST, seed: int = SEED, keep_emptied: bool = True) -> DataFrame:
    """docs, all rows and columns, with the repeated passages cut out of text. Cases as in repeated_passages; other texts stay as they are, null and empty ones too.

    keep_emptied=False leaves out the rows whose text had a word and has none any more.
    """
    doc, copy, starts, stops = salted_names(docs.columns, "doc", "copy", "starts", "stops")
    ranges = _passages(docs, least, seed).groupBy("doc", "copy").agg(F.collect_list(F.struct("start", "stop")).alias(starts))
    ranges = ranges.select(F.col("doc").alias(doc), F.col("copy").alias(copy), F.col(f"{starts}.start").alias(starts), F.col(f"{starts}.stop").alias(stops))
    return cut_ranges(docs, ranges, [doc, copy, starts, stops], _without, keep_emptied)
