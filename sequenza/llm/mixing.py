"""Bits per byte of each document by online logistic context mixing.

Each bit of a text is predicted from several contexts. A context and the bits of the byte that are known hash to a slot, and the zeros and ones that came in it
give a logit. Four predictors know the corpus: the last one to three bytes, and the word so far with the byte before it. Their counts are gathered from every document: each
task fills tables of its own and emits them in parts, parts are added up by part, so what is gathered grows with the input, while the model keeps
the size that is broadcast. Documents are in one of FOLDS folds by doc_id and are scored by the counts of the other folds, so a
document's own bits are never in the model that predicts it; a copy under another doc_id may be.

One more predictor knows nothing but the text so far: the byte that followed the last time that its last MATCH bytes (hashed) came, which it expects again as long as
the bits of the byte so far agree, and the more so the longer it has been right. The logits are combined by weights that are gated by the bit's place in the byte,
and the combined probability is refined by an adaptive table indexed by that, by whether the last byte was a letter, and by the logit. Weights and table take their step after
every bit. The eight bits of a byte go by different gates and cells, so they are worked out together, and texts pass by side by side, a byte of each at a
time; a long one is SEGMENT bytes after SEGMENT bytes, each beginning with START again but knowing the bytes before it. Probabilities keep LEAST away
from 0 and 1 on both sides, so the bits are a code's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequenza.llm.common import WORD, Rolling, pieces, text_buffer

#: Predictors, and the slots of each: 2**LINE_BITS lines of 16 slots, one line for each half of a byte.
CONTEXTS, LINE_BITS = 4, 17
SLOTS = 16 << LINE_BITS
#: Pieces in which a table is added up: their slots are 16-bit numbers.
PARTS = SLOTS >> 16
FOLDS = 2
#: Bytes of the context in the text itself, and what a run of right bytes adds to its logit, in 1/SCALE.
MATCH, TRUST = 5, 8
SEGMENT = 4096
#: Bytes that are prepared at once.
STEP = 1 << 16
#: Logits are kept as integers of 1/SCALE, at most LIMIT.
SCALE, LIMIT = 12, 10
CELLS, RATE, REFINE, LEAST = 24, 0.01, 0.02, 1 / 4096
START = (0.15, 0.3, 0.45, 0.3, 0.3)

_ODDS = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)]
_ALPHA = WORD.copy()
_ALPHA[48:58] = False
#: For each byte, eight bytes as one number: its bits as 1 and -1; and 1 for the bits up to the first that is set, 0 after it.
_SIGNS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int8) * 2 - 1).view(np.int64).ravel()
_AGREE = (np.cumsum(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1), axis=1) - np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) == 0).astype(np.int8).view(np.int64).ravel()

def contexts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The hashed contexts of each byte, a row for each predictor. Nothing before a row's start counts."""
    n = len(data)
    wide, place = data.astype(np.uint32), np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    back = []
    for k in (1, 2, 3):
        x = np.zeros(n, np.uint32)
        x[k:] = wide[:-k] if k < n else 0
        x[place < k] = 0
        back.append(x)
    one, two, three = back
    apart = np.ones(n + 1, bool)
    apart[1:] = ~_ALPHA[data]
    start = np.maximum(np.maximum.accumulate(np.where(apart[:n], np.arange(n), 0)), np.arange(n) - place)
    word = Rolling(data)(start, np.arange(n)).astype(np.uint32)
    before = np.where(start > np.arange(n) - place, wide[np.maximum(start - 2, 0)], np.uint32(0))
    two_back = one | (two << np.uint32(8))
    return np.stack([(one + np.uint32(1)) * _ODDS[0], (two_back + np.uint32(7)) * _ODDS[1], ((two_back | (three << np.uint32(16))) + np.uint32(77)) * _ODDS[2], (word ^ (before * _ODDS[3])) * _ODDS[0]])


def _lines(hashes: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first slots of the two lines of each byte, for one predictor."""
    shift = np.uint32(32 - LINE_BITS)
    high = hashes ^ (hashes >> np.uint32(15))
    low = (high + (data >> 4).astype(np.uint32) + np.uint32(1)) * _ODDS[3]
    low ^= low >> np.uint32(13)
    return ((high * _ODDS[1]) >> shift) << np.uint32(4), ((low * _ODDS[2]) >> shift) << np.uint32(4)


def count(tables: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Adds the texts to tables (CONTEXTS x SLOTS): how often each half byte came in each line, from which the counts of its bits follow."""
    hashes = contexts(data, offsets)
    for k in range(CONTEXTS):
        high, low = _lines(hashes[k], data)
        for at in (high | (data >> 4), low | (data & 15)):
            np.add.at(tables[k], at, tables.dtype.type(1))


def logits(tables: np.ndarray) -> np.ndarray:
    """The predictors, as integers of 1/SCALE: for each line and half byte the logits of its four bits, each by the bits before it."""
    lines = tables.reshape(-1, 16).astype(np.float64)
    out = np.empty((len(lines), 16, 4), np.int8)
    for bit in range(4):
        both = lines.reshape(-1, 1 << bit, 2, 8 >> bit).sum(3)
        value = np.clip(np.log((both[..., 1] + 0.4) / (both[..., 0] + 0.4)), -LIMIT, LIMIT)
        out[:, :, bit] = np.repeat(np.rint(value * SCALE), 16 >> bit, axis=1)
    return out.reshape(*tables.shape, 4)


def matched(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte that each one's text leads to expect, and how many bytes before were as expected in a row (at most TRUST); -1 and 0 where the MATCH bytes before it are new."""
    n = len(data)
    place, row = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets)), np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.flatnonzero(place >= MATCH)
    key = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(1, MATCH + 1):
            key = key * np.uint64(0x9E3779B97F4A7C15) + data[at - k] + np.uint64(1)
        key *= np.uint64(0xD1342543DE82EF95)
    bits = np.uint64(n.bit_length())
    key = np.sort(((row[at].astype(np.uint64) << np.uint64(24)) | (key >> np.uint64(40))) << bits | at.astype(np.uint64))
    where = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    again = np.flatnonzero((key[1:] >> bits) == (key[:-1] >> bits))
    expected = np.full(n, -1, np.int16)
    expected[where[again + 1]] = data[where[again]]
    wrong = np.maximum.accumulate(np.where((expected != data) | (place == 0), np.arange(n), 0))  # the last byte that wasn't as expected
    run = np.zeros(n, np.int64)
    run[1:] = np.arange(n - 1) - wrong[:-1]
    run[place == 0] = 0
    return expected, np.where(expected < 0, 0, np.minimum(run, TRUST))


def score(models: np.ndarray, folds: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bits that each row takes by the model of its fold. models: the logits of each."""
    rows, sizes = len(offsets) - 1, np.diff(offsets)
    cost = np.zeros(rows)
    if not len(data):
        return cost
    # Lanes: segments of rows, longest first, so that those that still go on are a prefix. All is put in the order of steps, and of lanes in a step.
    parts = -(-sizes // SEGMENT)
    row = np.repeat(np.arange(rows), parts)
    part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    length = np.minimum(sizes[row] - part * SEGMENT, SEGMENT)
    order = np.argsort(-length, kind="stable")
    lanes, steps = len(order), int(length[order[0]])
    begin = np.concatenate([[0], np.cumsum(np.searchsorted(-length[order], -np.arange(steps), "left"))])
    lane = np.empty(lanes, np.int64)
    lane[order] = np.arange(lanes)
    place = begin[(np.arange(len(data)) - np.repeat(offsets[:-1], sizes)) % SEGMENT] + np.repeat(lane, length)
    n, packed = len(data), np.ascontiguousarray(models).view(np.int32).ravel()
    hashes, byte_of, gate_of, base, guess, trust = np.empty((n, CONTEXTS), np.uint32), np.empty(n, np.uint8), np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.uint8), np.empty(n, np.int8)
    gates, bases, cut = np.repeat(2 * lane, length), folds.astype(np.int64) * (CONTEXTS * SLOTS), 0
    while cut < rows:  # rows by rows and then places by places, so that what is worked on stays in the processor's cache
        end = max(cut + 1, int(np.searchsorted(offsets, offsets[cut] + STEP, "right")) - 1)
        a, z = offsets[cut], offsets[end]
        if z > a:
            own, within = data[a:z], offsets[cut : end + 1] - a
            after = np.zeros(z - a, bool)  # after a letter
            after[1:] = _ALPHA[own[:-1]]
            after[within[:-1][np.diff(within) > 0]] = False
            expected, run = matched(own, within)
            to = place[a:z]
            hashes[to], byte_of[to], gate_of[to], base[to] = contexts(own, within).T, own, gates[a:z] + after, np.repeat(bases[cut:end], np.diff(within))
            guess[to], trust[to] = np.maximum(expected, 0), np.where(expected >= 0, TRUST * (1 + run), 0)
        cut = end
    data, known = byte_of, np.empty((CONTEXTS + 1, n, 8), np.int8)  # the logits of the bits
    for a in range(0, n, STEP):
        z = min(n, a + STEP)
        own = data[a:z]
        for k in range(CONTEXTS):
            halves = known[k, a:z].view(np.int32)
            for half, (line, nibble) in enumerate(zip(_lines(np.ascontiguousarray(hashes[a:z, k]), own), (own >> 4, own & 15))):
                at = (line | nibble).astype(np.int64)
                at += base[a:z]
                at += k * SLOTS
                halves[:, half] = packed.take(at)
        known[CONTEXTS, a:z] = _SIGNS.take(guess[a:z]).view(np.int8).reshape(-1, 8) * _AGREE.take(guess[a:z] ^ own).view(np.int8).reshape(-1, 8) * trust[a:z, None]
    del hashes, base, guess, trust, place, gates
    weights = np.repeat(np.repeat(np.array(START, np.float32) / SCALE, 8).reshape(-1, 1, 8), lanes, axis=1)
    middle = np.arange(-(CELLS // 2), CELLS - CELLS // 2) * (16 / CELLS)
    table = np.tile((1 / (1 + np.exp(-middle))).astype(np.float32), lanes * 16)
    cells, total, rate = np.arange(8) * CELLS + CELLS // 2, np.zeros(lanes), np.float32(RATE / SCALE**2)
    for a, z in zip(begin[:-1].tolist(), begin[1:].tolist()):
        y, x, w = np.unpackbits(data[a:z, None], axis=1).astype(np.float32), known[:, a:z].astype(np.float32), weights[:, : z - a]
        t = w[0] * x[0]
        for k in range(1, CONTEXTS + 1):
            t += w[k] * x[k]
        np.maximum(t, np.float32(-8), out=t)
        np.minimum(t, np.float32(7.999), out=t)
        p = np.exp(-t)
        p += 1
        np.reciprocal(p, out=p)
        t *= np.float32(CELLS / 16)
        cell = t.astype(np.int64)  # towards 0 from both sides: the middle cell is twice as wide
        cell += cells
        cell += (gate_of[a:z] * (8 * CELLS))[:, None]
        refined = table.take(cell)
        final = p + refined
        final *= np.float32(0.5)
        np.maximum(final, np.float32(LEAST), out=final)
        np.minimum(final, np.float32(1 - LEAST), out=final)
        final += y
        final -= 1  # the probability of what came, or less it; signs go with the eight
        final = final[:, :4] * final[:, 4:]
        final = final[:, :2] * final[:, 2:]
        total[: z - a] -= np.log2(np.abs(final[:, 0] * final[:, 1]))
        refined *= np.float32(1 - REFINE)
        refined += y * np.float32(REFINE)
        table[cell] = refined
        y -= p
        y *= rate
        x *= y
        w += x
    np.add.at(cost, row[order], total)
    return cost


def train(docs: DataFrame, folds: int = FOLDS) -> np.ndarray:
    """The models of all texts of docs: of each fold, by the counts of all others; with one fold, of all."""
    width = 1 << 16

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.zeros((folds, CONTEXTS, SLOTS), np.uint32)
        for piece in pieces(batches, "text", 2 * STEP):
            fold = piece.column(1).to_numpy()
            for f in range(folds):
                data, offsets = text_buffer(piece.column(0).filter(pa.array(fold == f)))
                if len(data):
                    count(tables[f], data, offsets)
        for k, own in enumerate(tables.reshape(-1, width)):
            at = np.flatnonzero(own)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([at.astype(np.uint16).tobytes()]), pa.array([own[at].tobytes()])], ["part", "at", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # by the part of a model
        for batch in batches:
            for part, at, n in zip(*(c.to_pylist() for c in batch.columns)):
                sums.setdefault(part, np.zeros(width, np.int64))[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.uint32)
        for part, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([logits(own).tobytes()])], ["part", "logits"])

    texts = docs.where("text IS NOT NULL").select(F.col("text").cast("string").alias("text"), _fold(folds).alias("fold"))
    each = CONTEXTS * PARTS
    partial = texts.mapInArrow(tally, "part int, at binary, n binary")
    if folds > 1:  # a part goes to the models of all other folds
        others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.floor(F.col("part") / each))
        partial = partial.select("part", "at", "n", F.explode(others).alias("f")).select((F.col("f") * each + F.col("part") % each).cast("int").alias("part"), "at", "n")
    model = np.zeros((folds * each, width * 4), np.int8)
    for r in partial.repartition(F.col("part")).mapInArrow(add, "part int, logits binary").toLocalIterator():
        model[r["part"]] = np.frombuffer(r["logits"], np.int8)
    return model.reshape(folds, CONTEXTS, SLOTS, 4)


def _fold(folds: int):
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(folds)).cast("int")


def bits_per_byte(docs: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_bytes, bits, bits_per_byte), a row for each row of docs, repeated ones too, by the model of corpus, or of the other folds of docs itself if that is None.

    Null and empty texts have 0 bytes and bits and null bits_per_byte. A null doc_id stays null; such rows are one fold. Rows that agree in doc_id and text have
    equal bits. Very long texts are read whole. An empty corpus predicts every bit by half at first. An empty table gives no row. Other columns, whatever their
    names, aren't looked at.
    """
    folds = FOLDS if corpus is None else 1
    models = docs.sparkSession.sparkContext.broadcast(train(docs if corpus is None else corpus, folds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", 1 << 21):
            data, offsets = text_buffer(piece.column(1))
            n, bits = np.diff(offsets), score(models.value, piece.column(2).to_numpy(), data, offsets)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n), pa.array(bits), pa.array(bits / np.maximum(n, 1), mask=n == 0)], ["doc_id", "n_bytes", "bits", "bits_per_byte"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _fold(folds).alias("fold")).mapInArrow(run, "doc_id long, n_bytes long, bits double, bits_per_byte double")
