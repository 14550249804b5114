"""SentencePiece encoding and decoding for merge-type vocabularies, by a score-ordered agenda of adjacent symbol pairs.

Encoding starts from single characters and merges, again and again, the adjacent pair whose piece has the best score, the
leftmost among ties. No piece of a merge-type vocabulary has the word mark after another character, so merges never cross
from a word into the next mark and each distinct unit (marks, then other characters) of a batch is encoded once. Units
of the same number of symbols share a matrix of pair scores: a step takes every row's best pair, merges it and scores
the two pairs beside it anew. Very long units use a heap instead. Every batch is checked against the sentencepiece library.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequenza.llm.common import U64, Rolling, pieces

MARK = 0x2581
#: Symbols of a unit beyond which its agenda is a heap.
LONG = 64
_NEVER = np.int32(2**31 - 1)
_FREE = U64(2**64 - 1)
_ODD = U64(0x9E3779B97F4A7C15)

SCHEMA = "doc_id long, n_pieces int, pieces array<int>, round_trip boolean, as_library boolean"


class Table:
    """A hash table from unsigned keys to small integers."""

    def __init__(self, keys: list[int], values: list[int]):
        bits = max(4, (3 * len(keys)).bit_length())
        self.shift, self.mask = U64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, _FREE, U64), np.zeros(1 << bits, np.int32)
        for key, value in zip(keys, values):
            slot = (key * int(_ODD) & (2**64 - 1)) >> (64 - bits)
            while self.keys[slot] != _FREE:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.values[slot] = key, value

    def __call__(self, keys: np.ndarray, missing: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            slot = ((keys * _ODD) >> self.shift).astype(np.int64)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], np.int32(missing))
        left = np.flatnonzero((found != keys) & (found != _FREE))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            found = self.keys[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (found != _FREE)]
        return out


@dataclass
class Vocabulary:
    """Symbols are piece ids, or larger numbers for characters that are no piece but part of one."""

    chars: Table
    pairs: Table  # left symbol << 32 | right symbol -> the piece they make
    rank: np.ndarray  # of each piece in the order of scores, equal scores having equal ranks; a last one for pairs that make none
    size: int
    bytes_of: np.ndarray  # the ids of the byte pieces
    unknown: int
    texts: np.ndarray  # all pieces' bytes ...
    starts: np.ndarray  # ... and where each begins, and the last ends


def load(path: str) -> Vocabulary:
    """The vocabulary of a merge-type model. Raises ValueError for one of another type, or that changes texts in another way than by marks for spaces and one before them."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    how, texts = proto.trainer_spec, proto.normalizer_spec
    if how.model_type != how.BPE or how.treat_whitespace_as_suffix:
        raise ValueError(f"{path} isn't a merge-type model with the word mark before words")
    if texts.precompiled_charsmap or texts.remove_extra_whitespaces or not texts.add_dummy_prefix or not texts.escape_whitespaces:
        raise ValueError(f"{path} normalises texts: only the identity with a mark before the text is encoded here")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    names = [model.id_to_piece(k) for k in range(size)]
    plain = [k for k in range(size) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
    crossing = [names[k] for k in plain if "▁" in names[k].lstrip("▁")]
    if crossing:
        raise ValueError(f"the word mark is inside pieces such as {crossing[0]!r}: not a merge-type vocabulary split at words")
    symbol = {names[k]: k for k in plain}
    for k in plain:
        for c in names[k]:
            symbol.setdefault(c, size + len(symbol))
    scored = sorted({names[k]: (-model.get_score(k), k) for k in plain if len(names[k]) > 1}.items(), key=lambda x: x[1])
    place: dict[float, int] = {}
    keys, values, rank = [], [], np.full(size + 1, _NEVER, np.int32)
    for name, (score, k) in scored:
        rank[k] = place.setdefault(score, len(place))
        for cut in range(1, len(name)):
            left, right = symbol.get(name[:cut]), symbol.get(name[cut:])
            if left is not None and right is not None:
                keys.append(left << 32 | right)
                values.append(k)
    bytes_of = np.full(256, model.unk_id(), np.int32)
    for k in range(size):
        if model.is_byte(k):
            bytes_of[int(names[k][3:5], 16)] = k
    texts = [bytes([int(n[3:5], 16)]) if model.is_byte(k) else b"" if model.is_control(k) else n.replace("▁", " ").encode() for k, n in enumerate(names)]
    texts[model.unk_id()] = " ⁇ ".encode()
    return Vocabulary(
        Table([ord(c) for c in symbol if len(c) == 1], [k for c, k in symbol.items() if len(c) == 1]), Table(keys, values), rank, size,
        bytes_of, model.unk_id(), np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]),
    )


def _merged(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The pieces that pairs of symbols make, -1 where they make none."""
    made = v.pairs((np.maximum(left, 0).astype(U64) << U64(32)) | np.maximum(right, 0).astype(U64), -1)
    return np.where((left >= 0) & (right >= 0), made, -1)


def _ranks(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return v.rank[_merged(v, left, right)]


def _heap(v: Vocabulary, symbols: np.ndarray) -> np.ndarray:
    """The places of a long unit's symbols after all merges, as (place, symbol) pairs."""
    n = len(symbols)
    ranks = _ranks(v, symbols[:-1], symbols[1:])
    own, following, before = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
    agenda = [(int(r), k, k + 1, own[k], own[k + 1]) for k, r in enumerate(ranks) if r != _NEVER]
    heapq.heapify(agenda)
    pair = lambda a, b: int(_ranks(v, np.array([own[a]]), np.array([own[b]]))[0])
    gone = [False] * n
    while agenda:
        _, a, b, x, y = heapq.heappop(agenda)
        if gone[a] or gone[b] or following[a] != b or own[a] != x or own[b] != y:
            continue
        own[a], gone[b] = int(_merged(v, np.array([x]), np.array([y]))[0]), True
        following[a] = following[b]
        if following[a] < n:
            before[following[a]] = a
        for p, q in ((before[a], a), (a, following[a])):
            if p >= 0 and q < n and (r := pair(p, q)) != _NEVER:
                heapq.heappush(agenda, (r, p, q, own[p], own[q]))
    places = [k for k in range(n) if not gone[k]]
    return np.array([places, [own[k] for k in places]])


def _matrix(v: Vocabulary, symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Units of equally many symbols, merged: (rows, places, symbols) of those that end with equally many."""
    n, width = symbols.shape
    rows, places = np.arange(n), np.broadcast_to(np.arange(width), (n, width))
    ranks = _ranks(v, symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(n, width - 1)
    while len(rows):
        if symbols.shape[1] == 1:
            yield rows, places, symbols
            return
        at = np.argmin(ranks, axis=1)
        best = ranks[np.arange(len(rows)), at]
        done = best == _NEVER
        if done.any():
            yield rows[done], places[done], symbols[done]
            rows, places, symbols, ranks, at, best = (x[~done] for x in (rows, places, symbols, ranks, at, best))
            if not len(rows):
                return
        each, width = np.arange(len(rows)), symbols.shape[1]
        kept = np.arange(width - 1) <= at[:, None]
        made = _merged(v, symbols[each, at], symbols[each, at + 1])
        symbols = np.where(kept, symbols[:, :-1], symbols[:, 1:])
        places = np.where(kept, places[:, :-1], places[:, 1:])
        symbols[each, at] = made
        if width == 2:
            continue
        ranks = np.where(kept[:, :-1], ranks[:, :-1], ranks[:, 1:])
        for first in (at - 1, at):
            ok = np.flatnonzero((first >= 0) & (first < width - 2))
            ranks[ok, first[ok]] = _ranks(v, symbols[ok, first[ok]], symbols[ok, first[ok] + 1])


def encode(v: Vocabulary, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after another, and the offsets of the texts in them."""
    joined = "".join(f"▁{t}" if t else "" for t in texts)
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    chars[chars == 32] = MARK
    sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    n = len(chars)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    mark = chars == MARK
    first = np.zeros(n, bool)
    first[1:] = mark[1:] & ~mark[:-1]
    first[offsets[:-1][sizes > 0]] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], n)
    _, some, of = np.unique(Rolling(chars)(starts, ends), return_index=True, return_inverse=True)
    begin, width = starts[some], (ends - starts)[some]
    symbol = v.chars(chars.astype(U64), -1)
    keep = np.zeros(n, np.int32)  # of each place in a distinct unit: 1 + its symbol, 2**30 if unknown, 0 if merged away
    for length in np.unique(width).tolist():
        own = begin[width == length]
        if length > LONG:
            for b in own.tolist():
                place, made = _heap(v, symbol[b : b + length])
                keep[b + place] = np.where(made < 0, 2**30, made + 1)
        elif length == 1:
            keep[own] = np.where(symbol[own] < 0, 2**30, symbol[own] + 1)
        else:
            for rows, places, made in _matrix(v, symbol[own[:, None] + np.arange(length)]):
                keep[own[rows][:, None] + places] = np.where(made < 0, 2**30, made + 1)
    where = np.flatnonzero(keep)
    made = keep[where] - 1
    other = made >= v.size
    # Characters that are no piece become the pieces of their bytes.
    code = chars[where]
    wide = np.where(other, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF), 1) if (v.bytes_of != v.unknown).any() else np.ones(len(where), np.int64)
    out = np.repeat(made, wide)
    if other.any():
        head = np.cumsum(wide) - wide
        flat = np.frombuffer("".join(map(chr, code[other].tolist())).encode("utf-8", "surrogatepass"), np.uint8)
        if (v.bytes_of != v.unknown).any():
            out[np.repeat(other, wide)] = v.bytes_of[flat]
        else:
            out[head[other]] = v.unknown
    cuts = np.concatenate([[0], np.cumsum(wide)])
    from_, to = cuts[np.searchsorted(where, begin)], cuts[np.searchsorted(where, begin + width)]
    lengths = (to - from_)[of]
    total = np.concatenate([[0], np.cumsum(lengths)])
    ids = out[np.repeat(from_[of] - total[:-1], lengths) + np.arange(total[-1])]
    return ids.astype(np.int32), total[np.searchsorted(starts, offsets)]


def decode(v: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The texts of the ids; the space before a text that stands for its first mark is dropped."""
    lengths = np.diff(v.starts)[ids]
    total = np.concatenate([[0], np.cumsum(lengths)])
    data = v.texts[np.repeat(v.starts[ids] - total[:-1], lengths) + np.arange(total[-1])].tobytes()
    cuts = total[offsets].tolist()
    return [data[a + (data[a : a + 1] == b" ") : b].decode("utf-8", "replace") if a < b else "" for a, b in zip(cuts, cuts[1:])]


_loaded: dict = {}


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_pieces, pieces, round_trip, as_library), a row for each row of docs, repeated ones too.

    round_trip says that the pieces decode to the text, as_library that the sentencepiece library gives the same pieces. For a null text all four are
    null; an empty one has no pieces. A null doc_id stays null. A text with the mark itself in it decodes to a space there, so its
    round_trip is false. Very long texts and words are whole. An empty table gives no row. model: a file that every worker can read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        if model not in _loaded:
            _loaded[model] = load(model), sentencepiece.SentencePieceProcessor(model_file=model)
        v, library = _loaded[model]
        for piece in pieces(batches, "text", 1 << 20):
            texts = piece.column(1).to_pylist()
            known = [t or "" for t in texts]
            ids, offsets = encode(v, known)
            null = np.array([t is None for t in texts])
            trip = np.array([a == b for a, b in zip(decode(v, ids, offsets), known)], bool)
            listed, cuts = ids.tolist(), offsets.tolist()
            same = np.array([listed[a:b] == other for a, b, other in zip(cuts, cuts[1:], library.encode(known, num_threads=1))], bool)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids), mask=pa.array(null))
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.diff(offsets).astype(np.int32), mask=null), lists, pa.array(trip, mask=null), pa.array(same, mask=null)], ["doc_id", "n_pieces", "pieces", "round_trip", "as_library"])

    if not os.path.exists(model):
        raise FileNotFoundError(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
