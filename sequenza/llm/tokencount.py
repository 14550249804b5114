"""Greedy longest-match token counts by a linear automaton.

The vocabulary is a trie with failure links. A node's failure link leads to the node where matching goes on after the
longest pieces of what was read are taken off; how many pieces those are is computed beforehand. A word is then counted
in time linear in its bytes, without building a piece: on a mismatch the node's popped count is added and its link is
followed. Steps run over all distinct words of a batch at once; goto's are a flat hash table.
"""

from __future__ import annotations

import functools
import os
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequenza.llm.common import U64, Rolling, pieces, row_sums, text_buffer

#: The folder of the public tokenizers' files, and the vocabulary that tokens are counted by.
TOKENIZERS = os.environ.get("SEQUENZA_TOKENIZERS", "/opt/tokenizers")
PIECE_MODEL = "piece_bpe_32k.model"
NONE = -1
_ODD = U64(0x9E3779B97F4A7C15)
_FREE = np.uint32(0xFFFFFFFF)


@dataclass
class Automaton:
    """fail and pops: of each node; ends: pieces still to pop at a word's end, NONE if that fails. keys, nodes: the hashed goto's."""

    fail: np.ndarray
    pops: np.ndarray
    ends: np.ndarray
    keys: np.ndarray
    nodes: np.ndarray
    shift: int

    def goto(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The child of each node by each byte, NONE where there is none."""
        key = (node.astype(np.uint32) << np.uint32(8)) | byte
        mask = len(self.keys) - 1
        with np.errstate(over="ignore"):
            slot = ((key.astype(U64) * _ODD) >> U64(self.shift)).astype(np.int64)
        found = self.keys[slot]
        out = np.where(found == key, self.nodes[slot], NONE)
        left = np.flatnonzero((found != key) & (found != _FREE))
        while len(left):
            slot[left] = (slot[left] + 1) & mask
            found = self.keys[slot[left]]
            hit = found == key[left]
            out[left[hit]] = self.nodes[slot[left[hit]]]
            left = left[~hit & (found != _FREE)]
        return out


def build(first: Iterable[bytes], later: Iterable[bytes]) -> Automaton:
    """The automaton for pieces that begin a word and pieces that continue one."""
    children: list[dict[int, int]] = [{}, {}]  # node 0 begins a word, node 1 continues it
    accepts = [False, False]
    for root, words in ((0, first), (1, later)):
        for word in words:
            at = root
            for byte in word:
                if (to := children[at].get(byte)) is None:
                    to = children[at][byte] = len(children)
                    children.append({})
                    accepts.append(False)
                at = to
            if at > 1:
                accepts[at] = True
    fail, pops = [NONE] * len(children), [0] * len(children)
    level = [0, 1]
    while level:
        following = []
        for node in level:
            for byte, to in children[node].items():
                following.append(to)
                if accepts[to]:
                    fail[to], pops[to] = 1, 1
                    continue
                z, count = fail[node], pops[node]
                while z != NONE and byte not in children[z]:
                    count += pops[z]
                    z = fail[z]
                if z != NONE:
                    fail[to], pops[to] = children[z][byte], count
        level = following
    ends = [NONE] * len(children)
    for node in range(len(children)):
        z, count = node, 0
        while z not in (1, NONE):
            count += pops[z]
            z = fail[z]
        ends[node] = count if z == 1 else NONE
    edges = [(node << 8 | byte, to) for node, own in enumerate(children) for byte, to in own.items()]
    bits = max(4, (2 * len(edges)).bit_length())
    keys, nodes = np.full(1 << bits, _FREE, np.uint32), np.zeros(1 << bits, np.int32)
    for key, to in edges:
        slot = (key * int(_ODD) & (2**64 - 1)) >> (64 - bits)
        while keys[slot] != _FREE:
            slot = (slot + 1) & ((1 << bits) - 1)
        keys[slot], nodes[slot] = key, to
    return Automaton(np.array(fail, np.int32), np.array(pops, np.int32), np.array(ends, np.int32), keys, nodes, 64 - bits)


def pieces_of_model(path: str) -> tuple[list[bytes], list[bytes]]:
    """The first and later pieces of a sentencepiece vocabulary: those with the word mark before them begin a word, and single characters may do both."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
    first = {p[1:] for p in own if p[0] == "▁" and "▁" not in p[1:] and len(p) > 1}
    later = {p for p in own if "▁" not in p}
    return sorted(p.encode() for p in first | {p for p in later if len(p) == 1}), sorted(p.encode() for p in later)


def vocabulary(folder: str = TOKENIZERS) -> tuple[list[bytes], list[bytes]]:
    """The first and later pieces of PIECE_MODEL in a folder of tokenizer files."""
    return pieces_of_model(f"{folder}/{PIECE_MODEL}")


def pieces_of_list(path: str) -> tuple[list[bytes], list[bytes]]:
    """The first and later pieces of a text file with one piece a line, later ones with ## before them."""
    with open(path, encoding="utf-8") as lines:
        own = [x.rstrip("\n") for x in lines]
    return [p.encode() for p in own if p and not p.startswith("##")], [p[2:].encode() for p in own if len(p) > 2 and p.startswith("##")]


def _kinds() -> np.ndarray:
    """0 white space, 2 punctuation and the ASCII symbols, 1 all else, by code point; planes beyond the third have no punctuation."""
    kinds = np.ones(0x110000, np.int8)
    kinds[[k for k in range(0x30000) if unicodedata.category(chr(k))[0] == "P"]] = 2
    kinds[[k for k in range(33, 127) if not chr(k).isalnum()]] = 2
    kinds[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 0
    return kinds


_KINDS = functools.cache(_kinds)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and how many each row has: runs without white space and punctuation, and each punctuation character, by the classes of Unicode."""
    n, table = len(data), _KINDS()
    kind = table[:256][data]
    lead = (data & 0xC0) != 0x80
    wide = np.flatnonzero(data >= 0xC0)
    if len(wide):
        byte = lambda k: data[np.minimum(wide + k, n - 1)].astype(np.int32) & 0x3F
        head = data[wide].astype(np.int32)
        size = 2 + (head >= 0xE0) + (head >= 0xF0)
        code = np.select([size == 2, size == 3], [(head & 0x1F) << 6 | byte(1), (head & 0x0F) << 12 | byte(1) << 6 | byte(2)], (head & 0x07) << 18 | byte(1) << 12 | byte(2) << 6 | byte(3))
        own = table[np.minimum(code, 0x10FFFF)]
        for k in range(4):
            kind[wide[size > k] + k] = own[size > k]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after, next_lead = np.zeros(n, np.int8), np.zeros(n, np.int8), np.ones(n, bool)
    before[1:], after[:-1], next_lead[:-1] = kind[:-1], kind[1:], lead[1:]
    starts = np.flatnonzero(np.where(kind == 2, lead, (kind == 1) & ((before != 1) | edge[:-1])))
    ends = np.flatnonzero(np.where(kind == 2, next_lead | edge[1:], (kind == 1) & ((after != 1) | edge[1:]))) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def count_words(automaton: Automaton, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Pieces of each word; a word that the vocabulary can't make is one unknown piece."""
    total = np.zeros(len(starts), np.int64)
    order = np.argsort(starts - ends, kind="stable")  # longest first, so that the words still being read are a prefix
    lengths = (ends - starts)[order]
    begins = starts[order]
    node = np.zeros(len(starts), np.int32)
    counts = np.zeros(len(starts), np.int64)
    alive = np.ones(len(starts), bool)
    for step in range(int(lengths[0]) if len(lengths) else 0):
        lanes = np.flatnonzero(alive[: np.searchsorted(-lengths, -step, "left")])
        if not len(lanes):
            break
        byte = data[begins[lanes] + step]
        while len(lanes):
            to = automaton.goto(node[lanes], byte)
            hit = to >= 0
            node[lanes[hit]] = to[hit]
            lanes, byte = lanes[~hit], byte[~hit]
            counts[lanes] += automaton.pops[node[lanes]]
            back = automaton.fail[node[lanes]]
            dead = back < 0
            alive[lanes[dead]] = False
            lanes, byte, back = lanes[~dead], byte[~dead], back[~dead]
            node[lanes] = back
    rest = automaton.ends[node]
    total[order] = np.where(alive & (rest != NONE), counts + rest, 1)
    return total


def count_texts(automaton: Automaton, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words and the tokens of each text, lower case or not as it is."""
    data, offsets = text_buffer(texts)
    starts, ends, counts = words(data, offsets)
    _, first, of = np.unique(Rolling(data)(starts, ends), return_index=True, return_inverse=True)
    each = count_words(automaton, data, starts[first], ends[first])[of]
    return counts, row_sums(each, np.concatenate([[0], np.cumsum(counts)]))


def token_counts(docs: DataFrame, first: list[bytes], later: list[bytes]) -> DataFrame:
    """(doc_id, n_words, n_tokens), a row for each row of docs, repeated ones too.

    Words are what white space and punctuation, of any script, part; each punctuation character is a word. Null and empty texts and those of spaces alone have 0 of both. A null doc_id stays null. Very long texts and words are
    read whole. An empty table gives no row.
    """
    automaton = docs.sparkSession.sparkContext.broadcast(build(first, later))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            n_words, n_tokens = count_texts(automaton.value, piece.column(1))
            yield pa.RecordBatch.from_arrays([piece.column(0), pc.cast(pa.array(n_words), pa.int64()), pa.array(n_tokens)], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
