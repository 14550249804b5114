"""Language identification in two steps: first the family, then one-versus-one linear SVMs between its languages.

Features are hashed byte pairs and triplets of the lower-cased text, as relative frequencies. Every classifier is a
linear SVM (squared hinge, L2) between two classes; a document gets the family, then the language, that wins most of
its duels, ties going to the larger sum of margins. All weights form one table, so a text costs one lookup for each of
its n-grams. The classifiers are fitted on a bounded sample of labelled rows (TRAIN_ROWS, those with the least hashes
of doc_id); prediction reads every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequenza.llm.common import pieces, row_sums, text_buffer

#: A language that isn't named here is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "pl": "slavic", "cs": "slavic", "sk": "slavic", "ru": "slavic", "uk": "slavic", "bg": "slavic",
}
SLOTS = 4096
#: Labelled rows that the classifiers are fitted on, at most.
TRAIN_ROWS = 2000
STEPS, PENALTY = 120, 1e-3

SCHEMA = "doc_id long, family string, language string, margin double"


@dataclass
class Duels:
    """Linear classifiers between pairs of classes: weights[:, k] > 0 speaks for classes[pairs[k][0]]."""

    classes: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray  # SLOTS + 1 rows, of which the last is 0
    bias: np.ndarray


@dataclass
class Model:
    families: Duels
    languages: dict[str, Duels]


def slots(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte of the texts the slot of the pair and of the triplet that start there (SLOTS where none does), and the offsets."""
    data, offsets = text_buffer(pc.utf8_lower(texts.cast(pa.string())))
    n = len(data)
    wide = np.zeros(n + 2, np.uint32)
    wide[:n] = data
    two = wide[:-2] | (wide[1:-1] << np.uint32(8))
    three = two | (wide[2:] << np.uint32(16))
    shift = np.uint32(32 - SLOTS.bit_length() + 1)
    pair, triplet = [((x * np.uint32(odd)) >> shift).astype(np.int16) for x, odd in ((two, 0x9E3779B1), (three, 0x85EBCA6B))]
    ends = offsets[1:]
    full = ends > offsets[:-1]
    pair[ends[full] - 1] = triplet[ends[full] - 1] = SLOTS
    longer = ends - offsets[:-1] > 1
    triplet[ends[longer] - 2] = SLOTS
    return pair, triplet, offsets


def _grams(offsets: np.ndarray) -> np.ndarray:
    sizes = np.diff(offsets)
    return np.maximum(sizes - 1, 0) + np.maximum(sizes - 2, 0)


def frequencies(texts: pa.Array) -> np.ndarray:
    """The relative frequencies of the slots, a row for each text."""
    pair, triplet, offsets = slots(texts)
    out = np.zeros((len(texts), SLOTS + 1), np.float32)
    for k in range(len(texts)):
        for part in (pair, triplet):
            out[k] += np.bincount(part[offsets[k] : offsets[k + 1]], minlength=SLOTS + 1)
    return out[:, :SLOTS] / np.maximum(_grams(offsets), 1)[:, None].astype(np.float32)


def _svm(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """A linear SVM with squared hinge loss and balanced classes, by accelerated gradient steps; y is 1 or -1."""
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    rows = np.hstack([x, np.ones((len(x), 1), np.float32)])
    rate = 1 / (2 * float((weight * (rows**2).sum(1)).sum()) + PENALTY)
    w = before = np.zeros(rows.shape[1], np.float32)
    for step in range(STEPS):
        ahead = w + (w - before) * np.float32(step / (step + 3))
        slack = np.maximum(0, 1 - y * (rows @ ahead))
        before, w = w, ahead - np.float32(rate) * (rows.T @ (-2 * weight * slack * y) + np.float32(PENALTY) * ahead)
    return w[:-1], float(w[-1])


def _duels(x: np.ndarray, names: list[str]) -> Duels:
    classes = sorted(set(names))
    of = np.array([classes.index(n) for n in names])
    pairs = [(a, b) for a in range(len(classes)) for b in range(a + 1, len(classes))]
    weights, bias = np.zeros((SLOTS + 1, len(pairs)), np.float32), np.zeros(len(pairs))
    scale = 1 / np.sqrt(x.mean(0) + np.float32(1e-6))  # rare n-grams count as much as common ones
    for k, (a, b) in enumerate(pairs):
        own = (of == a) | (of == b)
        w, bias[k] = _svm(x[own] * scale, np.where(of[own] == a, 1, -1).astype(np.float32))
        weights[:SLOTS, k] = w * scale
    return Duels(classes, pairs, weights, bias)


def fit(texts: pa.Array, langs: list[str]) -> Model:
    """The classifiers for labelled texts. Without any texts the model knows no language."""
    x = frequencies(texts)
    groups = [FAMILIES.get(n, n) for n in langs]
    families = _duels(x, groups)
    return Model(families, {f: _duels(x[own], [n for n, g in zip(langs, groups) if g == f]) for f in families.classes if (own := np.array([g == f for g in groups])).any()})


def _winners(duels: Duels, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class that wins most duels in each row of sums, and its mean margin."""
    votes = np.zeros((len(sums), len(duels.classes)))
    total = np.zeros_like(votes)
    for k, (a, b) in enumerate(duels.pairs):
        margin = sums[:, k] + duels.bias[k]
        votes[:, a] += margin > 0
        votes[:, b] += margin <= 0
        total[:, a] += margin
        total[:, b] -= margin
    best = np.argmax(votes + 0.5 * np.tanh(total / (1 + np.abs(total).max(initial=0))), axis=1)
    return best, total[np.arange(len(sums)), best] / max(len(duels.classes) - 1, 1)


def predict(model: Model, texts: pa.Array) -> tuple[list[str | None], list[str | None], np.ndarray]:
    """Family, language and margin of each text; None and 0 for a text of fewer than two bytes."""
    pair, triplet, offsets = slots(texts)
    grams = _grams(offsets)

    def sums(duels: Duels) -> np.ndarray:
        columns = [row_sums(w[pair] + w[triplet], offsets) / np.maximum(grams, 1) for w in duels.weights.T.copy()]
        return np.stack(columns, 1) if columns else np.zeros((len(grams), 0))

    n = len(grams)
    families, languages, margins = np.full(n, None, object), np.full(n, None, object), np.zeros(n)
    if model.families.classes:
        best, margin = _winners(model.families, sums(model.families))
        for k, family in enumerate(model.families.classes):
            own = (best == k) & (grams > 0)
            if own.any():
                duels = model.languages[family]
                inner, closer = _winners(duels, sums(duels)[own])
                families[own], languages[own] = family, np.array(duels.classes, object)[inner]
                margins[own] = closer if duels.pairs else margin[own]
    return families.tolist(), languages.tolist(), margins


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """The model for at most `rows` labelled documents, those with the least hashes of doc_id."""
    sample = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id").alias("at"))
    last = sample.select("at").orderBy("at").limit(rows).agg(F.max("at")).first()[0]  # so that no texts but the chosen ones are sorted
    table = sample.where(F.col("at") <= F.lit(last).cast("long")).orderBy("at", "lang", "text").limit(rows).toArrow()
    return fit(table.column("text").combine_chunks(), table.column("lang").to_pylist())


def identify(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, family, language, margin), a row for each row of docs, repeated ones too.

    A text that is null or shorter than two bytes has null family and language and margin 0; so has every text if no row is
    labelled. A null doc_id stays null. Rows with equal texts get equal results. Among classes with as many duels won the one with the larger margins wins, then the
    first by name. Very long texts are whole. An empty table gives no row. Other columns, whatever their names, aren't looked at.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            family, language, margin = predict(model.value, piece.column(1))
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(family, pa.string()), pa.array(language, pa.string()), pa.array(margin)], ["doc_id", "family", "language", "margin"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
