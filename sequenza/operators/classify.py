"""Streaming TF-IDF and the online classifier over it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sequenza.functions import text
from sequenza.functions.keys import placed
from sequenza.operators import fold
from sequenza.operators.order import Order

#: Vocabularies of more rows than this are joined by a shuffle instead of a broadcast.
MOST_BROADCAST_ROWS = 500_000


def term_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, word, tf)."""
    whole = placed(docs.select("doc_id", "text"), "doc_id")
    return whole.select("doc_id", F.explode(text.tokens(F.col("text"))).alias("word")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("tf"))


def running_df(counts: DataFrame, segment: int = 1 << 16) -> DataFrame:
    """counts with df: in how many documents the word came so far, this one included, by doc_id."""
    return fold.running_count(counts, ["word"], Order(["doc_id"]), "df", F.floor(F.col("doc_id") / segment))


def tfidf(counts: DataFrame, number: Column) -> DataFrame:
    """counts (with df) with weight = tf * ln(number / df) + 1, scaled to length 1 in each document. number: how many documents came so far."""
    raw = counts.withColumn("raw", F.col("tf") * F.log(number / F.col("df")) + 1)
    return raw.withColumn("weight", F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("doc_id")))).drop("raw")


def decayed_idf(counts: DataFrame, every: int, factor: float) -> DataFrame:
    """(word, df): document counts of which all earlier ones are multiplied by `factor` after each block of `every` documents, at the last document; doc_id counts from 0."""
    block = F.floor(F.col("doc_id") / every)
    last = counts.agg(F.max(block).alias("last"))
    return counts.crossJoin(last).groupBy("word").agg(F.sum(F.pow(F.lit(factor), F.col("last") - block)).alias("df"))


def windowed_weight(counts: DataFrame, window: Column) -> DataFrame:
    """(doc_id, word, weight): tf / sum of tf * ln(window / df), scaled to length 1, without a constant; counts has df."""
    of = Window.partitionBy("doc_id")
    raw = counts.withColumn("raw", F.col("tf") / F.sum("tf").over(of) * F.log(window / F.col("df")))
    return raw.withColumn("weight", F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(of))).select("doc_id", "word", "weight")


def vectorized(words: DataFrame, vocabulary: DataFrame, unknown: int = 0) -> DataFrame:
    """words with idx from vocabulary (word, idx), and `unknown` for words that aren't in it."""
    small = vocabulary.limit(MOST_BROADCAST_ROWS + 1).count() <= MOST_BROADCAST_ROWS
    return words.join(F.broadcast(vocabulary) if small else vocabulary, "word", "left").withColumn("idx", F.coalesce("idx", F.lit(unknown)))


def vocabulary_of(counts: DataFrame, least: int = 2) -> DataFrame:
    """(word, idx): words of at least `least` documents, numbered from 1 by frequency and then by word."""
    common = counts.groupBy("word").agg((-F.count(F.lit(1))).alias("fewer")).where(F.col("fewer") <= -least).withColumn("one", F.lit(1).cast("long"))
    return fold.running_sum(common, ["fewer", "word"], "one", "idx").select("word", "idx")


@dataclass(frozen=True)
class Learned:
    """A feature's place among the rows, and the rows: z, n and the weights that the feature's last step computed, one of each for each class. Row 0 is that of features not seen yet, all 0."""

    places: dict[int, int]
    rows: np.ndarray


@dataclass(frozen=True)
class Ftrl:
    """FTRL-proximal for softmax regression over sparse rows; predictions are logistic scores scaled to sum 1."""

    classes: int
    alpha: float = 132.0
    beta: float = 0.1
    l1: float = 0.0086
    l2: float = 0.095

    def start(self) -> Learned:
        """No feature yet."""
        return Learned({}, np.zeros((1024, 3, self.classes)))

    def learn(self, state: Learned, idx: list[int], values: np.ndarray, label: int) -> Learned:
        """The state after one labelled row, in place: the rows of the touched features change. idx has no feature twice."""
        places = state.places
        at = np.array([places.setdefault(k, len(places) + 1) for k in idx], np.int64)
        rows = state.rows
        if len(places) >= len(rows):
            rows = np.concatenate([rows, np.zeros((max(len(rows), len(places) + 1), 3, self.classes))])
        z, n, _ = rows[at].swapaxes(0, 1)
        w = np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))
        scores = values @ w
        p = np.exp(scores - scores.max())
        p /= p.sum()
        gradient = values[:, None] * (p - (np.arange(self.classes) == label))
        grown = n + gradient**2
        z = z + gradient - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        rows[at] = np.stack([z, grown, w], 1)
        return Learned(places, rows)

    def predict(self, state: Learned, idx: list[int], values: np.ndarray) -> np.ndarray:
        """By the weights of each feature's last step, as they were before that step's gradient went in."""
        p = 1 / (1 + np.exp(-(values @ state.rows[np.array([state.places.get(k, 0) for k in idx], np.int64), 2])))
        return p / p.sum()


def classified(rows: DataFrame, model: Ftrl, keys: list[str] = ()) -> DataFrame:
    """(keys, doc_id, topic, probability) of unlabelled rows, in one pass in the order of doc_id that learns from labelled ones.

    rows: doc_id, idx array<long>, weight array<double>, label int or null, and the keys: each key has a learner of its own, and
    without keys one learner sees all rows in one task, a batch at a time. Rows before any labelled one have no prediction.
    """
    names = ", ".join(f"`{k}` {dict(rows.dtypes)[k]}" for k in keys)

    def step(row: dict, state: Learned | None) -> tuple[Learned | None, list[tuple]]:
        idx, values = row["idx"], np.asarray(row["weight"], float)
        if row["label"] is None:
            return state, [] if state is None else [(row["doc_id"], k, float(p)) for k, p in enumerate(model.predict(state, idx, values))]
        return model.learn(model.start() if state is None else state, idx, values, int(row["label"])), []  # nothing but this pass holds the state, and a task that runs again starts afresh

    return fold.stateful_flat_map(rows.select(*keys, "doc_id", "idx", "weight", "label"), list(keys), ["doc_id"], step, names + ", " * bool(keys) + "doc_id long, topic int, probability double")


def topics_sorted(topics: Column) -> Column:
    """An array of (id, probability) structs, most probable first."""
    return F.array_sort(topics, lambda a, b: F.when(a["probability"] > b["probability"], -1).when(a["probability"] < b["probability"], 1).otherwise(a["id"] - b["id"]))
