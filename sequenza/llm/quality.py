"""Quality rules: an isolation forest on rule statistics.

Each document becomes a row of rule statistics (lengths, shares of symbols, capitals, repetition ...). Trees of
random splits are grown on labelled documents of good quality; a document that random splits isolate after few steps is
an anomaly. The score is 2 ** (-mean path length / expected path length), and the threshold above which a document is
rejected is the one that parts the labelled good rows from the bad ones best while it keeps KEEP of the good ones.

Trees and threshold come from all labelled documents: each good one is in one tree at least, in as many as give a tree SAMPLE rows,
and the threshold is found by counts over all scores. Statistics and scores cover every document, whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sequenza.llm.common import SPACE, U64, WORD, Rolling, mix, pieces, row_sums, salted_names, spans, stable, text_buffer

STATISTICS = ["word_length", "symbols", "capitals", "punctuation", "bars", "distinct", "common", "short_words", "line_length", "closed_lines", "repeated_lines"]
#: Those that are shares or means over words: a text of few words has them drawn towards the mean of good rows, as if it had PRIOR_WORDS more words like those.
SHARES = np.array([s != "line_length" for s in STATISTICS])
PRIOR_WORDS = 60
#: SAMPLE rows of a tree are the fewest where there are as many; trees stop at the depth for so many.
TREES, SAMPLE, SEED = 100, 1024, 11
#: Ranges of scores that are counted one by one.
RANGES = 4096
#: The share of labelled good rows that a threshold must keep.
KEEP = 0.995

_UPPER, _PUNCTUATION, _SYMBOL, _END = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_PUNCTUATION[[ord(c) for c in ".,;:!?'\"()-"]] = True
_SYMBOL[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = True
_END[[ord(c) for c in ".!?\"')"]] = True


def statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """STATISTICS of each text, a row for each, and its number of words; null is empty, and an empty text has 0 throughout."""
    data, offsets = text_buffer(texts)
    n = len(offsets) - 1
    solid = np.maximum(row_sums(~SPACE[data], offsets), 1)
    share = lambda table: row_sums(table[data], offsets) / solid
    starts, ends, counts = spans(~SPACE[data], offsets)
    many, row = np.maximum(counts, 1), np.repeat(np.arange(n), counts)
    hashes = Rolling(data)(starts, ends)
    with np.errstate(over="ignore"):
        mixed = mix(hashes + mix(row.astype(U64)))
    _, first, times = np.unique(mixed, return_index=True, return_counts=True)
    distinct = np.bincount(row[first], minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, row[first], times)
    _, _, pure = spans(WORD[data], offsets)
    breaks = data == 10
    line_starts, line_ends, line_counts = spans(~breaks, offsets)
    line_row = np.repeat(np.arange(n), line_counts)
    with np.errstate(over="ignore"):
        _, line_first = np.unique(mix(Rolling(data)(line_starts, line_ends) + mix(line_row.astype(U64))), return_index=True)
    lines = np.maximum(line_counts, 1)
    short = np.bincount(row, weights=(ends - starts <= 3), minlength=n)
    closed = np.bincount(line_row, weights=_END[data[line_ends - 1]], minlength=n) if len(line_row) else np.zeros(n)
    columns = [
        np.where(counts > 0, row_sums(~SPACE[data], offsets) / many, 0), share(_SYMBOL), share(_UPPER),
        share(_PUNCTUATION), row_sums(data == 124, offsets) / many, distinct / many, most / many, short / many,
        np.log1p(pure / lines), closed / lines, 1 - np.bincount(line_row[line_first], minlength=n) / lines,
    ]
    out = np.stack(columns, 1)
    out[:, -1] = np.where(line_counts > 0, out[:, -1], 0)
    return out, counts


def _expected(n: np.ndarray | float) -> np.ndarray:
    """The mean path length of an unsuccessful search among n rows."""
    n = np.maximum(np.asarray(n, float), 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n > 1, 1.0, 0.0))


@dataclass
class Forest:
    """Nodes of all trees: the statistic and the value they split at, their left child (the right one follows), and at a leaf (feature -1) the path length."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    length: np.ndarray
    roots: np.ndarray
    expected: float
    prior: np.ndarray
    threshold: float = np.inf

    def scores(self, rows: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Of raw statistics."""
        rows = shrunk(rows, words, self.prior)
        total = np.zeros(len(rows))
        for root in self.roots:
            node, at = np.full(len(rows), root), np.arange(len(rows))
            while len(at):
                feature = self.feature[node[at]]
                total[at[feature < 0]] += self.length[node[at[feature < 0]]]
                at, feature = at[feature >= 0], feature[feature >= 0]
                node[at] = self.left[node[at]] + (rows[at, feature] >= self.value[node[at]])
        return 2.0 ** (-total / (len(self.roots) or 1) / (self.expected or 1))


def shrunk(rows: np.ndarray, words: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """rows with the shares of short texts drawn towards the prior."""
    return np.where(SHARES, (rows * words[:, None] + prior * PRIOR_WORDS) / (words[:, None] + PRIOR_WORDS), rows)


def _deepest(size: int) -> int:
    return int(np.ceil(np.log2(max(size, 2)))) + 4


def _tree(rows: np.ndarray, draw: np.random.Generator, deepest: int) -> tuple[np.ndarray, ...]:
    """feature, value, left and length of a tree grown on all of rows, in whatever order they are."""
    feature, value, left, length = [], [], [], []

    def node() -> int:
        feature.append(-1)
        value.append(0.0)
        left.append(0)
        length.append(0.0)
        return len(feature) - 1

    todo = [(node(), rows, 0)]
    while todo:
        at, own, depth = todo.pop()
        low, high = own.min(0), own.max(0)
        open_ = np.flatnonzero(high > low)
        if len(own) < 2 or depth >= deepest or not len(open_):
            length[at] = depth + float(_expected(len(own)))
            continue
        f = int(draw.choice(open_))
        split = low[f] + (high[f] - low[f]) * (1 - draw.random())
        feature[at], value[at] = f, split
        left[at] = node()
        node()
        under = own[:, f] < split
        todo += [(left[at], own[under], depth + 1), (left[at] + 1, own[~under], depth + 1)] if under.any() else []
        if not under.any():
            feature[at], length[at] = -1, depth + float(_expected(len(own)))
    return np.array(feature, np.int8), np.array(value), np.array(left, np.int32), np.array(length)


def _forest(trees: list[tuple[np.ndarray, ...]], size: float, prior: np.ndarray) -> Forest:
    """The forest of trees of `size` rows each."""
    roots = np.cumsum([0] + [len(t[0]) for t in trees])[:-1]
    trees = [(f, v, l + np.int32(r), n) for (f, v, l, n), r in zip(trees, roots)]
    columns = (np.concatenate([np.zeros(0, kind), *x]) for kind, x in zip((np.int8, float, np.int32, float), zip(*trees) if trees else [()] * 4))
    return Forest(*columns, roots=roots.astype(np.int64), expected=float(_expected(size)), prior=prior)


def grow(rows: np.ndarray, words: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> Forest:
    """An isolation forest over raw statistics, its threshold not yet set."""
    prior = rows.mean(0) if len(rows) else np.zeros(len(STATISTICS))
    rows = shrunk(rows, words, prior)
    draw, size = np.random.default_rng(seed), min(sample, len(rows))
    return _forest([_tree(rows[draw.choice(len(rows), size, replace=False)], draw, _deepest(size)) for _ in range(trees if size else 0)], size, prior)


def calibrate(scores: np.ndarray, good: np.ndarray, keep: float = KEEP) -> float:
    """The score above which to reject: of those that keep the share of good rows, the one that rejects most bad rows less good ones. Infinite without good or bad rows."""
    if good.all() or not good.any():
        return np.inf
    candidates = np.unique(scores)
    over_good = 1 - np.searchsorted(np.sort(scores[good]), candidates, "right") / good.sum()
    over_bad = 1 - np.searchsorted(np.sort(scores[~good]), candidates, "right") / (~good).sum()
    gain = np.where(over_good <= 1 - keep, over_bad - over_good, -1)
    best = int(np.argmax(gain))
    if gain[best] <= 0:
        return np.inf
    return float((candidates[best] + candidates[min(best + 1, len(candidates) - 1)]) / 2)


def _measured(docs: DataFrame) -> DataFrame:
    """(doc_id, known, words, x), a row for each row of docs: whether it has a text, its number of words and its statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            x, words = statistics(piece.column(1))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1).is_valid(), pa.array(words, pa.int64()), rows], ["doc_id", "known", "words", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, known boolean, words long, x array<double>")


def _columns(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The statistics and numbers of words of measured rows."""
    x, words = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (batch.column("x"), batch.column("words")))
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS)), words.to_numpy(zero_copy_only=False)


def _trees_of(ids: np.ndarray, many: int) -> np.ndarray:
    """The `many` trees of each id, a row for each id: by hashes, so the same wherever the rows are."""
    with np.errstate(over="ignore"):
        hashes = mix(mix(ids.astype(np.int64).view(U64), SEED)[:, None] + mix(np.arange(TREES, dtype=U64))[None])
    return np.argsort(hashes, axis=1, kind="stable")[:, :many]


def _grown(good: DataFrame) -> Forest:
    """The forest of measured good rows (id, words, x), all of them: a tree is grown in one task, on a share of the rows or, if they are few, on more, so that it has SAMPLE rows."""
    prior = good.agg(F.count(F.lit(1)), *[F.sum(F.col("x")[k].cast("decimal(28,12)")) for k in range(len(STATISTICS))]).first()
    n, prior = prior[0], np.array([float(p or 0) for p in prior[1:]]) / max(prior[0], 1)
    if not n:
        return _forest([], 0, prior)
    many = min(TREES, -(-TREES * SAMPLE // n))
    size = many * n / TREES
    deepest = _deepest(min(SAMPLE, int(size)))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), many)))
                yield pa.RecordBatch.from_arrays([pa.array(_trees_of(batch.column("id").to_numpy(), many).ravel().astype(np.int32)), own.column("words"), own.column("x")], ["tree", "words", "x"])

    def tree(rows: pa.Table) -> pa.Table:
        number = rows.column("tree")[0].as_py()
        parts = _tree(shrunk(*_columns(rows), prior), np.random.default_rng([SEED, number]), deepest)
        return pa.table([[number], *([p] for p in parts)], pa.schema([("tree", pa.int32()), *((name, pa.list_(kind)) for name, kind in zip(("feature", "value", "left", "length"), (pa.int8(), pa.float64(), pa.int32(), pa.float64())))]))

    grown = good.select("id", "words", "x").mapInArrow(spread, "tree int, words long, x array<double>").groupBy("tree").applyInArrow(tree, "tree int, feature array<tinyint>, value array<double>, left array<int>, length array<double>").toArrow().sort_by("tree")
    return _forest([tuple(grown.column(name)[k].values.to_numpy() for name in ("feature", "value", "left", "length")) for k in range(grown.num_rows)], size, prior)


def _calibrated(scored: DataFrame, keep: float = KEEP) -> float:
    """What calibrate gives for all of scored (good, score), by running counts in ranges of scores."""
    counts = scored.groupBy("score").agg(F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad")).withColumn("range", F.floor(F.col("score") * RANGES))
    counts = stable(counts)
    good, bad = counts.agg(F.sum("good"), F.sum("bad")).first()
    if not good or not bad:
        return np.inf
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.groupBy("range").agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).select("range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in "gb"])
    within = Window.partitionBy("range").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    over = counts.join(F.broadcast(ranges), "range").select("score", (1 - (F.col("g_before") + F.sum("good").over(within)) / F.lit(good)).alias("over_good"), (1 - (F.col("b_before") + F.sum("bad").over(within)) / F.lit(bad)).alias("over_bad"))
    best = over.where(F.col("over_good") <= 1 - keep).select((F.col("over_bad") - F.col("over_good")).alias("gain"), "score").orderBy(F.desc("gain"), "score").first()
    if best is None or best["gain"] <= 0:
        return np.inf
    following = counts.where(F.col("score") > best["score"]).agg(F.min("score")).first()[0]
    return (best["score"] + (best["score"] if following is None else following)) / 2


def _fitted(measured: DataFrame, labels: DataFrame, rows: int | None) -> Forest:
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.min("quality") > 0).alias("good"))
    if rows is not None:
        chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(rows)
    table = stable(measured.where("known").withColumnRenamed("doc_id", "id").join(chosen, "id").select("id", "good", "words", "x"))
    forest = _grown(table.where("good"))
    shared = table.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("good"), pa.array(shared.value.scores(*_columns(batch)))], ["good", "score"])

    forest.threshold = _calibrated(table.select("good", "words", "x").mapInArrow(run, "good boolean, score double"))
    return forest


def fit(docs: DataFrame, labels: DataFrame, rows: int | None = None) -> Forest:
    """The forest grown on the labelled good documents of docs, with its threshold; where `rows` is given, on the documents of so many labels. A doc_id with several labels counts as bad if one of them is."""
    return _fitted(_measured(docs), labels, rows)


def judge(docs: DataFrame, labels: DataFrame, rows: int | None = None) -> DataFrame:
    """(doc_id, score, rejected), a row for each row of docs, repeated ones too.

    A null text counts as an empty one, which has statistics of 0 and is judged by them. A null doc_id stays null. Rows with
    equal texts get equal results. Without labels, or without both good and bad ones, nothing is rejected. Very long texts are whole; an empty table gives no row.
    """
    measured = stable(_measured(docs))
    forest = docs.sparkSession.sparkContext.broadcast(_fitted(measured, labels, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = forest.value.scores(*_columns(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array(scores > forest.value.threshold)], ["doc_id", "score", "rejected"])

    return measured.select("doc_id", "words", "x").mapInArrow(run, "doc_id long, score double, rejected boolean")


def drop_rejected(docs: DataFrame, labels: DataFrame, rows: int | None = None) -> DataFrame:
    """docs, all columns, without the rejected documents. Cases as in judge."""
    forest = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, rows))
    bad, = salted_names(docs.columns, "bad")

    @F.pandas_udf("boolean")
    def rejected(texts):
        column = pa.array(texts, pa.string(), from_pandas=True)
        found = [forest.value.scores(*statistics(p.column(0))) > forest.value.threshold for p in pieces(iter([pa.RecordBatch.from_arrays([column], ["text"])]), "text")]
        return pd.Series(np.concatenate(found) if found else np.zeros(0, bool))

    return docs.withColumn(bad, rejected(F.col("text").cast("string"))).where(~F.col(bad)).drop(bad)

