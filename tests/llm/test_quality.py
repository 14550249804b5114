import re

import numpy as np
import pyarrow as pa

from sequenza.llm import quality

FOLDER = "/root/testdata/sf0.1"


def test_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    forest = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    held = docs.join(labels.where("doc_id % 2 = 1"), "doc_id").select("text", "quality").toArrow()
    rejected = forest.scores(*quality.statistics(held["text"].combine_chunks())) > forest.threshold
    good = held["quality"].to_numpy() == 1
    assert rejected[good].mean() < 0.02 and rejected[~good].mean() > 0.9


def test_path_lengths_by_walking():
    draw = np.random.default_rng(1)
    x, words = draw.random((300, len(quality.STATISTICS))), np.full(300, 50)
    forest = quality.grow(x, words, trees=5, sample=64)
    rows = quality.shrunk(x, words, forest.prior)
    for k in range(0, 300, 50):
        total = 0.0
        for node in forest.roots:
            while forest.feature[node] >= 0:
                node = forest.left[node] + (rows[k, forest.feature[node]] >= forest.value[node])
            total += forest.length[node]
        assert np.isclose(forest.scores(x, words)[k], 2 ** (-total / 5 / forest.expected))
    outlier = x.copy()
    outlier[0] = 40
    assert forest.scores(outlier, words)[0] > forest.scores(x, words).max() * 0.99


def test_threshold():
    scores, good = np.array([0.1, 0.2, 0.3, 0.8, 0.9]), np.array([1, 1, 1, 0, 0], bool)
    assert 0.3 <= quality.calibrate(scores, good) < 0.8
    assert quality.calibrate(scores, np.ones(5, bool)) == quality.calibrate(scores, np.zeros(5, bool)) == np.inf


def test_statistics_of_plain_texts():
    x, words = quality.statistics(pa.array(["Aa b.\nAa b.", "", None]))
    at = dict(zip(quality.STATISTICS, x[0]))
    assert words.tolist() == [4, 0, 0] and at["distinct"] == 0.5 and at["repeated_lines"] == 0.5 and at["closed_lines"] == 1 and at["capitals"] == 0.25
    assert not x[1:].any()


def plain_statistics(text: str) -> list[float]:
    """All statistics of a text by loops."""
    data = text.encode()
    blank = b" \t\n\x0b\x0c\r"
    words, lines = [w for w in re.split(rb"[ \t\n\x0b\x0c\r]+", data) if w], [x for x in data.split(b"\n") if x]
    solid = max(sum(b not in blank for b in data), 1)
    n, m = max(len(words), 1), max(len(lines), 1)
    share = lambda chars: sum(b in chars for b in data) / solid
    pure = len(re.findall(rb"[A-Za-z0-9_\x80-\xff]+", data))
    return [
        sum(map(len, words)) / n, share(b"#$%&*+/<=>@[\\]^_`{|}~"), share(bytes(range(65, 91))), share(b".,;:!?'\"()-"), data.count(b"|") / n,
        len(set(words)) / n, max(map(words.count, words), default=0) / n, sum(len(w) <= 3 for w in words) / n, np.log1p(pure / m),
        sum(x[-1] in b".!?\"')" for x in lines) / m, 1 - len(set(lines)) / m if lines else 0.0,
    ]


def test_statistics_as_loops(spark):
    draw = np.random.default_rng(5)
    texts = ["".join(draw.choice(list("ab cD. |#é\n\t,()'7"), draw.integers(0, 200))) for _ in range(60)] + ["", "\n\n", "x", "A B\nA B\n\nA B", "| | |"]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    x, words = quality.statistics(pa.array(texts))
    assert np.allclose(x, [plain_statistics(t) for t in texts]) and words.tolist() == [len(t.split()) if t.isascii() else len(re.findall(r"[^ \t\n\x0b\f\r]+", t)) for t in texts]


def test_several_labels_of_one_document_and_repeated_rows(spark):
    draw = np.random.default_rng(3)
    plain = lambda: " ".join(draw.choice(["Plain", "words", "in", "a\nrow,", "and", "more", "of", "them.\n", "R&D", "longer"], draw.integers(40, 90)))
    rows = [(k % 40, plain()) for k in range(80)] + [(k, "### $$$ %%% " * 40) for k in range(50, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(60)] + [(k, 0) for k in range(50, 60)], "doc_id long, quality int")
    assert {r["doc_id"] for r in quality.judge(docs, labels).where("rejected").collect()} == set(range(50, 60))
    assert quality.fit(docs, labels, rows=7).threshold == np.inf or quality.fit(docs, labels, rows=7).roots.size


def test_edges(spark):
    draw = np.random.default_rng(2)
    plain = lambda: " ".join(draw.choice(["Plain", "words", "in", "a\nrow,", "and", "more", "of", "them.\n", "R&D", "longer"], draw.integers(40, 90)))
    rows = [(k, plain(), 1) for k in range(60)] + [(k, "### $$$ %%% " * 40, 0) for k in range(60, 90)]
    labels = spark.createDataFrame(rows, "doc_id long, text string, quality int").select("doc_id", "quality")
    rows += [(None, None, 1), (None, rows[3][1], 1), (91, "", 1), (1, rows[2][1], 1), (92, "Plain words. " * 30000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, good int").selectExpr("text", "doc_id", "good", "good AS score", "good AS rejected", "good AS bad", "good AS quality", "good AS id")
    out = quality.judge(docs, labels)
    assert out.count() == 95 and {r["doc_id"] for r in out.where("rejected").collect()} >= set(range(60, 90))
    scores = {(r["doc_id"], r["score"]) for r in out.collect()}
    assert {s for d, s in scores if d == 2} <= {s for d, s in scores if d == 1}
    kept = quality.drop_rejected(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id < 60").count() >= 60
    assert quality.judge(docs, labels.limit(0)).where("rejected").count() == 0
    assert quality.judge(docs.limit(0), labels).count() == quality.drop_rejected(docs.limit(0), labels).count() == 0


def test_all_labelled_documents_count(spark):
    """However many there are: the means, the trees and the threshold are those of all."""
    draw = np.random.default_rng(7)
    some = list("ab cD. |#\n\t,(") + ["Plain ", "words ", "more. "]
    rows = [(k, "".join(draw.choice(some, draw.integers(1, 60), p=None if k % 5 else [0.02] * 5 + [0.08] * 2 + [0.62 / 6] * 6 + [0.04] * 3))) for k in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    good = np.array([k % 5 > 0 for k, _ in rows])
    labels = spark.createDataFrame([(k, int(g)) for (k, _), g in zip(rows, good)], "doc_id long, quality int")
    forest, (x, words) = quality.fit(docs, labels), quality.statistics(pa.array([t for _, t in rows]))
    assert np.allclose(forest.prior, x[good].mean(0), atol=1e-9) and len(forest.roots) == quality.TREES
    assert np.isfinite(forest.threshold) and forest.threshold == quality.calibrate(forest.scores(x, words), good)
    assert forest.scores(x, words).tolist() == quality.fit(docs.repartition(3), labels).scores(x, words).tolist()
    judged = {r["doc_id"]: (r["score"], r["rejected"]) for r in quality.judge(docs, labels).collect()}
    assert [judged[k] for k, _ in rows] == [(s, s > forest.threshold) for s in forest.scores(x, words).tolist()]


def test_every_good_row_is_in_a_tree():
    ids = np.arange(-50, 3000)
    for many in (1, 15, quality.TREES):
        trees = quality._trees_of(ids, many)
        assert trees.shape == (len(ids), many) and (np.diff(np.sort(trees, axis=1), axis=1) > 0).all()
        assert np.bincount(trees.ravel(), minlength=quality.TREES).min() > 0
