"""Operators against plain models, and their determinism under any arrival order."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sequenza.functions import keys, positions, stem, text
from sequenza.operators import classify, fold, graph, grouping, labels, lineage, ranking, wordcount
from sequenza.operators.flow import Stream
from sequenza.operators.flow import run as flow_run
from sequenza.operators.order import Order

SCHEMA = "t long, k string, v long"


def items(seed: int, n: int = 60) -> list[tuple]:
    draw = random.Random(seed)
    rows = [(t, draw.choice("abcd"), draw.randrange(10)) for t in range(n)]
    draw.shuffle(rows)
    return rows


def model(rows, window, undo):
    """The windows of each key, by reading its rows in order."""
    out = []
    for key in {k for _, k, _ in rows}:
        own = [v for _, k, v in sorted(rows) if k == key]
        ends = range(1, len(own) + 1)
        if undo:
            ends = range(window, len(own) + 1) if len(own) >= window else [len(own)]
        out += [(key, own[max(0, e - window) : e]) for e in ends]
    return sorted(out)


@pytest.mark.parametrize("window", [1, 2, 3, 14, grouping.UNBOUNDED])
@pytest.mark.parametrize("undo", [False, True])
def test_grouping_as_model_in_any_arrival_order(spark, window, undo):
    for seed in (1, 2):
        rows = items(seed)
        df = spark.createDataFrame(rows, SCHEMA).repartition(1 + seed * 2)
        got = sorted((r["k"], r["window"]) for r in grouping.grouping(df, ["k"], Order(["t"]), "v", window, undo).collect())
        assert got == model(rows, window, undo)


def test_order_tells_ties(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (2, "a", 1)], SCHEMA)
    assert Order(["t"]).ties(df).count() == 1
    assert Order(["t"], (), ["v"]).ties(df).count() == 0


def test_stateful_map_is_the_sequential_fold(spark):
    rows = items(3)
    step = lambda row, state: ((state or "") + str(row["v"]), (row["t"], (state or "") + str(row["v"])))
    got = {r["t"]: r["s"] for r in fold.stateful_map(spark.createDataFrame(rows, SCHEMA).repartition(5), ["k"], ["t"], step, "k string, t long, s string").collect()}
    state, expected = {}, {}
    for t, k, v in sorted(rows):
        state[k] = state.get(k, "") + str(v)
        expected[t] = state[k]
    assert got == expected


def test_running_sum_and_count_over_partitions(spark):
    rows = items(4, 500)
    df = spark.createDataFrame(rows, SCHEMA)
    total, expected = 0, {}
    for t, _, v in sorted(rows):
        total += v
        expected[t] = total
    assert {r["t"]: r["s"] for r in fold.running_sum(df, ["t"], "v", "s").collect()} == expected
    counted = fold.running_count(df, ["k"], Order(["t"]), "n", F.floor(F.col("t") / 7)).collect()
    assert {r["t"]: r["n"] for r in counted} == {t: sum(1 for u, j, _ in rows if j == k and u <= t) for t, k, _ in rows}
    assert fold.running_sum(df.limit(0), ["t"], "v", "s").count() == 0


def test_labels(spark):
    s = Stream(spark.createDataFrame([(1, "a b"), (2, None)], "id long, line string"), Order(["id"])).spawn_label("l", "id")
    words = s.flat_map(F.split("line", " "), "w", "c").map(label_l=F.col("label_l"), w=F.col("w"), c=F.col("c"))
    got = [(r["label_l"], r["w"], r["is_marker"]) for r in words.label_markers(s, "l").df.orderBy("label_l", "is_marker", "c").collect()]
    assert got == [(1, "a", False), (1, "b", False), (1, None, True), (2, None, True)]
    with pytest.raises(ValueError):
        labels.require_labels(s.df, ["other"])
    with pytest.raises(ValueError):
        s.union(Stream(s.df.drop("label_l"), s.order))
    with pytest.raises(Exception, match="without the label"):
        labels.require_labels(s.df.withColumn("label_l", F.lit(None).cast("long")), ["l"]).collect()


def test_keys_and_hashes(spark):
    row = spark.range(1).select(keys.bucketed(F.lit(-3), 2).alias("m"), keys.list_hash(F.array(F.lit(2**31 - 1), F.lit(77))).alias("h"), keys.wrapped32(F.lit(2**31)).alias("w")).first()
    h = 1
    for x in (2**31 - 1, 77):
        h = (31 * h + x + 2**31) % 2**32 - 2**31
    assert (row["m"], row["h"], row["w"]) == (-1, h, -(2**31))


def test_split_drops_only_trailing_empties(spark):
    df = spark.createDataFrame([(" a  b \t",), ("",), (None,), ("x",), (" \n",)], "s string")
    assert [r[0] for r in df.select(text.split_words(F.col("s"))).collect()] == [["", "a", "", "b"], [""], None, ["x"], []]


def test_positions_round_trip(spark):
    df = spark.createDataFrame([(5, 1_000_000, 200, 4095), (0, 0, 0, 0), (8_388_607, 1, 2, 3)], "page int, position int, version int, range int")
    packed = df.withColumn("p", positions.pack(*map(F.col, ("page", "position", "version", "range"))))
    assert packed.select(*[c.alias(n) for n, c in positions.unpack(F.col("p")).items()]).collect() == df.collect()
    assert all(r[0] for r in df.select(positions.within_limits(*map(F.col, ("page", "position", "version", "range")))).collect())


def test_bfs_by_plain_search(spark):
    draw = random.Random(9)
    edges = [(draw.randrange(30), draw.randrange(30)) for _ in range(60)]
    expected = {(1, 0): 0}
    level = {0}
    for depth in (1, 2, 3):
        level = {t for s, t in edges if s in level} - {v for _, v in expected}
        expected |= {(1, v): depth for v in level}
    got = graph.bounded_bfs(spark.createDataFrame([(1, 0, 3)], "request long, vertex long, path_length int"), spark.createDataFrame(edges, "source long, target long"), 3)
    assert {(r["request"], r["vertex"]): r["depth"] for r in got.collect()} == expected


def test_merge_tops(spark):
    df = spark.range(1).select(wordcount.merge_tops(F.expr("map('a', 3, 'b', 1)"), F.expr("map('b', 5, 'c', 3)"), 2).alias("m"))
    assert [tuple(x) for x in df.first()["m"]] == [("b", 5), ("a", 3)]


def test_bm25_leaves_out_common_terms_and_ranks_all(spark):
    docs = spark.createDataFrame([(1, "aa bb"), (2, "aa cc cc"), (3, "aa"), (4, "")], "page long, text string")
    got = [(r["page"], round(r["score"], 6)) for r in ranking.bm25(ranking.postings(docs), spark.createDataFrame([("cc",), ("aa",)], "word string")).collect()]
    assert got[0][0] == 2 and got[0][1] > 0 and [p for p, s in got[1:]] == [1, 3, 4] and all(s == 0 for _, s in got[1:])


def plain_ftrl(rows, classes, alpha, beta, l1, l2):
    """The online learner by loops over classes and features: predictions use the weights as the last step left them."""
    z, n, w, out = {}, {}, {}, []
    for idx, values, label in rows:
        if label is None:
            scores = [1 / (1 + np.exp(-sum(v * w.get((k, i), 0) for i, v in zip(idx, values)))) for k in range(classes)]
            out.append([s / sum(scores) for s in scores])
            continue
        for k in range(classes):
            for i in idx:
                zed = z.get((k, i), 0.0)
                w[k, i] = -(zed - np.sign(zed) * l1) / ((beta + np.sqrt(n.get((k, i), 0.0))) / alpha + l2) if abs(zed) > l1 else 0.0
        p = [np.exp(sum(v * w[k, i] for i, v in zip(idx, values))) for k in range(classes)]
        for k in range(classes):
            for i, v in zip(idx, values):
                g = (p[k] / sum(p) - (k == label)) * v
                old = n.get((k, i), 0.0)
                z[k, i] = z.get((k, i), 0.0) + g - (np.sqrt(old + g * g) - np.sqrt(old)) / alpha * w[k, i]
                n[k, i] = old + g * g
    return out


def test_ftrl_as_loops_and_accurate(spark):
    draw = np.random.default_rng(1)
    rows = []
    for doc in range(300):
        topic = int(draw.integers(3))
        idx = sorted({int(x) for x in draw.integers(topic * 20, topic * 20 + 40, 12)})
        rows.append((doc, idx, [float(x) for x in draw.random(len(idx))], topic if doc % 3 else None, topic))
    df = spark.createDataFrame([r[:4] for r in rows], "doc_id long, idx array<long>, weight array<double>, label int").repartition(5)
    got = {}
    for r in classify.classified(df, classify.Ftrl(3)).collect():
        got.setdefault(r["doc_id"], {})[r["topic"]] = r["probability"]
    expected = plain_ftrl([(i, v, y) for _, i, v, y, _ in rows], 3, 132.0, 0.1, 0.0086, 0.095)
    unlabelled = [r for r in rows if r[3] is None]
    assert set(got) == {r[0] for r in unlabelled[1:]}  # the first row comes before any labelled one
    for (doc, *_), p in zip(unlabelled[1:], expected[1:]):
        assert np.allclose([got[doc][k] for k in range(3)], p)
    right = [max(got[r[0]], key=got[r[0]].get) == r[4] for r in unlabelled[1:]]
    assert np.mean(right[len(right) // 2 :]) > 0.6


def test_topics_by_probability(spark):
    df = spark.createDataFrame([([(0, 0.2), (1, 0.5), (2, 0.3)],)], "t array<struct<id: int, probability: double>>")
    assert [x["id"] for x in df.select(classify.topics_sorted(F.col("t")).alias("t")).first()["t"]] == [1, 2, 0]


def test_scores_agree_within_epsilon(spark):
    df = spark.createDataFrame([(1.0, 1.0 + 1e-12), (1.0, 1.001)], "a double, b double")
    assert [r[0] for r in df.select(ranking.same_score(F.col("a"), F.col("b"))).collect()] == [True, False]


def test_folds_with_nulls_and_falling_orders(spark):
    big = 9007199254740993
    rows = [(None, 3, big), ("a", 1, None), (None, 1, big + 2), ("a", None, big), (None, 2, None)]
    df = spark.createDataFrame(rows, SCHEMA.replace("t long, k string", "k string, t long"))
    step = lambda row, state: (n := (state or 0) + 1, (row["t"], n, row["v"]))
    got = sorted(map(tuple, fold.stateful_map(df, ["k"], ["t"], step, "k string, t long, n int, v long").collect()), key=str)
    assert got == sorted([(None, 1, 1, big + 2), (None, 2, 2, None), (None, 3, 3, big), ("a", None, 1, big), ("a", 1, 2, None)], key=str)
    falling = Stream(df, Order([], [F.desc("v")])).key_by("k").stateful_map(step, "k string, t long, n int, v long")
    assert sorted((str(r["k"]), r["n"], r["t"]) for r in falling.df.collect()) == [("None", 1, 1), ("None", 2, 3), ("None", 3, 2), ("a", 1, None), ("a", 2, 1)]
    counted = fold.running_count(df.withColumn("_segment", F.lit(1)).withColumn("_n", F.lit(2)), ["k"], Order(["t"]), "n", F.floor(F.col("t") / 2))
    assert sorted((str(r["k"]), str(r["t"]), r["n"], r["_segment"], r["_n"]) for r in counted.collect()) == [("None", "1", 1, 1, 2), ("None", "2", 2, 1, 2), ("None", "3", 3, 1, 2), ("a", "1", 2, 1, 2), ("a", "None", 1, 1, 2)]
    assert fold.stateful_map(df.limit(0), ["k"], ["t"], step, "k string, t long, n int, v long").count() == 0
    assert fold.stateful_map(df, [], ["t", "v"], lambda row, s: ((s or 0) + 1, ((s or 0) + 1,)), "n int").agg(F.max("n")).first()[0] == 5


def test_a_long_key_passes_by_in_batches(spark):
    df = spark.range(30_000).selectExpr("id % 2 AS k", "id AS t")
    got = fold.stateful_map(df, ["k"], [F.desc("t")], lambda row, s: ((s or 0) + 1, (row["t"], (s or 0) + 1)), "k long, t long, n long")
    assert got.where("n = (30000 - t + 1) DIV 2").count() == 30_000


def test_order_violations_are_errors(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1)], "k string, t long")
    step = fold.in_order(lambda row, s: (None, (row["t"],)), lambda row: row["t"])
    with pytest.raises(Exception, match="came after"):
        fold.stateful_map(df, ["k"], ["t"], step, "k string, t long").collect()


def test_user_columns_stay_with_partial_windows(spark):
    df = spark.createDataFrame([(t, "a", t) for t in range(5)], SCHEMA).withColumns({"_place": F.lit(7), "_SIZE": F.lit(8)})
    got = grouping.grouping(df, ["k"], Order(["t"]), "v", 3, True)
    assert [(r["window"], r["_place"], r["_SIZE"]) for r in got.orderBy("t").collect()] == [([0, 1, 2], 7, 8), ([1, 2, 3], 7, 8), ([2, 3, 4], 7, 8)]


def test_chained_folds_keep_labels(spark):
    s = Stream(spark.createDataFrame([(1, "a", 5), (2, "b", 6), (3, "a", 7)], SCHEMA), Order(["t"])).spawn_label("l", "k")
    one = s.key_by(labelled=["l"]).stateful_map(lambda row, n: ((n or 0) + row["v"], (row["t"], (n or 0) + row["v"])), "label_l string, t long, sum long")
    two = one.key_by(labelled=["l"]).aggregate(lambda row, n: ((n[0] if n else 0) + row["sum"], row["t"]), lambda n: (n[1], n[0]), "label_l string, t long, total long")
    assert sorted(map(tuple, labels.require_labels(two.df, ["l"]).collect())) == [("a", 1, 5), ("a", 3, 17), ("b", 2, 6)]


def test_init_runs_once_in_each_task_and_flow(spark):
    s = Stream(spark.range(100).selectExpr("id AS t", "id AS label_x").repartition(4), Order(["t"]))
    made = s.map_with(lambda: {"id": random.random()}, lambda resource, row: [(row["t"], resource["id"])] * (row["t"] % 2), "t long, model double")
    rows = made.df.collect()
    assert len(rows) == 50 and len({r["model"] for r in rows}) <= 4 and all(r["label_x"] == r["t"] for r in rows)
    calls = []
    assert flow_run(lambda x: x.filter("t < 3"), s, lambda: calls.append(1)).count() == 3 and calls == [1]


def test_placement_never_changes_results(spark):
    s = Stream(spark.createDataFrame(items(5), SCHEMA), Order(["t"]))
    placed = s.shuffled(keys.uniform_hash("k")).key_by("k").scan("n", F.count("t")).df
    assert sorted(map(tuple, placed.collect())) == sorted(map(tuple, s.key_by("k").scan("n", F.count("t")).df.collect()))
    marked = s.spawn_label("l", "k").with_columns(key=keys.labelled_key("v", labels=["l"]), one=keys.constant_key())
    assert marked.df.select("key").distinct().count() == len({(k, v) for _, k, v in items(5)}) and marked.df.select("one").distinct().count() == 1


def test_no_folder_on_a_cluster_is_an_error():
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "_jsc": type("J", (), {"sc": staticmethod(lambda: type("X", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))})})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        lineage.shared_folder(Session)


def test_vectorized_unknown_words(spark):
    words = spark.createDataFrame([("a",), ("z",)], "word string")
    got = classify.vectorized(words, spark.createDataFrame([("a", 4)], "word string, idx long")).orderBy("word").collect()
    assert [r["idx"] for r in got] == [4, 0]


def test_stems_of_both_languages(spark):
    english = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat troubled troubl sized size hopping hop falling fall hissing hiss failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit operator oper feudalism feudal hopefulness hope formaliti formal sensibiliti sensibl triplicate triplic formative form electrical electr goodness good revival reviv allowance allow airliner airlin adjustable adjust irritant irrit replacement replac adoption adopt bowdlerize bowdler probate probat rate rate controll control roll roll".split()
    russian = "важная важн важнейшие важн вазы ваз валенки валенк вами вам варением варен россия росс слон слон литва литв вставка вставк противоположность противоположн прятаться прята бесконечность бесконечн читавший чита".split()
    for words in (english, russian):
        assert [stem.stem(w) for w in words[::2]] == words[1::2]
    df = spark.createDataFrame([(["cats", "слоны", "x1", None],), (None,), ([],)], "w array<string>").repartition(1)
    assert sorted([r[0] for r in df.select(stem.stems(F.col("w"))).collect()], key=str) == sorted([["cat", "слон", "x1", None], None, []], key=str)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_vertex_that_two_paths_reach_is_there_once(spark):
    requests = spark.createDataFrame([(1, 0, 1), (1, 5, 3)], "request long, vertex long, path_length int")
    edges = spark.createDataFrame([(0, 7), (5, 7), (7, 8), (8, 0)], "source long, target long")
    got = graph.bounded_bfs(requests, edges, 3)
    assert sorted(map(tuple, got.collect())) == [(1, 0, 0), (1, 5, 0), (1, 7, 1), (1, 8, 2)]
    assert "LeftAnti" not in plan(got)


def test_a_learner_keeps_its_features_in_one_array():
    model = classify.Ftrl(2)
    state = model.start()
    for k in range(40):
        state = model.learn(state, list(range(k * 50, k * 50 + 60)), np.ones(60), k % 2)
    assert state.rows.shape[1:] == (3, 2) and 40 * 50 + 10 < len(state.rows) <= 4096 and not state.rows[0].any()
    assert model.predict(state, [10**9], np.ones(1)).tolist() == [0.5, 0.5]


def test_texts_move_before_they_are_split(spark):
    """Counts of a document's words need no shuffle of words, running counts one, and nothing is written between."""
    docs = spark.createDataFrame([(k, f"aa b{k % 3} aa cc") for k in range(20)], "doc_id long, text string")
    counts = classify.term_counts(docs)
    assert plan(counts).count("Exchange ") == 1 and counts.where("word = 'aa' AND tf = 2").count() == 20
    running = classify.running_df(counts, 8)
    assert "ExistingRDD" not in plan(running).replace("Scan ExistingRDD[doc_id", "") and running.where("word = 'cc' AND df = doc_id + 1").count() == 20


def test_postings_of_a_query(spark):
    docs = spark.createDataFrame([(1, "aa bb AA"), (2, "cc"), (3, None)], "page long, text string")
    got = sorted(map(tuple, ranking.postings(docs, ["aa", "zz"]).collect()))
    assert got == [(1, 3, "aa", 2), (2, 1, None, 0), (3, 0, None, 0)]
