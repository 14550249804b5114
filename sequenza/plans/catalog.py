"""Every query of the library's own operators, with the SQL that gives the same rows.

Lists leave as strings and floating-point values rounded, so that any engine can compare them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sequenza.functions import keys, positions, text, times
from sequenza.operators import classify, fold, graph, grouping, index, labels, latency, ranking, wordcount
from sequenza.operators.flow import Stream
from sequenza.operators.lineage import cut, fresh_path
from sequenza.operators.order import Order
from sequenza.plans.oracles import ORACLES
from sequenza.sources.readers import pages_xml, table
from sequenza.streaming import stateful
from sequenza.streaming.run import ROCKSDB, counted_by_time, drained, replayed, window_contents

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
EVENT_ORDER = Order(["ts"], (), ["event_id"])
LINE_ORDER = Order(["l_orderkey", "l_linenumber"], (), ["l_partkey", "l_suppkey", "l_quantity", "l_shipdate"])


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in _QUERIES}


def _events(spark: SparkSession, d: str) -> Stream:
    return Stream(table(spark, d, "events"), EVENT_ORDER)


def _joined(c: str | Column = "window") -> Column:
    return F.array_join(c, ",")


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


# Maps, filters, flat maps, unions, placement


@query
def map_chain(spark, d):
    """Four maps in a row."""
    s = Stream(table(spark, d, "lineitem"), LINE_ORDER).with_columns(value=F.col("l_linenumber").cast("long"))
    for factor in (-1, -2, -3, -4):
        s = s.with_columns(value=F.col("value") * factor)
    return s.map(l_orderkey=F.col("l_orderkey"), l_partkey=F.col("l_partkey"), value=F.col("value")).df


@query
def filter_events(spark, d):
    return _events(spark, d).filter("event_type <> 'view' AND value >= 10").map(event_id=F.col("event_id"), event_type=F.col("event_type")).df


@query
def flat_map_children(spark, d):
    """Words of lines, each with its place among the children of its document."""
    s = Stream(table(spark, d, "documents").select("doc_id", "text"), Order(["doc_id"]))
    s = s.flat_map(F.split("text", "\n"), "line", "line_no").flat_map(F.split("line", text.SPACE), "word", "child")
    return s.filter("word <> ''").map(doc_id=F.col("doc_id"), line_no=F.col("line_no"), child=F.col("child"), word=F.col("word")).df


@query
def union_fork(spark, d):
    """One stream forked in two and merged again."""
    s = _events(spark, d)
    low, high = s.filter("value < 50").map(event_id=F.col("event_id"), side=F.lit("low")), s.filter("value >= 50").map(event_id=F.col("event_id"), side=F.lit("high"))
    return low.union(high).df


@query
def merge_bag(spark, d):
    """A merge keeps rows that come twice."""
    s = _events(spark, d)
    return s.union(s.filter("event_type = 'click'")).df.groupBy("event_type").agg(F.count("*").alias("n"))


@query
def hash_mod(spark, d):
    """Buckets by a signed remainder."""
    value = F.col("o_custkey") - F.lit(100)
    return table(spark, d, "orders").groupBy(keys.bucketed(value, 5).alias("bucket")).agg(F.count("*").alias("n"))


@query
def broadcast_twice(spark, d):
    """Two broadcasts to four replicas each."""
    s = Stream(table(spark, d, "nation"), Order(["n_nationkey"])).broadcast(4, "first").broadcast(4, "second")
    return s.df.groupBy("n_name").agg(F.count("*").alias("n"))


@query
def post_broadcast_state(spark, d):
    """State kept apart in each replica of a broadcast."""
    s = _events(spark, d).map(ts=F.col("ts"), event_id=F.col("event_id"), event_type=F.col("event_type")).broadcast(2)
    return s.key_by("event_type", "replica").scan("n", F.count("event_id")).df.groupBy("event_type", "replica").agg(F.max("n").alias("n"))


@query
def prefixed_strings(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.concat(F.lit("prefix_"), "c_name").alias("value"))


# Count windows


@query
def grouping_w1(spark, d):
    return _events(spark, d).key_by("user_id").grouping("event_type", 1).df.select("event_id", _joined().alias("items"))


@query
def grouping_w2(spark, d):
    return _events(spark, d).key_by("user_id").grouping("event_type", 2).df.select("event_id", _joined().alias("items"))


@query
def grouping_w3(spark, d):
    return _events(spark, d).key_by("user_id").grouping("event_type", 3).df.select("event_id", _joined().alias("items"))


@query
def grouping_undo_w3(spark, d):
    return _events(spark, d).key_by("user_id").grouping("event_type", 3, undo_partial=True).df.select("event_id", _joined().alias("items"))


@query
def grouping_undo_larger_than_group(spark, d):
    """Windows that many groups never fill."""
    return _events(spark, d).key_by("user_id").grouping("event_type", 60, undo_partial=True).df.select("event_id", _joined().alias("items"))


@query
def grouping_unbounded(spark, d):
    """One list for each finished group."""
    return _events(spark, d).key_by("user_id").grouping("event_type", grouping.UNBOUNDED, undo_partial=True).df.select("user_id", _joined().alias("items"))


@query
def grouping_custom_order(spark, d):
    """A custom order between time and lineage: here all rows of a day have one time."""
    order = Order(["day"], [F.desc("value")], ["event_id"])
    s = _events(spark, d).with_columns(day=F.to_date("ts"))
    return s.key_by("user_id", order=order).grouping("event_id", 2).df.select("event_id", _joined().alias("items"))


@query
def grouping_composite_key(spark, d):
    return _events(spark, d).key_by("user_id", "event_type").grouping("event_id", 2).df.select("event_id", _joined().alias("items"))


@query
def grouping_global(spark, d):
    """All rows in one group, over a small table."""
    return grouping.global_group(table(spark, d, "nation"), Order(["n_nationkey"]), "n_name", 3).select("n_nationkey", _joined().alias("items"))


@query
def triple_grouping(spark, d):
    """Three windows in a chain, each over hashes of the lists before it."""
    s = Stream(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("v")), Order(["o_orderkey"]))
    for _ in range(3):
        s = s.with_columns(k=keys.bucketed(F.col("v"), 20)).key_by("k").grouping("v", 2).with_columns(v=keys.list_hash(F.col("window")))
        s = s.map(o_orderkey=F.col("o_orderkey"), v=F.col("v"))
    return s.df


# Folds


@query
def running_sum(spark, d):
    """A running sum over all rows, in whole cents."""
    cents = table(spark, d, "events").select("ts", "event_id", _cents("value").alias("cents"))
    return fold.running_sum(cents, ["ts", "event_id"], "cents", "total").select("event_id", "total")


@query
def running_sum_by_key(spark, d):
    return _events(spark, d).with_columns(cents=_cents("value")).key_by("user_id").scan("total", F.sum("cents")).df.select("event_id", "total")


@query
def running_extremes(spark, d):
    s = _events(spark, d).with_columns(cents=_cents("value")).key_by("user_id").scan("low", F.min("cents"))
    return s.key_by("user_id").scan("high", F.max("cents")).df.select("event_id", "low", "high")


@query
def last_value_state(spark, d):
    """State that is the last purchase a user made before each event."""
    before = EVENT_ORDER.within(["user_id"]).rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, d, "events").withColumn("last", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(before)).select("event_id", F.coalesce("last", F.lit(-1)).alias("last"))


@query
def stateful_map_general(spark, d):
    """A fold that isn't algebraic: state * 31 + cents, modulo a prime."""
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", _cents("value").alias("cents"))

    def step(row, state):
        now = ((7 if state is None else state) * 31 + row["cents"]) % 1_000_003
        return now, (row["event_id"], now)

    return fold.stateful_map(rows, ["user_id"], ["ts", "event_id"], step, "user_id long, event_id long, state long")


@query
def stateful_map_desc_order(spark, d):
    """A fold over rows in falling order: the first event of the order so far, and the place."""
    order = Order([], [F.desc("value")], ["event_id"])

    def step(row, state):
        top, n = state or (row["event_id"], 0)
        return (top, n + 1), (row["event_id"], top, n + 1)

    keyed = Stream(table(spark, d, "events").select("user_id", "event_id", "value"), EVENT_ORDER).key_by("user_id", order=order)
    return keyed.stateful_map(step, "user_id long, event_id long, top long, place long").df


@query
def stateful_map_nulls(spark, d):
    """Null keys and null values beside longs that a double can't hold."""
    kind, big = F.nullif("event_type", F.lit("view")), F.when(F.col("event_id") % 5 != 0, F.lit(9007199254740993) + F.col("event_id"))
    rows = table(spark, d, "events").select(kind.alias("kind"), "ts", "event_id", big.alias("big"))

    def step(row, state):
        now = state if row["big"] is None else row["big"]
        return now, (row["event_id"], -1 if now is None else now, row["big"] is None)

    return fold.stateful_map(rows, ["kind"], ["ts", "event_id"], step, "kind string, event_id long, last long, missing boolean")


@query
def chained_folds(spark, d):
    """A fold of what a fold released: the place of an event among its user's, and the sum of those places by kind of event."""
    s = _events(spark, d).key_by("user_id").aggregate(lambda row, n: (n[0] + 1 if n else 1, row), lambda state: (state[1]["event_type"], state[1]["ts"], state[1]["event_id"], state[0]), "user_id long, event_type string, ts timestamp, event_id long, n long")
    total = s.key_by("event_type").aggregate(lambda row, state: ((state[0] if state else 0) + row["n"], row), lambda state: (state[1]["event_id"], state[1]["n"], state[0]), "event_type string, event_id long, n long, total long")
    return total.df


@query
def running_count_null_keys(spark, d):
    """Running counts by segments where some keys are null."""
    rows = table(spark, d, "events").select("event_id", F.nullif("event_type", F.lit("view")).alias("kind"))
    return fold.running_count(rows, ["kind"], Order(["event_id"]), "n", F.floor(F.col("event_id") / 100)).select("event_id", "n")


@query
def stateful_flat_map_sessions(spark, d):
    """No output or one for each row: the rows of a user after every third event, with how many came so far."""
    rows = table(spark, d, "events").select("user_id", "ts", "event_id")

    def step(row, state):
        n = (state or 0) + 1
        return n, [(row["event_id"], n)] if n % 3 == 0 else []

    return fold.stateful_flat_map(rows, ["user_id"], ["ts", "event_id"], step, "user_id long, event_id long, n long")


# Labels


def _spawned(spark, d) -> Stream:
    return Stream(table(spark, d, "documents").select("doc_id", "text"), Order(["doc_id"])).spawn_label("doc", "doc_id")


@query
def label_scope_counts(spark, d):
    """Words counted within the label of the document they came from."""
    s = _spawned(spark, d)
    whole = Stream(keys.placed(labels.require_labels(s.df, ["doc"]), "label_doc"), s.order)
    return whole.flat_map(text.tokens(F.col("text")), "word", "pos").df.groupBy("label_doc", "word").agg(F.count("*").alias("n"))


@query
def label_markers(spark, d):
    """The lines of each document, and a marker after them."""
    s = _spawned(spark, d)
    lines = s.flat_map(F.split("text", "\n"), "line", "pos").map(label_doc=F.col("label_doc"), pos=F.col("pos"), n_chars=F.length("line"))
    return lines.label_markers(s, "doc", pos=F.lit(-1), n_chars=F.lit(-1)).df


@query
def label_markers_ordered(spark, d):
    """The place of each marker in its label's rows: always the last."""
    s = _spawned(spark, d)
    lines = s.flat_map(F.split("text", "\n"), "line", "pos").map(label_doc=F.col("label_doc"), pos=F.col("pos"))
    both = lines.label_markers(s, "doc").df
    place = F.row_number().over(Window.partitionBy("label_doc").orderBy("is_marker", "pos"))
    return both.withColumn("place", place).where("is_marker").select("label_doc", "place")


@query
def label_keyed_state(spark, d):
    """Running counts by label and key: each label has state of its own."""
    s = Stream(table(spark, d, "conversations"), Order(["conv_id", "turn"])).spawn_label("conv", "conv_id")
    return s.key_by("role", labelled=["conv"]).scan("n", F.count("turn")).df.select("conv_id", "turn", "n")


# Word counts


def _words(spark, d) -> DataFrame:
    return wordcount.words_of(table(spark, d, "documents"), "doc_id", "text")


@query
def wordcount_final(spark, d):
    return wordcount.final(_words(spark, d))


@query
def wordcount_running(spark, d):
    return wordcount.running(_words(spark, d), "doc_id").select("doc_id", "pos", "word", "count")


@query
def wordcount_top10(spark, d):
    return wordcount.top(wordcount.final(_words(spark, d)), 10)


@query
def wordcount_bucketed_top5(spark, d):
    return wordcount.bucketed_top(wordcount.final(_words(spark, d)), 5, F.length("word"))


# Inverted index and ranking


def _pages(spark, d) -> DataFrame:
    return index.word_positions(index.versions(table(spark, d, "conversations"), "conv_id", "turn", "text"))


@query
def word_positions(spark, d):
    return _pages(spark, d).select("page", "version", "word", _joined(F.col("positions").cast("array<string>")).alias("positions"))


@query
def stemmed_positions(spark, d):
    """The places of stems instead of words."""
    versions = index.versions(table(spark, d, "conversations"), "conv_id", "turn", "text")
    return index.word_positions(versions, stemmed=True).select("page", "version", "word", _joined(F.col("positions").cast("array<string>")).alias("positions"))


@query
def packed_positions(spark, d):
    return index.packed(_pages(spark, d)).select("page", "version", "word", _joined(F.col("packed").cast("array<string>")).alias("packed"))


@query
def unpacked_positions(spark, d):
    entries = index.state(_pages(spark, d))
    return entries.select("word", *[c.alias(n) for n, c in positions.unpack(F.col("entry")).items()])


@query
def index_diff(spark, d):
    """Additions to the index, and removals of what an earlier version of the page had."""
    out = index.diffs(_pages(spark, d))
    none = F.lit(-1)
    return out.select("word", "page", "version", "op", F.coalesce("start", none).alias("start"), F.coalesce("range", none).alias("range"), F.coalesce(_joined(F.col("positions").cast("array<string>")), F.lit("")).alias("positions"))


@query
def index_diff_forgetful(spark, d):
    """The same where an update forgets versions."""
    return index.diffs(_pages(spark, d), keep_version=False).where("op = 'remove'").select("word", "page", "version", "start", "range")


@query
def index_final(spark, d):
    return index.state(_pages(spark, d))


def _query_terms(postings: DataFrame, docs: DataFrame) -> DataFrame:
    """The three words of most documents among those in fewer than a third of them."""
    n = docs.agg(F.count_distinct("page").alias("n"))
    return postings.where("word IS NOT NULL").groupBy("word").agg(F.count("*").alias("df")).crossJoin(n).where("df * 3 < n").orderBy(F.desc("df"), "word").limit(3).select("word")


def _ranked(spark, d, all_docs: bool) -> DataFrame:
    """The query's words first, of which only a few come back, and then the postings of those words, which are a few rows for each document."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("page"), "text")
    terms = cut(_query_terms(ranking.postings(docs), docs))
    postings = cut(ranking.postings(docs, [r["word"] for r in terms.collect()]))
    return ranking.bm25(postings, terms, all_docs).select("page", F.round("score", 9).alias("score"))


@query
def bm25(spark, d):
    return _ranked(spark, d, False)


@query
def bm25_all_docs(spark, d):
    return _ranked(spark, d, True)


@query
def ranking_latest_versions(spark, d):
    """The documents that a ranking over versions holds: each page's newest."""
    return ranking.latest(index.versions(table(spark, d, "conversations"), "conv_id", "turn", "text")).select("page", "version", F.length("text").alias("n_chars"))


# Classification


def _df(spark, d) -> DataFrame:
    return classify.running_df(classify.term_counts(table(spark, d, "documents")))


@query
def term_frequency(spark, d):
    return classify.term_counts(table(spark, d, "documents"))


@query
def split_labeled(spark, d):
    """Documents with a label and those without, each a label scope of its own, and the tokens counted in each scope."""
    docs = table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    s = Stream(docs, Order(["doc_id"]))
    known, unknown = s.filter("quality IS NOT NULL").spawn_label("known", "doc_id"), s.filter("quality IS NULL").spawn_label("unknown", "doc_id")
    words = [x.flat_map(text.tokens(F.col("text")), "word", "pos") for x in (known, unknown)]
    counts = [labels.require_labels(x.df, [n]).groupBy(f"label_{n}").agg(F.count("*").alias("n")) for x, n in zip(words, ("known", "unknown"))]
    return counts[0].unionByName(counts[1], allowMissingColumns=True).fillna(-1)


@query
def running_df(spark, d):
    return _df(spark, d).select("doc_id", "word", "df")


@query
def tfidf(spark, d):
    return classify.tfidf(_df(spark, d), F.col("doc_id") + 1).select("doc_id", "word", F.round("weight", 6).alias("weight"))


@query
def decayed_idf(spark, d):
    return classify.decayed_idf(classify.term_counts(table(spark, d, "documents")), 200, 0.761).select("word", F.round("df", 6).alias("df"))


@query
def windowed_tfidf(spark, d):
    counts = classify.term_counts(table(spark, d, "documents"))
    known = counts.join(counts.groupBy("word").agg(F.count("*").alias("df")), "word")
    total = table(spark, d, "documents").agg(F.count("*").alias("total"))
    return classify.windowed_weight(known.crossJoin(total), F.col("total")).select("doc_id", "word", F.round("weight", 6).alias("weight"))


@query
def vectorized(spark, d):
    """Words numbered by a vocabulary; those outside are 0."""
    counts = classify.term_counts(table(spark, d, "documents"))
    vectors = classify.vectorized(counts, classify.vocabulary_of(counts))
    return vectors.groupBy("doc_id", "idx").agg(F.sum("tf").alias("tf"))


@query
def ftrl_predictions(spark, d):
    """Topics of unlabelled documents by one online learner over all documents in order."""
    weights = classify.tfidf(_df(spark, d), F.col("doc_id") + 1)
    vocabulary = classify.vocabulary_of(classify.term_counts(table(spark, d, "documents")))
    vectors = classify.vectorized(weights, vocabulary).groupBy("doc_id", "idx").agg(F.sum("weight").alias("weight"))
    known = vectors.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("idx", "weight"))).alias("x"))
    rows = known.join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id", "left")
    out = classify.classified(rows.select("doc_id", F.col("x.idx").alias("idx"), F.col("x.weight").alias("weight"), "label"), classify.Ftrl(2))
    return out.select("doc_id", "topic", F.round("probability", 6).alias("probability"))


@query
def one_vs_rest_baseline(spark, d):
    """An L1 logistic baseline, one classifier for each language, over hashed term frequencies."""
    from pyspark.ml.classification import LogisticRegression, OneVsRest
    from pyspark.ml.feature import HashingTF, StringIndexer

    docs = table(spark, d, "documents").select("doc_id", "lang", text.tokens(F.col("text")).alias("tokens"))
    rows = HashingTF(inputCol="tokens", outputCol="features", numFeatures=1 << 16).transform(docs)
    rows = StringIndexer(inputCol="lang", outputCol="label", stringOrderType="alphabetAsc").fit(docs).transform(rows)
    model = OneVsRest(classifier=LogisticRegression(regParam=0.001, elasticNetParam=1.0), parallelism=4).fit(rows)
    return model.transform(rows).select("doc_id", "label", "prediction")


# Graph search


def _edges(spark, d) -> DataFrame:
    of = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("source"), F.lead("l_partkey").over(of).alias("target")).where("target IS NOT NULL")


def _requests(spark, d, hops: int) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("request"), F.col("p_partkey").alias("vertex"), F.lit(hops).alias("path_length"))


@query
def bfs_two_hops(spark, d):
    """The parts that come into reach of each part at each depth, as their number and sums over them."""
    vertex = F.col("vertex")
    return graph.bounded_bfs(_requests(spark, d, 2), _edges(spark, d), 2).groupBy("request", "depth").agg(F.count("*").alias("n"), F.sum(vertex).alias("total"), F.sum(vertex * vertex % 1000003).alias("squares"))


@query
def bfs_with_markers(spark, d):
    requests = _requests(spark, d, 1)
    return graph.with_markers(graph.bounded_bfs(requests, _edges(spark, d), 1), requests).fillna(-1, ["vertex", "depth"])


def _updates(spark, d) -> DataFrame:
    """Each event gives its user's vertex new targets: the two users after it."""
    user = F.col("user_id")
    return table(spark, d, "events").select(user.alias("source"), _micros("ts").alias("time"), F.col("event_id").alias("tie"), F.array((user * 7 + F.col("event_id")) % 150, (user * 3 + F.col("event_id")) % 150).alias("targets"))


@query
def bfs_mutable_edges(spark, d):
    """Two hops over edges as they were at each request's time."""
    asks = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("request"), F.col("user_id").alias("vertex"), F.lit(2).alias("path_length"), _micros("ts").alias("time"))
    return graph.mutable_bfs(asks, _updates(spark, d), 2)


# Benchmark measures


@query
def latency_percentiles(spark, d):
    """Percentiles of how long a user's outputs took, the first 20 users aside."""
    each = latency.latencies(table(spark, d, "events"), "user_id", "ts", "ts")
    return latency.percentiles(each, "latency", "user_id", skip=20, exact=True)


@query
def validator_missing(spark, d):
    """Documents that were expected to have a label and have none."""
    return latency.missing(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])


@query
def arrival_gaps(spark, d):
    uniform = (F.col("event_id") * 7919 % 1000 + 0.5) / 1000
    return table(spark, d, "events").select("event_id", F.round(latency.arrival_gap(uniform, 400.0), 6).alias("gap"))


# Streams in several files that are read one at a time, most with rows that come too late to be in order, run to the end of what is there

#: Seconds that a row of a replayed table may be late, and the delay that lets it in.
JITTER, DELAY = 86_400, "1 day"
#: Events that one part of a stream has at most, about: larger tables have more parts, so that what a key's rows take in a batch stays as it is.
MOST_ROWS = 1_500_000


def _late_events(spark, d, *columns: str) -> DataFrame:
    rows = table(spark, d, "events").select(*columns)
    return replayed(rows, "ts", max(4, -(-rows.count() // MOST_ROWS)), JITTER)[1]


@query
def streaming_map_filter(spark, d):
    """Stateless steps over a stream, without any barrier."""
    return drained(_late_events(spark, d, "event_id", "ts", "event_type", "value").where("event_type <> 'view' AND value >= 10").select("event_id", "event_type"))


@query
def streaming_wordcount(spark, d):
    docs = replayed(table(spark, d, "documents").select("doc_id", "text"), "doc_id", 3, end=False)[1]
    return drained(wordcount.words_of(docs, "doc_id", "text").groupBy("word").count(), mode="complete")


@query
def streaming_grouping(spark, d):
    """Count windows over rows that arrive out of order."""
    out = stateful.grouping(_late_events(spark, d, "user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], "event_type", 3, "ts", DELAY)
    return drained(out).select("event_id", F.col("window").alias("items"))


@query
def streaming_running_count(spark, d):
    out = stateful.running_count(_late_events(spark, d, "event_type", "ts", "event_id"), "event_type", ["ts", "event_id"], time="ts", delay=DELAY)
    return drained(out).select("event_id", "count")


@query
def streaming_fold(spark, d):
    """The fold of stateful_map_general over a stream, its state in RocksDB."""

    def step(row, state):
        now = ((7 if state is None else state) * 31 + row["cents"]) % 1_000_003
        return now, (row["event_id"], now)

    rows = _late_events(spark, d, "user_id", "ts", "event_id", "value").select("user_id", "ts", "event_id", _cents("value").alias("cents"))
    return drained(stateful.fold(rows, "user_id", ["ts", "event_id"], step, "user_id long, event_id long, state long", "ts", DELAY), state=ROCKSDB)


@query
def streaming_label_markers(spark, d):
    """The lines of each document as they arrive, and a marker once no more can come."""
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("label_doc"), F.timestamp_seconds(1_600_000_000 + F.col("doc_id") * 60).alias("ts"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    stream_ = replayed(lines.select("label_doc", "ts", "pos", F.length("line").alias("n_chars")), "ts", 3, 3600)[1]
    out = drained(stateful.label_markers(stream_, "label_doc", "ts", "1 hour")).where("label_doc IS NOT NULL")
    return out.select("label_doc", F.coalesce("pos", F.lit(-1)).alias("pos"), F.coalesce("n_chars", F.lit(-1)).alias("n_chars"), "is_marker")


@query
def streaming_index_diff(spark, d):
    """The inverted index over a stream of page versions: one entry for each word of each version, with what it replaces. A version that comes after a later one is an error."""

    def step(row, state):
        seen = state or {}  # the state of this run alone: what is kept is written after the last row
        old = seen.get(row["word"], (-1, -1))
        seen[row["word"]] = (row["first"], row["n"])
        return seen, (row["version"], row["word"], row["first"], row["n"], *old)

    turns = replayed(table(spark, d, "conversations").select("conv_id", "turn", "text"), "turn", 3, end=False)[1]
    turns = turns.select(F.col("conv_id").alias("page"), (F.col("turn") + 1).alias("version"), text.index_tokens(F.col("text")).alias("tokens"))
    words = turns.select("page", "version", "tokens", F.explode(F.array_distinct("tokens")).alias("word"))
    n = F.size("tokens") - F.size(F.array_remove("tokens", F.col("word")))
    rows = words.select("page", "version", "word", (F.array_position("tokens", F.col("word")) - 1).cast("int").alias("first"), n.alias("n"))
    return drained(stateful.fold(rows, "page", ["version", "word"], step, "page long, version long, word string, first int, n int, old_first int, old_n int"))


@query
def streaming_time_windows(spark, d):
    """Event-time windows over a stream, each given out once the watermark has passed it."""
    return times.unzoned(drained(counted_by_time(times.zoned(_late_events(spark, d, "ts", "event_type"), "ts"), "ts", "event_type", "1 day", DELAY)), "start")


@query
def streaming_window_contents(spark, d):
    """The events of each day in order, once the day is over."""
    out = window_contents(times.zoned(_late_events(spark, d, "ts", "event_id"), "ts"), "ts", "1 day", DELAY, ["ts", "event_id"], "event_id")
    return times.unzoned(drained(out), "start").select("start", _joined(F.col("items").cast("array<string>")).alias("items"))


# Sources


@query
def pages_from_xml(spark, d):
    """Page versions written as an XML dump and read again."""
    path = fresh_path(spark, "pages")
    rows = table(spark, d, "conversations").where("trim(text) <> ''").select(F.col("conv_id").alias("_id"), F.concat(F.lit("conversation "), "conv_id").alias("_title"), F.col("text").alias("_VALUE"), "turn")
    rows.coalesce(1).sortWithinPartitions("_id", "turn").drop("turn").write.format("xml").option("rowTag", "page").option("rootTag", "pages").save(path)
    return pages_xml(spark, path).select("page", "version", "title", F.length("text").alias("n_chars"))
