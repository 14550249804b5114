import itertools
import random

import duckdb
import pytest

from sequenza.llm import packing, queries, tokencount


@pytest.mark.parametrize("seed", range(6))
def test_least_padding(seed):
    draw = random.Random(seed)
    lengths = sorted(draw.sample(range(1, 60), 9))
    counts = [draw.randrange(1, 20) for _ in lengths]
    for buckets in (1, 2, 3, 8, 9, 12):
        got = packing.boundaries(lengths, counts, buckets)
        cuts = itertools.chain.from_iterable(itertools.combinations(lengths[:-1], k) for k in range(min(buckets, 9)))
        assert len(got) <= buckets and packing.padding(lengths, counts, got) == min(packing.padding(lengths, counts, [*c, lengths[-1]]) for c in cuts)
    assert packing.boundaries([], [], 3) == []


@pytest.mark.parametrize("n", [40, 97, 300])
def test_choices_that_pad_as_little_go_as_in_sql(n):
    """One document of each length: many choices of boundaries are equally good."""
    con = duckdb.connect()
    con.execute(f"CREATE TABLE documents AS SELECT range AS doc_id, repeat('w ', CAST(range + 1 AS INT)) AS text FROM range({n})")
    uppers = [x for x, in con.execute(f"SELECT DISTINCT padded_length FROM ({queries.oracle_sql()['packing_by_words']}) ORDER BY 1").fetchall()]
    assert packing.boundaries(list(range(1, n + 1)), [1] * n) == uppers


def test_batches_as_brute_force(spark):
    draw = random.Random(4)
    rows = [(k, " ".join("w" for _ in range(draw.randrange(0, 40)))) for k in range(300)]
    got = {r["doc_id"]: (r["n_tokens"], r["padded_length"], r["batch"]) for r in packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), buckets=4, budget=100).collect()}
    sizes = {k: len(t.split()) for k, t in rows}
    distinct = sorted({n for n in sizes.values() if n})
    uppers = packing.boundaries(distinct, [sum(n == x for n in sizes.values()) for x in distinct], 4)
    seen, expected = dict.fromkeys(uppers, 0), {}
    for k in range(300):
        upper = next((u for u in uppers if u >= sizes[k]), None) if sizes[k] else None
        expected[k] = (sizes[k], upper, None if upper is None else seen[upper] // max(1, 100 // upper))
        if upper:
            seen[upper] += 1
    assert got == expected


def test_edges(spark):
    rows = [(1, "a b"), (1, "a b"), (None, None), (None, "x"), (4, ""), (5, "  "), (6, "w " * 50000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS batch", "2 AS n_tokens", "3 AS padded_length")
    got = sorted(map(tuple, packing.pack(docs).collect()), key=str)
    assert got == sorted([(1, 2, 2, 0), (1, 2, 2, 0), (None, 0, None, None), (None, 1, 1, 0), (4, 0, None, None), (5, 0, None, None), (6, 50000, 50000, 0)], key=str)
    assert packing.pack(docs.limit(0)).count() == 0
    assert {r["batch"] for r in packing.pack(docs.where("doc_id > 3 AND doc_id < 6")).collect()} == {None}


def test_by_tokens_of_a_vocabulary(spark):
    """Lengths are those that token_counts gives, and no batch holds more than the budget."""
    draw = random.Random(5)
    rows = [(k, " ".join("".join(draw.choice("abc!\u2019") for _ in range(draw.randrange(1, 9))) for _ in range(draw.randrange(0, 30)))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    pieces = ([b"a", b"ab", b"c"], [b"a", b"b", b"c", b"bc"])
    counts = {r["doc_id"]: r["n_tokens"] for r in tokencount.token_counts(docs, *pieces).collect()}
    got = packing.pack(docs, 5, 64, pieces).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == counts and max(counts.values()) > 64
    lengths = sorted({n for n in counts.values() if n})
    assert {r["padded_length"] for r in got if r["n_tokens"]} <= set(packing.boundaries(lengths, [sum(n == x for n in counts.values()) for x in lengths], 5))
    batches = {}
    for r in got:
        if r["batch"] is not None:
            batches.setdefault((r["padded_length"], r["batch"]), []).append(r["doc_id"])
    assert all(len(ids) * upper <= max(64, upper) for (upper, _), ids in batches.items())
