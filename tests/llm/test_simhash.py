import random

import numpy as np
import pyarrow as pa

from sequenza.llm import simhash

FOLDER = "/root/testdata/sf0.01"


def brute_groups(docs: list[int], high: np.ndarray, low: np.ndarray, most: int) -> dict[int, int]:
    """Least document of each connected component of all pairs within `most` bits."""
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k in range(len(docs)):
        gap = np.bitwise_count(high[k + 1 :] ^ high[k]) + np.bitwise_count(low[k + 1 :] ^ low[k])
        for j in np.flatnonzero(gap <= most):
            a, b = find(docs[k]), find(docs[k + 1 + j])
            root[max(a, b)] = min(a, b)
    return {d: find(d) for d in docs}


def test_recall_against_all_pairs(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    table = docs.select("doc_id", "text").orderBy("doc_id").toArrow()
    _, _, high, low = simhash.fingerprints(table["text"].combine_chunks())
    gaps = 0
    found = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(docs).collect()}
    ids = table["doc_id"].to_pylist()
    hits = 0
    for k in range(len(ids)):
        near = np.flatnonzero(np.bitwise_count(high[k + 1 :] ^ high[k]).astype(int) + np.bitwise_count(low[k + 1 :] ^ low[k]) <= simhash.MOST_BITS) + k + 1
        gaps += len(near)
        hits += sum(found[ids[k]] == found[ids[j]] for j in near)
    assert gaps > 20 and hits / gaps >= 0.9
    expected = brute_groups(ids, high, low, simhash.MOST_BITS)
    assert all(expected[d] == expected[g] for d, g in found.items())  # no pair that isn't in a true group


def test_edited_copies_and_unrelated_texts(spark):
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("etaoinshr") for _ in range(draw.randrange(2, 9)))
    rows, of = [], {}
    for k in range(60):
        words = [word() for _ in range(200)]
        for c in range(3):
            copy = list(words)
            for _ in range(4 * c):
                copy[draw.randrange(200)] = word()
            of[len(rows)] = k
            rows.append((len(rows), " ".join(copy)))
    got = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(of[g] == of[d] for d, g in got.items())
    assert sum(got[d] == d - d % 3 for d in got) >= 0.95 * len(got)


def test_edges(spark):
    rows = [(1, "some text that is here twice", 1), (1, "some text that is here twice", 1), (2, "some text that is here twice", 2), (None, None, 3), (None, "x", 4), (5, None, 5), (6, "", 6), (7, "", 7), (8, "long " * 100000, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int").selectExpr("node", "text", "doc_id", "node AS gone", "node AS root", "node AS kept")
    got = [(r["doc_id"], r["group_id"], r["kept"]) for r in simhash.near_duplicates(docs).collect()]
    assert len(got) == 9 and got.count((1, 1, True)) == 2 and {(2, 1, False), (None, None, True), (5, 5, True), (6, 6, True), (7, 6, False), (8, 8, True)} <= set(got)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r["node"] for r in kept.collect()) == [1, 1, 3, 4, 5, 6, 8]
    assert {(r["doc_id"], r["group_id"]) for r in simhash.near_duplicate_groups(docs).collect()} == {(1, 1), (2, 1), (6, 6), (7, 6)}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_large_groups_stay_whole(spark):
    rows = [(k, f"the very same words in every one of many copies with {'one' if k % 2 else 'two'} change") for k in range(500)]
    groups = {r["group_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(groups) <= 2 and pa.array(rows[0][1:]) is not None


def test_recall_of_isolated_pairs_by_similarity(spark):
    draw = random.Random(7)
    texts = []
    for k in range(2400):  # pairs of texts that have 60 to 140 of 160 word pairs in common
        own = [f"w{k}x{n}" for n in range(161)]
        cut = 60 + k % 81
        texts += [" ".join(own), " ".join(own[: cut + 1] + [f"v{k}x{n}" for n in range(160 - cut)])]
    rows = list(enumerate(texts))
    draw.shuffle(rows)
    _, _, first, second = simhash.fingerprints(pa.array(texts))
    gap = np.bitwise_count(first[::2] ^ first[1::2]).astype(int) + np.bitwise_count(second[::2] ^ second[1::2])
    got = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = np.array([got[2 * k + 1] == 2 * k for k in range(len(gap))])
    shared = 60 + np.arange(len(gap)) % 81
    similarity, close = shared / (320 - shared), gap <= simhash.MOST_BITS
    assert not found[~close].any()
    recall = {low: (int(own.sum()), found[own].mean()) for low in (0.3, 0.4, 0.5, 0.6, 0.7) if (own := close & (similarity >= low) & (similarity < low + 0.1)).any()}
    assert len(recall) >= 4 and all(r >= 0.9 for n, r in recall.values() if n >= 10)


def test_stars_by_plain_search():
    draw = np.random.default_rng(8)
    for n, m in ((1, 0), (30, 20), (200, 190), (500, 2000)):
        a, b = draw.integers(0, n, m) * 7, draw.integers(0, n, m) * 7
        root = {int(x): int(x) for x in np.concatenate([a, b])}
        changed = True
        while changed:
            changed = False
            for x, y in zip(a.tolist(), b.tolist()):
                least = min(root[x], root[y])
                changed |= root[x] != least or root[y] != least
                root[x] = root[y] = least
        u, v = simhash.stars(a, b)
        assert dict(zip(u.tolist(), v.tolist())) == {x: r for x, r in root.items() if x != r}


def test_a_third_of_all_rows_is_one_text(spark):
    docs = spark.range(30_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'the very same text in many rows' ELSE concat_ws(' ', id, id * 7, id * 11, id * 13, id * 17) END AS text")
    groups = simhash.near_duplicate_groups(docs)
    assert groups.where("group_id = 0").count() == 10_000 and groups.where("group_id <> 0").count() < 100
