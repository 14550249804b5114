"""The pipeline and the queries over whole small tables, against plain versions of every stage."""

import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import test_digest
import test_lines
import test_packing  # noqa: F401
import test_suffix
import test_tokencount
from tokenizers.pre_tokenizers import BertPreTokenizer

import corpus_pipeline
from sequenza.llm import packing, quality, queries, simhash

FOLDER = "/root/testdata/sf0.001"
SPACE = "[ \t\n\x0b\f\r]"


@pytest.fixture(scope="module")
def docs():
    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()}


def plain_quality(spark, docs):
    forest = quality.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    return {d: t for d, t in docs.items() if forest.scores(*quality.statistics(pa.array([t])))[0] <= forest.threshold}


def plain_lines(docs):
    out = {d: t.split("\n") for d, t in docs.items()}
    for d, a, b in test_lines.brute(list(docs.items())):
        out[d][a : b + 1] = [None] * (b + 1 - a)
    return {d: "\n".join(x for x in lines if x is not None) for d, lines in out.items()}


def plain_near(docs):
    ids = sorted(docs)
    groups = plain_groups(docs)
    return {d: docs[d] for d in ids if groups[d] == d}


def plain_groups(docs):
    """Components of all pairs that share two blocks and are close."""
    ids = sorted(docs)
    high, low, first, second = simhash.fingerprints(pa.array([docs[d] for d in ids]))
    blocks = np.stack([(h >> np.uint64(16 * k)) & np.uint64(0xFFFF) for h in (high, low) for k in range(4)], 1)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (blocks[a] == blocks[b]).sum() >= 2 and int(np.bitwise_count(first[a] ^ first[b])) + int(np.bitwise_count(second[a] ^ second[b])) <= simhash.MOST_BITS:
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def plain_suffix(docs):
    gone = {}
    for d, a, b, _ in test_suffix.brute(list(docs.items()), 50):
        gone.setdefault(d, []).append((a, b))
    out = dict(docs)
    for d, ranges in gone.items():
        words = [m.span() for m in re.finditer("[^ \t\n\x0b\f\r]+", docs[d])]
        keep = docs[d]
        for a, b in sorted(ranges, reverse=True):
            keep = keep[: words[a][0]] + (keep[words[b + 1][0] :] if b + 1 < len(words) else "")
        out[d] = keep
    return out


def solid(docs):
    return {d: t for d, t in docs.items() if re.search("[^ \t\n\x0b\f\r]", t)}


def plain_tokens(docs):
    """Words and tokens of each document, by the library's pre-tokenizer and a plain greedy match."""
    first, later = (set(x) for x in test_tokencount.tokencount.pieces_of_model(test_tokencount.MODEL))
    words = {d: [w.encode() for w, _ in BertPreTokenizer().pre_tokenize_str(t)] for d, t in docs.items()}
    return {d: (len(w), sum(test_tokencount.greedy(x, first, later) for x in w)) for d, w in words.items()}


def plain_pack(docs, by_words=False):
    sizes = {d: len(re.findall("[^ \t\n\x0b\f\r]+", t)) for d, t in docs.items()} if by_words else {d: n for d, (_, n) in plain_tokens(docs).items()}
    distinct = sorted({n for n in sizes.values() if n})
    uppers = packing.boundaries(distinct, [sum(n == x for n in sizes.values()) for x in distinct])
    seen, out = dict.fromkeys(uppers, 0), []
    for d in sorted(docs):
        upper = next((u for u in uppers if sizes[d] and u >= sizes[d]), None)
        out.append((d, sizes[d], upper, None if upper is None else seen[upper] // max(1, packing.BUDGET // upper)))
        if upper:
            seen[upper] += 1
    return out


def test_pipeline_as_plain_stages(spark, docs, tmp_path):
    now, table = docs, spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = table.columns
    plain = [lambda x: plain_quality(spark, x), lambda x: solid(plain_lines(x)), plain_near, lambda x: solid(plain_suffix(x))]
    for (name, stage), model in zip(corpus_pipeline.STAGES, plain):
        before, now = now, model(now)
        stage(spark, table, FOLDER).write.parquet(f"{tmp_path}/{name}")
        table = spark.read.parquet(f"{tmp_path}/{name}")
        rows = table.collect()
        assert table.columns == columns and {r["doc_id"]: r["text"] for r in rows} == now, name
        assert all(r["n_chars"] == len(r["text"]) for r in rows)
        assert now != before, f"{name} does nothing to these documents"
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == plain_pack(now)


def test_stages_without_rows(spark):
    empty = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0


def test_stages_with_nulls_and_extra_columns(spark):
    rows = [(1, "some plain text. " * 8, "en", "s", 1), (1, "some plain text. " * 8, "en", "s", 1), (None, None, None, None, None), (None, "other plain words. ", None, "s", 3), (4, "", "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS doc", "2 AS copy", "3 AS words", "4 AS bad", "5 AS runs")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        assert out.where("doc_id = 1").count() == 2, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == 5


def test_queries_over_whole_tables(spark, docs):
    run = {f.split("_")[0]: q for f, q in queries.queries().items()}
    rows = lambda n: sorted(map(tuple, run[n](spark, FOLDER).collect()), key=str)
    assert sorted(r[0] for r in rows("op1")) == sorted(docs)
    assert rows("op2") == test_suffix.brute(list(docs.items()), 50)
    assert rows("op3") == test_lines.brute(list(docs.items()))
    assert rows("op4") == sorted(((d, *n) for d, n in plain_tokens(docs).items()), key=str)
    kept = plain_quality(spark, docs)
    assert {r[0] for r in rows("op5") if not r[2]} == set(kept) and len(rows("op5")) == len(docs)
    groups = plain_groups(docs)
    sizes = {g: list(groups.values()).count(g) for g in groups.values()}
    assert rows("op6") == sorted(((d, g) for d, g in groups.items() if sizes[g] > 1), key=str)
    assert all(r[3] and r[4] for r in rows("op7")) and len(rows("op7")) == len(docs)
    assert sorted(rows("op8")) == plain_pack(docs) and sorted(rows("packing")) == plain_pack(docs, by_words=True)
    assert {r[0]: r[1] for r in rows("op9")} == {d: (x.hex() if (x := test_digest.plain(t)) else None) for d, t in docs.items()}
    assert {r[0]: r[1] for r in rows("op10")} == {d: len(t.encode()) for d, t in docs.items()} and np.isfinite([r[2] for r in rows("op10")]).all()


def test_no_sql_for_the_pipeline():
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" in queries.queries() and "pipeline" not in queries.oracle_sql()
