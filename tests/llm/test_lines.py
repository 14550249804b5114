import random
import re
import time

import pyarrow as pa
import pytest

from sequenza.llm import lines

SCHEMA = "doc_id long, text string"


def brute(rows, least=3, least_words=8):
    """(doc, first, last) of runs of lines of which every window came earlier: the shortest from each line that has words or lines enough."""
    seen, out = set(), []
    for doc, text in sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0)):
        solid = [(n, x) for n, x in enumerate(text.split("\n")) if x.strip(" \t\n\x0b\f\r")]
        runs = []
        for k in range(len(solid)):
            z = next((z for z in range(k, len(solid)) if z - k + 1 == least or sum(len(re.findall("[^ \t\n\x0b\f\r]+", x)) for _, x in solid[k : z + 1]) >= least_words), None)
            if z is None:
                continue
            window = tuple(x for _, x in solid[k : z + 1])
            if window in seen:
                top, bottom = solid[k][0], solid[z][0]
                if runs and top <= runs[-1][1] + 1:
                    runs[-1][1] = max(bottom, runs[-1][1])
                else:
                    runs.append([top, bottom])
            seen.add(window)
        out += [(doc, a, b) for a, b in runs]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_as_brute_force(spark, seed):
    draw = random.Random(seed)
    rows = [(k, "\n".join(draw.choice(["aa", "b c", "", " ", "d", "one two three four five six", "a line that has words enough all by itself", f"own {k} {draw.randrange(3)}"]) for _ in range(draw.randrange(25)))) for k in range(40)]
    got = sorted((tuple(r) for r in lines.repeated_runs(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()), key=str)
    assert got == brute(rows) and got


def test_edges(spark):
    run = "one\ntwo\nthree\nfour"
    rows = [(1, run, 7), (1, run, 7), (2, f"start\n{run}\nend", 8), (None, None, 9), (None, f"x\n{run}", 1), (5, "", 2), (6, "one\ntwo", 3), (8, "\n".join(str(k) for k in range(50000)), 4)]
    docs = spark.createDataFrame(rows, SCHEMA + ", top int").selectExpr("top", "text", "doc_id", "top AS doc", "top AS copy", "top AS lines", "top AS mark")
    got = {(r["doc_id"], r["first_line"], r["last_line"]) for r in lines.repeated_runs(docs).collect()}
    assert got == {(1, 0, 3), (2, 1, 4)}
    cut = lines.drop_repeated_runs(docs)
    assert cut.columns == docs.columns and cut.count() == 8
    texts = {(r["doc_id"], r["top"]): r["text"] for r in cut.collect()}
    assert texts[1, 7] == "" and texts[2, 8] == "start\nend" and texts[None, 9] is None and texts[None, 1] == f"x\n{run}" and texts[5, 2] == "" and texts[8, 4] == rows[-1][1]
    assert lines.repeated_runs(docs.limit(0)).count() == 0 and lines.drop_repeated_runs(docs.limit(0)).count() == 0


def test_words_per_line_and_one_line_repeats(spark):
    line = "this line has exactly eight words in it"
    rows = [(1, f"{line}\nend"), (2, f"start\n{line}"), (3, "this line has exactly seven words here\nx"), (4, "this line has exactly seven words here\ny"), (5, line), (6, line)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, lines.repeated_runs(docs).collect())) == brute(rows) == [(2, 1, 1), (5, 0, 0), (6, 0, 0)]
    assert {r["doc_id"]: r["text"] for r in lines.drop_repeated_runs(docs, keep_emptied=False).collect()} == {1: rows[0][1], 2: "start", 3: rows[2][1], 4: rows[3][1]}


def test_rows_that_were_blank_stay(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "a")], SCHEMA)
    assert lines.drop_repeated_runs(docs, keep_emptied=False).count() == 4


def test_many_runs_in_one_document_take_linear_time():
    n = 100_000
    texts, tops = pa.array(["\n".join(f"line {k}" for k in range(2 * n)), None, "a\nb\nc"]), pa.array([list(range(0, 2 * n, 2)), [], [1, 2]], pa.list_(pa.int32()))
    began = time.perf_counter()
    got = lines._without(texts, tops, tops).to_pylist()
    assert time.perf_counter() - began < 5
    assert got[0] == "\n".join(f"line {k}" for k in range(1, 2 * n, 2)) and got[2] == "a"


def test_a_line_in_a_third_of_all_rows(spark):
    """A hot line costs its places and nothing more."""
    docs = spark.range(60_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'we use cookies to make this very site better' ELSE concat('own ', id) END AS text")
    assert lines.repeated_runs(docs).count() == 19_999
