import numpy as np
import pyarrow as pa
import pytest

from sequenza.llm import suffix

SCHEMA = "doc_id long, text string"


def brute(rows, least):
    """Word ranges of which every window occurred earlier, by doc_id (None first) and place; for texts that differ where doc_ids agree, not defined here."""
    seen, out = {}, []
    for doc, text in sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0)):
        words, gone, sources = text.split(), {}, {}
        for k in range(len(words) - least + 1):
            window = tuple(words[k : k + least])
            if window in seen:
                for j in range(k, k + least):
                    gone[j] = True
                sources[k] = seen[window]
            else:
                seen[window] = doc
        k = 0
        while k < len(words):
            if k in gone:
                z = k
                while z + 1 in gone:
                    z += 1
                own = [s for j, s in sources.items() if k <= j <= z]
                out.append((doc, k, z, None if None in own else min(own)))
                k = z
            k += 1
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus(seed, docs, letters):
    draw = np.random.default_rng(seed)
    passages = [" ".join(f"w{x}" for x in draw.integers(0, 1000, draw.integers(10, 40))) for _ in range(6)]
    rows = []
    for k in range(docs):
        parts = []
        for _ in range(draw.integers(0, 6)):
            parts.append(passages[draw.integers(6)] if draw.random() < 0.5 else " ".join(f"w{x}" for x in draw.integers(0, letters, draw.integers(1, 30))))
        rows.append((k, "\n ".join(parts)))
    return rows


@pytest.mark.parametrize("seed,letters", [(1, 1000), (2, 2)])
def test_as_brute_force(spark, seed, letters):
    rows = corpus(seed, 60, letters)
    got = rows_of(suffix.repeated_passages(spark.createDataFrame(rows, SCHEMA).repartition(3), 20, 9))
    assert got == brute(rows, 20) and got


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK", 200)
    rows = corpus(3, 50, 50)
    monkeypatch.setattr(suffix, "_find", lambda least, seed, block, f=suffix._find: f(least, seed, 200))
    assert rows_of(suffix.repeated_passages(spark.createDataFrame(rows, SCHEMA), 20, 9)) == brute(rows, 20)


def test_long_repeats_at_production_parameters(spark):
    draw = np.random.default_rng(5)
    words = lambda n: " ".join(f"v{x}" for x in draw.integers(0, 10**6, n))
    shared = words(51)
    rows = [(k, f"{words(70)} {shared} {words(30)}") for k in range(5)] + [(9, words(20000)), (10, words(49))]
    assert rows_of(suffix.repeated_passages(spark.createDataFrame(rows, SCHEMA))) == brute(rows, 50) == [(k, 70, 120, 0) for k in range(1, 5)]


def test_cover():
    assert {(a - b) % suffix.PERIOD for a in suffix.COVER for b in suffix.COVER} == set(range(suffix.PERIOD))


def test_nulls_repeats_and_clashing_columns(spark):
    long = " ".join(f"x{k}" for k in range(60))
    rows = [(1, long, "a"), (1, long, "a"), (2, "before " + long + " after", "b"), (None, None, None), (None, long, "c"), (5, "", "d"), (6, None, "e")]
    docs = spark.createDataFrame(rows, SCHEMA + ", doc string").selectExpr("doc", "text", "doc_id", "doc copy", "doc starts", "doc anchor", "doc words")
    assert rows_of(suffix.repeated_passages(docs)) == sorted([(1, 0, 59, None), (2, 1, 60, None)], key=str)
    cut = suffix.drop_repeated_passages(docs)
    assert cut.columns == docs.columns
    assert sorted(((r.doc_id, r.text, r.doc) for r in cut.collect()), key=str) == sorted([(1, "", "a"), (1, "", "a"), (2, "before after", "b"), (None, None, None), (None, long, "c"), (5, "", "d"), (6, None, "e")], key=str)
    assert suffix.drop_repeated_passages(docs.limit(0)).count() == 0


def test_words_that_agree_in_their_first_bits_are_told_apart(spark):
    """Two words whose hashes agree in 32 bits aren't equal, nor are windows with one of them in place of the other."""
    draw = np.random.default_rng(4)
    words = [f"v{x}" for x in draw.integers(0, 10**6, 81)]
    left, right = (" ".join([*words[:40], w, *words[41:]]) for w in ("q125426", "q167281"))
    assert rows_of(suffix.repeated_passages(spark.createDataFrame([(1, left), (2, right)], SCHEMA))) == []
    assert rows_of(suffix.repeated_passages(spark.createDataFrame([(1, left), (2, right), (3, left + " end")], SCHEMA))) == [(3, 0, 80, 1)]


def test_a_block_parts_windows_by_their_checks():
    """All words equal in the bits that are sorted: only the checks differ."""
    least, seed = 20, 9
    width = np.full(4, least)
    context, offset, first = suffix.sort_block(np.zeros(4, int), np.zeros(4 * least, np.uint16), np.full(4, 3), width, np.array([7, 8, 7, 8], np.uint64), least, seed)
    assert dict(zip(context.tolist(), first.tolist())) == {0: 0, 1: 1, 2: 0, 3: 1} and set(offset.tolist()) == {8}


@pytest.mark.parametrize("least,seed", [(100, 16), (70, 40), (30, 9)])
def test_other_lengths(spark, least, seed):
    draw = np.random.default_rng(least)
    shared = [f"s{x}" for x in draw.integers(0, 10**6, 130)]
    rows = []
    for k in range(30):
        own = list(shared)
        if k % 3:
            own[draw.integers(130)] = f"other{k}"
        rows.append((k, " ".join([f"a{k}_{j}" for j in range(draw.integers(0, 40))] + own)))
    assert rows_of(suffix.repeated_passages(spark.createDataFrame(rows, SCHEMA), least, seed)) == brute(rows, least)


def test_parameters_are_checked(spark):
    docs = spark.createDataFrame([(1, "a")], SCHEMA)
    for least, seed in ((50, 8), (16, 16)):
        with pytest.raises(ValueError):
            suffix.repeated_passages(docs, least, seed)


def test_a_hot_phrase_is_in_no_block(spark, monkeypatch):
    """Many documents that share one phrase, and passages around it: blocks stay within bounds and the result is that of brute force."""
    monkeypatch.setattr(suffix, "BLOCK", 320)
    draw = np.random.default_rng(7)
    phrase = " ".join(f"p{k}" for k in range(12))
    tails = [" ".join(f"t{x}" for x in draw.integers(0, 10**6, 15)) for _ in range(5)]
    rows = [(k, f"{' '.join(f'b{k}_{j}' for j in range(k % 7))} {phrase} {tails[k % 5] if k % 2 else f'own{k} ' * 12}") for k in range(400)]
    seen = []
    sort = suffix.sort_block
    monkeypatch.setattr(suffix, "sort_block", lambda *args: seen.append(len(args[3])) or sort(*args))
    docs = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(suffix.repeated_passages(docs, 20, 9)) == brute(rows, 20)
    contexts = [c for b in (docs.selectExpr("doc_id AS doc", "doc_id AS copy", "text", "array(0) AS places").toArrow().to_batches()) for c in suffix._contexts(20, 9)(iter([b])) ]
    assert sum(c.num_rows for c in contexts) == 400


def test_contexts_of_one_anchor_keep_within_the_block():
    """More contexts than a block takes go through in parts; what is held is bounded by the distinct ones of the bucket."""
    least, seed, block = 20, 9, 3200
    sizes, sort = [], suffix.sort_block

    def counted(bucket, words, *rest):
        sizes.append(len(bucket))
        return sort(bucket, words, *rest)

    draw = np.random.default_rng(1)
    kinds = draw.integers(0, 60, 100_000)
    width = 20
    table = draw.integers(0, 2**16, (60, width)).astype(np.uint16)
    batches = []
    for k in range(0, len(kinds), 4096):
        own = kinds[k : k + 4096]
        n = len(own)
        batches.append(pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int64)), pa.array(np.arange(k, k + n)), pa.array(np.zeros(n, np.int64)), pa.array(np.full(n, 3, np.int32)), pa.array(np.full(n, 3, np.int32)), pa.array([table[x].tobytes() for x in own]), pa.array([np.uint64(x).tobytes() for x in own])], ["anchor", "doc", "copy", "place", "lead", "words", "checks"]))
    suffix.sort_block = counted
    try:
        found = sum(b.num_rows for b in suffix._find(least, seed, block)(iter(batches)))
    finally:
        suffix.sort_block = sort
    assert found == 100_000 - 60 and max(sizes) <= 2 * block // 32 + 60


def test_copies_repeat_from_end_to_end(spark):
    draw = np.random.default_rng(9)
    words = lambda n: " ".join(f"c{x}" for x in draw.integers(0, 10**6, n))
    one, two, short = words(80), words(200), words(30)
    rows = [(5, f"{one} {words(3)}"), (6, two), (7, f"{one} z"), (8, two), (9, f"{one} z"), (10, short), (11, short), (12, f"{two} {two}"), (13, f"{two} {two}"), (None, two)]
    assert rows_of(suffix.repeated_passages(spark.createDataFrame(rows, SCHEMA))) == brute(rows, 50)
