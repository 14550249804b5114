from collections import Counter

import numpy as np
import pyarrow as pa

from sequenza.llm import mixing
from sequenza.llm.common import text_buffer

FOLDER = "/root/testdata/sf0.01"


M32, M64 = 2**32 - 1, 2**64 - 1
ODDS = [0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F]


def letter(byte: int) -> bool:
    return byte >= 128 or chr(byte).isalpha() or byte == 95


def mixed(h: int, salt: int) -> int:
    h = (h + salt * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & M64
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & M64
    h = (h ^ h >> 27) * 0x94D049BB133111EB & M64
    return h ^ h >> 31


def plain_slots(text: bytes, k: int) -> list[tuple[int, int]]:
    """The slots of the two halves of byte k of a text, for each predictor, by loops."""
    one, two, three = (text[k - j] if k >= j else 0 for j in (1, 2, 3))
    start = k
    while start and letter(text[start - 1]):
        start -= 1
    total = sum((text[j] + 1) * pow(0x9E3779B97F4A7C15, j - start, 1 << 64) for j in range(start, k)) & M64
    word = (mixed(total, 1) ^ (k - start)) & M32
    before = text[max(start - 2, 0)] if start else 0
    hashes = [(one + 1) * ODDS[0], ((one | two << 8) + 7) * ODDS[1], ((one | two << 8 | three << 16) + 77) * ODDS[2], (word ^ (before * ODDS[3] & M32)) * ODDS[0]]
    out = []
    for h in hashes:
        h &= M32
        high = h ^ h >> 15
        low = (high + (text[k] >> 4) + 1) * ODDS[3] & M32
        low ^= low >> 13
        shift = 32 - mixing.LINE_BITS
        out.append((((high * ODDS[1] & M32) >> shift) * 16, ((low * ODDS[2] & M32) >> shift) * 16))
    return out


def plain_counts(texts: list[bytes]) -> Counter:
    counts = Counter()
    for text in texts:
        for k, byte in enumerate(text):
            for c, (high, low) in enumerate(plain_slots(text, k)):
                counts[c, high | byte >> 4] += 1
                counts[c, low | byte & 15] += 1
    return counts


def plain(counts: Counter, text: bytes) -> float:
    """The bits of one text by loops over its bits, each of which everything learns from at once."""
    cost, seen, run = 0.0, {}, 0
    for k, byte in enumerate(text):
        if k % mixing.SEGMENT == 0:
            weights = [list(mixing.START) for _ in range(8)]
            table = [[[1 / (1 + np.exp(-(c - mixing.CELLS // 2) * 16 / mixing.CELLS)) for c in range(mixing.CELLS)] for _ in range(8)] for _ in range(2)]
        gate = int(k > 0 and letter(text[k - 1]))
        expected = seen.get(text[k - mixing.MATCH : k]) if k >= mixing.MATCH else None
        slots = plain_slots(text, k)
        for bit in range(8):
            y, half = byte >> (7 - bit) & 1, bit // 4
            x = []
            for c in range(mixing.CONTEXTS):
                nibble, place = (byte >> 4, byte & 15)[half], bit % 4
                n = [0, 0]
                for v in range(16):
                    if v >> (4 - place) == nibble >> (4 - place):
                        n[v >> (3 - place) & 1] += counts[c, slots[c][half] | v]
                x.append(np.rint(np.clip(np.log((n[1] + 0.4) / (n[0] + 0.4)), -mixing.LIMIT, mixing.LIMIT) * mixing.SCALE) / mixing.SCALE)
            agree = expected is not None and expected >> (8 - bit) == byte >> (8 - bit)
            x.append((2 * (expected >> (7 - bit) & 1) - 1) * mixing.TRUST * (1 + min(run, mixing.TRUST)) / mixing.SCALE if agree else 0.0)
            w = weights[bit]
            t = min(max(sum(a * b for a, b in zip(w, x)), -8), 7.999)
            p = 1 / (1 + np.exp(-t))
            cell = int(t * mixing.CELLS / 16) + mixing.CELLS // 2
            final = min(max((p + table[gate][bit][cell]) / 2, mixing.LEAST), 1 - mixing.LEAST)
            cost -= np.log2(final if y else 1 - final)
            table[gate][bit][cell] += (y - table[gate][bit][cell]) * mixing.REFINE
            weights[bit] = [a + mixing.RATE * (y - p) * b for a, b in zip(w, x)]
        run = run + 1 if expected == byte else 0
        if k >= mixing.MATCH:
            seen[text[k - mixing.MATCH : k]] = byte
    return cost


TEXTS = ["The cat sat on the mat. The cat sat on the mat, and the hat sat on the cat. " * 3, "Zwölf Boxkämpfer, é! 123 Zwölf Boxkämpfer", "x", "", "aaaaaaaaaaaaaaaaaaaaaaaab"]


def test_as_loops(monkeypatch):
    monkeypatch.setattr(mixing, "SEGMENT", 100)
    corpus = ["the cat and the hat sat on a mat. " * 10, "Boxer und Kämpfer"]
    tables = np.zeros((mixing.CONTEXTS, mixing.SLOTS), np.uint32)
    mixing.count(tables, *text_buffer(pa.array(corpus)))
    counts = plain_counts([t.encode() for t in corpus])
    assert {(int(k), int(at)): int(tables[k, at]) for k, at in np.argwhere(tables)} == counts
    data, offsets = text_buffer(pa.array(TEXTS))
    got = mixing.score(mixing.logits(tables)[None], np.zeros(len(TEXTS), np.int64), data, offsets)
    assert np.allclose(got, [plain(counts, t.encode()) for t in TEXTS], rtol=1e-3)


def test_whole_query_as_loops(spark):
    """Each document by the counts of the other fold's documents, its own left out."""
    texts = [*TEXTS, TEXTS[0], "the cat and the hat", "und noch ein Boxkämpfer"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    folds = {r["doc_id"]: r["fold"] for r in docs.select("doc_id", mixing._fold(mixing.FOLDS).alias("fold")).collect()}
    got = {r["doc_id"]: r["bits"] for r in mixing.bits_per_byte(docs).collect()}
    assert len(set(folds.values())) == mixing.FOLDS
    for k, text in enumerate(texts):
        counts = plain_counts([t.encode() for j, t in enumerate(texts) if folds[j] != folds[k]])
        assert np.isclose(got[k], plain(counts, text.encode()), rtol=1e-3), k


def test_no_document_helps_itself(spark):
    draw = np.random.default_rng(3)
    words = " ".join("".join(draw.choice(list("abcdefghijklmnop"), 6)) for _ in range(400))
    one = mixing.bits_per_byte(spark.createDataFrame([(1, words)], "doc_id long, text string")).first()["bits_per_byte"]
    none = mixing.bits_per_byte(spark.createDataFrame([(1, words)], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")).first()["bits_per_byte"]
    assert one == none > 3.5


def test_probabilities_are_a_code():
    """Over all texts of one byte after a prefix, two to the power of minus the bits sums to 1."""
    tables = np.zeros((mixing.CONTEXTS, mixing.SLOTS), np.uint32)
    mixing.count(tables, *text_buffer(pa.array(["banana bandana " * 20])))
    data = np.concatenate([np.frombuffer(b"banana b" + bytes([k]), np.uint8) for k in range(256)])
    whole = mixing.score(mixing.logits(tables)[None], np.zeros(256, np.int64), data, np.arange(257) * 9)
    part = mixing.score(mixing.logits(tables)[None], np.zeros(1, np.int64), data[:8], np.array([0, 8]))
    assert np.isclose((2.0 ** (part[0] - whole)).sum(), 1, rtol=1e-4)


def test_counts_give_the_logits_of_bits():
    tables = np.zeros((1, 16), np.int64)
    tables[0, [0b0000, 0b0001, 0b1000]] = [5, 3, 9]
    got = mixing.logits(tables)[0, 0b0001]
    expected = [np.log((9 + 0.4) / (8 + 0.4)), np.log(0.4 / 8.4), np.log(0.4 / 8.4), np.log(3.4 / 5.4)]
    assert np.array_equal(got, np.rint(np.array(expected) * mixing.SCALE))


def test_held_out_text_is_predicted(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("lang = 'en'")
    rest = docs.where("doc_id % 5 = 1")
    mean = lambda df: df.agg({"bits": "sum", "n_bytes": "sum"}).selectExpr("`sum(bits)` / `sum(n_bytes)`").first()[0]
    learned = mean(mixing.bits_per_byte(rest, docs.where("doc_id % 5 <> 1")))
    assert learned < 3 < mean(mixing.bits_per_byte(rest, docs.limit(0)))
    backwards = rest.selectExpr("doc_id", "reverse(text) AS text")
    assert mean(mixing.bits_per_byte(backwards, docs)) > learned + 0.5


def test_edges(spark):
    rows = [(1, "aaaa"), (1, "aaaa"), (None, None), (None, "b"), (4, ""), (5, "long text " * 20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS bits", "2 AS N_BYTES", "3 AS part")
    got = mixing.bits_per_byte(docs).collect()
    assert len(got) == 6 and len({r["bits"] for r in got if r["doc_id"] == 1}) == 1
    assert sorted((r["n_bytes"], r["bits"]) for r in got if r["bits_per_byte"] is None) == [(0, 0.0), (0, 0.0)]
    assert next(r["bits_per_byte"] for r in got if r["doc_id"] == 5) < 0.5
    assert mixing.bits_per_byte(docs.limit(0)).count() == 0
