import random

import numpy as np
import pyarrow as pa
import pytest

from sequenza.llm import tokencount

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def greedy(word: bytes, first: set, later: set) -> int:
    at, n = 0, 0
    while at < len(word):
        own = first if at == 0 else later
        end = next((e for e in range(len(word), at, -1) if word[at:e] in own), 0)
        if not end:
            return 1
        at, n = end, n + 1
    return n


def counted(first, later, texts):
    return tokencount.count_texts(tokencount.build(first, later), pa.array(texts))


@pytest.mark.parametrize("seed", range(5))
def test_random_vocabularies(seed):
    draw = random.Random(seed)
    piece = lambda: bytes(draw.choice(b"abc") for _ in range(draw.randrange(1, 6)))
    first, later = {piece() for _ in range(8)}, {piece() for _ in range(8)}
    words = ["".join(draw.choice("abcd" if draw.random() < 0.02 else "abc") for _ in range(draw.randrange(1, 14))) for _ in range(400)]
    _, got = counted(sorted(first), sorted(later), words)
    assert got.tolist() == [greedy(w.encode(), first, later) for w in words]


def test_as_the_tokenizers_library():
    from tokenizers import models

    first, later = tokencount.pieces_of_model(MODEL)
    vocabulary = {"[UNK]": 0} | {p: k + 1 for k, p in enumerate([*(x.decode() for x in first), *("##" + x.decode() for x in later)])}
    library = models.WordPiece(vocabulary, unk_token="[UNK]", max_input_chars_per_word=10**6)
    draw = random.Random(7)
    words = ["".join(draw.choice("etaoinshrédluü中語") for _ in range(draw.randrange(1, 15))) for _ in range(500)]
    assert counted(first, later, words)[1].tolist() == [len(library.tokenize(w)) for w in words]


def test_words_and_edges(spark):
    n_words, n_tokens = counted([b"a", b"!"], [b"a"], ["aa a! !!", "", "   ", None, "aba"])
    assert n_words.tolist() == [5, 0, 0, 0, 1] and n_tokens.tolist() == [6, 0, 0, 0, 1]
    docs = spark.createDataFrame([(1, "aa a"), (1, "aa a"), (None, None), (3, ""), (4, "a" * 300000)], "doc_id long, text string").selectExpr("*", "1 AS n_tokens", "2 AS N_WORDS")
    got = sorted(map(tuple, tokencount.token_counts(docs, [b"a"], [b"a"]).collect()), key=str)
    assert got == sorted([(1, 2, 3), (1, 2, 3), (None, 0, 0), (3, 0, 0), (4, 1, 300000)], key=str)
    assert tokencount.token_counts(docs.limit(0), [b"a"], []).count() == 0


def test_vocabulary_list(tmp_path):
    (tmp_path / "v").write_text("un\n##a\nable\n")
    assert tokencount.pieces_of_list(f"{tmp_path}/v") == ([b"un", b"able"], [b"a"])
    assert np.array_equal(counted(*tokencount.pieces_of_list(f"{tmp_path}/v"), ["una", "able", "aun"])[1], [2, 1, 1])


def test_words_as_the_tokenizers_library_parts_them():
    from tokenizers import pre_tokenizers

    library = pre_tokenizers.BertPreTokenizer()
    draw = random.Random(9)
    own = ["\u201chello\u201d", "a\u2014b \u2013 c", "hello\u00a0world", "snake_case a+b $5", "全角。句点、と", "\u2026\u00bfqué?", "x\u3000y\u2028z", "\U0001f600 smile\U00020000", "", " ", "é", "\u2019", "naïve\u2019s"]
    own += ["".join(draw.choice("ab é_.,!\u2019\u201d\u2014\u00a0中。\U0001f600\n") for _ in range(draw.randrange(40))) for _ in range(300)]
    data, offsets = tokencount.text_buffer(pa.array(own))
    starts, ends, counts = tokencount.words(data, offsets)
    got = [bytes(data[a:z]).decode() for a, z in zip(starts, ends)]
    expected = [[w for w, _ in library.pre_tokenize_str(t)] for t in own]
    assert got == [w for t in expected for w in t] and counts.tolist() == [len(t) for t in expected]
