import random

import numpy as np
import pytest
import sentencepiece

from sequenza.llm import sentencepieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def test_as_library_and_back():
    v, library = sentencepieces.load(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    draw = random.Random(1)
    texts = ["", " ", "   ", "a  b", "  lead", "trail  ", "\n\t x", "日本語 text", "a\x00b", "😀 ok", "x" * 3000, "lorem" * 200 + " " * 50 + "q", "e" * 65, "1234567890" * 9]
    texts += ["".join(draw.choice("eta oinshr  é中\n.,😀Z9") for _ in range(draw.randrange(200))) for _ in range(300)]
    ids, offsets = sentencepieces.encode(v, texts)
    got = [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
    assert got == library.encode(texts)
    assert sentencepieces.decode(v, ids, offsets) == texts == library.decode(got)
    assert any(np.diff(offsets) > 500)


def test_edges(spark):
    rows = [(1, "hello there"), (1, "hello there"), (None, None), (None, "x"), (4, ""), (5, "▁mark"), (6, "word " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS pieces", "2 AS N_PIECES")
    got = sentencepieces.encoded(docs, MODEL).collect()
    assert len(got) == 7 and sum(r["doc_id"] == 1 for r in got) == 2
    by = {(r["doc_id"], r["n_pieces"] is None): r for r in got}
    assert by[None, True]["pieces"] is None and by[None, True]["round_trip"] is None and by[4, False]["pieces"] == []
    assert not by[5, False]["round_trip"] and by[5, False]["as_library"]
    assert all(r["as_library"] and (r["round_trip"] or r["doc_id"] == 5) for r in got if r["pieces"] is not None)
    assert sentencepieces.encoded(docs.limit(0), MODEL).count() == 0


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    for change in ("add_dummy_prefix", "model_type"):
        proto = sentencepiece_model_pb2.ModelProto()
        with open(MODEL, "rb") as file:
            proto.ParseFromString(file.read())
        if change == "model_type":
            proto.trainer_spec.model_type = proto.trainer_spec.UNIGRAM
        else:
            proto.normalizer_spec.add_dummy_prefix = False
        (tmp_path / "m.model").write_bytes(proto.SerializeToString())
        with pytest.raises(ValueError):
            sentencepieces.load(f"{tmp_path}/m.model")
