import numpy as np
import pyarrow as pa

from sequenza.llm import language

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    table = docs.select("doc_id", "lang", "text").orderBy("doc_id").toArrow()
    half = table.num_rows // 2
    model = language.fit(table["text"][:half].combine_chunks(), table["lang"][:half].to_pylist())
    _, got, _ = language.predict(model, table["text"][half:].combine_chunks())
    assert np.mean([a == b for a, b in zip(got, table["lang"][half:].to_pylist())]) > 0.97


def test_family_of_each_language(spark):
    out = language.identify(spark.read.parquet(f"{FOLDER}/documents.parquet")).where("language IS NOT NULL").select("family", "language").distinct().collect()
    assert {(language.FAMILIES[r["language"]], r["language"]) for r in out} == {(r["family"], r["language"]) for r in out}


def test_unlisted_language_is_its_own_family():
    texts = pa.array(["aaaa aaa aa", "aaa aaaa", "zzzz zz", "zz zzz zzzz"])
    assert language.predict(language.fit(texts, ["q1", "q1", "q2", "q2"]), pa.array(["aa aaa", "zz zzz"]))[:2] == (["q1", "q2"], ["q1", "q2"])


def test_edges(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (2, "der Hund und die Katze", "de"), (None, "le chat et le chien", "fr"), (4, None, "es"), (5, "", None), (6, "x", None), (7, "the dog " * 20000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS family", "'y' AS at", "1 AS language")
    got = [(r["doc_id"], r["family"], r["language"]) for r in language.identify(docs).collect()]
    assert len(got) == 8 and got.count((2, "germanic", "de")) == 2 and (None, "romance", "fr") in got and (7, "germanic", "en") in got
    assert {(4, None, None), (5, None, None), (6, None, None)} <= set(got)
    assert language.identify(docs.limit(0)).count() == 0
    assert [r["language"] for r in language.identify(docs.withColumn("lang", docs["lang"].substr(9, 1)).replace("", None, "lang").limit(1)).collect()] == [None]


def plain_predict(model, text: str):
    """Family and language by loops over n-grams and duels."""
    data = text.lower().encode()
    if len(data) < 2:
        return None, None
    shift = 32 - language.SLOTS.bit_length() + 1
    slots = [((data[k] | data[k + 1] << 8) * 0x9E3779B1 & 0xFFFFFFFF) >> shift for k in range(len(data) - 1)]
    slots += [((data[k] | data[k + 1] << 8 | data[k + 2] << 16) * 0x85EBCA6B & 0xFFFFFFFF) >> shift for k in range(len(data) - 2)]

    def winner(duels):
        votes, total = [0.0] * len(duels.classes), [0.0] * len(duels.classes)
        for k, (a, b) in enumerate(duels.pairs):
            margin = sum(float(duels.weights[s, k]) for s in slots) / len(slots) + duels.bias[k]
            votes[a if margin > 0 else b] += 1
            total[a] += margin
            total[b] -= margin
        most = max(map(abs, total), default=0)
        return duels.classes[max(range(len(votes)), key=lambda c: votes[c] + 0.5 * np.tanh(total[c] / (1 + most)))]

    family = winner(model.families)
    return family, winner(model.languages[family])


def test_query_as_loops(spark):
    """The whole query over small tables: every document's n-grams, sums and duels by loops over the fitted classifiers."""
    from sequenza.llm import queries

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = language.train(docs)
    expected = {r["doc_id"]: plain_predict(model, r["text"]) for r in docs.select("doc_id", "text").collect()}
    got = {r["doc_id"]: (r["family"], r["language"]) for r in queries.op1_language_id(spark, folder).collect()}
    assert got.keys() == expected.keys() and got == expected
