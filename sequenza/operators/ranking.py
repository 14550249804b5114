"""BM25 ranking of documents over their latest versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequenza.functions import text
from sequenza.functions.keys import placed

K1, B = 2.0, 0.75


def latest(docs: DataFrame) -> DataFrame:
    """The newest version of each page."""
    return docs.groupBy("page").agg(F.max_by("text", "version").alias("text"), F.max("version").alias("version"))


def postings(docs: DataFrame, words: list[str] | None = None) -> DataFrame:
    """(page, length, word, tf) for docs (page, text): how often each token comes in a document of `length` tokens; a document without tokens has one row of null word.

    words: a query, whose words alone are listed then; a document without any of them has the row of null word.
    """
    tokens = placed(docs.select("page", "text"), "page").select("page", text.index_tokens(F.col("text")).alias("tokens"))
    listed = F.col("tokens") if words is None else F.filter("tokens", lambda x: x.isin(words))
    sized = tokens.select("page", F.coalesce(F.size("tokens"), F.lit(0)).alias("length"), listed.alias("tokens"))  # before the explode, else it is made anew for each token
    return sized.select("page", "length", F.explode_outer("tokens").alias("word")).groupBy("page", "length", "word").agg(F.count("word").alias("tf"))


def bm25(postings: DataFrame, terms: DataFrame, all_docs: bool = True, k1: float = K1, b: float = B) -> DataFrame:
    """(page, score) for postings (page, length, word, tf) and terms (word), best first by score and then by page.

    A term's frequency is its share of the document's tokens; terms in more than half of the documents count nothing. Documents without
    a term have score 0, and are left out if all_docs is false. terms: a query, broadcast only as Spark's own size limit allows.
    Cut the postings first where they are used more than once, so that texts are read once.
    """
    sizes = postings.select("page", "length").distinct()
    totals = sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))
    hits = postings.join(terms.select("word").distinct(), "word", "left_semi")
    spread = hits.groupBy("word").agg(F.count(F.lit(1)).alias("df")).crossJoin(totals)  # one row of totals
    ratio = (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)
    weights = spread.withColumn("idf", F.log10(ratio)).where("idf >= 0").select("word", "idf", "mean")
    share = F.col("tf") / F.col("length")
    each = F.col("idf") * share * (k1 + 1) / (share + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    scores = hits.join(weights, "word").groupBy("page").agg(F.sum(each).alias("score"))
    if all_docs:
        scores = sizes.select("page").join(scores, "page", "left").select("page", F.coalesce("score", F.lit(0.0)).alias("score"))
    return scores.orderBy(F.desc("score"), "page")


def same_score(a, b, epsilon: float = 1e-9):
    """Whether two score columns agree."""
    return F.abs(a - b) < epsilon
