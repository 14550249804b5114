"""Word counts, running and final, and the most frequent words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sequenza.functions import keys, text
from sequenza.operators import fold
from sequenza.operators.order import Order

#: Lines of one segment of a running count.
SEGMENT = 1 << 16


def words_of(lines: DataFrame, id_: str, line: str) -> DataFrame:
    """(id, pos, word): the parts of each line between white-space characters in order. Empty ones before and between others are words too, those at the end aren't."""
    return lines.select(F.col(id_), F.posexplode(text.split_words(F.col(line))).alias("pos", "word"))


def running(words: DataFrame, id_: str) -> DataFrame:
    """words with `count`: how often the word came so far, for every occurrence in the order of id and pos. id is an integer that tells lines apart."""
    return fold.running_count(words, ["word"], Order([id_], (), ["pos"]), "count", F.floor(F.col(id_) / SEGMENT))


def final(words: DataFrame) -> DataFrame:
    """(word, count)."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def top(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent words; ties go by word."""
    return counts.orderBy(F.desc("count"), "word").limit(k)


def bucketed_top(counts: DataFrame, k: int, bucket: Column, buckets: int = 2) -> DataFrame:
    """The same by two levels: the k of each bucket, then the k of those. bucket: an integer of the word."""
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("count"), "word"))
    partial = counts.withColumn("bucket", keys.bucketed(bucket, buckets)).withColumn("rank", rank).where(F.col("rank") <= k)
    return top(partial.select("word", "count"), k)


def merge_tops(a: Column, b: Column, k: int) -> Column:
    """Two maps from word to count as one: the larger count of each word, and the k largest of those, as an array of (word, count)."""
    merged = F.map_zip_with(a, b, lambda w, x, y: F.greatest(x, y))
    pairs = F.transform(F.map_entries(merged), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("word")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda e: F.struct(e["word"].alias("word"), (-e["n"]).alias("count")))
