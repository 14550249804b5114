"""An inverted index over versions of pages, kept by additions and removals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sequenza.functions import positions, stem, text


def versions(pages: DataFrame, page: str, order: str, body: str) -> DataFrame:
    """(page, version, text): the version is the place of a row among its page's rows, from 1."""
    return pages.select(F.col(page).alias("page"), F.row_number().over(Window.partitionBy(page).orderBy(order)).alias("version"), F.col(body).alias("text"))


def word_positions(pages: DataFrame, stemmed: bool = False) -> DataFrame:
    """(page, version, word, positions): a row for each distinct token of a page version, or for each distinct stem, with its places from 0 in order."""
    tokens = text.index_tokens(F.col("text"))
    each = pages.select("page", "version", F.posexplode(stem.stems(tokens) if stemmed else tokens).alias("pos", "word"))
    return each.groupBy("page", "version", "word").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def packed(words: DataFrame) -> DataFrame:
    """words with their positions packed, range 0."""
    pack = lambda p: positions.pack(F.col("page"), p, F.col("version"), F.lit(0))
    return words.withColumn("packed", F.transform("positions", pack))


def diffs(words: DataFrame, keep_version: bool = True) -> DataFrame:
    """(word, page, version, op, start, range, positions): what each page version adds to the index, and what of the version before it goes.

    An `add` row holds the packed positions. A `remove` row comes for a word that an earlier version had: start is its packed
    first position with range 0, range its count. Words that a version lacks aren't removed. keep_version=False writes version 0 into
    removals after a word's first one, as an index that forgets versions on update does.
    """
    by_version = Window.partitionBy("page", "word").orderBy("version")
    seen = words.withColumns({"first": F.col("positions")[0], "n": F.size("positions")})
    seen = seen.withColumns({"old_first": F.lag("first").over(by_version), "old_n": F.lag("n").over(by_version), "old_version": F.lag("version").over(by_version), "place": F.row_number().over(by_version)})
    old = F.col("old_version") if keep_version else F.when(F.col("place") == 2, F.col("old_version")).otherwise(0)
    add = F.struct(F.lit("add").alias("op"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("int").alias("range"), F.transform("positions", lambda p: positions.pack(F.col("page"), p, F.col("version"), F.lit(0))).alias("positions"))
    remove = F.struct(F.lit("remove").alias("op"), positions.pack(F.col("page"), F.col("old_first"), old, F.lit(0)).alias("start"), F.col("old_n").alias("range"), F.lit(None).cast("array<long>").alias("positions"))
    rows = F.when(F.col("old_first").isNull(), F.array(add)).otherwise(F.array(remove, add))
    return seen.select("word", "page", "version", F.inline(rows))


def state(words: DataFrame) -> DataFrame:
    """(word, page, entry): the index after all versions, one packed entry (first position, count as range) for each word and page."""
    last = words.groupBy("word", "page").agg(F.max_by(F.struct(F.col("positions")[0].alias("first"), F.size("positions").alias("n"), "version"), "version").alias("s"))
    return last.select("word", "page", positions.pack(F.col("page"), F.col("s.first"), F.col("s.version"), F.col("s.n")).alias("entry"))
