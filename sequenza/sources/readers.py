"""Reading inputs: Parquet tables, page dumps in XML, news CSV, vocabularies, topics; in batch or as streams with a rate limit."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

NEWS = "url string, title string, text string, other string, label string"
PAGES = "_id long, _title string, _VALUE string, id long, title string, revision struct<text: string>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pages_xml(spark: SparkSession, path: str) -> DataFrame:
    """(page, version, title, text) of a page dump: an element `page` for each version, numbered from 1 by its place in the dump.

    Both kinds of dump are read: <page id="1" title="A">text</page>, and pages with elements id, title and revision/text.
    """
    rows = spark.read.format("xml").option("rowTag", "page").option("ignoreSurroundingSpaces", False).schema(PAGES).load(path)
    body = F.when(F.col("_id").isNotNull(), F.coalesce("_VALUE", F.lit(""))).otherwise(F.col("revision.text"))
    placed = rows.select(F.coalesce("_id", "id").alias("page"), F.coalesce("_title", "title").alias("title"), body.alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    # The ids rise within a block of a file, so this order is that of the dump however it is split.
    return placed.withColumn("version", F.row_number().over(Window.partitionBy("page").orderBy("file", "block", "place"))).select("page", "version", "title", "text")


def news_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """News documents; an empty label is null."""
    return spark.read.schema(NEWS).option("header", header).option("multiLine", True).option("escape", '"').csv(path)


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(word, idx) of a file of lines `word index`."""
    parts = F.split(F.col("value"), " ")
    return spark.read.text(path).select(parts[0].alias("word"), parts[1].cast("long").alias("idx"))


def topics(path: str) -> list[str]:
    """The class names of a file whose first line says how many there are."""
    with open(path, encoding="utf-8") as lines:
        count, *names = [x.strip() for x in lines if x.strip()]
    if int(count) != len(names):
        raise ValueError(f"{path} says {count} topics and names {len(names)}")
    return names


def stream(spark: SparkSession, path: str, schema: str | StructType | None = None, files_per_trigger: int | None = None, format: str = "parquet") -> DataFrame:
    """The files of a folder (or one file) as a replayable stream; files_per_trigger bounds what is in flight, None doesn't."""
    schema = schema or spark.read.format(format).load(path).schema
    reader = spark.readStream.format(format).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if path.startswith("/") and os.path.isfile(path):
        folder, name = os.path.split(path)
        return reader.option("pathGlobFilter", name).load(folder)
    return reader.load(path)


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines from a socket: without replay, so a restart loses what was on its way."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()
