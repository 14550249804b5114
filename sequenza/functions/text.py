"""Splitting text into words and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "[ \\t\\n\\x0B\\f\\r]"
TOKEN = "[\\p{L}\\p{N}_]{2,}"


def split_words(line: Column) -> Column:
    """The parts between white-space characters: empty ones at the start or inside stay, those at the end go. An empty line is one empty part, a line of spaces none."""
    cut = F.rtrim(line, F.lit(" \t\n\x0b\f\r"))
    return F.when((cut == "") & (line != ""), F.array().cast("array<string>")).otherwise(F.split(cut, SPACE))


def tokens(text: Column) -> Column:
    """Runs of two or more letters, digits and underscores of any script, case kept."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def index_tokens(text: Column) -> Column:
    """Tokens for an index: lower case."""
    return tokens(F.lower(text))
