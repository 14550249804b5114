"""Bounded breadth-first search, a frontier at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sequenza.functions.keys import placed
from sequenza.operators.lineage import cut


def bounded_bfs(requests: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(request, vertex, depth): the vertices within a request's path_length hops of its start, the start at depth 0, each at its least depth.

    requests: request, vertex, path_length; edges: source, target; hops: the longest path_length. A level joins only the vertices that the level before it found first. Lists of targets
    move whole to where their request is, and are taken apart there. A vertex's code is its depth and, below it, how little of a path is left: the least is the first and the longest.
    """
    lists = cut(edges.select("source", "target").distinct().groupBy("source").agg(F.collect_list("target").alias("targets")))
    code = lambda depth: F.lit(depth) * F.lit(1 << 32) + (F.lit((1 << 31) - 1) - F.col("path_length"))
    longest = F.lit((1 << 31) - 1) - F.col("code").bitwiseAND(F.lit((1 << 32) - 1))
    seen = requests.select("request", "vertex", code(0).alias("code")).groupBy("request", "vertex").agg(F.min("code").alias("code"))
    for depth in range(1, hops + 1):
        frontier = seen.where(F.shiftright("code", 32) == depth - 1).select("request", "vertex", longest.alias("path_length")).where(F.col("path_length") >= depth)
        if depth > 1 and frontier.isEmpty():
            break
        reached = frontier.join(lists, F.col("vertex") == F.col("source")).select("request", "targets", code(depth).alias("code"))
        both = placed(reached.unionByName(seen.select("request", F.array("vertex").alias("targets"), "code")), "request")
        seen = both.select("request", F.explode("targets").alias("vertex"), "code").groupBy("request", "vertex").agg(F.min("code").alias("code"))
        if depth < hops:
            seen = cut(seen)
    return seen.select("request", "vertex", F.shiftright("code", 32).cast("int").alias("depth"))


def with_markers(found: DataFrame, requests: DataFrame) -> DataFrame:
    """found with a last row for each request, of null vertex, that says its search has ended."""
    ends = requests.select("request", F.lit(None).cast("long").alias("vertex"), F.lit(None).cast("int").alias("depth")).distinct()
    return found.withColumn("is_marker", F.lit(False)).unionByName(ends.withColumn("is_marker", F.lit(True)))


def current_targets(requests: DataFrame, updates: DataFrame) -> DataFrame:
    """(request, vertex, targets) for requests (request, vertex, time): the list that the last update (source, time, tie, targets) at or before its time gave the vertex."""
    new = updates.select(F.col("source").alias("vertex"), "time", "tie", "targets", F.lit(None).cast("long").alias("request"))
    ask = requests.select("vertex", "time", F.lit(2**62).alias("tie"), F.lit(None).cast(dict(updates.dtypes)["targets"]).alias("targets"), "request")
    up_to = Window.partitionBy("vertex").orderBy("time", "tie", F.col("request").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = new.unionByName(ask).withColumn("targets", F.last("targets", ignorenulls=True).over(up_to))
    return both.where("request IS NOT NULL AND targets IS NOT NULL").select("request", "vertex", "targets")


def mutable_bfs(requests: DataFrame, updates: DataFrame, hops: int) -> DataFrame:
    """bounded_bfs for requests (request, vertex, path_length, time) over edges that updates replace: a request sees each vertex's list as of its own time."""
    frontier = requests.select("request", "vertex", F.lit(0).alias("depth"), "path_length", "time").distinct()
    seen = frontier
    for depth in range(1, hops + 1):
        asking = frontier.where(F.col("path_length") >= depth)
        lists = current_targets(asking, updates)
        found = asking.join(lists, ["request", "vertex"]).select("request", F.explode("targets").alias("vertex"), F.lit(depth).alias("depth"), "path_length", "time").distinct()
        frontier = cut(found.join(seen.select("request", "vertex"), ["request", "vertex"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.select("request", "vertex", "depth")
