"""Breadth-first searches and cheapest paths over an edge table."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundflow.plans.shared import discard, stored


def reach(edges: DataFrame, starts: DataFrame, max_hops: int | None, direction: str = "out") -> DataFrame:
    """(start, address, hops): everything within ``max_hops`` of each start, or
    everything that can be reached.

    ``edges(from_address, to_address)``, ``starts(start)``; ``direction`` is
    out, in or both. One join per hop; what was reached before is dropped by an
    anti join, and every frontier is written to the shared folder.
    """
    one = edges.select(F.col("from_address").alias("a"), F.col("to_address").alias("b"))
    two = one.select(F.col("b").alias("a"), F.col("a").alias("b"))
    step = stored({"out": one, "in": two, "both": one.union(two)}[direction].distinct(), "steps")
    seen = stored(starts.select("start", F.col("start").alias("address"), F.lit(0).alias("hops")).distinct(), "reach")
    front = seen
    for hop in count(1) if max_hops is None else range(1, max_hops + 1):
        found = front.join(step, F.col("address") == F.col("a")).select("start", F.col("b").alias("address")).distinct()
        front = stored(found.join(seen, ["start", "address"], "left_anti").withColumn("hops", F.lit(hop)), "reach")
        if front.isEmpty():
            break
        seen = seen.union(front)
        if hop % 16 == 0:  # or the plan grows with the hops
            seen = stored(seen, "reach")
    return seen


def between(edges: DataFrame, source: str, sink: str) -> DataFrame:
    """The edges that lie on some walk from source to sink."""
    spark = edges.sparkSession
    edges = stored(edges, "edges")
    ahead = reach(edges, spark.createDataFrame([(source,)], "start string"), None).select(F.col("address").alias("from_address"))
    back = reach(edges, spark.createDataFrame([(sink,)], "start string"), None, "in").select(F.col("address").alias("to_address"))
    return edges.join(ahead, "from_address").join(back, "to_address").select(edges.columns)


def shortest_paths(edges: DataFrame, starts: DataFrame, max_hops: int, direction: str = "out", wanted: DataFrame | None = None, enough: int = 1) -> DataFrame:
    """(start, address, hops, path): one shortest path to everything in reach,
    the one whose addresses sort first. With ``wanted(address)``, a start that
    has met ``enough`` of its rows is searched no further than that hop: what is
    farther comes after them."""
    one = edges.select(F.col("from_address").alias("a"), F.col("to_address").alias("b"))
    two = one.select(F.col("b").alias("a"), F.col("a").alias("b"))
    step = stored({"out": one, "in": two, "both": one.union(two)}[direction].distinct(), "steps")
    seen = stored(starts.select("start", F.col("start").alias("address"), F.lit(0).alias("hops"), F.array("start").alias("path")).distinct(), "paths")
    front = seen
    for hop in range(1, max_hops + 1):
        found = front.join(step, F.col("address") == F.col("a")).groupBy("start", F.col("b").alias("address")).agg(F.min("path").alias("before"))
        fresh = found.join(seen.select("start", "address"), ["start", "address"], "left_anti")
        front = stored(fresh.select("start", "address", F.lit(hop).alias("hops"), F.concat("before", F.array("address")).alias("path")), "paths")
        if front.isEmpty():
            break
        seen = seen.union(front)
        if wanted is not None and hop < max_hops:
            done = seen.where("hops > 0").join(wanted.select("address"), "address").groupBy("start").count().where(F.col("count") >= enough)
            front = stored(front.join(done.select("start"), "start", "left_anti"), "paths")
    return seen


def nearest(edges: DataFrame, starts: DataFrame, max_hops: int, direction: str = "out") -> DataFrame:
    """(address, hops): how far each address is from the nearest of the starts
    other than itself, within ``max_hops``.

    Every address keeps two starts at most, of those nearest to it: who is third
    there is so for all who are reached through it, so a round passes two rows
    along an edge, however many starts there are.
    """
    one = edges.select(F.col("from_address").alias("a"), F.col("to_address").alias("b"))
    two = one.select(F.col("b").alias("a"), F.col("a").alias("b"))
    step = stored({"out": one, "in": two, "both": one.union(two)}[direction].distinct(), "steps")
    made = [stored(starts.select("start", F.col("start").alias("address"), F.lit(0).alias("hops")).distinct(), "nearest")]
    seen = made[0]
    for hop in range(1, max_hops + 1):
        own = seen.groupBy("address").agg(F.collect_list("start").alias("own"))  # two at most
        ends = F.struct(F.min("start").alias("first"), F.max("start").alias("last"))
        found = made[-1].join(step, F.col("address") == F.col("a")).select("start", F.col("b").alias("address"))
        found = found.join(own, "address", "left").where("own is null or (size(own) < 2 and not array_contains(own, start))")
        fresh = found.groupBy("address").agg(ends.alias("ends"), F.first("own").alias("own")).select("address", F.explode(F.slice(F.array_distinct(F.array("ends.first", "ends.last")), F.lit(1), 2 - F.coalesce(F.size("own"), F.lit(0)))).alias("start"))
        made.append(stored(fresh.select("start", "address", F.lit(hop).alias("hops")), "nearest"))
        if made[-1].isEmpty():
            break
        seen = seen.union(made[-1])
        if hop % 16 == 0:  # or the plan grows with the hops
            seen = stored(seen, "nearest")
    discard(step)
    return seen.where("hops > 0").groupBy("address").agg(F.min("hops").alias("hops"))


def cheapest(edges: DataFrame, source: str, target: str) -> DataFrame:
    """The cheapest path (path, hops, cost, total_usd, bottleneck_usd) by weight.

    Rounds of relaxation, until nothing gets cheaper: labels that did are
    extended by one edge; a label that costs more than the target's is dropped.
    """
    spark = edges.sparkSession
    first = spark.createDataFrame([(source, 0.0, [source], 0.0, float("inf"))], "address string, cost double, path array<string>, total_usd double, bottleneck_usd double")
    best, edges = stored(first, "cheapest"), stored(edges, "edges")
    front = best
    while not front.isEmpty():
        label = F.struct("cost", "path", "total_usd", "bottleneck_usd")
        grown = front.join(edges, F.col("address") == F.col("from_address")).where(~F.array_contains("path", F.col("to_address"))).select(
            F.col("to_address").alias("address"), (F.col("cost") + F.col("weight")).alias("cost"), F.concat("path", F.array("to_address")).alias("path"),
            (F.col("total_usd") + F.col("capacity_usd")).alias("total_usd"), F.least("bottleneck_usd", "capacity_usd").alias("bottleneck_usd"),
        )
        grown = grown.groupBy("address").agg(F.min(label).alias("l")).select("address", "l.*")
        old = best.select("address", F.col("cost").alias("old"), F.col("path").alias("old_path"))
        bound = best.where(F.col("address") == target).agg(F.min("cost").alias("bound"))
        better = grown.join(old, "address", "left").join(F.broadcast(bound)).where("old is null or cost < old or (cost = old and path < old_path)").where("bound is null or cost <= bound")
        front = stored(better.select(best.columns), "cheapest")
        best = stored(best.join(front.select("address"), "address", "left_anti").select(front.columns).union(front), "cheapest")
    return best.where(F.col("address") == target).select("path", (F.size("path") - 1).alias("hops"), "cost", "total_usd", "bottleneck_usd")
