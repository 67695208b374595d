"""Graph measures and traversals over the transfer graph."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundflow.functions.columns import cents, confidence_rank
from fundflow.operators.flow import projection_edges
from fundflow.operators.wallets import degrees
from fundflow.plans.components import components
from fundflow.plans.paths import reach, shortest_paths
from fundflow.plans.shared import dealt, discard, stored
from fundflow.shipping import ship

#: Links that the merging of communities looks at in one go.
LINKS_AT_ONCE = 2_000_000
#: Rows of two numbers that are few enough to broadcast.
FEW_ROWS = 500_000


def pagerank(transfers: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(address, score) after a fixed number of rounds. An address passes its
    score on by value; by number of edges if none of its edges has value; to
    everyone if it has no edge. Scores add up to 1.

    A round is one join on the sender and one sum by receiver, written down;
    edges and addresses are dealt by sender once and kept so, and only scores
    are shuffled. An address without edges has one to a node of no name, so what
    it passes to everyone comes out of the same sum; the driver gets that number.
    """
    edges = projection_edges(transfers)
    nodes = stored(transfers.select(F.explode(F.array("from_address", "to_address")).alias("address")).distinct(), "rank-nodes")
    out = edges.groupBy("from_address").agg(F.sum(cents(F.col("value_usd"))).cast("double").alias("v"), F.count("*").alias("k"))
    weight = F.when(F.col("v") > 0, F.greatest(F.col("value_usd"), F.lit(0.0)) / F.col("v")).otherwise(1 / F.col("k"))
    flow = stored(edges.join(out, "from_address").select("from_address", "to_address", weight.alias("w")).where("w > 0"), "rank-flow")
    n = nodes.count()
    if not n:
        return nodes.withColumn("score", F.lit(0.0))
    sinks = nodes.join(flow.select(F.col("from_address").alias("address")).distinct(), "address", "left_anti")
    nobody = ""
    steps = flow.unionByName(sinks.select(F.col("address").alias("from_address"), F.lit(nobody).alias("to_address"), F.lit(1.0).alias("w")))
    parts = int(transfers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps, nodes = steps.repartition(parts, "from_address").persist(), nodes.repartition(parts, "address").persist()
    ranks, given = nodes.withColumn("score", F.lit(1.0 / n)), None
    for _ in range(rounds):
        passed = ranks.join(steps, F.col("address") == F.col("from_address")).groupBy("to_address").agg(F.sum(F.col("score") * F.col("w")).alias("got"))
        before, given = given, stored(passed, "ranks")
        if before is not None:
            discard(before)
        loose = given.where(F.col("to_address") == nobody).first()
        score = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + (loose.got if loose else 0.0) / n)
        ranks = nodes.join(given, F.col("address") == F.col("to_address"), "left").select("address", score.alias("score"))
    out = stored(ranks, "ranks")
    steps.unpersist()
    nodes.unpersist()
    discard(flow, *[given] if given is not None else [])
    return out


def betweenness(transfers: DataFrame, pairs_per_batch: int = 200_000_000) -> DataFrame:
    """(address, score): share of shortest directed paths that run through it,
    unweighted, divided by (n - 1)(n - 2).

    All addresses that sent something are sources, in batches of so many that a
    batch reaches no more than ``pairs_per_batch`` (source, address) pairs; only
    what got something is ever reached. Sources that got nothing and sent to the
    same addresses search as one. A batch searches level by level, counting
    shortest ways, and adds up shares on the way back: joins on the address and
    sums by pair, each level a table. Beyond the first hop, both ways follow only
    edges whose sender got something, so the many who pay a hub aren't tried as
    steps between. Addresses are numbers meanwhile.
    """
    nodes = stored(transfers.select(F.explode(F.array("from_address", "to_address")).alias("address")).distinct().withColumn("id", F.monotonically_increasing_id()), "between-nodes")
    n = nodes.count()
    number = lambda c, i: nodes.select(F.col("address").alias(c), F.col("id").alias(i)).hint("merge")
    edges = transfers.where("from_address <> to_address").select("from_address", "to_address").distinct()
    edges = stored(edges.join(number("from_address", "a"), "from_address").join(number("to_address", "b"), "to_address").select("a", "b"), "between-edges")
    got = stored(edges.select(F.col("b").alias("a")).distinct(), "between-got")
    onward = stored(edges.join(got.hint("merge"), "a", "left_semi"), "between-onward")
    ends = onward.select("a").distinct().select(F.col("a").alias("source"), F.lit(1.0).alias("times"))
    starts = stored(ends.unionByName(_alike(edges.join(got.hint("merge"), "a", "left_anti"))), "between-starts")
    reached, found = 1 + got.count(), []
    batches, onward = -(-starts.count() * reached // pairs_per_batch), _sized(onward)
    for k in range(batches):
        sources = stored(starts.where(F.pmod(F.xxhash64("source"), F.lit(batches)) == k), "between-sources")
        found += _dependencies(edges, onward, sources, reached)
    scale = (n - 1) * (n - 2) if n > 2 else 1
    if not found:
        return nodes.select("address", F.lit(0.0).alias("score"))
    total = reduce(DataFrame.unionByName, found).groupBy("id").agg((F.sum("share") / scale).alias("score"))
    return nodes.join(total.hint("merge"), "id", "left").select("address", F.coalesce("score", F.lit(0.0)).alias("score"))


def _sized(df: DataFrame) -> DataFrame:
    """``df`` for a join: broadcast if it has few rows. The size of a file says
    little, as a number that repeats takes next to nothing there."""
    return df.hint("broadcast" if df.count() <= FEW_ROWS else "merge")


def _alike(edges: DataFrame) -> DataFrame:
    """(source, times): the least of the senders of one set of receivers, and
    how many there are. Sets are told apart by size and two sums of 64-bit hashes."""
    hashes = [F.sum(F.xxhash64("b", *[F.lit(x) for x in salt]).cast("decimal(38,0)")) for salt in ((), ("set",))]
    sets = edges.groupBy("a").agg(F.struct(F.count("*"), *hashes).alias("set"))
    return sets.groupBy("set").agg(F.min("a").alias("source"), F.count("*").cast("double").alias("times")).select("source", "times")


def _dependencies(edges: DataFrame, onward: DataFrame, sources: DataFrame, reached: int) -> list[DataFrame]:
    """Tables (id, share): what shortest paths from the sources(source, times)
    pass through it, each of which reaches so many at most."""
    pairs, times = sources.count() * reached, _sized(sources)
    keep = lambda df, name: stored(dealt(df, pairs, "source"), name)  # noqa: E731  a source's pairs meet in a task, where sums shrink them
    along = lambda rows, here, there, x: rows.join(onward.withColumnRenamed(here, "id"), "id").groupBy("source", F.col(there).alias("id")).agg(F.sum(x).alias(x))
    seen = stored(sources.select("source", F.col("source").alias("id")), "between-seen")
    first = edges.join(sources.select(F.col("source").alias("a")).hint("merge"), "a").select(F.col("a").alias("source"), F.col("b").alias("id"), F.lit(1.0).alias("ways"))
    levels, passed = [keep(first, "between-level")], []
    while not levels[-1].isEmpty():
        seen = seen.union(levels[-1].select("source", "id"))
        if len(levels) % 16 == 0:  # or the plan grows with the levels
            seen = stored(seen, "between-seen")
        # no anti join, which Spark would put before the sum, so that every step was shuffled
        ahead = along(levels[-1], "a", "b", "ways").join(seen.withColumn("old", F.lit(True)).hint("merge"), ["source", "id"], "left").where("old is null")
        levels.append(keep(ahead.drop("old"), "between-level"))
    discard(levels.pop())
    below = levels.pop() if levels else None
    share = None if below is None else below.withColumn("share", F.lit(0.0))
    while levels:
        here = levels.pop()
        back = along(share.select("source", "id", ((1 + F.col("share")) / F.col("ways")).alias("each")), "b", "a", "each")
        share = keep(here.join(back.hint("merge"), ["source", "id"], "left").select("source", "id", "ways", F.coalesce(F.col("each") * F.col("ways"), F.lit(0.0)).alias("share")), "between-share")
        passed.append(stored(share.where("share > 0").join(times, "source").groupBy("id").agg(F.sum(F.col("share") * F.col("times")).alias("share")), "between-passed"))
        discard(below, here)
        below = share
    discard(*[] if below is None else [below], sources)
    return passed


def centrality(transfers: DataFrame) -> DataFrame:
    """Per address: PageRank, betweenness and degrees side by side."""
    return pagerank(transfers).withColumnRenamed("score", "pagerank").join(betweenness(transfers).withColumnRenamed("score", "betweenness"), "address").join(degrees(transfers), "address", "left").fillna(0, ["in_degree", "out_degree", "degree"])


def _neighbours(links: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ``links`` of :func:`_louvain` as rows of arrays: where each row starts,
    neighbours in ascending order and their weights; and the nodes in the order
    in which links, sorted, first name them."""
    a, b, w = links
    links.clear()
    n, order = int(b.max()) + 1, np.lexsort((b, a))
    a, b, w = a[order], b[order], w[order]
    back, at = np.arange(len(a) - 1, -1, -1), np.full(n, 2 * len(a))
    at[b[::-1]] = 2 * back + 1
    first = np.full(n, 2 * len(a))
    first[a[::-1]] = 2 * back
    del order, back
    start = np.concatenate(([0], np.cumsum(np.bincount(a, minlength=n) + np.bincount(b, minlength=n))))
    order = np.lexsort((np.concatenate((b, a)), np.concatenate((a, b))))
    near = np.concatenate((b, a))[order]
    return start, near, w[order % len(a)], np.argsort(np.minimum(at, first))


def _merged(start: np.ndarray, near: np.ndarray, w: np.ndarray, order: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rows of :func:`_neighbours` between groups. Weights are added one by
    one in the order of rows, some millions of links at a time."""
    n = int(group.max()) + 1
    size = np.diff(start)[order]
    ends = np.cumsum(size)
    keys, sums, first = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
    i = 0
    while i < len(order):
        done = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, done + LINKS_AT_ONCE, "right")))
        rows, k = order[i:j], size[i:j]
        links = np.arange(k.sum()) + np.repeat(start[rows] - (np.cumsum(k) - k), k)
        found, seen, which = np.unique(np.repeat(group[rows], k) * n + group[near[links]], return_index=True, return_inverse=True)
        new = ~np.isin(found, keys, assume_unique=True)
        at = np.searchsorted(keys, found[new])
        keys, sums, first = np.insert(keys, at, found[new]), np.insert(sums, at, 0.0), np.insert(first, at, done + seen[new])
        np.add.at(sums, np.searchsorted(keys, found)[which], w[links])
        i = j
    by = np.lexsort((first, keys // n))
    of = keys[by] // n
    start = np.searchsorted(of, np.arange(n + 1))
    return start, keys[by] % n, sums[by], np.argsort(first[by][start[:-1]])


def _louvain(links: list[np.ndarray]) -> np.ndarray:
    """Each node's community by greedy modularity in a fixed order, named by its
    least member. ``links`` are arrays a, b and w (each link once, a < b) over
    nodes 0 to n - 1, all of them linked; the list is emptied."""
    rows = _neighbours(links)
    group = np.arange(len(rows[0]) - 1)
    while True:
        start, near, w, order = rows
        bounds = start.tolist()
        n = len(bounds) - 1
        degree = [sum(w[bounds[v] : bounds[v + 1]].tolist()) for v in range(n)]
        total = sum(degree[v] for v in order.tolist()) or 1.0
        of, inside = list(range(n)), list(degree)
        moved_once = False
        for _ in range(100):
            moved = False
            for v in range(n):
                shared: dict[int, float] = defaultdict(float)
                here, own = of[v], slice(bounds[v], bounds[v + 1])
                for u, x in zip(near[own].tolist(), w[own].tolist()):
                    if u != v:
                        shared[of[u]] += x
                inside[here] -= degree[v]
                best = max(sorted({*shared, here}), key=lambda c: (round(shared.get(c, 0.0) - inside[c] * degree[v] / total, 12), c == here))
                inside[best] += degree[v]
                if best != here:
                    of[v], moved, moved_once = best, True, True
            if not moved:
                break
        if not moved_once:
            break
        _, least, into = np.unique(np.array(of), return_index=True, return_inverse=True)
        into = np.argsort(np.argsort(least))[into]  # groups in the order of their least members
        rows, group = _merged(*rows, into), into[group]
    _, least = np.unique(group, return_index=True)
    return least[group]


def communities(transfers: DataFrame, wallets: DataFrame | None = None, min_size: int = 3) -> DataFrame:
    """community, members, size and average_risk (two digits), riskiest first.

    Communities never span connected components, so each component is one
    group: components are found by contraction, and a task refines one, which
    it gets as numbers in the order of names: some 80 bytes of it per edge.
    """
    ship(transfers.sparkSession)
    edges = stored(projection_edges(transfers).select(F.least("from_address", "to_address").alias("a"), F.greatest("from_address", "to_address").alias("b"), "value_usd").groupBy("a", "b").agg(F.sum(cents(F.col("value_usd"))).cast("double").alias("w")), "community-edges")
    roots = components(edges.select("a", "b"))
    parts = roots.where("node = root").select("root", F.monotonically_increasing_id().alias("component"))
    order = Window.partitionBy("component").orderBy("node")
    numbered = stored(roots.join(parts, "root").select("component", "node", (F.row_number().over(order) - 1).alias("i")), "community-nodes")
    first, second = (numbered.select("component", F.col("node").alias(c), F.col("i").alias(f"{c}_number")) for c in "ab")
    # few bytes a row, as a component's rows are sorted in one task
    both = F.shiftleft(F.col("a_number").cast("long"), 32) + F.col("b_number")
    inside = edges.join(first, "a").join(second.drop("component"), "b").select("component", both.alias("link"), F.when(F.col("w") > 0, F.col("w")).otherwise(1.0).alias("w"))

    def refine(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [((p.link.to_numpy() >> 32).astype(np.int32), (p.link.to_numpy() & 0xFFFFFFFF).astype(np.int32), p.w.to_numpy(copy=True)) for p in batches]
        links = [np.concatenate(c) for c in zip(*got)]
        got.clear()
        found = _louvain(links)
        yield pd.DataFrame({"component": key[0], "i": np.arange(len(found), dtype=np.int32), "c": found.astype(np.int32)})

    found = inside.groupBy("component").applyInPandas(refine, "component long, i int, c int")
    name = lambda number, c: numbered.select("component", F.col("i").alias(number), F.col("node").alias(c))
    members = found.join(name("i", "address"), ["component", "i"]).join(name("c", "community"), ["component", "c"]).select("address", "community")
    risk = members.sparkSession.createDataFrame([], "address string, risk_score double") if wallets is None else wallets.groupBy("address").agg(F.max("risk_score").alias("risk_score"))
    grouped = members.join(risk, "address", "left").groupBy("community").agg(F.sort_array(F.collect_list("address")).alias("members"), F.count("*").alias("size"), F.round(F.avg("risk_score"), 2).alias("average_risk"))
    return grouped.where(F.col("size") >= min_size).orderBy(F.desc_nulls_last("average_risk"), F.desc("size"), "community")


def neighborhood(transfers: DataFrame, starts: DataFrame, depth: int = 2, limit: int | None = None) -> DataFrame:
    """(address, hops) within reach in either direction."""
    found = reach(transfers, starts, depth, "both").groupBy("address").agg(F.min("hops").alias("hops"))
    return found if limit is None else found.orderBy("hops", "address").limit(limit)


def subgraph(transfers: DataFrame, starts: DataFrame, depth: int = 2) -> DataFrame:
    """The aggregated edges among all addresses within reach."""
    near = neighborhood(transfers, starts, depth).select("address")
    edges = projection_edges(transfers)
    return edges.join(near.withColumnRenamed("address", "from_address"), "from_address", "left_semi").join(near.withColumnRenamed("address", "to_address"), "to_address", "left_semi")


def paths_to_entities(transfers: DataFrame, starts: DataFrame, entities: DataFrame, max_hops: int = 4, kinds: tuple[str, ...] = (), least: str = "PROBABLE", direction: str = "both", top: int | None = None) -> DataFrame:
    """Shortest paths from each start to labelled services of these kinds and of
    at least this confidence: start, address, name, entity_type, confidence,
    hops, path; nearest first, the first ``top`` of each start if given."""
    wanted = entities.where(confidence_rank(F.col("confidence")) >= confidence_rank(F.lit(least)))
    if kinds:
        wanted = wanted.where(F.col("entity_type").isin(*kinds))
    ends = {} if top is None else {"wanted": wanted, "enough": top}
    paths = shortest_paths(transfers.where("from_address <> to_address"), starts, max_hops, direction, **ends).where("hops > 0")
    found = paths.join(wanted.select("address", "name", "entity_type", "confidence"), "address")
    if top is None:
        return found
    order = Window.partitionBy("start").orderBy("hops", "address", "name")
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= top).drop("_n")


def trace(transfers: DataFrame, start: str, max_hops: int = 3, min_value_usd: float = 0.0) -> DataFrame:
    """The edges that funds from ``start`` take, hop by hop: each edge leaves an
    address at the hop at which that was first reached."""
    moved = transfers.where(F.col("value_usd") >= min_value_usd)
    seen = reach(moved, transfers.sparkSession.createDataFrame([(start,)], "start string"), max_hops - 1)
    edges = projection_edges(moved)
    return edges.join(seen.select(F.col("address").alias("from_address"), (F.col("hops") + 1).alias("hop")), "from_address").select("hop", "from_address", "to_address", "tx_count", "value_usd")


def traced_paths(transfers: DataFrame, start: str, max_hops: int = 5, min_value_usd: float = 0.0) -> DataFrame:
    """The paths of :func:`trace`: path, length and value of the edges on it, one
    to everything in reach (the shortest, the one that sorts first)."""
    moved = transfers.where(F.col("value_usd") >= min_value_usd)
    paths = shortest_paths(moved.where("from_address <> to_address"), transfers.sparkSession.createDataFrame([(start,)], "start string"), max_hops).where("hops > 0")
    hops = paths.select("address", "path", "hops", F.posexplode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("i", "from_address"))
    steps = hops.withColumn("to_address", F.get("path", F.col("i") + 1)).join(projection_edges(moved), ["from_address", "to_address"])
    return steps.groupBy("address").agg(F.first("path").alias("path"), F.first("hops").alias("length"), F.sum(cents(F.col("value_usd"))).cast("double").alias("value_usd"))


def hop_levels(transfers: DataFrame, start: str, max_hops: int | None = None) -> DataFrame:
    """(address, hops, directed): levels along the transfers, and against them
    for what only a walk in either direction reaches."""
    starts = transfers.sparkSession.createDataFrame([(start,)], "start string")
    ahead = reach(transfers, starts, max_hops).select("address", "hops", F.lit(True).alias("directed"))
    either = reach(transfers, starts, max_hops, "both").select("address", "hops", F.lit(False).alias("directed"))
    return ahead.unionByName(either.join(ahead, "address", "left_anti"))


def node_projection(transfers: DataFrame, wallets: DataFrame) -> DataFrame:
    """Nodes per chain: address, label and risk_score of the wallet (null if
    none), tx_count of the transfers that touch it."""
    ends = transfers.select("chain", F.explode(F.array_distinct(F.array("from_address", "to_address"))).alias("address"))
    counts = ends.groupBy("chain", "address").agg(F.count("*").alias("n"))
    known = wallets.groupBy("chain", F.lower("address").alias("address")).agg(F.max("label").alias("label"), F.max("risk_score").alias("risk_score"))
    return known.join(counts, ["chain", "address"], "full").select("chain", "address", "label", "risk_score", F.coalesce("n", F.lit(0)).alias("tx_count"))


def busy_chains(transfers: DataFrame, min_hops: int = 3, least_sent: int = 10, min_value: float = 0.0, top: int = 20) -> DataFrame:
    """Directed simple paths of ``min_hops`` transfers' edges, each above a
    value, from wallets of many transfers; the most valuable first.

    A way on from a node shuns the senders that it visits itself, ``min_hops -
    1`` at most. So whoever pays a node less than ``top + min_hops - 1`` others
    begins no path of the first ``top``: these others begin better ones. Of
    what a node pays, the same holds for a path's last edge.
    """
    edges = projection_edges(transfers).where(F.col("value_usd") > min_value)
    busy = transfers.groupBy("from_address").count().where(F.col("count") > least_sent).select("from_address")
    enough = top + min_hops - 1
    rank = lambda here, there: F.row_number().over(Window.partitionBy(here).orderBy(F.desc("value_usd"), there))
    most = lambda df, here, there: df.withColumn("_n", rank(here, there)).where(F.col("_n") <= enough).drop("_n")
    edges = stored(edges, "chain-edges")
    walks = most(edges.join(busy, "from_address"), "to_address", "from_address").select(F.col("to_address").alias("node"), F.array("from_address", "to_address").alias("addresses"), "value_usd")
    named = lambda df: df.select(F.col("from_address").alias("node"), F.col("to_address").alias("to"), F.col("value_usd").alias("v"))
    steps = [named(edges)] * (min_hops - 2) + [named(most(edges, "from_address", "to_address"))] * (min_hops > 1)
    for step in steps:
        walks = walks.join(step, "node").where(~F.array_contains("addresses", F.col("to"))).select(F.col("to").alias("node"), F.concat("addresses", F.array("to")).alias("addresses"), (F.col("value_usd") + F.col("v")).alias("value_usd"))
    return walks.select("addresses", "value_usd").where(F.col("value_usd") > min_value * min_hops).orderBy(F.desc("value_usd"), "addresses").limit(top)
