"""Flow graph: aggregated edges, temporal buckets, weighted paths, max flow."""

from __future__ import annotations

import heapq
from collections import defaultdict, deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundflow.functions.columns import positive, total, value_weight
from fundflow.plans.max_flow import decomposed, least_cut, preflow
from fundflow.plans.paths import between
from fundflow.plans.shared import stored
from fundflow.shipping import ship

#: Paths into which a flow is decomposed by default (the report's length).
MOST_PATHS = 5
EPSILON = 1e-9
#: Edges between source and sink that one task is given (some 200 bytes each).
TASK_EDGES = 500_000


def movements(transfers: DataFrame) -> DataFrame:
    """Transfers that move value: finite, above zero, not to oneself."""
    return transfers.where(positive(F.col("value_usd")) & (F.col("from_address") != F.col("to_address")))


def flow_edges(transfers: DataFrame, hashes: bool = True) -> DataFrame:
    """One edge per (from, to): capacity_usd, weight, tx_count, first_seen,
    last_seen and the hashes in order of time."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("timestamp", "tx_hash"))), lambda x: x["tx_hash"]).alias("tx_hashes")
    edges = movements(transfers).groupBy("from_address", "to_address").agg(
        total(F.col("value_usd")).alias("capacity_usd"), F.count("*").alias("tx_count"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), *[listed] * hashes
    )
    return edges.withColumn("weight", value_weight(F.col("capacity_usd")))


def projection_edges(transfers: DataFrame) -> DataFrame:
    """Graph edges with counts and summed values; unpriced transfers count 0."""
    return (
        transfers.where("from_address <> to_address").groupBy("from_address", "to_address")
        .agg(F.count("*").alias("tx_count"), F.coalesce(total(F.coalesce("value_usd", F.lit(0.0))), F.lit(0.0)).alias("value_usd"))
    )


def temporal_flow(transfers: DataFrame, unit: str = "day", address: str | None = None, start=None, end=None, samples: int = 5) -> DataFrame:
    """Outgoing counts and values per address and hour, day or ISO week, with
    the first few hashes of each bucket; the range includes both ends."""
    rows = transfers
    if address is not None:
        rows = rows.where(F.col("from_address") == address)
    if start is not None:
        rows = rows.where(F.col("timestamp") >= F.lit(start))
    if end is not None:
        rows = rows.where(F.col("timestamp") <= F.lit(end))
    rows = rows.withColumn("bucket", F.date_trunc(unit, "timestamp"))
    counts = rows.groupBy("bucket", "from_address").agg(F.count("*").alias("tx_count"), total(F.coalesce("value_usd", F.lit(0.0))).alias("value_usd"))
    if samples < 1:
        return counts.withColumn("sample_hashes", F.expr("cast(array() as array<string>)"))
    return counts.join(first_hashes(rows, ["bucket", "from_address"], samples).withColumnRenamed("hashes", "sample_hashes"), ["bucket", "from_address"])


def first_hashes(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Per group, ``hashes`` of its first transfers; no more than ``most`` of a
    group leave a task."""
    order = Window.partitionBy(*keys).orderBy("timestamp", "tx_hash")
    few = rows.select(*keys, "timestamp", "tx_hash").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    return few.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "tx_hash"))), lambda x: x["tx_hash"]).alias("hashes"))


def timeline(transfers: DataFrame, unit: str = "day") -> DataFrame:
    """One row: buckets, transactions, value, the busiest bucket (the first of
    equals) and its count."""
    buckets = transfers.groupBy(F.date_trunc(unit, "timestamp").alias("bucket")).agg(F.count("*").alias("n"), total(F.coalesce("value_usd", F.lit(0.0))).alias("v"))
    peak = F.max(F.struct("n", (-F.unix_micros("bucket")).alias("at")))
    return buckets.agg(
        F.count("*").alias("active_buckets"), F.coalesce(F.sum("n"), F.lit(0)).alias("tx_count"), F.sum(F.col("v").cast("decimal(38,2)")).cast("double").alias("value_usd"),
        F.timestamp_micros(-peak["at"]).alias("peak_bucket"), peak["n"].alias("peak_count"),
    )


def weighted_path(transfers: DataFrame, source: str, target: str, max_hops: int = 10) -> DataFrame:
    """The cheapest path by :func:`value_weight`: no row if there is none, if it
    has more than ``max_hops`` hops, or if both ends are one.

    Distances are relaxed over the edge table, a round per hop, until nothing
    gets cheaper; ties go to the path whose addresses sort first.
    """
    from fundflow.plans.paths import cheapest

    edges = flow_edges(transfers, hashes=False)
    found = cheapest(edges.select("from_address", "to_address", "weight", "capacity_usd"), source, target)
    return found.where((F.col("hops") <= max_hops) & (F.lit(source) != F.lit(target)))


def _max_flow(capacity: dict[tuple[str, str], float], source: str, sink: str) -> tuple[float, dict, set]:
    """(flow value, flow per edge, nodes on the source's side): shortest
    augmenting paths in levels, with blocking flows."""
    nxt: dict[str, dict[str, float]] = defaultdict(dict)
    for (a, b), c in sorted(capacity.items()):
        nxt[a][b] = nxt[a].get(b, 0.0) + c
        nxt[b].setdefault(a, 0.0)
    value = 0.0
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for b, c in nxt[a].items():
                if c > EPSILON and b not in level:
                    level[b] = level[a] + 1
                    queue.append(b)
        if sink not in level:
            break
        order, at, path = {a: list(nxt[a]) for a in level}, dict.fromkeys(level, 0), [source]
        while path:
            a = path[-1]
            if a == sink:
                hops = list(zip(path, path[1:]))
                step = min(nxt[x][y] for x, y in hops)
                value += step
                for x, y in hops:
                    nxt[x][y] -= step
                    nxt[y][x] += step
                full = next(i for i, (x, y) in enumerate(hops) if nxt[x][y] <= EPSILON)
                path = path[: full + 1]
                continue
            while at[a] < len(order[a]) and not (nxt[a][b := order[a][at[a]]] > EPSILON and level.get(b) == level[a] + 1):
                at[a] += 1
            if at[a] < len(order[a]):
                path.append(order[a][at[a]])
            else:
                path.pop()
                if path:
                    at[path[-1]] += 1
    flow = {(a, b): c - nxt[a][b] for (a, b), c in capacity.items() if c - nxt[a][b] > EPSILON}
    return value, flow, set(level)


def _widest(flow: dict[tuple[str, str], float], source: str, sink: str) -> list[str] | None:
    out: dict[str, list[str]] = defaultdict(list)
    for (a, b), f in sorted(flow.items()):
        if f > EPSILON:
            out[a].append(b)
    best, heap, done = {source: float("inf")}, [(-float("inf"), source, [source])], set()
    while heap:
        width, a, path = heapq.heappop(heap)
        if a == sink:
            return path
        if a in done:
            continue
        done.add(a)
        for b in out[a]:
            w = min(-width, flow[a, b])
            if w > best.get(b, 0.0):
                best[b] = w
                heapq.heappush(heap, (-w, b, [*path, b]))
    return None


def max_flow(transfers: DataFrame, source: str, sink: str, most_paths: int | None = MOST_PATHS) -> DataFrame:
    """One row: max_flow_usd, cut (edges whose freeze stops it, sorted),
    bottleneck_usd (least capacity on the cut) and up to ``most_paths`` paths
    (None: all), widest first. Zero and empty arrays if nothing gets through.

    Only edges that the source reaches and that lead to the sink, over any
    number of hops, can carry flow between them. Up to :data:`TASK_EDGES` of
    those are handed to one task; more are pushed through in rounds over the
    edge table (:mod:`fundflow.plans.max_flow`). Where several cuts are least,
    one task gives the one nearest to the source, rounds that nearest to the sink.
    """
    kind = "max_flow_usd double, bottleneck_usd double, cut array<struct<from_address: string, to_address: string, capacity_usd: double>>, paths array<struct<path: array<string>, value_usd: double>>"
    edges = stored(between(flow_edges(transfers, hashes=False).select("from_address", "to_address", "capacity_usd"), source, sink), "flow-edges")
    if source != sink and edges.count() > TASK_EDGES:
        residual, value = preflow(edges, source, sink)
        paths = decomposed(edges, residual, source, sink, most_paths)
        cut = least_cut(edges, residual, sink).agg(F.coalesce(F.min("capacity_usd"), F.lit(0.0)).alias("bottleneck_usd"), F.sort_array(F.collect_list(F.struct("from_address", "to_address", "capacity_usd"))).alias("cut"))
        ways = edges.sparkSession.createDataFrame([([{"path": p, "value_usd": w} for p, w in paths],)], "paths array<struct<path: array<string>, value_usd: double>>")
        return cut.join(F.broadcast(ways)).select(F.lit(value).alias("max_flow_usd"), "bottleneck_usd", "cut", "paths")

    def solve(pdf):
        import pandas as pd

        capacity = {(r.from_address, r.to_address): r.capacity_usd for r in pdf.itertuples() if r.from_address is not None}
        value, flow, near = (0.0, {}, set()) if source == sink or not capacity else _max_flow(capacity, source, sink)
        if value <= EPSILON:
            return pd.DataFrame([(0.0, 0.0, [], [])], columns=["max_flow_usd", "bottleneck_usd", "cut", "paths"])
        cut = sorted((a, b, c) for (a, b), c in capacity.items() if a in near and b not in near)
        net = {(a, b): f - flow.get((b, a), 0.0) for (a, b), f in flow.items()}
        paths = []
        while (most_paths is None or len(paths) < most_paths) and (path := _widest(net, source, sink)):
            width = min(net[e] for e in zip(path, path[1:]))
            for e in zip(path, path[1:]):
                net[e] -= width
            paths.append({"path": path, "value_usd": width})
        names = ("from_address", "to_address", "capacity_usd")
        return pd.DataFrame([(value, min(c for *_, c in cut), [dict(zip(names, x)) for x in cut], paths)], columns=["max_flow_usd", "bottleneck_usd", "cut", "paths"])

    ship(edges.sparkSession)
    none = edges.sparkSession.createDataFrame([(None, None, None)], edges.schema)
    return edges.unionByName(none).groupBy(F.lit(0).alias("g")).applyInPandas(solve, kind)


def cut_edges(transfers: DataFrame, found: DataFrame) -> DataFrame:
    """The edges of a :func:`max_flow` result's cut as :func:`flow_edges` has
    them: value, weight, counts, times and hashes."""
    cut = found.select(F.inline("cut")).select("from_address", "to_address")
    return flow_edges(transfers.join(cut, ["from_address", "to_address"], "left_semi"))
