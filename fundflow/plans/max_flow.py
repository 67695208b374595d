"""Maximum flow over an edge table that no worker has to hold."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundflow.plans.paths import reach
from fundflow.plans.shared import discard, stored

EPSILON = 1e-9
#: Rounds after which heights are taken anew from distances to the sink.
RELABEL_ROUNDS = 5


def _distances(residual: DataFrame, sink: str) -> DataFrame:
    """(v, d): hops to the sink, of all that can still reach it."""
    open_ = residual.where(F.col("r") > EPSILON).select(F.col("a").alias("from_address"), F.col("b").alias("to_address"))
    found = reach(open_, residual.sparkSession.createDataFrame([(sink,)], "start string"), None, "in")
    return found.select(F.col("address").alias("v"), F.col("hops").alias("d"))


def _measured(nodes: DataFrame, residual: DataFrame, source: str, sink: str, n: int) -> DataFrame:
    """Nodes with exact heights; n where the sink can't be reached any more."""
    far = nodes.join(_distances(residual, sink), "v", "left")
    return stored(far.select("v", F.when(F.col("v") == source, n).otherwise(F.coalesce("d", F.lit(n))).cast("long").alias("h"), "x"), "flow-nodes")


def preflow(edges: DataFrame, source: str, sink: str) -> tuple[DataFrame, float]:
    """(residual(a, b, r), value of a maximum flow) of ``edges(from_address,
    to_address, capacity_usd)``, by push and relabel in rounds.

    In a round every node that holds money passes it on, along edges that lead
    one step down, in order of their heads, and then rises above its lowest open
    edge if none leads down; both are joins of the node and edge tables. Heights
    become distances to the sink every few rounds, which also lifts all that is
    cut off from it beyond reach (the gap). The rounds end when no node below
    that height holds money: what the sink has then is the greatest flow, and
    what lies elsewhere can't get through.
    """
    pairs = edges.select(F.col("from_address").alias("a"), F.col("to_address").alias("b"), F.col("capacity_usd").alias("r"))
    residual = stored(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(0.0).alias("r"))).groupBy("a", "b").agg(F.sum("r").alias("r")), "flow-residual")
    out = residual.where((F.col("a") == source) & (F.col("r") > EPSILON))
    nodes = residual.select(F.col("a").alias("v")).distinct().join(out.select(F.col("b").alias("v"), F.col("r").alias("x")), "v", "left").select("v", F.coalesce("x", F.lit(0.0)).alias("x"))
    n = nodes.count()
    gone = out.select("a", "b", (-F.col("r")).alias("r")).unionByName(out.select(F.col("b").alias("a"), F.col("a").alias("b"), "r"))
    full = residual
    residual = stored(residual.unionByName(gone).groupBy("a", "b").agg(F.sum("r").alias("r")), "flow-residual")
    nodes = _measured(nodes, residual, source, sink, n)
    discard(full)
    for round_ in count(1):
        holding = (F.col("x") > EPSILON) & (F.col("h") < n) & ~F.col("v").isin(source, sink)
        if nodes.where(holding).isEmpty():
            break
        heads = nodes.select(F.col("v").alias("b"), F.col("h").alias("hb"))
        down = residual.where(F.col("r") > EPSILON).join(nodes.where(holding).withColumnRenamed("v", "a"), "a").join(heads, "b").where("h = hb + 1")
        before = F.sum("r").over(Window.partitionBy("a").orderBy("b")) - F.col("r")
        pushed = stored(down.withColumn("p", F.least(F.col("r"), F.col("x") - before)).where(F.col("p") > 0).select("a", "b", "p"), "flow-pushes")
        moved = pushed.select("a", "b", (-F.col("p")).alias("r")).unionByName(pushed.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("p").alias("r")))
        old = residual, nodes
        residual = stored(residual.unionByName(moved).groupBy("a", "b").agg(F.sum("r").alias("r")), "flow-residual")
        sums = pushed.select(F.col("a").alias("v"), (-F.col("p")).alias("x")).unionByName(pushed.select(F.col("b").alias("v"), F.col("p").alias("x")))
        held = nodes.unionByName(sums.withColumn("h", F.lit(0).cast("long")).select("v", "h", "x")).groupBy("v").agg(F.max("h").alias("h"), F.sum("x").alias("x"))
        if round_ % RELABEL_ROUNDS == 0:
            nodes = _measured(held, residual, source, sink, n)
        else:
            lowest = residual.where(F.col("r") > EPSILON).join(heads, "b").groupBy(F.col("a").alias("v")).agg(F.min("hb").alias("low"))
            risen = F.when(holding, F.greatest(F.col("h"), F.least(F.coalesce(F.col("low") + 1, F.lit(n)), F.lit(n)))).otherwise(F.col("h"))
            nodes = stored(held.join(lowest, "v", "left").select("v", risen.cast("long").alias("h"), "x"), "flow-nodes")
        discard(pushed, *old)
    value = nodes.where(F.col("v") == sink).agg(F.coalesce(F.sum("x"), F.lit(0.0))).first()[0]
    discard(nodes)
    return residual, value


def least_cut(edges: DataFrame, residual: DataFrame, sink: str) -> DataFrame:
    """The edges into all that can still reach the sink from what can't."""
    near = stored(_distances(residual, sink).select(F.col("v").alias("to_address")), "flow-near-sink")
    return edges.join(near, "to_address", "left_semi").join(near.withColumnRenamed("to_address", "from_address"), "from_address", "left_anti")


def widest(flow: DataFrame, source: str, sink: str) -> tuple[list[str], float] | None:
    """The path (a, b, f) of the greatest least flow, the one whose addresses
    sort first of equals; None without any."""
    first = flow.sparkSession.createDataFrame([(source, float("inf"), [source])], "v string, width double, path array<string>")
    best = front = stored(first, "flow-widest")
    while not front.isEmpty():
        reached = best.where(F.col("v") == sink).agg(F.coalesce(F.max("width"), F.lit(0.0)).alias("bar"))
        grown = front.where(F.col("v") != sink).join(flow, F.col("v") == F.col("a")).where(~F.array_contains("path", F.col("b"))).select(F.col("b").alias("v"), F.least("width", "f").alias("width"), F.concat("path", F.array("b")).alias("path"))
        top = grown.groupBy("v").agg(F.min(F.struct((-F.col("width")).alias("w"), "path")).alias("l")).select("v", (-F.col("l.w")).alias("width"), "l.path")
        known = best.select("v", F.col("width").alias("w0"), F.col("path").alias("p0"))
        better = top.join(known, "v", "left").join(F.broadcast(reached)).where("(w0 is null or width > w0 or (width = w0 and path < p0)) and width >= bar")
        front = stored(better.select("v", "width", "path"), "flow-widest")
        best = stored(best.join(front.select("v"), "v", "left_anti").unionByName(front), "flow-widest")
    row = best.where(F.col("v") == sink).first()
    return (row.path, row.width) if row and row.width > EPSILON else None


def decomposed(edges: DataFrame, residual: DataFrame, source: str, sink: str, most: int | None) -> list[tuple[list[str], float]]:
    """Up to ``most`` paths of the flow with what each carries, widest first."""
    used = edges.select(F.col("from_address").alias("a"), F.col("to_address").alias("b"), F.col("capacity_usd").alias("c")).join(residual, ["a", "b"])
    back = used.select(F.col("b").alias("a"), F.col("a").alias("b"), (F.col("c") - F.col("r")).alias("g")).where(F.col("g") > EPSILON)
    net = used.join(back, ["a", "b"], "left").select("a", "b", (F.col("c") - F.col("r")).alias("f")).where(F.col("f") > EPSILON)
    net, paths = stored(net, "flow-net"), []
    while (most is None or len(paths) < most) and (found := widest(net, source, sink)):
        path, width = found
        paths.append(found)
        steps = net.sparkSession.createDataFrame([(a, b, -width) for a, b in zip(path, path[1:])], "a string, b string, f double")
        old, net = net, stored(net.unionByName(steps).groupBy("a", "b").agg(F.sum("f").alias("f")).where(F.col("f") > EPSILON), "flow-net")
        discard(old)
    return paths
