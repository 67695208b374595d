"""Laundering shapes in time: fans, peel chains, cycles."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundflow.functions.columns import around, band, cents, clamp, seconds
from fundflow.operators.flow import movements
from fundflow.plans.shared import dealt, stored

# Bounds on what one edge, chain or ring may bring, as defaults
# of parameters; None takes a bound off. Scores' weights below are fixed values too.
TX_PER_EDGE, CHAIN_DEPTH, CYCLE_STARTS = 8, 64, 8
CEILING = 0.95
#: Times by which fewer paths have to meet for ends to be looked for first.
PREFIX_GAIN = 4
#: Buckets and bands that a hop is looked up in.
HOP_COPIES = 6
MOTIFS = ("fan_out_fan_in", "peel_chain", "cycle")


# CEILING, and the weights that each shape gives its three parts.
def _score(a: float, x: Column, b: float, y: Column, c: float, z: Column) -> Column:
    return F.round(CEILING * (a * x + b * y + c * z), 3)


def _mean(c: str) -> Column:
    return F.avg(c)


def fan_pairs(transfers: DataFrame, min_mules: int = 3) -> DataFrame:
    """(source, sink, n_mules): ends of enough two-hop paths.

    A mule with d edges in and e out makes d x e paths, which hubs make too
    many. Two ends that share ``min_mules`` mules share one that isn't among the
    last ``min_mules - 1`` of either, in whatever order all mules stand. With
    the mules of most paths last, ends meet on the others alone; the ones that
    do are then counted over all of their mules. Where that saves less than
    :data:`PREFIX_GAIN` times, as in graphs without hubs, all paths are counted.
    """
    edges = movements(transfers).select("from_address", "to_address").distinct()
    sources = edges.groupBy("from_address").count().where(F.col("count") >= min_mules).select("from_address")
    sinks = edges.groupBy("to_address").count().where(F.col("count") >= min_mules).select("to_address")
    a = edges.join(sources, "from_address").select(F.col("from_address").alias("source"), F.col("to_address").alias("mule"))
    b = edges.join(sinks, "to_address").select(F.col("to_address").alias("sink"), F.col("from_address").alias("mule"))
    load = a.groupBy("mule").agg(F.count("*").alias("d")).join(b.groupBy("mule").agg(F.count("*").alias("e")), "mule").select("mule", (F.col("d") * F.col("e")).alias("load"))
    load = stored(load, "mule-loads")
    a, b = (stored(_rarest_first(side.join(load, "mule"), end, min_mules), "fan-sides") for side, end in ((a, "source"), (b, "sink")))
    met = a.where("early").groupBy("mule").agg(F.count("*").alias("d")).join(b.where("early").groupBy("mule").agg(F.count("*").alias("e")), "mule").agg(F.sum(F.col("d") * F.col("e"))).first()[0]
    every = load.agg(F.sum("load")).first()[0]
    a_all, b_all = a.select("source", "mule"), b.select("sink", "mule")
    if (met or 0) * PREFIX_GAIN > (every or 0):
        paths = a_all.join(b_all, "mule").where("source <> sink")
    else:
        ends = a.where("early").select("source", "mule").join(b.where("early").select("sink", "mule"), "mule").where("source <> sink").select("source", "sink").distinct()
        paths = ends.join(a_all, "source").join(b_all, ["sink", "mule"])
    return paths.groupBy("source", "sink").agg(F.count("*").alias("n_mules")).where(F.col("n_mules") >= min_mules)


def _rarest_first(side: DataFrame, end: str, least: int) -> DataFrame:
    """``side(end, mule, load)`` with ``early``: whether a mule isn't among the
    last ``least - 1`` of its end; ends of too few mules go."""
    of, order = Window.partitionBy(end), Window.partitionBy(end).orderBy(F.desc("load"), F.desc("mule"))
    ranked = side.withColumn("n", F.count("*").over(of)).where(F.col("n") >= least).withColumn("k", F.row_number().over(order))
    return ranked.select(end, "mule", (F.col("k") >= least).alias("early"))


def timed_hops(transfers: DataFrame, window_seconds: int, value_tolerance: float, tx_per_edge: int | None) -> DataFrame:
    """Per source, mule and sink the best pair of hops: the second within the
    window after the first, of nearly its value; least gap, then deviation,
    then hash.

    Hops are joined on the mule, a time bucket as wide as the window and a band
    of values as wide as the tolerance, so a busy mule's hops meet only those
    that can match. Both are dealt by the number of rows.
    """
    legs, rows = movements(transfers), transfers.count()
    if tx_per_edge is not None:
        order = Window.partitionBy("from_address", "to_address").orderBy("timestamp", "tx_hash")
        legs = dealt(legs.select("from_address", "to_address", "tx_hash", "value_usd", "timestamp"), rows, "from_address", "to_address")
        legs = legs.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= tx_per_edge)
    bucket = F.floor(F.unix_micros("timestamp") / (max(1, window_seconds) * 1_000_000))
    keys = F.explode(F.array(bucket, bucket + 1)).alias("_bucket"), around(band(F.col("value_usd"), value_tolerance)).alias("_bands")
    a = legs.select(F.col("from_address").alias("source"), F.col("to_address").alias("mule"), F.col("tx_hash").alias("hash_in"), F.col("value_usd").alias("value_in"), F.col("timestamp").alias("at_in"), *keys).withColumn("_band", F.explode("_bands")).drop("_bands")
    b = legs.select(F.col("from_address").alias("mule"), F.col("to_address").alias("sink"), F.col("tx_hash").alias("hash_out"), F.col("value_usd").alias("value_out"), F.col("timestamp").alias("at_out"), bucket.alias("_bucket"), band(F.col("value_usd"), value_tolerance).alias("_band"))
    gap, off = seconds(F.col("at_in"), F.col("at_out")), F.abs(F.col("value_out") - F.col("value_in")) / F.col("value_in")
    met = ["mule", "_bucket", "_band"]
    pairs = dealt(a, HOP_COPIES * rows, *met).join(b.hint("merge"), met).drop("_bucket", "_band").where("source <> sink").withColumn("gap", gap).withColumn("deviation", off)
    pairs = pairs.where((F.col("gap") >= 0) & (F.col("gap") <= window_seconds) & (F.col("deviation") <= value_tolerance))
    best = F.min(F.struct("gap", "deviation", "hash_out", "hash_in", "value_in", "value_out", "at_in", "at_out")).alias("best")
    return pairs.groupBy("source", "mule", "sink").agg(best).select("source", "mule", "sink", "best.*")


def mule_hops(transfers: DataFrame, window_seconds: int = 1800, min_mules: int = 3, value_tolerance: float = 0.25, tx_per_edge: int | None = TX_PER_EDGE) -> DataFrame:
    """The :func:`timed_hops` between ends that enough mules connect, at
    whatever time. The first ``tx_per_edge`` transfers of an edge count."""
    hops = stored(timed_hops(transfers, window_seconds, value_tolerance, tx_per_edge), "timed-hops")
    per = hops.groupBy("source", "sink").agg(F.count("*").alias("n"))
    enough = per.where(F.col("n") >= min_mules).select("source", "sink")
    few = stored(per.where(F.col("n") < min_mules).select("source", "sink"), "hop-ends")  # only these may have more, at other times
    edges = stored(movements(transfers).select("from_address", "to_address").distinct(), "mule-edges")
    paths = few.join(edges.groupBy(F.col("from_address").alias("source")).agg(F.count("*").alias("k")), "source").agg(F.sum("k")).first()[0] or 0
    ways = dealt(few.join(edges.toDF("source", "mule"), "source"), paths, "mule", "sink").join(edges.toDF("mule", "sink"), ["mule", "sink"])
    wide = ways.groupBy("source", "sink").agg(F.count("*").alias("n")).where(F.col("n") >= min_mules).select("source", "sink")
    return hops.join(enough.unionByName(wide), ["source", "sink"])


def fan_out_fan_in(transfers: DataFrame, window_seconds: int = 1800, min_mules: int = 3, value_tolerance: float = 0.25, tx_per_edge: int | None = TX_PER_EDGE) -> DataFrame:
    """Fans whose legs fall into one burst (no gap longer than the window)."""
    hops = stored(timed_hops(transfers, window_seconds, value_tolerance, tx_per_edge), "timed-hops")
    enough = hops.groupBy("source", "sink").count().where(F.col("count") >= min_mules).select("source", "sink")
    hops = stored(hops.join(enough, ["source", "sink"]), "mule-hops")
    events = hops.select("source", "sink", "mule", F.explode(F.array(F.struct(F.col("at_in").alias("at"), F.col("hash_in").alias("hash")), F.struct(F.col("at_out").alias("at"), F.col("hash_out").alias("hash")))).alias("e")).select("source", "sink", "mule", "e.at", "e.hash")
    order = Window.partitionBy("source", "sink").orderBy("at", "hash", "mule")
    cut = F.coalesce(seconds(F.lag("at").over(order), F.col("at")) > window_seconds, F.lit(False))
    runs = events.withColumn("cut", cut.cast("int")).withColumn("run", F.sum("cut").over(order))
    whole = runs.groupBy("source", "sink", "run", "mule").count().where("count = 2").drop("count")
    legs = whole.join(hops, ["source", "sink", "mule"])
    fan = legs.groupBy("source", "sink", "run").agg(
        F.sort_array(F.collect_list("mule")).alias("mules"), F.count("*").alias("mule_count"),
        F.sum(cents(F.col("value_in"))).cast("double").alias("fan_out_usd"), F.sum(cents(F.col("value_out"))).cast("double").alias("fan_in_usd"),
        _mean("deviation").alias("mean_value_deviation"), F.max("gap").alias("max_hop_seconds"), seconds(F.min("at_in"), F.max("at_out")).alias("span_seconds"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.array("hash_in", "hash_out"))))).alias("tx_hashes"),
    ).where(F.col("mule_count") >= min_mules)
    breadth = clamp(F.col("mule_count") / (2 * min_mules))
    fidelity = clamp(1 - F.col("mean_value_deviation") / value_tolerance) if value_tolerance > 0 else F.lit(1.0)
    tight = clamp(1 - F.col("span_seconds") / window_seconds) if window_seconds > 0 else F.lit(0.0)
    return fan.select(
        F.lit(MOTIFS[0]).alias("motif"), F.concat(F.array("source"), "mules", F.array("sink")).alias("addresses"), "tx_hashes", F.col("fan_out_usd").alias("value_usd"),
        _score(0.45, breadth, 0.35, fidelity, 0.20, tight).alias("confidence"), "span_seconds",
        "source", "sink", "mules", "mule_count", "fan_out_usd", "fan_in_usd", "max_hop_seconds", F.round("mean_value_deviation", 4).alias("mean_value_deviation"),
    )


def peel_chains(transfers: DataFrame, min_length: int = 3, peel_ratio_max: float = 0.4, window_seconds: int = 86400, max_depth: int | None = CHAIN_DEPTH) -> DataFrame:
    """Corridors in which every hop forwards most of what came and shaves a
    slice off to a side address; chains within others are left out.

    All walks advance together, one join per hop: the onward transfer is the
    largest, the peel the largest that is small enough (hash decides ties). A
    chain is cut after ``max_depth`` hops.
    """
    legs = stored(movements(transfers).select("tx_hash", "from_address", "to_address", "value_usd", "timestamp"), "legs")
    out = legs.select(F.col("from_address").alias("node"), F.struct("value_usd", "tx_hash", F.col("to_address").alias("to"), F.col("timestamp").alias("at")).alias("next"))
    busy = out.groupBy("node").count().where("count >= 2").select("node")
    walks = legs.join(busy.withColumnRenamed("node", "to_address"), "to_address", "left_semi").select(
        F.col("tx_hash").alias("entry"), F.col("to_address").alias("node"), F.col("value_usd").alias("held"), F.col("timestamp").alias("clock"), F.col("timestamp").alias("began"),
        F.array("from_address", "to_address").alias("path"), F.array("from_address", "to_address").alias("visited"),
        F.array(F.struct("tx_hash", "value_usd", "timestamp")).alias("forwards"), F.expr("cast(array() as array<struct<tx_hash: string, value_usd: double, timestamp: timestamp, to: string, ratio: double>>)").alias("peels"),
    )
    walks, ended = stored(walks, "walks"), []
    for _ in count() if max_depth is None else range(max_depth):
        options = walks.join(out, "node").where((F.col("next.at") >= F.col("clock")) & (seconds(F.col("began"), F.col("next.at")) <= window_seconds) & ~F.array_contains("visited", F.col("next.to")))
        small = F.col("next.value_usd") / F.col("held") <= peel_ratio_max
        key = [c for c in walks.columns if c in ("entry", "node", "began")]
        seen = options.groupBy(*key, "path").agg(
            F.count("*").alias("n"), F.max("next").alias("forward"), F.sort_array(F.collect_list(F.when(small, F.col("next"))), asc=False).alias("slices"), F.first("held").alias("h")
        ).where((F.col("n") >= 2) & (F.col("forward.value_usd") / F.col("h") >= 1 - peel_ratio_max))
        step = seen.withColumn("peel", F.get(F.filter("slices", lambda s: s["tx_hash"] != F.col("forward.tx_hash")), F.lit(0))).where("peel is not null")
        went = walks.join(step.select("entry", "path", "forward", "peel"), ["entry", "path"])
        stopped = walks.join(step.select("entry", "path"), ["entry", "path"], "left_anti").where(F.size("peels") >= min_length)
        ended.append(stored(stopped.select("entry", "path", "forwards", "peels"), "ended"))
        walks = stored(went.select(
            "entry", F.col("forward.to").alias("node"), F.col("forward.value_usd").alias("held"), F.col("forward.at").alias("clock"), "began",
            F.concat("path", F.array("forward.to")).alias("path"), F.concat("visited", F.array("forward.to", "peel.to")).alias("visited"),
            F.concat("forwards", F.array(F.struct(F.col("forward.tx_hash").alias("tx_hash"), F.col("forward.value_usd").alias("value_usd"), F.col("forward.at").alias("timestamp")))).alias("forwards"),
            F.concat("peels", F.array(F.struct(F.col("peel.tx_hash").alias("tx_hash"), F.col("peel.value_usd").alias("value_usd"), F.col("peel.at").alias("timestamp"), F.col("peel.to").alias("to"), (F.col("peel.value_usd") / F.col("held")).alias("ratio")))).alias("peels"),
        ), "walks")
        if walks.isEmpty():
            break
    chains = ended[0]
    for more in [*ended[1:], walks.select("entry", "path", "forwards", "peels")]:
        chains = chains.union(more)
    chains = stored(chains.withColumn("hashes", F.transform("forwards", lambda f: f["tx_hash"])).withColumn("links", F.size("peels")), "chains")
    # a chain within a longer one shares its first hop with it
    inner = chains.select("entry", "hashes", "links").alias("x").join(
        chains.select(F.explode("hashes").alias("hop"), F.col("hashes").alias("outer_hashes"), F.col("links").alias("outer_links")).alias("y"),
        (F.col("x.entry") == F.col("y.hop")) & (F.col("y.outer_links") > F.col("x.links")) & (F.size(F.array_except("x.hashes", "y.outer_hashes")) == 0),
    ).select("x.entry").distinct()
    kept = chains.join(inner, "entry", "left_anti")
    ratios = F.transform("peels", lambda p: p["ratio"])
    mean = F.aggregate(ratios, F.lit(0.0), lambda a, r: a + r) / F.col("links")
    times = F.concat(F.transform("forwards", lambda f: f["timestamp"]), F.transform("peels", lambda p: p["timestamp"]))
    span = seconds(F.array_min(times), F.array_max(times))
    tight = clamp(1 - span / window_seconds) if window_seconds > 0 else F.lit(0.0)
    thin = clamp(1 - mean / peel_ratio_max) if peel_ratio_max > 0 else F.lit(1.0)
    return kept.select(
        F.lit(MOTIFS[1]).alias("motif"), F.concat("path", F.array_sort(F.array_distinct(F.transform("peels", lambda p: p["to"])))).alias("addresses"),
        F.array_sort(F.array_distinct(F.concat("hashes", F.transform("peels", lambda p: p["tx_hash"])))).alias("tx_hashes"), F.col("forwards")[0]["value_usd"].alias("value_usd"),
        _score(0.45, clamp(F.col("links") / (2 * min_length)), 0.35, thin, 0.20, tight).alias("confidence"), span.alias("span_seconds"),
        "links", "path", F.round(mean, 4).alias("mean_peel_ratio"), F.element_at("forwards", -1)["value_usd"].alias("residual_usd"), F.aggregate("peels", F.lit(0.0), lambda a, p: a + p["value_usd"]).alias("peeled_usd"),
    )


def cycles(transfers: DataFrame, max_length: int = 6, window_seconds: int = 86400, max_starts: int | None = CYCLE_STARTS) -> DataFrame:
    """Rings that close forward in time within the window.

    A ring starts at its least address. From each of the first ``max_starts``
    transfers of its first hop, every later hop takes the earliest transfer that follows;
    the first start that closes in time counts. Walks advance one hop per join
    and die when the window is over, so no list of all rings is ever made.
    """
    order = Window.partitionBy("from_address", "to_address").orderBy("timestamp", "tx_hash")
    legs = stored(movements(transfers).select("from_address", "to_address", "tx_hash", "value_usd", "timestamp").withColumn("n", F.row_number().over(order)), "ring-legs")
    hop = F.struct(F.col("timestamp").alias("at"), F.col("tx_hash").alias("hash"), F.col("value_usd").alias("value"), F.col("n").alias("n"))
    edges = legs.select(F.col("from_address").alias("node"), F.col("to_address").alias("to"), hop.alias("hop"))
    walks = legs.where((F.col("to_address") > F.col("from_address")) & (F.lit(True) if max_starts is None else F.col("n") <= max_starts)).select(
        F.col("from_address").alias("start"), F.col("to_address").alias("node"), F.col("n").alias("k"), F.array("from_address", "to_address").alias("path"), F.array(hop).alias("hops")
    )
    walks, closed = stored(walks, "ring-walks"), []
    for length in range(2, max_length + 1):
        last = F.element_at("hops", -1)["at"]
        steps = walks.join(edges, "node").where((F.col("hop.at") >= last) & (seconds(F.col("hops")[0]["at"], F.col("hop.at")) <= window_seconds))
        steps = steps.where((F.col("to") == F.col("start")) | ((F.col("to") > F.col("start")) & ~F.array_contains("path", F.col("to"))))
        taken = steps.groupBy("start", "path", "k", "to").agg(F.min("hop").alias("hop"), F.first("hops").alias("hops"))
        taken = stored(taken.withColumn("hops", F.concat("hops", F.array("hop"))), "ring-steps")
        closed.append(taken.where("to = start").select("path", "k", "hops", F.lit(length).alias("length")))
        if length < max_length:
            walks = stored(taken.where("to <> start").select("start", F.col("to").alias("node"), "k", F.concat("path", F.array("to")).alias("path"), "hops"), "ring-walks")
            if walks.isEmpty():
                break
    rings = closed[0]
    for more in closed[1:]:
        rings = rings.union(more)
    rings = rings.groupBy("path", "length").agg(F.min(F.struct("k", "hops")).alias("first")).select("path", "length", "first.hops")
    values = F.transform("hops", lambda h: h["value"])
    span = seconds(F.col("hops")[0]["at"], F.element_at("hops", -1)["at"])
    keep = F.array_min(values) / F.array_max(values)
    tight = clamp(1 - span / window_seconds) if window_seconds > 0 else F.lit(0.0)
    return rings.select(
        F.lit(MOTIFS[2]).alias("motif"), F.col("path").alias("addresses"), F.transform("hops", lambda h: h["hash"]).alias("tx_hashes"), F.array_min(values).alias("value_usd"),
        _score(0.40, clamp(keep), 0.35, tight, 0.25, clamp(F.lit(3.0) / F.col("length"))).alias("confidence"), span.alias("span_seconds"), "length", F.round(keep, 4).alias("retention"), F.array_max(values).alias("max_hop_usd"),
    )


def detect_motifs(transfers: DataFrame, motifs: tuple[str, ...] = MOTIFS, **params) -> DataFrame:
    """All shapes in one table, most valuable first. ``params`` go to the
    detectors that know them; one that none knows is an error."""
    found, used = None, set()
    for name, detect in zip(MOTIFS, (fan_out_fan_in, peel_chains, cycles)):
        if name in motifs:
            known = {k: v for k, v in params.items() if k in detect.__code__.co_varnames[: detect.__code__.co_argcount]}
            used |= set(known)
            rows = detect(transfers, **known).select("motif", "addresses", "tx_hashes", "value_usd", "confidence", "span_seconds")
            found = rows if found is None else found.union(rows)
    if set(params) - used or found is None:
        raise TypeError(f"unknown: {', '.join(sorted(set(params) - used) or motifs)}")
    return found.orderBy(F.desc("value_usd"), "motif", "addresses")
