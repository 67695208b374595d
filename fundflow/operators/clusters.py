"""Entity clusters (co-spending, gas funding) and wallet roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundflow.functions.columns import cents, clamp, seconds
from fundflow.plans.components import components
from fundflow.plans.shared import dealt, stored

COSPEND, GAS_FUNDING = "cospend", "gas_funding"


def cospend_links(transfers: DataFrame) -> DataFrame:
    """(a, b): the least sender of a transaction of several and each other."""
    rows = transfers.count()
    senders = dealt(transfers.select("tx_hash", "from_address"), rows, "tx_hash").withColumn("a", F.min("from_address").over(Window.partitionBy("tx_hash")))
    return dealt(senders.where("from_address <> a").select("a", F.col("from_address").alias("b")), rows, "a", "b").distinct()


def first_receipts(transfers: DataFrame) -> DataFrame:
    """The first transfer that each address ever got."""
    order = Window.partitionBy("to_address").orderBy("timestamp", "tx_hash", "from_address", "value_usd")
    return transfers.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def gas_funding_links(transfers: DataFrame, window_seconds: int = 3600, min_children: int = 3, max_funding_usd: float = 50.0) -> DataFrame:
    """(a, b): a parent and each address it opened with a small amount within a
    burst of openings. A burst is any window that holds enough of them."""
    spent = transfers.groupBy(F.col("from_address").alias("to_address")).agg(F.min("timestamp").alias("spent_at"))
    openings = first_receipts(transfers).join(spent, "to_address", "left").where(F.col("value_usd") <= max_funding_usd)
    openings = openings.where("from_address <> to_address and (spent_at is null or spent_at >= timestamp)")
    at = F.unix_micros("timestamp")
    by = Window.partitionBy("from_address").orderBy(at)
    reach = window_seconds * 1_000_000
    counted = openings.withColumn("n", F.count("*").over(by.rangeBetween(-reach, 0)))
    peak = counted.withColumn("peak", F.max("n").over(by.rangeBetween(0, reach)))
    return peak.where(F.col("peak") >= min_children).select(F.col("from_address").alias("a"), F.col("to_address").alias("b")).distinct()


def cluster_links(transfers: DataFrame, cospend: bool = True, gas_funding: bool = True, window_seconds: int = 3600, min_children: int = 3, max_funding_usd: float = 50.0) -> DataFrame:
    """(a, b, heuristic): the links of the heuristics that are asked for."""
    parts = []
    if cospend:
        parts.append(cospend_links(transfers).withColumn("heuristic", F.lit(COSPEND)))
    if gas_funding:
        parts.append(gas_funding_links(transfers, window_seconds, min_children, max_funding_usd).withColumn("heuristic", F.lit(GAS_FUNDING)))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _grouped(transfers: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """Links, stored, and (node, root) of every linked address."""
    links = stored(cluster_links(transfers, **how), "cluster-links")
    return links, components(links.select("a", "b"))


def cluster_members(transfers: DataFrame, min_cluster_size: int = 2, **how) -> DataFrame:
    """(root, member), a row for each member of a cluster of that size; ``how``
    as in :func:`cluster_links`."""
    _, roots = _grouped(transfers, **how)
    large = roots.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") >= min_cluster_size).select("root")
    return roots.join(large, "root").select("root", F.col("node").alias("member"))


def build_clusters(transfers: DataFrame, min_cluster_size: int = 2, arrays: bool = True, **how) -> DataFrame:
    """cluster_id, root (least member), members (only with ``arrays``; the rows
    of :func:`cluster_members` have no bound on a cluster's size), member_count,
    heuristics, total_value_usd (each transfer once per cluster that it touches)."""
    links, roots = _grouped(transfers, **how)
    used = links.join(roots.withColumnRenamed("node", "a"), "a").groupBy("root").agg(F.sort_array(F.collect_set("heuristic")).alias("heuristics"))
    members = roots.groupBy("root").agg(*[F.sort_array(F.collect_list("node")).alias("members")] * arrays, F.count("*").alias("member_count")).where(F.col("member_count") >= min_cluster_size)
    ends = [roots.select(F.col("node").alias(f"{s}_address"), F.col("root").alias(f"{s}_root")) for s in ("from", "to")]
    touched = transfers.select("from_address", "to_address", "value_usd").join(ends[0], "from_address", "left").join(ends[1], "to_address", "left")
    # of both ends first, so that a cluster's transfers are added up before roots are told apart
    pairs = touched.groupBy("from_root", "to_root").agg(F.sum(cents(F.col("value_usd"))).alias("v"))
    totals = pairs.select("v", F.explode(F.array_distinct(F.array_compact(F.array("from_root", "to_root")))).alias("root")).groupBy("root").agg(F.sum("v").cast("double").alias("total_value_usd"))
    out = members.join(used, "root").join(totals, "root", "left")
    return out.select(F.concat(F.lit("cluster:"), "root").alias("cluster_id"), "root", *["members"] * arrays, "member_count", "heuristics", F.coalesce("total_value_usd", F.lit(0.0)).alias("total_value_usd"))


def role_features(transfers: DataFrame) -> DataFrame:
    """Per address, over all of them at once: degrees, values, times,
    counterparties in both directions."""
    real = transfers.where("from_address <> to_address")
    legs = real.select(
        F.explode(F.array(
            F.struct(F.col("to_address").alias("address"), F.col("from_address").alias("other"), F.lit(True).alias("incoming")),
            F.struct(F.col("from_address").alias("address"), F.col("to_address").alias("other"), F.lit(False).alias("incoming")),
        )).alias("l"), "value_usd", "timestamp",
    ).select("l.*", "value_usd", "timestamp")
    pair = legs.groupBy("address", "other").agg(
        F.max("incoming").alias("got"), F.max(~F.col("incoming")).alias("gave"),
        F.sum(F.when(F.col("incoming"), cents(F.col("value_usd")))).alias("value_in"), F.sum(F.when(~F.col("incoming"), cents(F.col("value_usd")))).alias("value_out"),
        F.min(F.when(F.col("incoming"), F.col("timestamp"))).alias("first_in"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"),
    )
    count = lambda c: F.sum(c.cast("long"))
    features = pair.groupBy("address").agg(
        count(F.col("got")).alias("in_degree"), count(F.col("gave")).alias("out_degree"), count(F.col("got") & F.col("gave")).alias("round_trip"),
        F.coalesce(F.sum("value_in"), F.lit(0)).cast("double").alias("value_in_usd"), F.coalesce(F.sum("value_out"), F.lit(0)).cast("double").alias("value_out_usd"),
        F.min("first_in").alias("first_in"), seconds(F.min("first"), F.max("last")).alias("active_seconds"),
    )
    later = real.select(F.col("from_address").alias("address"), "timestamp").join(features.select("address", "first_in"), "address").where("timestamp >= first_in")
    hold = later.groupBy("address").agg(seconds(F.first("first_in"), F.min("timestamp")).alias("hold_seconds"))
    return (
        features.join(hold, "address", "left")
        .withColumn("forwarded_ratio", F.when(F.col("value_in_usd") > 0, F.col("value_out_usd") / F.col("value_in_usd")).otherwise(0.0))
        .withColumn("velocity_usd_per_hour", F.when(F.col("active_seconds") > 0, F.col("value_out_usd") / (F.col("active_seconds") / 3600)).otherwise(F.col("value_out_usd")))
    )


def _sure(base: float, *boosts: Column) -> Column:
    return F.round(clamp(sum((F.greatest(F.lit(0.0), b) for b in boosts), F.lit(base))), 2)


def wallet_roles(transfers: DataFrame) -> DataFrame:
    """address, role, confidence, signals: the first rule that holds."""
    i, o, fwd, hold = (F.col(c) for c in ("in_degree", "out_degree", "forwarded_ratio", "hold_seconds"))
    # Thresholds, bases and boosts of each role, and the names of signals
    rules = [
        ("mixer", "fan_in_and_fan_out", (i >= 5) & (o >= 5), _sure(0.55, F.least(i, o) / 40, F.col("round_trip") / 20)),
        ("exchange_deposit", "sweeps_to_single_sink", (i >= 3) & (o == 1) & (fwd >= 0.7), _sure(0.55, i / 40, fwd / 10)),
        ("distributor", "fan_out", (o >= 5) & (o >= 3 * F.greatest(i, F.lit(1))), _sure(0.55, o / 50, fwd / 10)),
        ("mule", "pass_through", (i > 0) & (o > 0) & (o <= 3) & (fwd >= 0.7) & F.coalesce(hold <= 86400, F.lit(False)), _sure(0.5, fwd / 5, (86400 - hold) / 864000)),
        ("holder", "retains_balance", (i > 0) & (fwd < 0.3), _sure(0.5, 0.3 - fwd)),
    ]
    role, sure, sign = F.lit("unknown"), F.lit(0.2), F.lit(None).cast("string")
    for name, signal, holds, confidence in reversed(rules):
        role, sure, sign = F.when(holds, name).otherwise(role), F.when(holds, confidence).otherwise(sure), F.when(holds, signal).otherwise(sign)
    signals = F.array_compact(F.array(
        F.format_string("in_degree=%d", i), F.format_string("out_degree=%d", o), F.format_string("forwarded_ratio=%.2f", fwd),
        F.format_string("value_in_usd=%.2f", F.col("value_in_usd")), F.format_string("velocity_usd_per_hour=%.2f", F.col("velocity_usd_per_hour")),
        F.when(hold.isNotNull(), F.format_string("hold_seconds=%d", F.floor(hold))), F.when(F.col("round_trip") > 0, F.format_string("round_trip_counterparties=%d", F.col("round_trip"))), sign,
    ))
    return role_features(transfers).select("address", role.alias("role"), sure.alias("confidence"), signals.alias("signals"))
