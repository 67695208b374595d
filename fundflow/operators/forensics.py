"""What a case's dashboard shows, and the bounds of what it may ask for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundflow.functions.columns import total
from fundflow.operators import attribution, clusters, flow, graph, motifs, taint, wallets
from fundflow.operators.assistant import Tables
from fundflow.plans.shared import stored

# Least and greatest value of each parameter of a request.
BOUNDS: dict[str, dict[str, tuple[float, float]]] = {
    "taint": {"max_hops": (1, 12), "top_n": (1, 200), "min_taint_usd": (0, float("inf"))},
    "clusters": {"window_seconds": (60, 86400), "min_cluster_size": (2, 50)},
    "motifs": {"window_seconds": (60, 604800), "min_mules": (2, 50), "max_cycle_length": (3, 10)},
    "flow": {"max_hops": (1, 15)},
    "bridge_matches": {"window_seconds": (60, 86400), "value_tolerance_pct": (0.1, 50)},
    "fiat_matches": {"window_seconds": (60, 7200), "usd_inr_rate": (5e-324, float("inf")), "amount_tolerance_pct": (0.1, 50)},
    "paths": {"max_hops": (1, 6)},
    "attributions": {"max_hops": (1, 10)},
    "listing": {"page": (1, float("inf")), "page_size": (1, 100)},
    "transactions": {"page": (1, float("inf")), "page_size": (1, 200)},
}


def checked(request: str, **values: float) -> dict[str, float]:
    """The parameters of a request, if all are known and within bounds."""
    bounds = BOUNDS[request]
    for name, value in values.items():
        if name not in bounds:
            raise ValueError(f"{request} has no parameter {name}")
        low, high = bounds[name]
        if not low <= value <= high:
            raise ValueError(f"{name} of {request} must be from {low} to {high}, not {value}")
    return values


def _taint(t: Tables, model: str = taint.HAIRCUT, top_n: int = 20, **values) -> DataFrame:
    return taint.summary(taint.propagate(t.transfers, taint.default_sources(t.transfers, t.wallets), model, **values), top_n)


def _paths(t: Tables, start: str, **values) -> DataFrame:
    starts = t.transfers.sparkSession.createDataFrame([(start,)], "start string")
    return graph.paths_to_entities(t.transfers, starts, t.entities, **values)


def _attributions(t: Tables, start: str, **values) -> DataFrame:
    starts = t.transfers.sparkSession.createDataFrame([(start,)], "start string")
    return attribution.attributions(t.transfers, starts, t.entities, **values)


def _motifs(t: Tables, max_cycle_length: int = 6, **values) -> DataFrame:
    return motifs.detect_motifs(t.transfers, max_length=max_cycle_length, **values)


REQUESTS: dict[str, Callable[..., DataFrame]] = {
    "taint": _taint, "motifs": _motifs, "paths": _paths, "attributions": _attributions,
    "clusters": lambda t, **values: clusters.build_clusters(t.transfers, arrays=False, **values),
    "flow": lambda t, source, target, **values: flow.weighted_path(t.transfers, source, target, **values),
    "listing": lambda t, **values: wallets.listed(t.wallets, **values),
    "transactions": lambda t, address, **values: wallets.wallet_transactions(t.transactions, address, **values),
}


def requested(request: str, t: Tables, **values) -> DataFrame:
    """What a request asks for: numbers have to be within :data:`BOUNDS`, texts
    (a start, a model) go to the operator as they are."""
    numbers = {k: v for k, v in values.items() if not isinstance(v, str)}
    return REQUESTS[request](t, **values | checked(request, **numbers))


def summary(transfers: DataFrame, case_wallets: DataFrame, top: int = 5) -> DataFrame:
    """One row: volume and addresses, clusters and the largest, motifs by kind
    and the most valuable, and what the riskiest wallets tainted."""
    base = wallets.forensic_summary(transfers)
    groups = clusters.build_clusters(transfers, arrays=False).agg(F.count("*").alias("cluster_count"), F.coalesce(F.max("member_count"), F.lit(0)).alias("largest_cluster"))
    found = stored(motifs.detect_motifs(transfers), "motifs")
    counts = found.groupBy("motif").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("motif", "n")))).alias("motif_counts"))
    best = found.orderBy(F.desc("value_usd"), "motif", "addresses").limit(top).select("motif", F.round("value_usd", 2).alias("value_usd"), F.slice("addresses", 1, 6).alias("addresses"), F.round("confidence", 4).alias("confidence"))
    tops = best.agg(F.sort_array(F.collect_list(F.struct("value_usd", "motif", "addresses", "confidence")), asc=False).alias("top_motifs"))
    dirty = stored(taint.propagate(transfers, taint.default_sources(transfers, case_wallets)), "taint")
    money = dirty.agg(F.count("*").alias("tainted_address_count"), F.coalesce(total(F.col("tainted_value_usd")), F.lit(0.0)).alias("total_tainted_usd"))
    worst = taint.summary(dirty, top).agg(F.sort_array(F.collect_list(F.struct("tainted_value_usd", "address", "hops")), asc=False).alias("top_destinations"))
    for one in (groups, counts, tops, money, worst):  # each has one row
        base = base.join(F.broadcast(one))
    return base
