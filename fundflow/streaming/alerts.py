"""Live alerting over a stream of transfers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def watchlist_alerts(transfers: DataFrame, watchlist: DataFrame, min_value_usd: float = 0.0) -> DataFrame:
    """Transfers that touch a watched address: stateless, works on a batch and
    on a stream alike. The list (``address``, ``label``) is a static side."""
    watched = watchlist.select(F.lower("address").alias("watched"), "label").distinct()
    big = transfers.where(F.col("value_usd") >= min_value_usd)
    legs = big.select("*", F.explode(F.array_distinct(F.array("from_address", "to_address"))).alias("watched"))
    return legs.join(watched, "watched").select("tx_hash", "from_address", "to_address", "value_usd", "timestamp", "chain", "watched", "label", F.when(F.col("watched") == F.col("from_address"), "sent").otherwise("received").alias("side"))


def velocity(transfers: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and values per sender and window of time; late rows are dropped
    once the watermark has passed them."""
    at = F.window("timestamp", window, slide) if slide else F.window("timestamp", window)
    rows = transfers.withWatermark("timestamp", late) if transfers.isStreaming else transfers
    return rows.groupBy(at.alias("w"), "from_address").agg(F.count("*").alias("tx_count"), F.sum(F.col("value_usd").cast("decimal(18,2)")).cast("double").alias("value_usd")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "from_address", "tx_count", "value_usd")


def sessions(transfers: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Bursts of a sender: transfers no further apart than the gap."""
    rows = transfers.withWatermark("timestamp", late) if transfers.isStreaming else transfers
    return rows.groupBy(F.session_window("timestamp", gap).alias("w"), "from_address").agg(F.count("*").alias("tx_count"), F.sum(F.col("value_usd").cast("decimal(18,2)")).cast("double").alias("value_usd")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "from_address", "tx_count", "value_usd")
