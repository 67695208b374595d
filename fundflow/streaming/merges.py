"""Wallets and transactions that a stream of transactions merges into kept tables.

A batch becomes facts (what each wallet sent and got, when it was seen) and rows
of transactions, which :mod:`fundflow.operators.store` merges into the last
version. Counters add up, so a batch must never count twice: its number is that
of the version it writes (:class:`Versions`), and a batch whose version is there
is skipped. Within a batch a transaction counts once however often it arrives,
and so does one that an earlier batch has brought.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fundflow.functions.columns import address, cents
from fundflow.operators import store
from fundflow.plans.shared import discard, stored
from fundflow.streaming.versions import Versions

WALLETS = "address string, chain string, label string, risk_score double, first_seen timestamp, last_seen timestamp, tx_count long, sent_usd double, received_usd double"
SEEN = "tx_hash string, chain string, from_address string, to_address string, value_usd double, timestamp timestamp"
KEY = ("tx_hash", "chain", "from_address", "to_address")


def fresh_rows(transfers: DataFrame, seen: DataFrame) -> DataFrame:
    """Transfers that weren't seen yet, once each: the earliest of equals."""
    rows = transfers.select(F.lower("tx_hash").alias("tx_hash"), "chain", address(F.col("from_address")).alias("from_address"), address(F.col("to_address")).alias("to_address"), "value_usd", "timestamp")
    once = rows.groupBy(*KEY).agg(F.min(F.struct("timestamp", "value_usd")).alias("f")).select(*KEY, "f.value_usd", "f.timestamp")
    return once.join(seen.select(*KEY), list(KEY), "left_anti")


def wallet_facts(transfers: DataFrame) -> DataFrame:
    """What transfers say of the wallets at their ends, in the columns of :data:`WALLETS`."""
    zero = F.lit(0).cast("decimal(38,2)")
    value = F.coalesce(cents(F.col("value_usd")), zero)
    ends = F.array(F.struct(F.col("from_address").alias("address"), value.alias("sent"), zero.alias("received")), F.struct(F.col("to_address").alias("address"), zero.alias("sent"), value.alias("received")))
    legs = transfers.select("chain", "timestamp", F.inline(ends))
    money = lambda c: F.sum(c).cast("double").alias(f"{c}_usd")
    per = legs.groupBy("address", "chain").agg(F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.count("*").alias("tx_count"), money("sent"), money("received"))
    return per.select("address", "chain", F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("risk_score"), "first_seen", "last_seen", "tx_count", "sent_usd", "received_usd")


def merged(wallets: DataFrame, seen: DataFrame, transfers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(wallets, seen) after some transfers, stored."""
    rows = stored(fresh_rows(transfers, seen), "merge-rows")
    out = stored(store.upsert_wallets(wallets, wallet_facts(rows)), "merged-wallets"), stored(seen.unionByName(rows), "merged-seen")
    discard(rows)
    return out


def in_batches(transfers: DataFrame, cuts: list[str]) -> DataFrame:
    """The wallets of a history that is merged batch by batch, cut at these times."""
    spark = transfers.sparkSession
    wallets, seen = spark.createDataFrame([], WALLETS), spark.createDataFrame([], SEEN)
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = transfers if low is None else transfers.where(F.col("timestamp") >= low)
        before = wallets, seen
        wallets, seen = merged(wallets, seen, part if high is None else part.where(F.col("timestamp") < high))
        discard(*before)
    return wallets


def keep(stream: DataFrame, folder: str, **trigger) -> StreamingQuery:
    """Merge a stream of transfers into the tables ``wallets`` and ``seen`` of
    :class:`Versions` below ``folder``."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        versions = Versions(spark, f"{folder}/versions")
        done = versions.complete()
        if done and number <= done[-1]:
            return
        known = [versions.read(t) if done else spark.createDataFrame([], kind) for t, kind in (("wallets", WALLETS), ("seen", SEEN))]
        new = merged(*known, batch)
        versions.write(number, wallets=new[0], seen=new[1])
        discard(*new)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(**trigger or {"availableNow": True}).start()
