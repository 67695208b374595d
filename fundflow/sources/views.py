"""The engine's tables over the generic Parquet tables of the test data.

``transfers`` is the core shape: tx_hash, from_address, to_address, value_usd,
timestamp (UTC), chain, asset, block_number. Here every event is a transfer
from its user to the wallet its properties name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fundflow.functions.columns import address

TRANSFER = ("tx_hash", "from_address", "to_address", "value_usd", "timestamp", "chain", "asset", "block_number")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hex_id(n: Column, width: int) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(n)), width, "0"))


def normalized(df: DataFrame) -> DataFrame:
    """Transfers with normal addresses and defaults for what is missing."""
    have = set(df.columns)
    defaults = {"chain": F.lit("ethereum"), "asset": F.lit("ETH"), "block_number": F.lit(None).cast("long")}
    filled = {c: F.coalesce(F.col(c), d) if c in have else d for c, d in defaults.items()}
    return df.select(
        "tx_hash", address(F.col("from_address")).alias("from_address"), address(F.col("to_address")).alias("to_address"),
        F.col("value_usd").cast("double").alias("value_usd"), F.col("timestamp").cast("timestamp").alias("timestamp"), *[v.alias(c) for c, v in filled.items()],
    )


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return normalized(
        e.select(
            hex_id(F.col("event_id"), 64).alias("tx_hash"),
            hex_id(F.col("user_id"), 40).alias("from_address"),
            hex_id(F.get_json_object("props", "$.k").cast("long"), 40).alias("to_address"),
            F.col("value").alias("value_usd"),
            F.col("ts").alias("timestamp"),
            F.when(F.col("event_id") % 4 == 0, "Polygon").otherwise("Ethereum").alias("chain"),
            F.lit("ETH").alias("asset"),
            F.col("event_id").alias("block_number"),
        )
    )


def chain_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw transactions: ``value`` in base units (a string), token and method."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_id") % 7
    return e.select(
        hex_id(F.col("event_id"), 64).alias("tx_hash"),
        F.when(F.col("event_id") % 4 == 0, "Polygon").otherwise("Ethereum").alias("chain"),
        F.col("event_id").alias("block_number"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        hex_id(F.col("user_id"), 40).alias("from_address"),
        hex_id(F.get_json_object("props", "$.k").cast("long"), 40).alias("to_address"),
        F.concat(F.floor(F.col("value") * 10).cast("string"), F.lit("00000000000000000")).alias("value"),
        F.col("value").cast("decimal(18,2)").alias("value_usd"),
        F.when(kind < 2, hex_id(kind + 1, 40)).alias("token_address"),
        F.when(kind == 0, "USDC").when(kind == 1, F.when(F.col("event_id") % 2 == 0, "SCAMCOIN")).alias("token_symbol"),
        F.when(F.col("event_type") == "purchase", "bridgeOut").when(F.col("event_type") == "click", "transfer").when(F.col("event_type") == "signup", "swap").alias("method"),
    )


def cospend_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions of several senders: an order's parts pay its suppliers."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        hex_id(F.col("l_orderkey"), 64).alias("tx_hash"),
        hex_id(F.col("l_partkey"), 40).alias("from_address"),
        hex_id(F.col("l_suppkey") + 1_000_000, 40).alias("to_address"),
        F.col("l_extendedprice").cast("double").alias("value_usd"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        F.lit("ethereum").alias("chain"),
        F.lit("ETH").alias("asset"),
        F.lit(None).cast("long").alias("block_number"),
    )


def fiat_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bank-rail payments, one some minutes apart from each event."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("UPI"), F.col("event_id").cast("string")).alias("reference_id"),
        F.concat(F.lit("payer-"), F.col("user_id").cast("string")).alias("payer_account"),
        F.concat(F.lit("payee-"), F.get_json_object("props", "$.k")).alias("payee_account"),
        F.round(F.col("value") * (82 + F.col("event_id") % 4), 2).alias("amount_inr"),
        F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + (F.col("event_id") % 1300 - 600) * 1_000_000).alias("timestamp"),
        F.lit("UPI").alias("rail"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled services: suppliers own the receiving wallets of their number."""
    kind = F.col("s_suppkey") % 10
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_name").alias("name"),
        F.when(kind.isin(0, 1, 2), "exchange").when(kind == 3, "mixer").when(kind == 4, "bridge").when(kind == 5, "defi").when(kind == 6, "sanctioned").when(kind == 7, "gambling").otherwise("merchant").alias("entity_type"),
        hex_id(F.col("s_suppkey"), 40).alias("address"),
        F.lit("Ethereum").alias("chain"),
        F.when(F.col("s_suppkey") % 3 == 0, "CONFIRMED").when(F.col("s_suppkey") % 3 == 1, "HIGH_CONFIDENCE").otherwise("PROBABLE").alias("confidence"),
        F.lit("directory").alias("source"),
    )


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case per customer; its wallets are their orders."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("case_id"),
        F.format_string("TRX-2024%04d-%04d", (F.col("c_custkey") % 1231).cast("int"), (F.col("c_custkey") % 10_000).cast("int")).alias("case_number"),
        F.concat(F.lit("Case of "), F.col("c_name")).alias("title"),
        F.lower("c_mktsegment").alias("crime_type"),
        F.when(F.col("c_acctbal") < 0, "closed").when(F.col("c_acctbal") < 5000, "active").otherwise("open").alias("status"),
        F.when(F.col("c_custkey") % 4 != 0, F.col("c_nationkey").cast("long")).alias("assigned_to"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("c_custkey") * 3600).alias("created_at"),
    )


def wallets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("wallet_id"),
        F.col("o_custkey").alias("case_id"),
        hex_id(F.col("o_orderkey") % 150, 40).alias("address"),
        F.when(F.col("o_orderkey") % 4 == 0, "Polygon").otherwise("Ethereum").alias("chain"),
        F.when(F.col("o_orderstatus") == "F", "attributed").when(F.col("o_orderstatus") == "O", "unattributed").otherwise("pending").alias("attribution_status"),
        (F.floor(F.col("o_totalprice")).cast("long") % 101).cast("double").alias("risk_score"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


def directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A published directory of services: (name, entity_type, addresses by chain id, confidence)."""
    s = table(spark, sf_dir, "supplier")
    shown = F.concat(F.lit("0x"), F.upper(F.lpad(F.lower(F.hex("s_suppkey")), 40, "0")))
    both = F.when(F.col("s_suppkey") % 2 == 0, F.create_map(F.lit(1).cast("long"), F.array(shown), F.lit(137).cast("long"), F.array(shown))).otherwise(F.create_map(F.lit(1).cast("long"), F.array(shown)))
    return s.select(F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 10 == 3, "mixer").otherwise("exchange").alias("entity_type"), both.alias("addresses"), F.lit("CONFIRMED").alias("confidence"))


def intelligence_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a provider of entity intelligence said: address, chain, body (JSON;
    some bodies are an error page)."""
    s = table(spark, sf_dir, "supplier")
    category = F.element_at(F.array(*[F.lit(x) for x in ("exchange", "mixer", "sanctions", "gambling")]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    said = F.to_json(F.struct(F.when(F.col("s_suppkey") % 5 != 4, category).alias("category"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 101).alias("riskScore"), F.array(F.lit("seen")).alias("tags")))
    return s.select(hex_id(F.col("s_suppkey"), 40).alias("address"), F.lit("Ethereum").alias("chain"), F.when(F.col("s_suppkey") % 7 == 6, "<html>502</html>").otherwise(said).alias("body"))


def event_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose metadata is cut off, no object or missing here and there."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 11
    return e.select("event_id", F.when(k == 3, F.substring("props", 1, 4)).when(k == 5, "[1]").when(k != 7, F.col("props")).alias("metadata"))


def investigation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of cases: run_id, case_id, status, started_at, result_summary (JSON)."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    return o.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("case_id"), status.alias("status"), F.col("o_orderdate").cast("timestamp").alias("started_at"), F.to_json(F.struct(F.col("o_orderkey").alias("orders"))).alias("result_summary"))
