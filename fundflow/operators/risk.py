"""Wallet risk in twelve factors, for all wallets at once.

One aggregate over each wallet's transactions measures what the factors need;
the factors are columns, unpivoted into rows where they are active. Ages are
taken at a given moment, never at "now".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundflow.functions.columns import seconds

# The weight of each factor.
WEIGHTS = {
    "sanctions_hit": 0.30,
    "mixer_interaction": 0.25,
    "peel_chain": 0.20,
    "high_risk_entity": 0.15,
    "rapid_movement": 0.10,
    "round_amounts": 0.08,
    "large_value_transfer": 0.07,
    "cross_chain_bridge": 0.05,
    "contract_interaction": 0.05,
    "new_wallet": 0.03,
    "low_liquidity_token": 0.02,
    "dusting_attack": 0.02,
}
# The least score of each severity, from the top.
SEVERITIES = (("critical", 80), ("high", 60), ("medium", 40), ("low", 5), ("info", 0))
# Scores by kind of entity.
ENTITY_SCORES = {"sanctioned": 100, "mixer": 95, "darknet": 90, "gambling": 70}
# What makes a wallet infrastructure.
INFRASTRUCTURE_TYPES = ("defi", "exchange", "bridge", "merchant")
INFRASTRUCTURE_NAMES = ("uniswap", "sushiswap", "curve", "aave", "binance", "kraken", "coinbase", "router", "exchange", "dex")
BRIDGED = ("USDC", "USDT", "WETH", "MATIC")
BOOST = 1.1
#: Transactions closer than this are rapid.
RAPID_SECONDS = 300


def severity(score: Column) -> Column:
    out = F.lit("info")
    for name, least in reversed(SEVERITIES):
        out = F.when(score >= least, name).otherwise(out)
    return out


def ether(value: Column) -> Column:
    """Base units, as digits, in whole coins; anything else is 0."""
    return F.when(value.rlike("^[0-9]+$"), F.try_divide(value.try_cast("double"), F.lit(1e18))).otherwise(0.0)


def wallet_legs(transactions: DataFrame) -> DataFrame:
    """Each transaction once per wallet that sent or got it."""
    both = F.array_distinct(F.array(F.lower("from_address"), F.lower("to_address")))
    return transactions.select(F.explode(both).alias("address"), "*")


def measures(transactions: DataFrame) -> DataFrame:
    """Per wallet: what the transaction factors look at. Sums alone, so a wallet
    of very many transactions is no task of its own."""
    legs = wallet_legs(transactions).withColumn("eth", ether(F.col("value")))
    symbol = F.upper(F.coalesce("token_symbol", F.lit("")))
    shady = F.coalesce(F.col("token_address") != "", F.lit(False)) & ((symbol == "") | (F.length(symbol) > 10) | symbol.contains("SCAM") | symbol.contains("FAKE"))
    count = lambda c, n: F.count_if(F.coalesce(c, F.lit(False))).alias(n)
    per = legs.groupBy("address").agg(
        F.count("*").alias("tx_count"), F.min("timestamp").alias("first_seen"),
        count((F.col("eth") >= 1) & (F.col("eth") == F.floor("eth")), "round_count"), count(F.col("eth") >= 100, "large_count"), F.max("eth").alias("max_eth"),
        count(symbol.isin(*BRIDGED) & F.lower("method").contains("bridge"), "bridge_count"), count((F.col("method") != "") & (F.col("method") != "transfer"), "contract_count"),
        count(shady, "shady_count"), count((F.col("eth") > 0) & (F.col("eth") <= 0.0001), "dust_count"),
    )
    return per.join(_rapid(legs), "address", "left").withColumn("rapid_count", F.coalesce("rapid_count", F.lit(0)))


def _rapid(legs: DataFrame) -> DataFrame:
    """(address, rapid_count): transactions less than :data:`RAPID_SECONDS` after
    the one before. In a bucket of that width all but the first are; the first
    is compared with the last of the bucket before."""
    at = F.unix_micros("timestamp")
    buckets = legs.where("timestamp is not null").groupBy("address", F.floor(at / (RAPID_SECONDS * 1_000_000)).alias("bucket")).agg(F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    before = buckets.select("address", (F.col("bucket") + 1).alias("bucket"), F.col("last").alias("before"))
    near = F.coalesce(seconds(F.col("before"), F.col("first")) < RAPID_SECONDS, F.lit(False)).cast("long")
    return buckets.join(before, ["address", "bucket"], "left").groupBy("address").agg(F.sum(F.col("n") - 1 + near).alias("rapid_count"))


def factors(transactions: DataFrame, as_of, entities: DataFrame | None = None, mixers: DataFrame | None = None, peels: DataFrame | None = None) -> DataFrame:
    """Active factors: address, factor, score, weight, severity.

    ``entities(address, name, entity_type)`` labels wallets; ``mixers(address,
    hops)`` are mixer interactions; ``peels(address)`` origins of peel chains.
    Each factor keeps its highest score.
    """
    spark = transactions.sparkSession
    m = measures(transactions)
    entities = spark.createDataFrame([], "address string, name string, entity_type string") if entities is None else entities
    mixers = spark.createDataFrame([], "address string, hops int") if mixers is None else mixers
    peels = spark.createDataFrame([], "address string") if peels is None else peels
    known = entities.groupBy(F.lower("address").alias("address")).agg(F.max_by("entity_type", F.struct("entity_type", "name")).alias("entity_type"), F.max_by("name", F.struct("entity_type", "name")).alias("entity_name"))
    near = mixers.groupBy(F.lower("address").alias("address")).agg(F.min("hops").alias("mixer_hops"))
    chains = peels.select(F.lower("address").alias("address"), F.lit(True).alias("peels")).distinct()
    w = m.join(known, "address", "left").join(near, "address", "left").join(chains, "address", "left")
    kind = F.lower(F.coalesce("entity_type", F.lit("")))
    infra = kind.isin(*INFRASTRUCTURE_TYPES)
    for name in INFRASTRUCTURE_NAMES:
        infra = infra | F.contains(F.lower(F.coalesce("entity_name", F.lit(""))), F.lit(name))
    hops = F.col("mixer_hops")
    by_entity = F.lit(0)
    for k, v in ENTITY_SCORES.items():
        by_entity = F.when(kind == k, v).otherwise(by_entity)
    scores = {
        "sanctions_hit": F.when(kind == "sanctioned", 100),
        "mixer_interaction": F.when(hops == 0, 99).when(infra, F.when(hops <= 1, 15).when(hops == 2, 8)).when(hops <= 1, 95).when(hops == 2, 50).when(hops == 3, 25).when(hops > 3, 10),
        "peel_chain": F.when(F.col("peels"), 85),
        "high_risk_entity": by_entity,
        "rapid_movement": F.when(F.col("rapid_count") >= 5, 75).when(F.col("rapid_count") >= 3, 50),
        "round_amounts": F.when(F.col("round_count") >= 5, 60).when(F.col("round_count") >= 3, 35),
        "large_value_transfer": F.when(infra, 0).when(F.col("max_eth") >= 1000, 70).when(F.col("large_count") > 0, 50),
        "cross_chain_bridge": F.when(F.col("bridge_count") > 0, 45),
        "contract_interaction": F.when(F.col("contract_count") > 10, 30),
        "new_wallet": F.when((F.col("tx_count") < 5) & (F.floor(seconds(F.col("first_seen"), F.lit(as_of).cast("timestamp")) / 86400) < 30), 25),
        "low_liquidity_token": F.when(F.col("shady_count") > 0, 55),
        "dusting_attack": F.when(F.col("dust_count") >= 4, 30),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("factor"), F.coalesce(v, F.lit(0)).cast("double").alias("score"), F.lit(WEIGHTS[k]).alias("weight")) for k, v in scores.items()])
    active = w.select("address", F.inline(F.filter(rows, lambda f: f["score"] > 0)))
    return active.withColumn("severity", severity(F.col("score")))


def scores(active: DataFrame) -> DataFrame:
    """Per wallet: risk_score (weighted mean with a boost, at most the highest
    factor), severity and the factors, heaviest first."""
    mean = F.sum(F.col("score") * F.col("weight")) / F.sum("weight") * BOOST
    listed = F.transform(F.sort_array(F.collect_list(F.struct("weight", "factor")), asc=False), lambda x: x["factor"])
    out = active.groupBy("address").agg(F.least(mean, F.max("score"), F.lit(100.0)).alias("risk_score"), F.count("*").alias("factor_count"), listed.alias("factors"))
    return out.withColumn("severity", severity(F.col("risk_score")))


def assess(transactions: DataFrame, as_of, **context: DataFrame) -> DataFrame:
    return scores(factors(transactions, as_of, **context))
