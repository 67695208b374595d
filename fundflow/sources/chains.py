"""Raw chain data as legs: UTXO transactions, token logs, calls, lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fundflow.functions import metadata
from fundflow.functions.codecs import hex_to_decimal_udf, is_evm_udf, tron_address_udf, tron_form_udf
from fundflow.shipping import ship

# Chains by id.
CHAINS = ((1, "Ethereum", "ETH"), (137, "Polygon", "MATIC"), (56, "BSC", "BNB"), (42161, "Arbitrum", "ETH"), (10, "Optimism", "ETH"), (8453, "Base", "ETH"))
# Currencies of the sanctions list by chain.
LISTED_CURRENCIES = {"ETH": "Ethereum", "ETC": "Ethereum Classic", "USDT": "Ethereum", "USDC": "Ethereum", "BNB": "BSC"}
LISTED_ADDRESS = r"Digital Currency Address\s*-\s*([A-Z0-9]+)\s+([a-zA-Z0-9]+)"
TRANSFER_SELECTOR = "a9059cbb"
COINBASE = "COINBASE"


def chains(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CHAINS), "chain_id long, name string, symbol string")


def resolve_chains(rows: DataFrame, name: str = "chain") -> DataFrame:
    """``rows`` with chain_id and native symbol of their chain's name, null for others."""
    known = chains(rows.sparkSession).select("chain_id", F.col("name").alias("_name"), F.col("symbol").alias("native_symbol"))
    return rows.join(F.broadcast(known), F.col(name) == F.col("_name"), "left").drop("_name")


def chain_info(rows: DataFrame, chain_id: str = "chain_id") -> DataFrame:
    """``rows`` with name and native symbol of their chain id, null for others."""
    known = chains(rows.sparkSession).select(F.col("chain_id").alias("_id"), F.col("name").alias("chain_name"), F.col("symbol").alias("native_symbol"))
    return rows.join(F.broadcast(known), F.col(chain_id) == F.col("_id"), "left").drop("_id")


def detect_chain(address: Column) -> Column:
    """1 for valid hex addresses, which alone name no chain; null for others."""
    return F.when(is_evm_udf(address), F.lit(1))


def bitcoins(satoshis: Column) -> Column:
    """Exact, without zeros at the end."""
    text = (satoshis.cast("decimal(30,0)") / F.lit(100_000_000).cast("decimal(10,0)")).cast("decimal(38,8)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")


def block_at(at: Column, anchor_block: int, anchor_time: str, block_seconds: float) -> Column:
    """The block of a time, counted from a known one at a steady pace."""
    drift = (F.unix_micros(at) - F.unix_micros(F.lit(anchor_time).cast("timestamp"))) / 1e6 / block_seconds
    return (F.lit(anchor_block) + F.bround(drift)).cast("long")


def nonces(transactions: DataFrame) -> DataFrame:
    """``transactions`` with the running number of each sender on its chain."""
    order = Window.partitionBy("chain", "from_address").orderBy("timestamp", "tx_hash")
    return transactions.withColumn("nonce", F.row_number().over(order) - 1)


def page_of(rows: DataFrame, order: list[Column | str], page: int = 1, page_size: int = 100) -> DataFrame:
    """One page of rows in order, from 1 on; none beyond the last."""
    return rows.orderBy(*order).offset((max(page, 1) - 1) * page_size).limit(page_size)


def address_legs(legs: DataFrame, address: str, start_block: int = 0, end_block: int | None = None, page: int = 1, page_size: int = 100) -> DataFrame:
    """A page of the UTXO legs ``(txid, from_address, to_address, value,
    leg_index, block_number)`` that touch an address within a window of blocks;
    legs without a block are not confirmed yet and always count."""
    mine = in_blocks(legs, start_block, end_block).where(F.lit(address).isin(F.col("from_address"), F.col("to_address")))
    return page_of(mine, [F.desc("block_number"), "txid", "leg_index"], page, page_size)


def transactions_of_logs(logs: DataFrame, transactions: DataFrame, page: int = 1, page_size: int = 100) -> DataFrame:
    """The transactions behind token logs ``(tx_hash, block_number)``: each hash
    once, a page of them, with what is known of it and the method that its
    input calls."""
    hashes = logs.where("tx_hash <> ''").groupBy("tx_hash").agg(F.min("block_number").alias("_block"))
    few = page_of(hashes, ["_block", "tx_hash"], page, page_size)
    return with_method(transactions.join(F.broadcast(few.select("tx_hash")), "tx_hash", "left_semi"))


def with_method(transactions: DataFrame) -> DataFrame:
    """``method``: the selector (ten characters) at the head of ``input``, null
    for plain payments."""
    return transactions.withColumn("method", F.when(F.length("input") >= 10, F.substring("input", 1, 10)))


def tron_native(entries: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """Native transactions as transfers: the first contract of each entry, if it
    pays TRX or calls a token's transfer.

    ``entries(txID, blockNumber, block_timestamp, ret array<struct<contractRet>>,
    raw_data struct<timestamp, contract array<struct<type, parameter
    struct<value struct<owner_address, to_address, amount, data,
    contract_address>>>>>)``; ``tokens(address, symbol, decimals)``.
    """
    ship(entries.sparkSession)
    tokens = entries.sparkSession.createDataFrame([], "address string, symbol string, decimals int") if tokens is None else tokens
    first = F.get(F.col("raw_data.contract"), F.lit(0))
    rows = entries.select(
        F.col("txID").alias("tx_hash"), F.coalesce(F.col("blockNumber").cast("long"), F.lit(0)).alias("block_number"), F.timestamp_millis(F.coalesce("block_timestamp", "raw_data.timestamp")).alias("timestamp"),
        (F.coalesce(F.get(F.col("ret"), F.lit(0))["contractRet"], F.lit("SUCCESS")) == "SUCCESS").alias("ok"), first["type"].alias("type"), first["parameter"]["value"].alias("v"),
    )
    paid = rows.where("type = 'TransferContract'").select(
        "tx_hash", "block_number", "timestamp", "ok", tron_form_udf("v.owner_address").alias("from_address"), tron_form_udf("v.to_address").alias("to_address"),
        F.coalesce(F.col("v.amount").cast("string"), F.lit("0")).alias("raw_value"), F.lit(None).cast("string").alias("token_address"), F.lit("TRX").alias("asset"), F.lit(6).alias("decimals"), F.lit("TransferContract").alias("method"),
    )
    called = rows.where("type = 'TriggerSmartContract'").withColumn("d", F.regexp_replace(F.lower("v.data"), "^0x", "")).where(F.col("d").startswith(TRANSFER_SELECTOR) & (F.length("d") >= 136))
    known = tokens.select(F.col("address").alias("_token"), F.col("symbol").alias("asset"), "decimals")
    called = called.withColumn("token_address", tron_form_udf("v.contract_address")).join(known, F.col("token_address") == F.col("_token"), "left").select(
        "tx_hash", "block_number", "timestamp", "ok", tron_form_udf("v.owner_address").alias("from_address"), tron_address_udf(F.substring("d", 9, 64)).alias("to_address"),
        hex_to_decimal_udf(F.substring("d", 73, 64)).alias("raw_value"), "token_address", "asset", "decimals", F.lit("transfer").alias("method"),
    )
    both = paid.unionByName(called)
    return both.select(*[c for c in both.columns if c != "decimals"], units(F.col("raw_value"), F.col("decimals")).alias("value"), F.col("decimals").isNotNull().alias("decimals_known"))


def utxo_legs(transactions: DataFrame) -> DataFrame:
    """Account-style legs of UTXO transactions.

    ``transactions(txid, fee, is_coinbase, inputs, outputs)``; inputs and
    outputs are arrays of (address, value). Per transaction and address, what
    came in and went out is netted; every net receiver gets from every net
    sender in proportion, rounded down. A minting transaction without senders
    has one named COINBASE.
    """
    ins = transactions.select("txid", F.inline("inputs")).select("txid", F.coalesce("address", F.lit(COINBASE)).alias("address"), (-F.col("value").cast("decimal(38,0)")).alias("net"))
    outs = transactions.select("txid", F.inline("outputs")).where("address is not null").select("txid", "address", F.col("value").cast("decimal(38,0)").alias("net"))
    net = ins.unionByName(outs).groupBy("txid", "address").agg(F.sum("net").cast("decimal(38,0)").alias("net")).where("net <> 0")
    got = net.where("net > 0").select("txid", F.col("address").alias("to_address"), F.col("net").alias("received"))
    sent = net.where("net < 0").select("txid", F.col("address").alias("from_address"), (-F.col("net")).cast("decimal(38,0)").alias("sent"))
    minted = transactions.where("is_coinbase").select("txid").join(sent, "txid", "left_anti")
    sent = sent.unionByName(got.join(minted, "txid").groupBy("txid").agg(F.lit(COINBASE).alias("from_address"), F.sum("received").cast("decimal(38,0)").alias("sent")))
    totals = sent.groupBy("txid").agg(F.sum("sent").cast("decimal(38,0)").alias("total"))
    share = F.expr("cast(cast(received as decimal(19,0)) * cast(sent as decimal(19,0)) div total as decimal(38,0))")
    legs = got.join(sent, "txid").join(totals, "txid").select("txid", "from_address", "to_address", share.alias("value")).where("value > 0")
    order = Window.partitionBy("txid").orderBy("to_address", "from_address")
    return legs.withColumn("leg_index", F.row_number().over(order) - 1)


def utxo_fees(transactions: DataFrame) -> DataFrame:
    """The stated fee, or what inputs exceed outputs by."""
    total = lambda c: F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x["value"]), F.lit(0))
    return transactions.select("txid", F.coalesce("fee", F.greatest(total("inputs") - total("outputs"), F.lit(0))).alias("fee"))


def units(value: Column, decimals: Column) -> Column:
    """Base units as a number; without decimals, as they are."""
    return F.when(decimals.isNull(), value.try_cast("double")).otherwise(value.try_cast("double") / F.pow(F.lit(10.0), decimals))


def trc20_legs(entries: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """Token transfers: ``entries(transaction_id, block_timestamp, from, to,
    value, token_info(address, symbol, decimals))``; decimals of unknown tokens
    come from ``tokens(address, decimals)``, else values stay raw."""
    tokens = entries.sparkSession.createDataFrame([], "address string, decimals int") if tokens is None else tokens
    known = tokens.select(F.col("address").alias("_token"), F.col("decimals").alias("_decimals"))
    rows = entries.join(known, F.col("token_info.address") == F.col("_token"), "left")
    return rows.select(
        F.col("transaction_id").alias("tx_hash"), F.col("from").alias("from_address"), F.col("to").alias("to_address"), units(F.col("value"), F.coalesce("token_info.decimals", "_decimals")).alias("value"),
        F.timestamp_millis("block_timestamp").alias("timestamp"), F.lit("Tron").alias("chain"), F.col("token_info.symbol").alias("asset"), F.col("token_info.address").alias("token_address"),
    )


def call_transfers(calls: DataFrame) -> DataFrame:
    """``transfer(address, uint256)`` calls decoded from their data:
    ``calls(tx_hash, data)`` -> tx_hash, to_address, value (digits)."""
    ship(calls.sparkSession)
    data = F.regexp_replace(F.lower("data"), "^0x", "")
    good = calls.select("tx_hash", data.alias("d")).where(F.col("d").startswith(TRANSFER_SELECTOR) & (F.length("d") >= 136))
    return good.select("tx_hash", tron_address_udf(F.substring("d", 9, 64)).alias("to_address"), hex_to_decimal_udf(F.substring("d", 73, 64)).alias("value"))


def in_blocks(rows: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """Rows of these blocks, and those without one (0 or null)."""
    none = F.coalesce("block_number", F.lit(0)) == 0
    keep = F.lit(True)
    keep = keep & (F.col("block_number") >= start) if start is not None else keep
    keep = keep & (F.col("block_number") <= end) if end is not None else keep
    return rows.where(none | keep)


def asset_transfers(entries: DataFrame, prices: DataFrame | None = None, categories: tuple[str, ...] = ()) -> DataFrame:
    """``entries(hash, from, to, value, asset, blockNum, blockTimestamp,
    category)`` of an indexer: hex blocks, ISO times; priced if asked; of these
    categories only, if any (``erc20``: token transfers)."""
    if categories:
        entries = entries.where(F.col("category").isin(*categories))
    prices = entries.sparkSession.createDataFrame([], "asset string, usd double") if prices is None else prices
    rows = entries.join(prices.withColumnRenamed("asset", "_asset"), F.col("asset") == F.col("_asset"), "left")
    return rows.select(
        F.col("hash").alias("tx_hash"), F.col("from").alias("from_address"), F.col("to").alias("to_address"), F.col("value").cast("double").alias("value"), (F.col("value") * F.col("usd")).alias("value_usd"),
        F.conv(F.regexp_replace("blockNum", "^0x", ""), 16, 10).cast("long").alias("block_number"), F.try_to_timestamp("blockTimestamp").alias("timestamp"), "asset", "category",
    )


def log_transfers(sent: DataFrame, received: DataFrame) -> DataFrame:
    """Token logs ``(transactionHash, topics, data, blockNumber)`` that an
    address sent and got, one per transaction (the last)."""
    ship(sent.sparkSession)
    both = sent.withColumn("_i", F.lit(0)).unionByName(received.withColumn("_i", F.lit(1)))
    block = F.conv(F.regexp_replace("blockNumber", "^0x", ""), 16, 10).cast("long")
    last = Window.partitionBy("transactionHash").orderBy(F.desc("_i"), F.desc(block), F.desc("data"))
    rows = both.withColumn("_n", F.row_number().over(last)).where("_n = 1")
    end = lambda i: F.concat(F.lit("0x"), F.lower(F.right(F.get("topics", F.lit(i)), F.lit(40))))
    return rows.select(F.col("transactionHash").alias("tx_hash"), end(1).alias("from_address"), end(2).alias("to_address"), hex_to_decimal_udf(F.regexp_replace("data", "^0x", "")).alias("value"), block.alias("block_number"))


def held_tokens(balances: DataFrame) -> DataFrame:
    """Token balances above zero: hex digits other than zeros."""
    return balances.where(F.regexp_replace("tokenBalance", "^0x0*", "") != "")


def sanctioned(rows: DataFrame) -> DataFrame:
    """Listed wallets of a sanctions list without a header: columns by
    position, number 0, name 1, program 3 and remarks 11."""
    c = [F.col(f"`{x}`") for x in rows.columns]
    names, addresses = (F.regexp_extract_all(c[11], F.lit(LISTED_ADDRESS), F.lit(i)) for i in (1, 2))
    found = rows.select(F.trim(c[0]).alias("entry"), F.trim(c[1]).alias("listed"), F.trim(F.translate(c[3], "[]", "")).alias("program"), F.inline(F.arrays_zip(names.alias("currency"), addresses.alias("address"))))
    chain = F.element_at(F.create_map(*[F.lit(x) for kv in LISTED_CURRENCIES.items() for x in kv]), F.col("currency"))
    hits = found.withColumn("chain", chain).where(F.col("chain").isNotNull() & F.col("address").startswith("0x"))
    first = Window.partitionBy("chain", F.lower("address")).orderBy(F.col("entry").try_cast("long"), "entry")
    return hits.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(
        F.concat(F.lit("OFAC: "), F.when(F.col("listed") != "", F.col("listed")).otherwise("Unknown")).alias("name"), F.lit("sanctioned").alias("entity_type"), "address", "chain",
        F.lit("CONFIRMED").alias("confidence"), F.lit("ofac_sdn").alias("source"), "entry", "program", "currency",
    )


def directory(spark: SparkSession, entries: list[tuple[str, str, dict[int, list[str]], str]]) -> DataFrame:
    """(name, type, {chain id: addresses}, confidence) as one row per address."""
    return directory_rows(spark.createDataFrame(entries, "name string, entity_type string, addresses map<long, array<string>>, confidence string"))


def directory_rows(rows: DataFrame) -> DataFrame:
    """A directory's services as one row per address: name, entity_type,
    address, chain, confidence, source; addresses on unknown chains are left out."""
    flat = rows.select("name", "entity_type", "confidence", F.explode("addresses").alias("chain_id", "list")).select("name", "entity_type", "confidence", "chain_id", F.explode("list").alias("address"))
    named = flat.join(F.broadcast(chains(rows.sparkSession).select("chain_id", F.col("name").alias("chain"))), "chain_id")
    return named.select("name", "entity_type", F.lower("address").alias("address"), "chain", "confidence", F.lit("directory").alias("source"))


def intelligence(answers: DataFrame, source: str = "intelligence") -> DataFrame:
    """A provider's answers ``(address, chain, body)`` as a dimension of
    addresses: entity_name (the category, or else the name), entity_category,
    risk_score (0 to 100), is_sanctioned, confidence, tags, source, failed.
    A body that is no JSON object is a failed lookup, without any of these."""
    body = metadata.parsed(F.col("body"))
    said = lambda name, kind="string": F.try_variant_get(body, f"$.{name}", kind)
    return answers.select(
        F.lower("address").alias("address"), "chain", F.coalesce(said("category"), said("name")).alias("entity_name"), said("category").alias("entity_category"), said("riskScore", "double").alias("risk_score"),
        F.coalesce(said("category") == "sanctions", F.lit(False)).alias("is_sanctioned"), said("confidence").alias("confidence"), F.coalesce(said("tags", "array<string>"), F.array().cast("array<string>")).alias("tags"),
        F.lit(source).alias("source"), (~metadata.is_object(F.col("body"))).alias("failed"),
    )
