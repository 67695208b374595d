"""Wallet and case queries: scans, listings, activity, patterns of amounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundflow.functions.columns import cents, positive, seconds, total
from fundflow.operators.flow import first_hashes


# -- scans ---------------------------------------------------------------
def case_transfers(transactions: DataFrame, wallets: DataFrame, case_id=None, chain: str | None = None, by_hash_alone: bool = False) -> DataFrame:
    """Priced transfers of the case's wallets, each once, in the core shape.

    A transfer is one (tx_hash, from, to) by default, so that transactions of
    several senders keep all their legs; ``by_hash_alone`` keeps one leg per
    hash. Unpriced copies are dropped before copies are.
    """
    mine = wallets if case_id is None else wallets.where(F.col("case_id") == case_id)
    if chain is not None:
        transactions = transactions.where(F.lower("chain") == chain.lower())
    owned = mine.select(F.col("address").alias("_owner")).distinct()
    rows = _touching(transactions.where(positive(F.col("value_usd").cast("double"))), owned)
    key = ["tx_hash"] if by_hash_alone else ["tx_hash", "from_address", "to_address"]
    order = Window.partitionBy(*key).orderBy("timestamp", "block_number", "from_address", "to_address")
    first = rows.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return first.select("tx_hash", "from_address", "to_address", F.col("value_usd").cast("double").alias("value_usd"), "timestamp", "chain", F.coalesce("token_symbol", F.lit("NATIVE")).alias("asset"), "block_number")


def _touching(rows: DataFrame, owned: DataFrame) -> DataFrame:
    """Rows that an owned address sent or got: two equi joins, no row twice."""
    sent = rows.join(owned, F.col("from_address") == F.col("_owner"), "left_semi")
    got = rows.join(owned, F.col("from_address") == F.col("_owner"), "left_anti").join(owned, F.col("to_address") == F.col("_owner"), "left_semi")
    return sent.unionByName(got)


def evidence_rows(transactions: DataFrame) -> DataFrame:
    """One row per hash, unpriced ones too."""
    order = Window.partitionBy("tx_hash").orderBy("timestamp", "block_number")
    return transactions.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def of_wallet(transactions: DataFrame, address: str, wallet_id=None) -> DataFrame:
    """What an address sent or got (addresses are in lower case), or what is
    filed under the wallet."""
    mine = (F.col("from_address") == address.lower()) | (F.col("to_address") == address.lower())
    return transactions.where(mine if wallet_id is None else mine | (F.col("wallet_id") == wallet_id))


def wallet_transactions(transactions: DataFrame, address: str, page: int = 1, page_size: int = 20, wallet_id=None) -> DataFrame:
    """A page of :func:`of_wallet`, latest block first; with total and
    total_pages of all."""
    mine = of_wallet(transactions, address, wallet_id)
    count = mine.agg(F.count("*").alias("total"), F.floor((F.count("*") + page_size - 1) / page_size).alias("total_pages"))
    return mine.orderBy(F.desc("block_number"), "tx_hash").offset((page - 1) * page_size).limit(page_size).join(F.broadcast(count))


def resolve_wallet(wallets: DataFrame, key: str) -> DataFrame:
    """The wallet of this id or address."""
    return wallets.where((F.col("wallet_id").cast("string") == key) | (F.lower("address") == key.lower())).orderBy("wallet_id").limit(1)


# -- listings ------------------------------------------------------------
def listed(rows: DataFrame, filters: dict[str, str | None], known: dict[str, tuple[str, ...]] | None = None, search: tuple[tuple[str, ...], str] | None = None, order: str = "created_at", page: int = 1, page_size: int = 20) -> DataFrame:
    """Filter by comma-separated values per column (values that ``known`` lacks
    are ignored), by a text contained in one of some columns, newest first."""
    for column, values in filters.items():
        if values:
            wanted = [v.strip() for v in values.split(",") if v.strip()]
            wanted = [v for v in wanted if v in known[column]] if known and column in known else wanted
            if wanted:
                rows = rows.where(F.col(column).cast("string").isin(wanted))
    if search:
        columns, text = search
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.contains(F.lower(F.col(c)), F.lit(text.lower()))
        rows = rows.where(hit)
    return rows.orderBy(F.desc(order), rows.columns[0]).offset((page - 1) * page_size).limit(page_size)


def stale(runs: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """``runs`` with those that run for longer than allowed marked as failed."""
    old = (F.col("status") == "running") & (F.col("started_at") < F.lit(as_of).cast("timestamp") - F.expr(f"interval {hours} hours"))
    return runs.withColumn("error_message", F.when(old, "timed out").otherwise(F.col("error_message"))).withColumn("status", F.when(old, "failed").otherwise(F.col("status")))


# -- activity ------------------------------------------------------------
def addresses(transfers: DataFrame) -> DataFrame:
    return transfers.select(F.explode(F.array("from_address", "to_address")).alias("address")).distinct()


def activity(transfers: DataFrame, wallets: DataFrame | None = None) -> DataFrame:
    """Per address: first and last seen, sent and received, transfers (a
    transfer counts for both of its ends); with ``wallets(address, case_id)``
    also the cases that it belongs to."""
    if wallets is not None:
        of = wallets.groupBy("address").agg(F.sort_array(F.collect_set("case_id")).alias("cases"))
        return activity(transfers).join(of, "address", "left")
    legs = transfers.select("timestamp", F.explode(F.array(
        F.struct(F.col("from_address").alias("address"), cents(F.col("value_usd")).alias("sent"), F.lit(None).cast("decimal(38,2)").alias("received")),
        F.struct(F.col("to_address").alias("address"), F.lit(None).cast("decimal(38,2)").alias("sent"), cents(F.col("value_usd")).alias("received")),
    )).alias("l")).select("timestamp", "l.*")
    money = lambda c: F.coalesce(F.sum(c).cast("double"), F.lit(0.0)).alias(f"{c}_usd")
    return legs.groupBy("address").agg(F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), money("sent"), money("received"), F.count("*").alias("tx_count"))


def wallet_stats(transfers: DataFrame) -> DataFrame:
    """Per address: distinct transactions and values, sent and received."""
    sent = transfers.groupBy(F.col("from_address").alias("address")).agg(F.countDistinct("tx_hash").alias("sent_count"), total(F.col("value_usd")).alias("sent_usd"))
    got = transfers.groupBy(F.col("to_address").alias("address")).agg(F.countDistinct("tx_hash").alias("received_count"), total(F.col("value_usd")).alias("received_usd"))
    both = sent.join(got, "address", "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.select("address", zero("sent_count"), zero("sent_usd"), zero("received_count"), zero("received_usd"))


def degrees(transfers: DataFrame) -> DataFrame:
    """In and out degree over distinct edges between different addresses."""
    edges = transfers.where("from_address <> to_address").select("from_address", "to_address").distinct()
    legs = edges.select(F.explode(F.array(F.struct(F.col("from_address").alias("address"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("to_address").alias("address"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("l")).select("l.*")
    return legs.groupBy("address").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum(F.col("i") + F.col("o")).alias("degree"))


def entity_exposure(transfers: DataFrame, entities: DataFrame, samples: int = 20) -> DataFrame:
    """Per labelled service: wallets that dealt with it, transactions, value,
    and the first few wallets."""
    sides = [transfers.select("tx_hash", "value_usd", F.col(a).alias("address"), F.col(b).alias("other")) for a, b in (("from_address", "to_address"), ("to_address", "from_address"))]
    met = sides[0].unionByName(sides[1])
    found = entities.select("name", "entity_type", "address").join(met, "address", "left")
    counts = found.groupBy("name", "entity_type").agg(F.countDistinct("other").alias("wallet_count"), F.countDistinct("tx_hash").alias("tx_count"), F.coalesce(total(F.col("value_usd")), F.lit(0.0)).alias("value_usd"))
    first = Window.partitionBy("name", "entity_type").orderBy("other")
    few = found.select("name", "entity_type", "other").where("other is not null").distinct().withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= samples)
    listed = few.groupBy(F.col("name").alias("_name"), F.col("entity_type").alias("_type")).agg(F.sort_array(F.collect_list("other")).alias("sample_wallets"))
    both = counts.join(listed, F.col("name").eqNullSafe(F.col("_name")) & F.col("entity_type").eqNullSafe(F.col("_type")), "left")
    return both.select(*counts.columns, F.coalesce("sample_wallets", F.expr("cast(array() as array<string>)")).alias("sample_wallets"))


# -- patterns ------------------------------------------------------------
def repeated_amounts(transfers: DataFrame, hours: int = 24, least: int = 3, top: int = 20, rounded: bool = False) -> DataFrame:
    """Senders that repeat one amount within the hours before their chain's
    last transfer; the first five hashes; the most repeated first."""
    value = F.round("value_usd") if rounded else F.col("value_usd")
    ends = transfers.groupBy("chain").agg(F.max("timestamp").alias("end"))
    recent = transfers.join(F.broadcast(ends), "chain").where(F.col("timestamp") >= F.col("end") - F.expr(f"interval {hours} hours"))
    recent, keys = recent.withColumn("amount", value), ["chain", "from_address", "amount"]
    groups = recent.groupBy(*keys).agg(F.count("*").alias("repeats")).where(F.col("repeats") >= least).orderBy(F.desc("repeats"), F.desc("amount"), "from_address", "chain").limit(top)
    listed = first_hashes(recent.join(F.broadcast(groups.select(*keys)), keys, "left_semi"), keys, 5)
    return groups.join(listed.withColumnRenamed("hashes", "tx_hashes"), keys).orderBy(F.desc("repeats"), F.desc("amount"), "from_address", "chain")


def rapid_movements(transfers: DataFrame, max_seconds: int = 300) -> DataFrame:
    """Two hops in a row through one wallet within so many seconds. The hops
    are joined on the wallet and a bucket of time."""
    width = max(1, max_seconds) * 1_000_000
    bucket = F.floor(F.unix_micros("timestamp") / width)
    a = transfers.select(F.col("from_address").alias("w1"), F.col("to_address").alias("w2"), F.col("tx_hash").alias("tx1"), F.col("value_usd").alias("value1"), F.col("timestamp").alias("t1"), F.explode(F.array(bucket, bucket + 1)).alias("b"))
    b = transfers.select(F.col("from_address").alias("w2"), F.col("to_address").alias("w3"), F.col("tx_hash").alias("tx2"), F.col("value_usd").alias("value2"), F.col("timestamp").alias("t2"), bucket.alias("b"))
    gap = seconds(F.col("t1"), F.col("t2"))
    return a.join(b, ["w2", "b"]).where((F.col("w1") != F.col("w3")) & (F.col("tx1") != F.col("tx2")) & (gap >= 0) & (gap <= max_seconds)).select("w1", "w2", "w3", "tx1", "tx2", "value1", "value2", gap.alias("seconds"))


def balance_violations(transfers: DataFrame, opening: DataFrame | None = None, by: tuple[str, ...] = (), fee: str | None = None) -> DataFrame:
    """Addresses per asset (and per other columns, as the case) whose receipts
    and opening don't cover their spends and, if there is such a column, fees."""
    keys, out = [*by, "asset"], cents(F.col("value_usd"))
    spent = out + F.coalesce(cents(F.col(fee)), F.lit(0)) if fee else out
    ends = F.array(F.struct(F.col("to_address").alias("address"), out.cast("decimal(38,2)").alias("v")), F.struct(F.col("from_address").alias("address"), (-spent).cast("decimal(38,2)").alias("v")))
    legs = transfers.select(*keys, F.explode(ends).alias("l")).select(*keys, "l.*")
    if opening is not None:
        legs = legs.unionByName(opening.select(*keys, "address", cents(F.col("amount_usd")).alias("v")))
    return legs.groupBy("address", *keys).agg(F.sum("v").alias("balance")).where("balance < 0").select("address", *keys, F.col("balance").cast("double").alias("balance_usd"))


# -- roll-ups ------------------------------------------------------------
def case_risk(wallets: DataFrame, bounds: tuple[int, int, int] = (75, 40, 20)) -> DataFrame:
    """Per case: wallets by band of risk, attributed ones, mean, worst five."""
    hi, mid, low = bounds
    r = F.coalesce("risk_score", F.lit(0.0))
    count = lambda c, n: F.count_if(c).alias(n)
    worst = F.transform(F.slice(F.sort_array(F.collect_list(F.struct(r.alias("r"), (-F.col("wallet_id")).alias("id"))), asc=False), 1, 5), lambda x: -x["id"])
    return wallets.groupBy("case_id").agg(
        F.count("*").alias("wallet_count"), count(r >= hi, "critical"), count((r >= mid) & (r < hi), "medium"), count((r >= low) & (r < mid), "low"), count(r < low, "minimal"),
        count(F.col("attribution_status") == "attributed", "attributed"), F.round(F.avg(cents(r)).cast("double"), 1).alias("average_risk"), worst.alias("worst_wallets"),
    )


def case_overview(cases: DataFrame, wallets: DataFrame) -> DataFrame:
    """Per case: its state, wallets, chains and high-risk wallets."""
    per = wallets.groupBy("case_id").agg(F.count("*").alias("wallet_count"), F.count_if(F.col("risk_score") >= 75).alias("high_risk"), F.sort_array(F.collect_set("chain")).alias("chains"), F.count_if(F.col("attribution_status") == "pending").alias("pending"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return cases.join(per, "case_id", "left").select("case_id", "case_number", "status", zero("wallet_count"), zero("high_risk"), zero("pending"), F.coalesce("chains", F.expr("cast(array() as array<string>)")).alias("chains"))


def investigation_summary(transactions: DataFrame) -> DataFrame:
    """One row: transactions, distinct addresses, base units moved (a string:
    they exceed any number type)."""
    both = transactions.select(F.explode(F.array("from_address", "to_address")).alias("a")).agg(F.countDistinct("a").alias("unique_addresses"))
    whole = transactions.agg(F.count("*").alias("tx_count"), F.coalesce(F.sum(F.try_to_number("value", F.lit("9" * 38))), F.lit(0)).cast("string").alias("total_value"))
    return whole.join(F.broadcast(both))


def forensic_summary(transfers: DataFrame) -> DataFrame:
    """One row: transfers, value, addresses, chains, first and last."""
    people = addresses(transfers).agg(F.count("*").alias("address_count"))
    whole = transfers.agg(F.count("*").alias("transfer_count"), total(F.col("value_usd")).alias("value_usd"), F.countDistinct("chain").alias("chain_count"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
    return whole.join(F.broadcast(people))


def dataset_summary(transfers: DataFrame, entities: DataFrame) -> DataFrame:
    """Per chain: transfers, value, the largest, addresses, and transfers that
    touch a mixer or a sanctioned address."""
    bad = entities.where(F.col("entity_type").isin("mixer", "sanctioned")).select(F.col("address").alias("_bad")).distinct()
    flagged = _touching(transfers, bad.withColumnRenamed("_bad", "_owner")).select("tx_hash", "from_address", "to_address").distinct().withColumn("_hit", F.lit(True))
    rows = transfers.join(flagged, ["tx_hash", "from_address", "to_address"], "left")
    return rows.groupBy("chain").agg(F.count("*").alias("tx_count"), total(F.col("value_usd")).alias("value_usd"), F.max("value_usd").alias("largest_usd"), F.countDistinct("from_address").alias("senders"), F.countDistinct("to_address").alias("receivers"), F.count_if(F.coalesce("_hit", F.lit(False))).alias("flagged"))
