"""Merging new facts into what is known, and lookups in it.

Tables are values here: each function returns the merged table, to be written
where the caller keeps it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundflow.functions.columns import confidence_rank


def upsert_wallets(known: DataFrame, new: DataFrame) -> DataFrame:
    """Wallets by (address, chain): counters add up, the first and last time
    widen, other facts are replaced where the new row has them. Columns:
    address, chain, label, risk_score, first_seen, last_seen, tx_count,
    sent_usd, received_usd."""
    key = [F.lower("address").alias("address"), "chain"]
    both = known.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    latest = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct("_new", F.col(c)))).alias(c)
    add = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)).cast("decimal(38,2)")).cast(known.schema[c].dataType).alias(c)
    return both.groupBy(*key).agg(latest("label"), latest("risk_score"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), add("tx_count"), add("sent_usd"), add("received_usd"))


def upsert_entities(known: DataFrame, new: DataFrame) -> DataFrame:
    """Entities by (address, chain): the more certain row stays (the newer of
    equals); certainty is compared by rank."""
    both = known.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = Window.partitionBy(F.lower("address"), "chain").orderBy(F.desc(confidence_rank(F.col("confidence"))), F.desc("_new"), "name")
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_new")


def upsert_transactions(known: DataFrame, new: DataFrame) -> DataFrame:
    """Transactions by (tx_hash, chain): facts of the chain stay as first seen,
    value_usd and metadata are replaced where the new row has them, the mark
    is_suspicious always."""
    both = known.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1))).withColumn("tx_hash", F.lower("tx_hash"))
    keys, marked = ("tx_hash", "chain"), ("value_usd", "metadata")
    latest = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct("_new", F.col(c)))).alias(c)
    rest = [c for c in known.columns if c not in (*keys, *marked, "is_suspicious")]
    first = F.min_by(F.struct(*rest), F.struct("_new", *rest)).alias("_first")
    merged = both.groupBy(*keys).agg(first, *map(latest, marked), F.max_by("is_suspicious", F.struct("_new", "is_suspicious")).alias("is_suspicious"))
    return merged.select(*[F.col(f"_first.{c}").alias(c) if c in rest else F.col(c) for c in known.columns])


def wallet_links(wallets: DataFrame, transactions: DataFrame) -> DataFrame:
    """Once each: which known wallet sent or received which transaction of its
    chain (address, chain, tx_hash, direction)."""
    own = wallets.select(F.lower("address").alias("address"), "chain").distinct()
    ends = F.array(F.struct(F.lower("from_address").alias("address"), F.lit("sent").alias("direction")), F.struct(F.lower("to_address").alias("address"), F.lit("received").alias("direction")))
    return transactions.select(F.lower("tx_hash").alias("tx_hash"), "chain", F.inline(ends)).join(own, ["address", "chain"], "left_semi").select("address", "chain", "tx_hash", "direction").distinct()


def entity_links(wallets: DataFrame, entities: DataFrame) -> DataFrame:
    """Once each: which known wallet belongs to which entity of its chain, and
    how surely (address, chain, name, confidence)."""
    own = wallets.select(F.lower("address").alias("address"), "chain").distinct()
    return entities.select(F.lower("address").alias("address"), "chain", "name", "confidence").join(own, ["address", "chain"], "left_semi").distinct()


def update_risk(wallets: DataFrame, scores: DataFrame) -> DataFrame:
    """``wallets`` with the ``scores(address, risk_score)`` that there are."""
    new = scores.groupBy(F.lower("address").alias("_a")).agg(F.max("risk_score").alias("_r"))
    return wallets.join(new, F.lower("address") == F.col("_a"), "left").withColumn("risk_score", F.coalesce("_r", "risk_score")).drop("_a", "_r")


def lookup_entities(wallets: DataFrame, entities: DataFrame) -> DataFrame:
    """``wallets`` with name, entity_type and confidence of their entity (the
    most certain one of their address and chain), null without one."""
    order = Window.partitionBy("_a", "_c").orderBy(F.desc(confidence_rank(F.col("confidence"))), "name")
    best = entities.select(F.lower("address").alias("_a"), F.col("chain").alias("_c"), "name", "entity_type", "confidence").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return wallets.join(best, (F.lower("address") == F.col("_a")) & (F.col("chain") == F.col("_c")), "left").drop("_a", "_c")


def notice_rows(transactions: DataFrame, address: str | None = None, top: int = 20, otherwise: int = 10) -> DataFrame:
    """The latest transactions that touch an address, or else the latest of
    all; with the value of the listed ones (null if none is priced)."""
    mine = transactions.where((F.lower("from_address") == address.lower()) | (F.lower("to_address") == address.lower())) if address else transactions
    listed = mine.orderBy(F.desc("block_number"), "tx_hash").limit(top if address else otherwise)
    total = listed.agg(F.sum("value_usd").cast("double").alias("total_usd"))
    return listed.join(F.broadcast(total)).select("tx_hash", "block_number", F.col("value_usd").cast("double").alias("value_usd"), "total_usd")


def narrative(wallets: DataFrame, bounds: tuple[int, int, int] = (75, 50, 25)) -> DataFrame:
    """Per case: wallets, attributed ones, and how many per band of risk."""
    r, (a, b, c) = F.coalesce("risk_score", F.lit(0.0)), bounds
    return wallets.groupBy("case_id").agg(
        F.count("*").alias("wallet_count"), F.count_if(F.col("attribution_status") == "attributed").alias("attributed"),
        F.count_if(r >= a).alias("critical"), F.count_if((r >= b) & (r < a)).alias("high"), F.count_if((r >= c) & (r < b)).alias("medium"), F.count_if(r < c).alias("low"),
    )


def compare_wallets(stats: DataFrame, left: str, right: str) -> DataFrame:
    """Statistics of two wallets side by side: measure, left, right."""
    two = stats.where(F.col("address").isin(left, right))
    names = [c for c in stats.columns if c != "address"]
    rows = two.select("address", F.inline(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).cast("double").alias("v")) for n in names])))
    return rows.groupBy("measure").agg(F.max(F.when(F.col("address") == left, F.col("v"))).alias("left_value"), F.max(F.when(F.col("address") == right, F.col("v"))).alias("right_value"))


def with_intelligence(wallets: DataFrame, intelligence: DataFrame) -> DataFrame:
    """``wallets`` with what is known of their address on any chain: the
    riskiest answer of an address; ``failed`` where its lookup did."""
    order = Window.partitionBy("_a").orderBy(F.col("failed"), F.desc_nulls_last("risk_score"), "chain", "entity_name")
    best = intelligence.withColumn("_a", F.lower("address")).withColumn("_n", F.row_number().over(order)).where("_n = 1")
    known = best.select("_a", "entity_name", "entity_category", "risk_score", "is_sanctioned", "tags", "failed")
    both = wallets.drop("risk_score").join(known, F.lower("address") == F.col("_a"), "left").drop("_a")
    return both.withColumn("is_sanctioned", F.coalesce("is_sanctioned", F.lit(False)))


def report_sections(cases: DataFrame, wallets: DataFrame, runs: DataFrame) -> DataFrame:
    """The sections of every case's report, a row per line: case_id, section,
    title, line, text. Wallets are listed by risk; the findings are those of the
    latest run, and there is no such section without one."""
    head = F.array(F.concat(F.lit("Case "), "case_number", F.lit(": "), "title"), F.concat(F.lit("Crime type: "), "crime_type"), F.concat(F.lit("Status: "), "status"))
    section = lambda n, title: (F.lit(n).alias("section"), F.lit(title).alias("title"))
    overview = cases.select("case_id", *section(1, "Case Overview"), F.posexplode(head).alias("line", "text"))
    order = Window.partitionBy("case_id").orderBy(F.desc("risk_score"), "address", "wallet_id")
    owned = cases.select("case_id").join(wallets, "case_id", "left").withColumn("line", F.row_number().over(order) - 1)
    listed = F.format_string("- %s (%s) - risk score %.2f, attribution: %s", "address", "chain", "risk_score", "attribution_status")
    tracked = owned.select("case_id", *section(2, "Tracked Wallets"), "line", F.when(F.col("wallet_id").isNull(), "No wallets tracked in this case.").otherwise(listed).alias("text"))
    latest = runs.groupBy("case_id").agg(F.max_by(F.struct("status", "result_summary"), F.struct("started_at", "run_id")).alias("run")).join(cases.select("case_id"), "case_id", "left_semi")
    found = F.array(F.concat(F.lit("Investigation status: "), "run.status"), F.coalesce("run.result_summary", F.lit("{}")))
    findings = latest.select("case_id", *section(3, "Investigation Findings"), F.posexplode(found).alias("line", "text"))
    return overview.unionByName(tracked).unionByName(findings).withColumn("line", F.col("line") + 1)
