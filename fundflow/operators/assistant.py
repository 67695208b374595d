"""Answers to classified questions, a table of them at once.

:func:`answers` classifies ``questions(id, text)``, hands the questions of each
kind to its handler and unites what they say. A handler joins the things that
its questions name with the engine's results, which it computes once for all of
them, so a thousand questions cost what one does.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundflow.functions.columns import CONFIDENCE, address
from fundflow.operators import attribution, flow, graph, motifs, risk, router, wallets
from fundflow.plans.paths import nearest
from fundflow.plans.shared import stored

SURE, LIKELY, _, NONE = CONFIDENCE[1], CONFIDENCE[2], CONFIDENCE[2], CONFIDENCE[3]
ANSWER = ("id", "kind", "target", "answer", "confidence")


@dataclass
class Tables:
    """What the handlers read: transfers and raw transactions, wallets and cases
    (None where no handler needs them) and entities, and the time at which ages
    are taken."""

    transfers: DataFrame
    transactions: DataFrame
    wallets: DataFrame | None
    cases: DataFrame | None
    entities: DataFrame
    as_of: str


def _said(rows: DataFrame, target: str | Column, known: Column, answer: Column, otherwise: Column, sure: str = SURE, unsure: str | Column = NONE) -> DataFrame:
    target = F.col(target) if isinstance(target, str) else target
    return rows.select("id", "kind", target.cast("string").alias("target"), F.when(known, answer).otherwise(otherwise).alias("answer"), F.when(known, sure).otherwise(unsure).alias("confidence"))


def _text(pattern: str, *columns: Column) -> Column:
    return F.format_string(pattern, *columns)


def resolved(questions: DataFrame, t: Tables) -> DataFrame:
    """Questions whose address is that of the wallet or of the transaction's
    sender that they name, where they name no address."""
    asked = questions.where("tx_hash is not null").select(F.lower("tx_hash").alias("_tx")).distinct()
    sender = t.transactions.select(F.lower("tx_hash").alias("_tx"), "from_address").join(asked, "_tx", "left_semi").groupBy("_tx").agg(F.min("from_address").alias("_sender"))
    known = t.wallets.select(F.col("wallet_id").cast("string").alias("_wallet"), F.col("address").alias("_owner"))
    named = questions.join(sender, F.lower("tx_hash") == F.col("_tx"), "left").join(known, F.col("wallet_id") == F.col("_wallet"), "left")
    return named.withColumn("address", F.coalesce(address(F.col("address")), "_sender", "_owner")).drop("_tx", "_sender", "_wallet", "_owner")


def wallet_risk(t: Tables, max_hops: int = 2) -> DataFrame:
    """Every wallet's score of all twelve factors: with mixers within
    ``max_hops`` and the origins of peel chains."""
    starts = t.entities.where("entity_type = 'mixer'").select(F.col("address").alias("start"))
    senders = t.transfers.select(F.col("from_address").alias("address")).distinct()
    mixers = nearest(t.transfers.where("from_address <> to_address"), starts, max_hops, "both").join(senders, "address", "left_semi")
    peels = motifs.peel_chains(t.transfers, min_length=2).select(F.col("path")[0].alias("address"))
    return risk.assess(t.transactions, t.as_of, entities=t.entities, mixers=mixers, peels=peels)


def risk_summary(questions: DataFrame, t: Tables) -> DataFrame:
    """The score and factors of a wallet; of a case that is named without one,
    how its wallets spread over the bands of risk."""
    scores = wallet_risk(t).select("address", "risk_score", "severity", "factors")
    per = t.cases.join(wallets.case_risk(t.wallets), "case_id", "left").select("case_number", F.lit(True).alias("filed"), "wallet_count", "average_risk", "critical", "medium", "low", "attributed")
    rows = questions.join(scores, "address", "left").join(per, "case_number", "left")
    wallet, case = F.col("risk_score").isNotNull(), F.col("address").isNull() & F.col("filed")
    of_wallet = _text("Wallet %s has a risk of %.1f of 100 (%s): %s.", F.col("address"), F.round("risk_score", 1), F.col("severity"), F.array_join("factors", ", "))
    of_case = F.when(F.col("wallet_count").isNull(), _text("Case %s has no wallets.", F.col("case_number"))).otherwise(
        _text("Case %s has %d wallets with an average risk of %.1f: %d critical, %d medium, %d low; %d are attributed.", *[F.col(c) for c in ("case_number", "wallet_count", "average_risk", "critical", "medium", "low", "attributed")])
    )
    nothing = F.when(F.col("address").isNotNull(), _text("No risk factor of wallet %s.", F.col("address"))).when(F.col("case_number").isNotNull(), _text("There is no case %s.", F.col("case_number"))).otherwise("Name a wallet, a transaction or a case.")
    return _said(rows, F.coalesce("address", "case_number"), F.coalesce(wallet | case, F.lit(False)), F.when(wallet, of_wallet).otherwise(of_case), nothing)


def attributions(questions: DataFrame, t: Tables) -> DataFrame:
    """The services that a wallet's money is nearest to."""
    starts = questions.where("address is not null").select(F.col("address").alias("start")).distinct()
    found = attribution.summary(attribution.attributions(t.transfers, starts, t.entities)).select(F.col("start").alias("address"), "total", "nearest", "highest_score")
    rows = questions.join(found, "address", "left")
    said = _text("Wallet %s leads to %d services, first of all %s (score %.2f).", F.col("address"), F.col("total"), F.col("nearest"), F.col("highest_score"))
    return _said(rows, "address", F.col("total").isNotNull(), said, F.when(F.col("address").isNull(), "Name a wallet.").otherwise(_text("No known service within reach of wallet %s.", F.col("address"))))


def patterns(transfers: DataFrame) -> DataFrame:
    """Peel-like chains, repeated amounts and rapid movements in one table:
    pattern, addresses, value_usd."""
    peels = graph.busy_chains(transfers).select(F.lit("peel_chain").alias("pattern"), "addresses", "value_usd")
    rounds = wallets.repeated_amounts(transfers, rounded=True).select(F.lit("round_amount").alias("pattern"), F.array("from_address").alias("addresses"), (F.col("amount") * F.col("repeats")).alias("value_usd"))
    rapid = wallets.rapid_movements(transfers).select(F.lit("rapid_movement").alias("pattern"), F.array("w1", "w2", "w3").alias("addresses"), F.least("value1", "value2").alias("value_usd"))
    return peels.unionByName(rounds).unionByName(rapid)


def pattern_counts(transfers: DataFrame) -> DataFrame:
    """Per pattern: how many and the greatest value."""
    return patterns(transfers).groupBy("pattern").agg(F.count("*").alias("n"), F.max("value_usd").alias("most_usd"))


def _listed(found: DataFrame, *by: str) -> DataFrame:
    """Per group: total, the counts of each pattern as text, the largest one."""
    per = found.groupBy(*by, "pattern").agg(F.count("*").alias("n"), F.max("value_usd").alias("most_usd"))
    name = lambda c: F.replace(c, F.lit("_"), F.lit(" "))
    counts = F.transform(F.sort_array(F.collect_list(F.struct("pattern", "n"))), lambda c: F.concat(c["n"].cast("string"), F.lit(" "), name(c["pattern"])))  # one of each pattern
    return per.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.array_join(counts, ", ").alias("counts"), name(F.max_by("pattern", F.struct("most_usd", "pattern"))).alias("top"), F.max("most_usd").alias("most"))


def case_patterns(found: DataFrame, cases: DataFrame, wallets: DataFrame) -> DataFrame:
    """The patterns that a wallet of a case takes part in: case_number, pattern,
    value_usd. ``found`` are rows of :func:`patterns` with an ``n``umber each."""
    own = cases.select("case_id", "case_number").join(wallets.select("case_id", "address").distinct(), "case_id").select("case_number", "address")
    members = found.select("n", "pattern", "value_usd", F.explode(F.array_distinct("addresses")).alias("address"))
    return members.join(own, "address").select("case_number", "n", "pattern", "value_usd").distinct().drop("n")


def pattern_detection(questions: DataFrame, t: Tables) -> DataFrame:
    """How many of each pattern there are, and the most valuable one; of those
    that wallets of the case take part in, if one is named."""
    found = stored(patterns(t.transfers).withColumn("n", F.monotonically_increasing_id()), "patterns")
    asked = t.cases.join(questions.select("case_number").distinct(), "case_number", "left_semi")
    per = _listed(case_patterns(found, asked, t.wallets), "case_number")
    every = _listed(found).withColumn("case_number", F.lit(""))
    filed = asked.select("case_number", F.lit(True).alias("filed"))
    rows = questions.withColumn("_of", F.coalesce("case_number", F.lit(""))).join(per.unionByName(every).withColumnRenamed("case_number", "_of"), "_of", "left").join(filed, "case_number", "left")
    where = F.when(F.col("case_number").isNull(), "").otherwise(F.concat(F.lit(" with wallets of case "), "case_number"))
    said = _text("%d suspicious patterns%s: %s. The largest is a %s of %.2f USD.", F.col("total"), where, F.col("counts"), F.col("top"), F.col("most"))
    unknown = F.col("case_number").isNotNull() & F.col("filed").isNull()
    none = F.when(unknown, _text("There is no case %s.", F.col("case_number"))).otherwise(F.concat(F.lit("No suspicious pattern"), where, F.lit(".")))
    return _said(rows, F.coalesce("case_number", "chain"), F.coalesce(F.col("total") > 0, F.lit(False)), said, none, unsure=F.when(unknown, NONE).otherwise(LIKELY))


def fund_flow(questions: DataFrame, t: Tables) -> DataFrame:
    """What a wallet sent and got, and the nearest exchange or bridge."""
    starts = questions.where("address is not null").select(F.col("address").alias("start")).distinct()
    near = graph.paths_to_entities(t.transfers, starts, t.entities, 6, ("exchange", "bridge"), top=5)
    first = near.groupBy(F.col("start").alias("address")).agg(F.min(F.struct("hops", "name")).alias("near"))
    rows = questions.join(wallets.wallet_stats(t.transfers), "address", "left").join(first, "address", "left")
    moved = _text("Wallet %s sent %.2f USD in %d transactions and got %.2f USD in %d. ", F.col("address"), F.col("sent_usd"), F.col("sent_count"), F.col("received_usd"), F.col("received_count"))
    ends = F.when(F.col("near").isNotNull(), _text("Nearest service: %s, %d hops away.", F.col("near.name"), F.col("near.hops"))).otherwise("No exchange or bridge within reach.")
    return _said(rows, "address", F.col("sent_count").isNotNull(), F.concat(moved, ends), F.when(F.col("address").isNull(), "Name a wallet.").otherwise(_text("No transfer of wallet %s.", F.col("address"))))


def entity_lookup(questions: DataFrame, t: Tables) -> DataFrame:
    """The wallet's entity, or else the wallet itself."""
    known = t.entities.groupBy(F.lower("address").alias("address")).agg(F.min(F.struct("name", "entity_type", "confidence")).alias("e"))
    filed = t.wallets.groupBy(F.lower("address").alias("address")).agg(F.max("risk_score").alias("risk"), F.count("*").alias("n"))
    rows = questions.join(known, "address", "left").join(filed, "address", "left")
    said = F.when(F.col("e").isNotNull(), _text("%s belongs to %s (%s, %s).", F.col("address"), F.col("e.name"), F.col("e.entity_type"), F.col("e.confidence"))).otherwise(_text("%s is a wallet without a known owner, in %d cases, with a risk of up to %.0f.", F.col("address"), F.col("n"), F.col("risk")))
    return _said(rows, "address", F.col("e").isNotNull() | F.col("n").isNotNull(), said, F.when(F.col("address").isNull(), "Name an address.").otherwise(_text("Nothing is known of %s.", F.col("address"))))


def case_overview(questions: DataFrame, t: Tables) -> DataFrame:
    """A case's state and wallets; without a case, how many cases there are."""
    per = wallets.case_overview(t.cases, t.wallets).select("case_number", "status", "wallet_count", "high_risk")
    total = t.cases.agg(F.count("*").alias("cases"), F.count_if(F.col("status") == "open").alias("open"))
    rows = questions.join(per, "case_number", "left").join(F.broadcast(total))  # one row
    one = _text("Case %s is %s: %d wallets, %d of high risk.", F.col("case_number"), F.col("status"), F.col("wallet_count"), F.col("high_risk"))
    ask = _text("Name a case; there are %d, %d of them open.", F.col("cases"), F.col("open"))
    return _said(rows, "case_number", F.col("status").isNotNull(), one, F.when(F.col("case_number").isNull(), ask).otherwise(_text("There is no case %s.", F.col("case_number"))))


def timeline(questions: DataFrame, t: Tables) -> DataFrame:
    """Days with transfers, how many there are and the busiest day; of the
    wallet that is named, as sender, or of all."""
    days = flow.temporal_flow(t.transfers, "day", samples=0).select("bucket", F.col("from_address").alias("address"), "tx_count")
    every = days.groupBy("bucket").agg(F.sum("tx_count").alias("tx_count")).select("bucket", F.lit("").alias("address"), "tx_count")
    per = days.unionByName(every).groupBy("address").agg(F.count("*").alias("days"), F.sum("tx_count").alias("n"), F.max_by("bucket", F.struct("tx_count", (-F.unix_micros("bucket")).alias("at"))).alias("peak"), F.max("tx_count").alias("most"))
    rows = questions.withColumn("_who", F.coalesce("address", F.lit(""))).join(per.withColumnRenamed("address", "_who"), "_who", "left")
    who = F.when(F.col("address").isNull(), "All wallets").otherwise(F.concat(F.lit("Wallet "), "address"))
    said = _text("%s: %d transfers on %d days, most on %s (%d).", who, F.col("n"), F.col("days"), F.date_format("peak", "yyyy-MM-dd"), F.col("most"))
    return _said(rows, "address", F.col("n").isNotNull(), said, F.concat(who, F.lit(": no transfers.")))


def comparison(questions: DataFrame, t: Tables) -> DataFrame:
    """The two wallets that a question names, side by side."""
    both = F.regexp_extract_all("text", F.lit(router.NAMED["address"]), F.lit(1))
    pair = questions.withColumn("_a", address(F.get(both, F.lit(0)))).withColumn("_b", address(F.get(both, F.lit(1))))
    stats = wallets.wallet_stats(t.transfers).select(F.col("address").alias("w"), (F.col("sent_usd") + F.col("received_usd")).alias("v"))
    rows = pair.join(stats.toDF("_a", "va"), "_a", "left").join(stats.toDF("_b", "vb"), "_b", "left")
    said = _text("%s moved %.2f USD, %s %.2f USD.", F.col("_a"), F.col("va"), F.col("_b"), F.col("vb"))
    return _said(rows, "address", F.col("va").isNotNull() & F.col("vb").isNotNull(), said, F.lit("Name two wallets that have transfers."))


def general(questions: DataFrame, t: Tables) -> DataFrame:
    """What can be asked, where nothing that is known was."""
    can = ", ".join(k.replace("_", " ") for k in router.KINDS)
    return _said(questions, "chain", F.lit(False), F.lit(""), F.lit(f"Questions of these kinds are answered: {can}."))


HANDLERS: dict[str, Callable[[DataFrame, Tables], DataFrame]] = {
    "risk_summary": risk_summary, "attribution": attributions, "pattern_detection": pattern_detection, "fund_flow": fund_flow, "entity_lookup": entity_lookup,
    "case_overview": case_overview, "timeline": timeline, "comparison": comparison, "general": general,
}
#: Kinds whose handlers go over all transfers, several times each.
MOVING = {"risk_summary", "attribution", "pattern_detection", "fund_flow", "timeline", "comparison"}


def answers(questions: DataFrame, t: Tables) -> DataFrame:
    """``questions(id, text)`` -> id, kind, target, answer, confidence. A
    question that matches no pattern is general. Transfers are made once where
    several handlers go over them."""
    kinds = router.classify(questions, otherwise="general")
    asked = stored(resolved(kinds, t), "questions")
    out, names = None, [r.kind for r in asked.select("kind").distinct().orderBy("kind").collect()]
    if len(MOVING.intersection(names)) > 1:
        t = replace(t, transfers=stored(t.transfers, "asked-transfers"))
    for name in names:
        said = HANDLERS[name](asked.where(F.col("kind") == name), t).select(*ANSWER)
        out = said if out is None else out.unionByName(said)
    return asked.select("id", "kind", F.lit("").alias("target"), F.lit("").alias("answer"), F.lit("").alias("confidence")).limit(0) if out is None else out
