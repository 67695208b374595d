"""Taint that is carried on from one batch of transfers to the next.

What is kept is small: of every address the money that it owns, the dirt in it,
its hops and what it got; under FIFO, the lots that it hasn't spent. A batch
starts from there: kept money is a receipt before its first transfer. Balances,
shares and pieces of lots are then those of :mod:`fundflow.operators.taint`,
solved forward from the kept dirt, so a history gives the same result however
it is cut into batches, as long as they follow one another in time.

On a stream, transfers wait until the latest one seen is ``late`` ahead of
them, so that those which arrive somewhat out of order still find their place;
what comes later than that is set apart in the table ``late``. Every batch
leaves one version of all tables (:class:`Versions`): a batch that is run again
doesn't count twice, and a stream that is started anew goes on from the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fundflow.functions.columns import address
from fundflow.operators import taint
from fundflow.operators.flow import movements
from fundflow.plans.scans import numbered
from fundflow.plans.shared import discard, stored
from fundflow.shipping import ship
from fundflow.streaming.versions import Versions

#: What is kept of an address; null hops: no dirt has come to it.
KEPT = "address string, balance decimal(38,10), dirt double, hops int, got double, received decimal(38,10)"
#: Unspent lots, in the order of (batch, place).
LOTS = "address string, batch long, place long, amount decimal(38,10), dirt double"
WAITING = "tx_hash string, from_address string, to_address string, value_usd double, timestamp timestamp"
_FIRST = -(1 << 62)


def opening(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, lots) before any transfer."""
    seeds = sources.where("amount_usd > 0").groupBy(address(F.col("address")).alias("address")).agg(F.sum("amount_usd").alias("dirt"))
    money = F.col("dirt").cast("decimal(38,10)")
    kept = seeds.select("address", money.alias("balance"), "dirt", F.lit(0).alias("hops"), F.col("dirt").alias("got"), money.alias("received"))
    return kept, seeds.select("address", F.lit(-1).cast("long").alias("batch"), F.lit(0).cast("long").alias("place"), money.alias("amount"), "dirt")


def advance(kept: DataFrame, lots: DataFrame, transfers: DataFrame, batch: int, model: str, max_hops: int = 6) -> tuple[DataFrame, DataFrame]:
    """(kept, lots) after some transfers that are later than all before."""
    fifo = model == taint.FIFO
    moves = numbered(movements(transfers).select(*taint.ORDER), *taint.ORDER)
    none = F.lit(None)
    if fifo:
        old = numbered(lots, "address", "batch", "place").withColumn("lot", F.col("at") + _FIRST).drop("at")
    else:
        old = stored(kept.select("address", F.col("balance").alias("amount"), F.lit(_FIRST).alias("lot")).where("amount > 0"), "taint-kept")
    owned = stored(taint.accounts(moves, old.select("address", F.col("amount").alias("amount_usd"), "lot")), "taint-accounts")
    rows = stored(taint.pieces(owned) if fifo else taint.shares(owned), "taint-rows")
    known = kept.where("hops is not null").select("address", none.cast("long").alias("lot"), "dirt", "hops", "got")
    if fifo:
        known = known.unionByName(old.where("dirt > 0").select(none.cast("string").alias("address"), "lot", "dirt", none.cast("int").alias("hops"), none.cast("double").alias("got")))
    after = taint.advanced(rows, stored(known, "taint-state"), max_hops, fifo)
    dirty = after.where("address is not null").select("address", "dirt", F.when(F.col("hops") < taint.FAR, F.col("hops")).alias("hops"), "got")
    last = owned.groupBy("address").agg(F.max_by(F.greatest(F.col("balance") + F.col("amount"), F.lit(0).cast("decimal(38,10)")), "at").alias("now"), F.sum(F.when((F.col("amount") > 0) & F.col("other").isNotNull(), F.col("amount"))).alias("came"))
    both = kept.select("address", "balance", "received").join(last, "address", "full").join(dirty, "address", "left")
    exact = lambda c: F.coalesce(c, F.lit(0)).cast("decimal(38,10)")
    new = both.select("address", exact(F.coalesce("now", "balance")).alias("balance"), F.coalesce("dirt", F.lit(0.0)).alias("dirt"), "hops", F.coalesce("got", F.lit(0.0)).alias("got"), (exact("received") + exact("came")).cast("decimal(38,10)").alias("received"))
    left = lots.limit(0)
    if fifo:
        spent = rows.groupBy("lot").agg(F.sum("size").alias("spent"), F.sum("share").alias("gone"))
        held = after.where("lot is not null").select("lot", F.col("dirt").alias("held"))
        all_lots = owned.where("amount > 0").select("address", F.col("at").alias("lot"), "amount").join(spent, "lot", "left").join(held, "lot", "left").join(old.select("lot", F.col("batch").alias("_b"), F.col("place").alias("_p")), "lot", "left")
        rest = (F.col("amount") - F.coalesce("spent", F.lit(0).cast("decimal(38,10)"))).cast("decimal(38,10)")
        left = all_lots.select("address", F.coalesce("_b", F.lit(batch).cast("long")).alias("batch"), F.coalesce("_p", "lot").alias("place"), rest.alias("amount"), F.greatest(F.coalesce("held", F.lit(0.0)) * (1 - F.coalesce("gone", F.lit(0.0))), F.lit(0.0)).alias("dirt")).where("amount > 0")
    new, left = stored(new, "taint-kept"), stored(left, "taint-lots")
    discard(moves, old, owned, rows, after)
    return new, left


def results(kept: DataFrame, model: str, min_taint_usd: float = 1.0) -> DataFrame:
    """What :func:`taint.propagate` gives, from what is kept."""
    received = F.col("received").cast("double")
    tainted = F.least("got", received)
    found = kept.where("hops is not null").select("address", tainted.alias("tainted_value_usd"), received.alias("received_value_usd"), "hops")
    ratio = F.when(F.col("received_value_usd") > taint.EPSILON, F.least(F.lit(1.0), F.col("tainted_value_usd") / F.col("received_value_usd"))).otherwise(0.0)
    return found.where(F.col("tainted_value_usd") >= min_taint_usd).select("address", ratio.alias("taint_ratio"), "tainted_value_usd", "received_value_usd", "hops", F.lit(model).alias("model"))


def in_batches(transfers: DataFrame, sources: DataFrame, batches: list[str], model: str = taint.HAIRCUT, max_hops: int = 6) -> DataFrame:
    """:func:`results` of a history that is cut at these times."""
    ship(transfers.sparkSession)
    kept, lots = opening(sources)
    for i, (low, high) in enumerate(zip([None, *batches], [*batches, None])):
        part = transfers if low is None else transfers.where(F.col("timestamp") >= low)
        before = kept, lots
        kept, lots = advance(kept, lots, part if high is None else part.where(F.col("timestamp") < high), i, model, max_hops)
        discard(*before)
    return results(kept, model)


def follow(stream: DataFrame, sources: DataFrame, folder: str, model: str = taint.HAIRCUT, max_hops: int = 6, late: str = "10 minutes", **options: str) -> StreamingQuery:
    """Keep taint of a stream of transfers in ``folder`` (tables ``kept``,
    ``lots``, ``waiting``, ``late``), which :func:`results` reads; ``options``
    are those of the stream's trigger."""
    spark = ship(stream.sparkSession)
    rows = stream.select(*[f.split()[0] for f in WAITING.split(", ")])

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        versions = Versions(session, f"{folder}/versions")
        done = versions.complete()
        if done and number <= done[-1]:
            return
        if done:
            kept, lots, waiting, missed = (versions.read(t) for t in ("kept", "lots", "waiting", "late"))
            passed = versions.read("passed").first().at
        else:
            kept, lots = opening(sources)
            waiting = missed = session.createDataFrame([], WAITING)
            passed = None
        fresh = stored(batch, "taint-batch")
        missed = missed.unionByName(fresh.where(F.col("timestamp") < F.lit(passed))) if passed else missed
        waiting = stored(waiting.unionByName(fresh.where(F.col("timestamp") >= F.lit(passed)) if passed else fresh), "taint-waiting")
        newest = waiting.agg(F.max("timestamp") - F.expr(f"interval {late}")).first()[0]
        now = max(x for x in (passed, newest) if x is not None) if passed or newest else None
        ready = waiting.where(F.col("timestamp") < F.lit(now)) if now else waiting.limit(0)
        kept, lots = advance(kept, lots, ready, number, model, max_hops)
        rest = waiting.where(F.col("timestamp") >= F.lit(now)) if now else waiting
        versions.write(number, kept=kept, lots=lots, waiting=rest, late=missed, passed=session.createDataFrame([(now,)], "at timestamp"))
        discard(fresh, waiting, kept, lots)

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(**options or {"availableNow": True}).start()


def followed(spark: SparkSession, folder: str, model: str = taint.HAIRCUT, max_hops: int = 6, min_taint_usd: float = 1.0) -> DataFrame:
    """Results as of now: of what the stream kept, and what still waits."""
    versions = Versions(spark, f"{folder}/versions")
    kept, _ = advance(versions.read("kept"), versions.read("lots"), versions.read("waiting"), versions.complete()[-1] + 1, model, max_hops)
    return results(kept, model, min_taint_usd)
