"""Taint propagation: how much of what an address received is illicit.

What an address owns doesn't depend on taint, so balances come first, for all
addresses at once: an address that spends more than it was seen to receive
starts again from nothing, which makes its balance the running sum of what came
in and went out, less the least value that sum has had. Taint is then a linear
system, and sparse:

* Haircut: a spend takes the same share of the money and of the dirt that its
  sender owns, namely its value over the balance (all of it at most).
* FIFO: what an address got tiles a line, in the order in which it came, and so
  does what it spent of it. A spend carries the dirt of the lots it lies over,
  in proportion. Both tilings are merged by one sort (:func:`pieces`).

The system is triangular in time, and solved forward. Money can only meet
within a connected component of the transfers of a period, and a component has
to fit a task: where one has more than :data:`TASK_ROWS` transfers, the period
is cut into as many as that calls for. What is dirty at the end of a period is a table from which the next
one goes on, so a component of any size is spread over tasks, each of which
holds the dirty addresses (and FIFO lots) of its part alone. Addresses with
very many transfers are cut into ranges of time for the balances.

The order of transfers is (timestamp, tx_hash, from, to, value). Money is summed
as decimals of ten places, so results don't depend on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundflow.functions.columns import address
from fundflow.operators.flow import movements
from fundflow.plans.components import components
from fundflow.plans.scans import numbered, running, slice_of
from fundflow.plans.shared import discard, stored
from fundflow.shipping import ship

HAIRCUT, FIFO = "haircut", "fifo"
EPSILON = 1e-9
#: Transfers (FIFO: pieces of them) of a component that one task goes through.
TASK_ROWS = 1_000_000
ORDER = ("timestamp", "tx_hash", "from_address", "to_address", "value_usd")
#: What is known of dirty addresses, and (FIFO) of dirty lots, at some time.
STATE = "address string, lot long, dirt double, hops int, got double"
FAR = 1 << 30  # hops of what no countable dirt has reached


def _tens(c: Column) -> Column:
    return c.cast("decimal(38,10)")


def _exact(c: str) -> Column:
    return _tens(F.col(c))


# -- what taint doesn't change ---------------------------------------------


def accounts(moves: DataFrame, seeds: DataFrame) -> DataFrame:
    """Receipts and spends with what their address had before them.

    ``moves`` are :func:`numbered`; ``seeds(address, amount_usd, lot)`` come
    before all of them, as receipts whose number is their (negative) lot.
    Columns: address, at, other, amount (spends are negative), balance, and
    ``received``, all that the address got before.
    """
    legs = F.explode(F.array(
        F.struct(F.col("from_address").alias("address"), F.col("to_address").alias("other"), (-_exact("value_usd")).alias("amount")),
        F.struct(F.col("to_address").alias("address"), F.col("from_address").alias("other"), _exact("value_usd").alias("amount")),
    )).alias("leg")
    events = moves.select("at", legs).select("leg.address", "at", "leg.other", "leg.amount")
    planted = seeds.select("address", F.col("lot").alias("at"), F.lit(None).cast("string").alias("other"), _exact("amount_usd").alias("amount"))
    every = events.unionByName(planted).withColumn("gain", F.greatest("amount", F.lit(0).cast("decimal(38,10)")))
    ran = running(every, "address", "amount", also="gain")
    return ran.select("address", "at", "other", "amount", _tens(F.col("before") - F.col("low")).alias("balance"), _tens(F.col("also_before")).alias("received"))


def shares(owned: DataFrame) -> DataFrame:
    """Haircut: at, from_address, to_address, share of its money that a spend takes."""
    value, balance = -F.col("amount").cast("double"), F.col("balance").cast("double")
    share = F.when(balance > EPSILON, F.least(F.lit(1.0), value / balance)).otherwise(0.0)
    return owned.where("amount < 0").select("at", F.col("address").alias("from_address"), F.col("other").alias("to_address"), share.alias("share"))


def pieces(owned: DataFrame) -> DataFrame:
    """FIFO: at, from_address, to_address, lot, size, share of that lot's money; a row
    for each spend and lot that overlap.

    Lots tile the line of all receipts, spends (as far as they were funded) the
    same line, each in order of time. Sorted by where they begin, every begin
    opens a piece of the lot and the spend that were begun last.
    """
    zero = F.lit(0).cast("decimal(38,10)")
    spent = F.least(-F.col("amount"), F.col("balance"))
    begins = owned.select(
        "address", F.when(F.col("amount") > 0, F.struct("at", F.col("amount").alias("size"))).alias("lot"),
        F.when((F.col("amount") < 0) & (spent > zero), F.struct("at", F.col("other").alias("to_address"), (F.col("received") - F.col("balance") + spent).alias("end"))).alias("spend"),
        F.when(F.col("amount") > 0, F.col("received")).otherwise(F.col("received") - F.col("balance")).alias("pos"),
    ).where("lot is not null or spend is not null")
    along = Window.partitionBy("address").orderBy("pos", F.col("lot").isNull())
    covering = begins.select("address", "pos", F.last("lot", ignorenulls=True).over(along).alias("lot"), F.last("spend", ignorenulls=True).over(along).alias("spend"), F.lead("pos").over(along).alias("next"))
    size = F.least(F.coalesce("next", "spend.end"), F.col("spend.end")) - F.col("pos")
    found = covering.where("lot is not null and spend is not null").withColumn("size", size).where(F.col("size") > zero)
    return found.select(F.col("spend.at").alias("at"), F.col("address").alias("from_address"), F.col("spend.to_address").alias("to_address"), F.col("lot.at").alias("lot"), "size", (F.col("size").cast("double") / F.col("lot.size").cast("double")).alias("share"))


# -- solving forward in time -------------------------------------------------


class _Dirt:
    """Dirty addresses of one component: what they hold, how near they are to a
    source, what dirt they got; and lots of theirs, under FIFO."""

    def __init__(self, max_hops: int):
        self.max_hops, self.holds, self.hops, self.got, self.lots = max_hops, {}, {}, {}, {}

    def know(self, who: str | None, lot: int | None, dirt: float, hops: int, got: float) -> None:
        if who is None:
            self.lots[lot] = dirt
        else:
            self.holds[who], self.hops[who], self.got[who] = dirt, hops, got

    def arrive(self, a: str, b: str, dirt: float, lot: int) -> None:
        """Dirt that has left a, on its way to b; beyond the horizon it is lost."""
        near = self.hops.get(a, FAR)
        if dirt <= 0 or near >= self.max_hops:
            return
        self.holds[b] = self.holds.get(b, 0.0) + dirt
        self.got[b] = self.got.get(b, 0.0) + dirt
        self.lots[lot] = dirt
        self.hops[b] = min(self.hops.get(b, FAR), near + 1 if dirt > EPSILON else FAR)

    def haircut(self, rows: Iterator[tuple]) -> None:
        for at, a, b, _, share in rows:
            held = self.holds.get(a, 0.0)
            if held > EPSILON:
                leaves = held * share
                self.holds[a] = held - leaves
                self.arrive(a, b, leaves, at)

    def fifo(self, rows: Iterator[tuple]) -> None:
        """Pieces of a spend follow one another."""
        now, dirt = None, 0.0
        for at, a, b, lot, share in rows:
            if now is not None and now[0] != at:
                self.arrive(now[1], now[2], dirt, now[0])
                dirt = 0.0
            now = at, a, b
            dirt += share * self.lots.get(lot, 0.0)
        if now:
            self.arrive(now[1], now[2], dirt, now[0])

    def state(self, fifo: bool) -> pd.DataFrame:
        lots = self.lots if fifo else {}
        none, far = [None] * len(lots), [None] * len(self.holds)
        real = lambda x: pd.Series(x, dtype="float64")
        return pd.DataFrame({
            "address": pd.Series([*self.holds, *none], dtype="object"), "lot": pd.array([*far, *lots], "Int64"), "dirt": real([*self.holds.values(), *lots.values()]),
            "hops": pd.array([*[int(self.hops[who]) for who in self.holds], *none], "Int64"), "got": real([*[self.got[who] for who in self.holds], *none]),
        })


def _solved(frames: Iterator[pd.DataFrame], max_hops: int, fifo: bool) -> Iterator[pd.DataFrame]:
    """Components one after the other: what is known first, then rows by time."""
    root, dirt = None, _Dirt(max_hops)
    rest: list[tuple] = []

    def run() -> None:
        (dirt.fifo if fifo else dirt.haircut)(iter(rest))
        rest.clear()

    for frame in frames:
        for of, own in frame.groupby("root", sort=False):
            if of != root:
                run()
                yield dirt.state(fifo)
                root, dirt = of, _Dirt(max_hops)
            known = own[own.row_kind == 0]
            for r in zip(known.address, known.lot, known.dirt, known.hops, known.got):
                dirt.know(None if pd.isna(r[0]) else r[0], *r[1:])
            todo = own[own.row_kind == 1]
            rest += zip(todo["at"], todo.from_address, todo.to_address, todo.lot, todo.share)
            if rest:  # the last spend may go on in the next frame
                cut = next((i for i in range(len(rest), 0, -1) if rest[i - 1][0] != rest[-1][0]), 0) if fifo else len(rest)
                ready, rest[:] = rest[:cut], rest[cut:]
                (dirt.fifo if fifo else dirt.haircut)(iter(ready))
    run()
    yield dirt.state(fifo)


def _period(rows: DataFrame, state: DataFrame, roots: DataFrame | None, max_hops: int, fifo: bool) -> DataFrame:
    """The state after these rows, of all that was dirty before or is now."""
    if roots is None:  # few enough for one task
        rows, known, idle = rows.withColumn("root", F.lit("")), state.withColumn("root", F.lit("")), None
    else:
        of = roots.select(F.col("node").alias("_node"), "root")
        dirty = state.where("address is not null").join(of, F.col("address") == F.col("_node"), "left").drop("_node")
        rows = rows.join(of, F.col("from_address") == F.col("_node")).drop("_node")
        rows = rows.join(dirty.select("root").distinct(), "root", "left_semi")  # no dirt comes to the others
        lots = state.where("lot is not null").drop("address").join(rows.select("lot", "root").distinct(), "lot") if fifo else None
        known = dirty.where("root is not null")
        known = known if lots is None else known.unionByName(lots.withColumn("address", F.lit(None).cast("string")).select(known.columns))
        idle = dirty.where("root is null").drop("root")
        idle = idle if not fifo else idle.unionByName(state.where("lot is not null").join(rows.select("lot").distinct(), "lot", "left_anti").select(idle.columns))
    todo = rows.select("root", "at", "from_address", "to_address", F.col("lot") if fifo else F.lit(None).cast("long").alias("lot"), "share", F.lit(1).alias("row_kind"))
    both = known.withColumn("row_kind", F.lit(0)).unionByName(todo, allowMissingColumns=True).fillna(0, ["at", "lot"])  # numbers stay whole numbers in pandas
    parts = 1 if roots is None else int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(parts, "root").sortWithinPartitions("root", "row_kind", "at")
    after = dealt.mapInPandas(lambda frames: _solved(frames, max_hops, fifo), STATE)
    return stored(after if idle is None else after.unionByName(idle), "taint-state")


def advanced(rows: DataFrame, state: DataFrame, max_hops: int, fifo: bool) -> DataFrame:
    """The state after all ``rows``, period by period; gives up ``state``. Where
    a component is too large, time is cut at once into as many periods as its
    rows call for, so components aren't found anew for every halving."""
    if rows.count() <= TASK_ROWS:
        after = _period(rows, state, None, max_hops, fifo)
    else:
        roots = stored(components(rows.select(F.col("from_address").alias("a"), F.col("to_address").alias("b"))), "taint-roots")
        largest = rows.join(roots, F.col("from_address") == F.col("node")).groupBy("root").count().agg(F.max("count")).first()[0]
        low, high = rows.agg(F.min("at"), F.max("at")).first()
        if largest > TASK_ROWS and low < high:  # a single spend is never cut
            discard(roots)
            periods = -(-largest * 5 // (4 * TASK_ROWS))  # a little shorter than need be, as cuts are approximate
            cuts = rows.agg(F.percentile_approx("at", [k / periods for k in range(1, periods)], max(10_000, 100 * periods))).first()[0]
            cuts = sorted({min(c, high - 1) for c in cuts})
            for after, until in zip([low - 1, *cuts], [*cuts, high]):
                state = advanced(rows.where((F.col("at") > after) & (F.col("at") <= until)), state, max_hops, fifo)
            return state
        after = _period(rows, state, roots, max_hops, fifo)
        discard(roots)
    discard(state)
    return after


def propagate(transfers: DataFrame, sources: DataFrame, model: str = HAIRCUT, max_hops: int = 6, min_taint_usd: float = 1.0) -> DataFrame:
    """``sources(address, amount_usd)`` -> address, taint_ratio,
    tainted_value_usd, received_value_usd, hops, model."""
    if model not in (HAIRCUT, FIFO):
        raise ValueError(model)
    ship(transfers.sparkSession)
    seeds = sources.where("amount_usd > 0").groupBy(address(F.col("address")).alias("address")).agg(F.sum("amount_usd").alias("amount_usd"))
    seeds = stored(seeds.withColumn("lot", -1 - F.monotonically_increasing_id()), "taint-seeds")
    moves = numbered(movements(transfers).select(*ORDER), *ORDER)
    owned = accounts(moves, seeds)
    rows = pieces(owned) if model == FIFO else shares(owned)
    rows = stored(rows.repartition(slice_of("at")).sortWithinPartitions("at"), "taint-rows")  # a period reads little else
    planted = seeds.select("address", F.lit(None).cast("long").alias("lot"), F.col("amount_usd").alias("dirt"), F.lit(0).alias("hops"), F.col("amount_usd").alias("got"))
    lots = seeds.select(F.lit(None).cast("string").alias("address"), "lot", F.col("amount_usd").alias("dirt"), F.lit(None).cast("int").alias("hops"), F.lit(None).cast("double").alias("got"))
    state = advanced(rows, stored(planted.unionByName(lots) if model == FIFO else planted, "taint-state"), max_hops, model == FIFO)
    discard(rows)
    found = state.where((F.col("address").isNotNull()) & (F.col("hops") < FAR)).select("address", "got", "hops")
    came = moves.select(F.col("to_address").alias("address"), _exact("value_usd").alias("v")).unionByName(seeds.select("address", _exact("amount_usd").alias("v")))
    total = came.groupBy("address").agg(F.sum("v").cast("double").alias("received_value_usd"))
    both = found.join(total, "address").withColumn("tainted_value_usd", F.least("got", "received_value_usd"))
    ratio = F.when(F.col("received_value_usd") > EPSILON, F.least(F.lit(1.0), F.col("tainted_value_usd") / F.col("received_value_usd"))).otherwise(0.0)
    return both.where(F.col("tainted_value_usd") >= min_taint_usd).select("address", ratio.alias("taint_ratio"), "tainted_value_usd", "received_value_usd", "hops", F.lit(model).alias("model"))


def default_sources(transfers: DataFrame, wallets: DataFrame, top: int = 3) -> DataFrame:
    """The riskiest wallets as sources of all that they sent, or else got."""
    worst = wallets.groupBy("address").agg(F.max("risk_score").alias("risk")).orderBy(F.desc("risk"), "address").limit(top)
    sent = transfers.groupBy(F.col("from_address").alias("address")).agg(F.sum("value_usd").alias("sent"))
    got = transfers.groupBy(F.col("to_address").alias("address")).agg(F.sum("value_usd").alias("got"))
    found = worst.join(sent, "address", "left").join(got, "address", "left")
    return found.select("address", F.when(F.col("sent") > 0, F.col("sent")).otherwise(F.col("got")).alias("amount_usd")).where("amount_usd > 0")


def summary(results: DataFrame, top_n: int = 20) -> DataFrame:
    """The addresses with the most tainted money, rounded for a report."""
    top = results.orderBy(F.desc("tainted_value_usd"), "address").limit(max(0, top_n))
    return top.select(
        "address", F.round("taint_ratio", 6).alias("taint_ratio"), F.round(F.col("taint_ratio") * 100, 2).alias("taint_percent"),
        F.round("tainted_value_usd", 2).alias("tainted_value_usd"), F.round("received_value_usd", 2).alias("received_value_usd"), "hops", "model",
    )
