"""Queries without SQL take all rows of their tables."""

from datetime import timedelta

import duckdb
import pytest

from fundflow import queries as core
from fundflow.operators import flow
from helpers import T0, legs

START = int(core.START, 16)
hexed = lambda n, w=40: f"0x{n:0{w}x}"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Events 1 to 30, a day apart, from the start to wallets 201, 202, ...;
    suppliers 200 to 231."""
    d = str(tmp_path_factory.mktemp("whole"))
    events = [(i, (T0 + timedelta(days=i)).replace(tzinfo=None), START, "click", 10.0 + i, f'{{"k": {200 + i}}}') for i in range(1, 31)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{d}/events.parquet")
    spark.createDataFrame([(i, f"S{i}", 0, 0.0) for i in range(200, 232)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{d}/supplier.parquet")
    return d


def test_each_payment_is_matched(spark, tables):
    got = {(r.payment_reference, r.chain_tx) for r in core.queries()["fiat_matches"](spark, tables).collect()}
    # the payment of event i is i - 600 seconds apart, at 82 + i % 4 a dollar
    assert got == {(f"UPI{i}", hexed(i, 64)) for i in range(1, 31)}


def test_entities_beyond_the_first_hundred(spark, tables):
    got = core.queries()["attributions"](spark, tables).collect()
    near = {hexed(200 + i) for i in range(1, 31) if (200 + i) % 10 in (0, 1, 2, 4, 5)}
    assert len(got) == 10 and {r.address for r in got} <= near and {r.hops for r in got} == {1}
    assert core.queries()["attribution_summary"](spark, tables).collect()[0].total == 10
    flagged = {r.address for r in core.queries()["risk_assessment_full"](spark, tables).collect() if r.risk_score > 0}
    assert {hexed(203), hexed(206)} <= flagged


def test_long_rings_and_far_services(spark, tmp_path):
    """A ring of six addresses, then a chain of six hops to a service."""
    ring = [(k, k % 6 + 1) for k in range(1, 7)]
    chain = [(START, 301), *((300 + k, 301 + k) for k in range(1, 5)), (305, 210)]
    events = [(i, (T0 + timedelta(seconds=60 * i)).replace(tzinfo=None), a, "click", 100.0, f'{{"k": {b}}}') for i, (a, b) in enumerate(ring + chain)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(210, "far", 0, 0.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    q, d = core.queries(), str(tmp_path)
    assert [r.addresses for r in q["cycles_upto6"](spark, d).collect()] == [[hexed(k) for k in range(1, 7)]]
    assert {r.motif: r.n for r in q["motif_counts"](spark, d).collect()} == {"cycle": 1}
    assert [(r.name, r.hops) for r in q["attributions"](spark, d).collect()] == [("far", 6)]
    assert [(r.total, r.average_hops) for r in q["attribution_summary"](spark, d).collect()] == [(1, 6.0)]


def test_flow_over_many_hops(spark):
    """A short way, and one of 18 hops that carries more."""
    far = ["S", *(f"n{k:02d}" for k in range(17)), "T"]
    rows = [("S", "a", 10, 0), ("a", "T", 10, 1), *((a, b, 70, k) for k, (a, b) in enumerate(zip(far, far[1:])))]
    r = flow.max_flow(legs(spark, [*rows, ("T", "x", 5, 9), ("y", "S", 5, 9)]), "S", "T").collect()[0]
    assert (r.max_flow_usd, [p.value_usd for p in r.paths], r.paths[0].path) == (80.0, [70.0, 10.0], far)
    assert sum(c.capacity_usd for c in r.cut) == 80.0


def test_query_of_flow_has_no_bound(spark, tmp_path):
    way = [START, *range(301, 306), 3]
    events = [(i, (T0 + timedelta(seconds=i)).replace(tzinfo=None), a, "click", 100.0, f'{{"k": {b}}}') for i, (a, b) in enumerate(zip(way, way[1:]))]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert core.queries()["max_flow"](spark, str(tmp_path)).collect()[0].max_flow_usd == 100.0


def test_query_of_mules_has_no_cap_on_an_edge(spark, tmp_path):
    """Twelve transfers from 1 to each of two mules, then one on from each: the
    last of the twelve is the nearest in time, in the query as in its SQL."""
    rows = [(60 * i, 1, m, 100.0) for m in (2, 3) for i in range(12)] + [(60 * 12, m, 4, 100.0) for m in (2, 3)]
    rows += [(60 * i, m, 5, 100.0 + i) for m in (2, 3) for i in range(12)]  # of many to a sink, too: the value decides
    rows += [(60 * 5, 6, m, 110.5) for m in (2, 3)]
    events = [(i, (T0 + timedelta(seconds=at)).replace(tzinfo=None), a, "click", v, f'{{"k": {b}}}') for i, (at, a, b, v) in enumerate(rows)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = core.queries()["mule_hops"](spark, str(tmp_path))
    found = {(int(r.source, 16), int(r.mule, 16), int(r.sink, 16)): (int(r.hash_in, 16), r.gap) for r in got.collect()}
    assert found[1, 2, 4] == (11, 60.0) and found[1, 3, 4] == (23, 60.0) and len(found) == 8
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    said = con.execute(core.oracle_sql()["mule_hops"])
    names = [c[0] for c in said.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(said.fetchall())
