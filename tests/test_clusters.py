from fundflow.operators import clusters
from fundflow.plans import shared
from helpers import legs


def test_gas_funding_burst(spark):
    rows = [("P", f"c{i}", 12, 60 * i) for i in range(5)]
    got = clusters.build_clusters(legs(spark, rows), min_children=3).collect()
    assert [(r.member_count, r.heuristics) for r in got] == [(6, ["gas_funding"])]
    spread = [("P", f"c{i}", 12, 3 * 3600 * i) for i in range(5)]
    assert clusters.gas_funding_links(legs(spark, spread)).count() == 0
    rich = [("P", f"c{i}", 25000, 60 * i) for i in range(5)]
    assert clusters.gas_funding_links(legs(spark, rich)).count() == 0


def test_a_thousand_burners_are_one_cluster(spark):
    rows = [("P", f"b{i:04d}", 4, i) for i in range(1000)] + [(f"b{i:04d}", "SINK", 900, 5000 + i) for i in range(1000)]
    got = clusters.build_clusters(legs(spark, rows)).collect()
    assert [(r.member_count, r.total_value_usd) for r in got] == [(1001, 904000.0)]


def test_cospend(spark):
    got = clusters.build_clusters(legs(spark, [("x", "t", 100, 0, "same"), ("y", "t", 50, 0, "same"), ("z", "t", 1, 0, "other")]), gas_funding=False).collect()
    assert [(r.members, r.total_value_usd) for r in got] == [(["x", "y"], 150.0)]


def test_members_are_rows(spark):
    rows = [("x", "t", 100, 0, "one"), ("y", "t", 50, 0, "one"), ("y", "t", 1, 0, "two"), ("z", "x", 1, 0, "two"), ("q", "t", 9, 0, "three")]
    t = legs(spark, rows)
    assert {(r.root, r.member) for r in clusters.cluster_members(t, gas_funding=False).collect()} == {("x", "x"), ("x", "y"), ("x", "z")}
    assert clusters.cluster_members(t, min_cluster_size=4, gas_funding=False).count() == 0
    [one] = clusters.build_clusters(t, arrays=False, gas_funding=False).collect()
    assert one.member_count == 3 and one.total_value_usd == 152.0 and "members" not in one.asDict()


def test_roles(spark):
    rows = [(f"s{i}", "dep", 100, i) for i in range(3)] + [("dep", "hot", 290, 10)]
    rows += [("boss", f"d{i}", 10, 20 + i) for i in range(6)] + [("v", "mule", 1000, 30), ("mule", "out", 950, 90), ("v", "hold", 100, 40)]
    rows += [(f"i{k}", "mix", 10, 50 + k) for k in range(5)] + [("mix", f"o{k}", 9, 60 + k) for k in range(5)]
    role = {r.address: r.role for r in clusters.wallet_roles(legs(spark, rows)).collect()}
    assert {k: role[k] for k in ("dep", "boss", "mule", "hold", "mix")} == {"dep": "exchange_deposit", "boss": "distributor", "mule": "mule", "hold": "holder", "mix": "mixer"}


def test_cospend_deals_rows_to_tasks_by_their_number(spark, monkeypatch):
    rows = [(f"s{i % 7}{j}", "shop", 1, i, f"tx{i}") for i in range(60) for j in range(3)]
    found = clusters.cospend_links(legs(spark, rows))
    monkeypatch.setattr(shared, "TASK_ROWS", 10)
    dealt = clusters.cospend_links(legs(spark, rows))
    assert dealt.rdd.getNumPartitions() == 18 and sorted(dealt.collect()) == sorted(found.collect()) and dealt.count() == 14
