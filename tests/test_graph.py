import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest

from fundflow.operators import attribution, graph, risk
from fundflow.plans import paths
from fundflow.plans.components import components
from helpers import T0, legs


def test_pagerank_sums_to_one(spark):
    r = {x.address: x.score for x in graph.pagerank(legs(spark, [("a", "b", 100, 0), ("b", "c", 90, 1), ("c", "d", 80, 2), ("e", "c", 10, 3)])).collect()}
    assert abs(sum(r.values()) - 1) < 1e-9 and max(r, key=r.get) == "d"
    r = {x.address: x.score for x in graph.pagerank(legs(spark, [("a", "b", 0, 0), ("b", "a", 0, 1)])).collect()}
    assert abs(r["a"] - r["b"]) < 1e-12


def test_betweenness_of_a_path(spark):
    r = {x.address: x.score for x in graph.betweenness(legs(spark, [("a", "b", 1, 0), ("b", "c", 1, 1), ("c", "d", 1, 2)])).collect()}
    assert r == {"a": 0, "b": 2 / 6, "c": 2 / 6, "d": 0}


def test_rings_are_communities(spark):
    rows = [(a, b, 100, i) for i, (a, b) in enumerate(["ab", "bc", "ca", "xy", "yz", "zx"])]
    w = spark.createDataFrame([("a", 90.0), ("b", 60.0), ("c", 30.0)], "address string, risk_score double")
    got = graph.communities(legs(spark, rows), w).collect()
    assert [(r.members, r.average_risk) for r in got] == [(["a", "b", "c"], 60.0), (["x", "y", "z"], None)]


def _by_dicts(edges):
    """Greedy modularity as :func:`graph._louvain` does it, over names and sets."""
    weight = defaultdict(lambda: defaultdict(float))
    for a, b, w in sorted(edges):
        weight[a][b] += w
        weight[b][a] += w
    groups, moved_once = {v: {v} for v in weight}, True
    while moved_once:
        degree = {v: sum(x.values()) for v, x in weight.items()}
        total, of, inside = sum(degree.values()), {v: v for v in weight}, dict(degree)
        moved, moved_once = True, False
        while moved:
            moved = False
            for v in sorted(weight):
                links, here = defaultdict(float), of[v]
                for u, w in weight[v].items():
                    if u != v:
                        links[of[u]] += w
                inside[here] -= degree[v]
                of[v] = max(sorted({*links, here}), key=lambda c: (round(links.get(c, 0.0) - inside[c] * degree[v] / total, 12), c == here))
                inside[of[v]] += degree[v]
                if of[v] != here:
                    moved = moved_once = True
        merged, new = defaultdict(set), defaultdict(lambda: defaultdict(float))
        for v, c in of.items():
            merged[c] |= groups[v]
        for a, x in weight.items():
            for b, w in x.items():
                new[min(merged[of[a]])][min(merged[of[b]])] += w
        groups, weight = {min(m): m for m in merged.values()}, new
    return sorted(sorted(m) for m in groups.values() if len(m) > 2)


def test_communities_get_numbers(spark, monkeypatch):
    """A worker holds numbers and weights of a component, and no names."""
    rng, louvain = random.Random(7), graph._louvain
    rows = [(f"{c}{a:02d}", f"{c}{b:02d}", rng.choice((0, 5, 7.25, 90)), i) for i, (c, a, b) in enumerate((rng.choice("pqr"), rng.randrange(40), rng.randrange(40)) for _ in range(210)) if a != b]
    edges = defaultdict(float)
    for a, b, w, _ in rows:
        edges[min(a, b), max(a, b)] += w
    want = sorted(m for c in "pqr" for m in _by_dicts([(a, b, w or 1.0) for (a, b), w in edges.items() if a[0] == c]))  # a component each
    found = [sorted(r.members) for r in graph.communities(legs(spark, rows)).collect()]
    assert sorted(found) == want and len(want) > 9
    names = sorted({v for p in edges for v in p if v[0] == "p"})
    number = {v: i for i, v in enumerate(names)}
    links = lambda: [np.array(c) for c in zip(*[(number[a], number[b], w or 1.0) for (a, b), w in edges.items() if a[0] == "p"])]
    once = louvain(links()).tolist()
    monkeypatch.setattr(graph, "LINKS_AT_ONCE", 1)
    assert louvain(links()).tolist() == once
    many = 200_000  # a path; 60 bytes or so per link and way at most
    path = [np.arange(many, dtype=np.int32), np.arange(1, many + 1, dtype=np.int32), np.ones(many)]
    tracemalloc.start()
    start, near, w, order = graph._neighbours(path)
    assert tracemalloc.get_traced_memory()[1] < 120 * many and not path and len(near) == 2 * many
    tracemalloc.stop()


def test_components_against_search(spark):
    rng = random.Random(2)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    near = defaultdict(set)
    for a, b in links:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for s in sorted(near):
        todo = [s]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = want.get(s, s)
                todo += near[x]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_nearest_other_start_against_search(spark, monkeypatch):
    rng = random.Random(5)
    t = spark.createDataFrame([(f"n{rng.randrange(40):02d}", f"n{rng.randrange(40):02d}") for _ in range(60)], "from_address string, to_address string").where("from_address <> to_address")
    starts = spark.createDataFrame([(f"n{i:02d}",) for i in range(0, 40, 3)] + [("away",)], "start string")
    for direction, hops in (("both", 3), ("out", 2)):
        want = {r.address: r.hops for r in paths.shortest_paths(t, starts, hops, direction).where("hops > 0").groupBy("address").agg({"hops": "min"}).toDF("address", "hops").collect()}
        assert {r.address: r.hops for r in paths.nearest(t, starts, hops, direction).collect()} == want
    written, write = [], paths.stored

    def noted(df, *more):
        out = write(df, *more)
        written.append(out.count())
        return out

    monkeypatch.setattr(paths, "stored", noted)
    hub = spark.range(400).selectExpr("concat('s', id) AS from_address", "'hub' AS to_address")
    got = paths.nearest(hub, hub.where("from_address < 's3'").selectExpr("from_address AS start"), 2, "both")
    assert {r.hops for r in got.where("address <> 'hub'").collect()} == {2} and got.count() == 401
    assert max(written) <= 2 * 401  # not a row for each start and address


def test_starts_that_met_enough_are_searched_no_further(spark):
    rng = random.Random(8)
    t = legs(spark, [(f"n{rng.randrange(50):02d}", f"n{rng.randrange(50):02d}", 1, i) for i in range(90)])
    starts = spark.createDataFrame([(f"n{i:02d}",) for i in range(12)] + [("away",)], "start string")
    e = spark.createDataFrame([(f"E{i}", "exchange", f"n{i % 50:02d}", "CONFIRMED") for i in range(1, 60, 4)], "name string, entity_type string, address string, confidence string")
    every = graph.paths_to_entities(t, starts, e, 5).collect()
    for top in (1, 3):
        want = [r for s in {r.start for r in every} for r in sorted((r for r in every if r.start == s), key=lambda r: (r.hops, r.address, r.name))[:top]]
        assert sorted(graph.paths_to_entities(t, starts, e, 5, top=top).collect()) == sorted(want)
    line = legs(spark, [("a", "b", 1, 0), ("b", "c", 1, 1), ("c", "d", 1, 2)])
    met = paths.shortest_paths(line, spark.createDataFrame([("a",)], "start string"), 3, wanted=spark.createDataFrame([("b",)], "address string"))
    assert {r.address for r in met.collect()} == {"a", "b"}


def test_attribution_is_nearest_first(spark):
    t = legs(spark, [("me", "ex", 5, 0), ("me", "hop", 5, 1), ("hop", "br", 5, 2)])
    e = spark.createDataFrame([("X", "exchange", "ex", "CONFIRMED"), ("B", "bridge", "br", "PROBABLE"), ("U", "exchange", "hop", "UNKNOWN")], "name string, entity_type string, address string, confidence string")
    r = attribution.attributions(t, spark.createDataFrame([("me",)], "start string"), e).orderBy("rank").collect()
    assert [(x.name, x.hops, x.attribution_type, x.confidence) for x in r] == [("X", 1, "direct", "CONFIRMED"), ("B", 2, "indirect", "PROBABLE")]
    assert abs(r[0].confidence_score - (0.7 + 0.3 * 0.1)) < 1e-9


def _tx(spark, n):
    kind = "tx_hash string, from_address string, to_address string, value string, timestamp timestamp, token_address string, token_symbol string, method string"
    return spark.createDataFrame([(f"t{i}", "me", "you", "1", T0, None, None, None) for i in range(n)], kind)


def test_risk_of_mixers(spark):
    m = spark.createDataFrame([("me", 1)], "address string, hops int")
    defi = spark.createDataFrame([("me", "Some DEX", "defi")], "address string, name string, entity_type string")
    far = spark.createDataFrame([("me", 2)], "address string, hops int")
    get = lambda **c: {r.address: (round(r.risk_score, 6), r.severity) for r in risk.assess(_tx(spark, 6), "2024-06-01", **c).collect()}
    assert get(mixers=m)["me"][0] <= 95 and risk.factors(_tx(spark, 1), "2030-01-01", mixers=m).where("factor = 'mixer_interaction'").first().score == 95
    one = risk.factors(_tx(spark, 1), "2030-01-01", mixers=far, entities=defi).where("address = 'me'").collect()
    assert [(r.factor, r.score, r.severity) for r in one] == [("mixer_interaction", 8.0, "low")]


def test_betweenness_against_every_shortest_path(spark):
    """Small random graphs, all shortest paths listed; one batch and several."""
    import random
    from collections import defaultdict, deque

    rng = random.Random(3)
    names = [f"n{i:02d}" for i in range(14)]
    edges = {(rng.choice(names), rng.choice(names)) for _ in range(34)} - {(x, x) for x in names}
    nxt, nodes = defaultdict(list), sorted({x for e in edges for x in e})
    for a, b in sorted(edges):
        nxt[a].append(b)
    want = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        ways, queue = {s: [[s]]}, deque([s])
        while queue:
            v = queue.popleft()
            for w in nxt[v]:
                if w not in ways:
                    ways[w] = []
                    queue.append(w)
                if not ways[w] or len(ways[w][0]) == len(ways[v][0]) + 1:
                    ways[w] += [[*p, w] for p in ways[v]]
        for t, paths in ways.items():
            for p in paths if t != s else ():
                for v in p[1:-1]:
                    want[v] += 1 / len(paths)
    scale = (len(nodes) - 1) * (len(nodes) - 2)
    t = legs(spark, [(a, b, 1, i) for i, (a, b) in enumerate(sorted(edges))])
    for pairs in (10**6, 60):
        got = {r.address: r.score for r in graph.betweenness(t, pairs).collect()}
        assert set(got) == set(nodes) and all(abs(got[v] - want[v] / scale) < 1e-9 for v in nodes)


def test_betweenness_counts_what_is_reached(spark, monkeypatch):
    """Senders that got nothing are never reached, and search as one where they pay the same."""
    calls, inner = [], graph._dependencies
    monkeypatch.setattr(graph, "_dependencies", lambda *a: calls.append(a) or inner(*a))
    rows = [(f"s{i:02d}", m, 1, i) for i in range(40) for m in ("m", "k")[: 1 + i % 2]] + [("m", "t", 1, 50), ("k", "t", 1, 50), ("k", "s00", 1, 60)]
    got = {r.address: r.score * 42 * 41 for r in graph.betweenness(legs(spark, rows), pairs_per_batch=50).collect()}
    assert len(calls) == 1 and len(got) == 43
    # 20 even senders to t over m, 20 odd ones over either, 20 odd ones to s00 over k, k to m over s00
    assert {a: round(v, 6) for a, v in got.items() if v} == {"m": 30.0, "k": 30.0, "s00": 1.0}


@pytest.mark.parametrize(("measure", "few", "most"), [("betweenness", 0, 15), ("betweenness", 500_000, 15), ("centrality", 500_000, 100)])
def test_betweenness_follows_only_edges_between(spark, monkeypatch, measure, few, most):
    """400 senders around a hub: none of them is tried as a step on the way back
    of another, and nothing is broadcast but tables counted as small."""
    monkeypatch.setattr(graph, "FEW_ROWS", few, raising=False)
    rows = [e for i in range(400) for e in ((f"s{i:03d}", "hub", 1, i), (f"s{i:03d}", f"m{i:03d}", 1, i))] + [("hub", "x", 1, 0), ("hub", "y", 1, 0), ("x", "z", 1, 0)]
    store = spark._jsparkSession.sharedState().statusStore()
    ran = lambda: {e.executionId() for i in range(store.executionsList().size()) for e in [store.executionsList().apply(i)]}
    before = ran()
    n = 400 + 400 + 4
    got = {r.address: r["betweenness" if measure == "centrality" else "score"] * (n - 1) * (n - 2) for r in getattr(graph, measure)(legs(spark, rows)).collect()}
    # hub: 400 senders to x, y and z; x: 400 senders and the hub to z
    assert len(got) == n and {a: round(v, 6) for a, v in got.items() if v} == {"hub": 1200.0, "x": 401.0}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    joined = broadcast = 0
    for e in ran() - before:
        nodes, said = store.planGraph(e).allNodes(), store.executionMetrics(e)
        for node in (nodes.apply(i) for i in range(nodes.size())):
            broadcast += "BroadcastExchange" in node.name()
            metrics = [node.metrics().apply(i) for i in range(node.metrics().size())]
            joined += sum(int(said.apply(m.accumulatorId()).replace(",", "")) for m in metrics if "Join" in node.name() and m.name() == "number of output rows" and said.contains(m.accumulatorId()))
    assert 0 < joined < most * len(rows) and (few or not broadcast)  # centrality: with the rounds of PageRank


def test_busy_chains_look_at_the_most_valuable_ends(spark):
    rng = random.Random(3)
    names = [f"n{i:02d}" for i in range(14)]
    t = legs(spark, [(*rng.sample(names, 2), rng.randrange(1, 40), i) for i in range(150)])
    v = {}
    for r in t.collect():
        v[r.from_address, r.to_address] = v.get((r.from_address, r.to_address), 0) + r.value_usd
    walks = [[a, b, c, d] for a, b in v for c in names for d in names if (b, c) in v and (c, d) in v and len({a, b, c, d}) == 4]
    want = sorted((-(v[a, b] + v[b, c] + v[c, d]), [a, b, c, d]) for a, b, c, d in walks)
    for top in (1, 3, 20):
        found = graph.busy_chains(t, 3, 0, top=top)
        assert [(-r.value_usd, r.addresses) for r in found.collect()] == want[:top]
        assert "row_number" in found._jdf.queryExecution().optimizedPlan().toString()  # not all walks are made


def test_chains_ship_digests_as_bytes(spark):
    import hashlib

    from fundflow.operators import evidence

    said = [hashlib.sha256(b"x").hexdigest(), "AB" * 32, "plain", "0" * 64, "0" * 64 + "\n"]
    chain = evidence.hash_chain(spark.createDataFrame(list(enumerate(said)), "position long, record_hash string"))
    link, want = evidence.EMPTY, []
    for h in said:
        link = hashlib.sha256((link + h).encode()).hexdigest()
        want.append((h, link))
    assert [(r.record_hash, r.link) for r in chain.orderBy("position").collect()] == want
    assert "unhex" in chain._jdf.queryExecution().optimizedPlan().toString().lower()
