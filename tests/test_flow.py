import math
import random

from pyspark.sql import functions as F

from fundflow.functions.columns import value_weight
from fundflow.operators import flow
from helpers import legs


def test_weights_fall_with_value_and_stay_finite(spark):
    values = [1.0, 10.0, 1e3, 1e6, 1e12, 0.0, -1.0, float("nan"), float("inf")]
    w = [r.w for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", value_weight(F.col("v")).alias("w")).orderBy("i").collect()]
    assert w[:5] == sorted(w[:5], reverse=True) and all(math.isfinite(x) and x > 0 for x in w) and set(w[5:]) == {1e6}


def test_edges_ignore_noise_and_order_hashes(spark):
    e = flow.flow_edges(legs(spark, [("A", "B", 5000, 300, "h5"), ("A", "B", 5000, 60, "h1"), ("A", "B", 5000, 180, "h3"), ("A", "A", 9, 0), ("A", "B", 0, 0), ("A", "B", -10, 0)])).collect()
    assert [(r.capacity_usd, r.tx_count, r.tx_hashes) for r in e] == [(15000.0, 3, ["h1", "h3", "h5"])]


def test_path_prefers_value(spark):
    t = legs(spark, [("S", "X", 10, 0), ("S", "L", 1e6, 1), ("L", "X", 1e6, 2)])
    r = flow.weighted_path(t, "S", "X").collect()[0]
    assert (r.path, r.hops, r.total_usd) == (["S", "L", "X"], 2, 2e6)
    assert flow.weighted_path(t, "S", "nobody").count() == flow.weighted_path(t, "S", "S").count() == flow.weighted_path(t, "S", "X", 1).count() == 0


def test_diamond_and_bottleneck(spark):
    r = flow.max_flow(legs(spark, [("S", "A", 100, 0), ("A", "T", 100, 1), ("S", "B", 50, 2), ("B", "T", 50, 3)]), "S", "T").collect()[0]
    assert r.max_flow_usd == 150 and [p.value_usd for p in r.paths] == [100, 50] and r.paths[0].path == ["S", "A", "T"]
    r = flow.max_flow(legs(spark, [("S", "A", 1e6, 0), ("A", "B", 1e4, 1), ("B", "T", 1e6, 2)]), "S", "T").collect()[0]
    assert (r.max_flow_usd, r.bottleneck_usd, [tuple(c)[:2] for c in r.cut]) == (1e4, 1e4, [("A", "B")])
    r = flow.max_flow(legs(spark, [("S", "A", 1, 0)]), "S", "T").collect()[0]
    assert (r.max_flow_usd, r.cut, r.paths) == (0.0, [], [])


def test_flow_is_what_the_cut_holds():
    rng = random.Random(3)
    for _ in range(60):
        cap = {(f"n{a}", f"n{b}"): float(rng.randrange(1, 30)) for a in range(7) for b in range(7) if a != b and rng.random() < 0.4}
        value, used, near = flow._max_flow(cap, "n0", "n6")
        assert abs(value - sum(c for (a, b), c in cap.items() if a in near and b not in near)) < 1e-6
        for n in {f"n{i}" for i in range(1, 6)}:
            assert abs(sum(f for (a, _), f in used.items() if a == n) - sum(f for (_, b), f in used.items() if b == n)) < 1e-6


def test_rounds_give_the_flow_of_one_task(spark, monkeypatch):
    """Random graphs beyond the bound of a task: same value, a cut of that
    capacity that no path gets around, paths that carry it."""
    rng = random.Random(4)
    for size, share in ((6, 0.5), (9, 0.3)):
        cap = {(f"n{a}", f"n{b}"): float(rng.randrange(1, 30)) for a in range(size) for b in range(size) if a != b and rng.random() < share}
        rows = [(a, b, c, i) for i, ((a, b), c) in enumerate(cap.items())]
        t, sink = legs(spark, rows), f"n{size - 1}"
        want = flow._max_flow(cap, "n0", sink)[0]
        monkeypatch.setattr(flow, "TASK_EDGES", 2)
        got = flow.max_flow(t, "n0", sink, None).first()
        assert abs(got.max_flow_usd - want) < 1e-6 and abs(sum(c.capacity_usd for c in got.cut) - want) < 1e-6 and got.bottleneck_usd == min((c.capacity_usd for c in got.cut), default=0)
        without = {e: c for e, c in cap.items() if e not in {(c.from_address, c.to_address) for c in got.cut}}
        assert flow._max_flow(without | {("n0", "n0x"): 1.0}, "n0", sink)[0] == 0
        used = {}
        for p in got.paths:
            assert p.path[0] == "n0" and p.path[-1] == sink
            for e in zip(p.path, p.path[1:]):
                used[e] = used.get(e, 0.0) + p.value_usd
        assert all(v <= cap[e] + 1e-6 for e, v in used.items()) and [p.value_usd for p in got.paths] == sorted((p.value_usd for p in got.paths), reverse=True)
        assert 0 < sum(p.value_usd for p in got.paths) <= want + 1e-6
