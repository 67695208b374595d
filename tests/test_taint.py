import random

import pytest

from fundflow.operators import taint
from helpers import legs


def run(spark, rows, sources, model="haircut", **params):
    seeds = spark.createDataFrame(list(sources.items()), "address string, amount_usd double")
    return {r.address: r for r in taint.propagate(legs(spark, rows), seeds, model, **params).collect()}


def test_haircut_dilutes(spark):
    out = run(spark, [("CLEAN", "A", 25000, 0), ("A", "B", 30000, 60), ("A", "C", 50000, 120), ("A", "D", 20000, 180)], {"A": 75000.0})
    assert {a: round(out[a].tainted_value_usd, 6) for a in "ABCD"} == {"A": 75000, "B": 22500, "C": 37500, "D": 15000}
    assert {round(out[a].taint_ratio, 9) for a in "BCD"} == {0.75} and out["A"].hops == 0 and out["B"].hops == 1


def test_models_differ_on_mixed_lots(spark):
    rows = [("CLEAN", "B", 100000, 0), ("A", "B", 100000, 60), ("B", "E", 100000, 120)]
    assert run(spark, rows, {"A": 100000.0})["E"].tainted_value_usd == 50000
    fifo = run(spark, rows, {"A": 100000.0}, "fifo")
    assert fifo["B"].taint_ratio == 0.5 and "E" not in fifo


@pytest.mark.parametrize("model", ["haircut", "fifo"])
def test_horizon_noise_and_empty(spark, model):
    chain = [(a, b, 10000, i) for i, (a, b) in enumerate(zip("ABCD", "BCDE"))]
    assert set(run(spark, chain, {"A": 10000.0}, model, max_hops=2)) == set("ABC")
    assert run(spark, chain, {"A": 10000.0}, model)["E"].hops == 4
    assert set(run(spark, [("A", "B", 0, 0)], {"A": 5.0}, model)) == {"A"}
    assert run(spark, chain, {"A": 0.0}, model) == {}


@pytest.mark.parametrize("model", ["haircut", "fifo"])
def test_random_ledgers_against_a_plain_replay(spark, model):
    """Pruning to what can matter and splitting into components changes nothing."""
    rng = random.Random(7)
    rows = [(f"w{rng.randrange(14)}", f"w{rng.randrange(14)}", rng.randrange(1, 400), i) for i in range(120)]
    rows = [r for r in rows if r[0] != r[1]]
    want = plain(rows, {"w0": 900.0, "w5": 300.0}, model, 3)
    got = run(spark, rows, {"w0": 900.0, "w5": 300.0}, model, max_hops=3, min_taint_usd=0.01)
    assert set(got) == {a for a, v in want.items() if v[1] is not None and v[0] >= 0.01}
    assert all(abs(got[a].tainted_value_usd - want[a][0]) < 1e-6 and got[a].hops == want[a][1] for a in got)


def plain(rows, sources, model, horizon):
    lots = {a: [[v, v]] for a, v in sources.items()}
    dirty, hops = dict(sources), dict.fromkeys(sources, 0)
    for a, b, value, _ in rows:
        have = lots.setdefault(a, [])
        carried, due = 0.0, value
        if model == "fifo":
            while due > 1e-9 and have:
                take = min(have[0][0], due)
                share = have[0][1] * take / have[0][0]
                have[0] = [have[0][0] - take, have[0][1] - share]
                carried, due = carried + share, due - take
                if have[0][0] <= 1e-9:
                    have.pop(0)
        elif have:
            total, bad = have[0]
            carried = min(min(1.0, bad / total) * value, bad) if total > 1e-9 else 0.0
            left = max(0.0, total - value)
            have[0] = [left, max(0.0, min(bad - carried, left))]
        passed = carried if hops.get(a) is not None and hops[a] < horizon else 0.0
        mine = lots.setdefault(b, [])
        if model == "fifo":
            mine.append([value, passed])
        elif mine:
            mine[0] = [mine[0][0] + value, mine[0][1] + passed]
        else:
            mine.append([value, passed])
        dirty[b] = dirty.get(b, 0.0) + passed
        if passed > 1e-9:
            hops[b] = min(hops.get(b, 99), hops[a] + 1)
    return {a: (v, hops.get(a)) for a, v in dirty.items()}


@pytest.mark.parametrize("model", ["haircut", "fifo"])
@pytest.mark.parametrize("seed", [11, 12])
def test_a_component_beyond_a_task(spark, monkeypatch, model, seed):
    """Periods of a few transfers, each in components, give what one task does:
    overdrawn and empty purses, equal times, a hot address."""
    rng = random.Random(seed)
    rows = [(f"w{rng.choice([0, 0, 0, 1, 2, 3, 4, 5, 6, 7])}", f"w{rng.choice([0, 0, 1, 2, 3, 4, 8, 9])}", rng.choice([1, 5, 50, 400, 0.01]), i // 3) for i in range(90)]
    rows = [r for r in rows if r[0] != r[1]]
    sources = {"w0": 300.0, "w3": 120.0, "gone": 7.0}
    want = plain(rows, sources, model, 4)
    for most in (10**6, 40):
        monkeypatch.setattr(taint, "TASK_ROWS", most)
        got = run(spark, rows, sources, model, max_hops=4, min_taint_usd=0.001)
        assert set(got) == {a for a, v in want.items() if v[1] is not None and v[0] >= 0.001}
        assert all(abs(got[a].tainted_value_usd - want[a][0]) < 1e-6 and got[a].hops == want[a][1] for a in got)


def test_periods_and_roots_are_parts(spark, monkeypatch):
    """Of a chain of stars no task gets more than the bound."""
    most, sizes = 20, []
    monkeypatch.setattr(taint, "TASK_ROWS", most)
    solve = taint._period

    def watched(rows, state, roots, *rest):
        counted = rows if roots is None else rows.join(roots, rows.from_address == roots.node)
        sizes.append(rows.count() if roots is None else counted.groupBy("root").count().agg({"count": "max"}).first()[0])
        return solve(rows, state, roots, *rest)

    monkeypatch.setattr(taint, "_period", watched)
    rows = [(f"h{k}", f"m{k}_{i}", 10, 100 * k + i) for k in range(3) for i in range(20)] + [(f"m{k}_{i}", f"h{k + 1}", 10, 100 * k + 50 + i) for k in range(3) for i in range(20)]
    got = run(spark, rows, {"h0": 200.0}, "fifo")
    assert len(sizes) > 3 and max(sizes) <= most and got["h3"].tainted_value_usd == pytest.approx(200) and got["h3"].hops == 6


def test_fifo_pieces_tile_lots(spark):
    """A spend lies over the lots that it consumes; what no lot funds has no piece."""
    rows = [("x", "a", 10, 0), ("x", "a", 20, 1), ("a", "b", 15, 2), ("a", "c", 40, 3), ("x", "a", 5, 4), ("a", "d", 5, 5)]
    moves = taint.numbered(legs(spark, rows).select(*taint.ORDER).coalesce(1), *taint.ORDER)
    seeds = spark.createDataFrame([], "address string, amount_usd double, lot long")
    value = {r.at: r.value_usd for r in moves.collect()}
    found = {(r.to_address, value[r.lot], round(r.share, 9)) for r in taint.pieces(taint.accounts(moves, seeds)).collect()}
    assert found == {("b", 10.0, 1.0), ("b", 20.0, 0.25), ("c", 20.0, 0.75), ("d", 5.0, 1.0)}


def test_components_are_not_found_anew_for_every_halving(spark, monkeypatch):
    rows = [(f"w{i % 9}", f"w{(i * 5 + 1) % 9}", 10, i) for i in range(160)]
    rows = [r for r in rows if r[0] != r[1]]
    want, found = run(spark, rows, {"w0": 300.0}, taint.HAIRCUT, max_hops=4), []
    monkeypatch.setattr(taint, "TASK_ROWS", 20)
    search = taint.components
    monkeypatch.setattr(taint, "components", lambda links: found.append(links.count()) or search(links))
    got = run(spark, rows, {"w0": 300.0}, taint.HAIRCUT, max_hops=4)
    assert found[0] == len(rows) and sum(found) < 2 * len(rows) and {a: (r.tainted_value_usd, r.hops) for a, r in got.items()} == {a: (r.tainted_value_usd, r.hops) for a, r in want.items()}
