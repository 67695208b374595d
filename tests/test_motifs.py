import random

import pytest

from fundflow.operators import motifs
from fundflow.plans import shared
from helpers import legs

FAN = [("src", f"m{i}", 25000, 60 * i) for i in range(4)] + [(f"m{i}", "dep", 24750, 600 + 60 * i) for i in range(4)]


def test_fan(spark):
    r = motifs.fan_out_fan_in(legs(spark, FAN)).collect()
    assert [(x.mule_count, x.value_usd, len(x.tx_hashes)) for x in r] == [(4, 100000.0, 8)]
    late = [(a, b, v, at + 7 * 86400 * (b == "dep")) for a, b, v, at in FAN]
    assert motifs.fan_out_fan_in(legs(spark, late)).count() == 0
    few = [x for x in FAN if "m2" not in x[:2] and "m3" not in x[:2]]
    assert motifs.fan_out_fan_in(legs(spark, few)).count() == 0 and motifs.fan_out_fan_in(legs(spark, few), min_mules=2).count() == 1
    odd = [(a, b, 1e6 if a == "m3" else v, at) for a, b, v, at in FAN]
    assert motifs.fan_out_fan_in(legs(spark, odd)).collect()[0].mules == ["m0", "m1", "m2"]


def test_peel_chain(spark):
    rows, held, at = [("entry", "p0", 1e6, 0)], 1e6, 60
    for i in range(4):
        rows += [(f"p{i}", f"p{i + 1}", held * 0.9, at), (f"p{i}", f"vasp{i}", held * 0.1, at + 1)]
        held, at = held * 0.9, at + 60
    r = motifs.peel_chains(legs(spark, rows)).collect()
    assert [(x.links, len(x.path), x.value_usd) for x in r] == [(4, 6, 1e6)] and r[0].addresses[-4:] == [f"vasp{i}" for i in range(4)]
    assert motifs.peel_chains(legs(spark, rows[:5])).count() == 0 and motifs.peel_chains(legs(spark, rows[:5]), min_length=2).count() == 1


def test_cycles(spark):
    ring = [("a", "b", 50000, 0), ("b", "c", 49000, 300), ("c", "a", 48000, 600)]
    r = motifs.cycles(legs(spark, ring)).collect()
    assert [(x.addresses, x.value_usd, x.span_seconds) for x in r] == [(["a", "b", "c"], 48000.0, 600.0)]
    slow = ring[:2] + [("c", "a", 48000, 400 * 86400)]
    assert motifs.cycles(legs(spark, slow)).count() == 0 and motifs.cycles(legs(spark, slow), window_seconds=500 * 86400).count() == 1
    eight = [(f"n{i}", f"n{(i + 1) % 8}", 10, i) for i in range(8)]
    assert motifs.cycles(legs(spark, eight)).count() == 0 and motifs.cycles(legs(spark, eight), max_length=8).count() == 1


def test_routing(spark):
    got = motifs.detect_motifs(legs(spark, FAN), ("fan_out_fan_in",), min_mules=3)
    assert [r.motif for r in got.collect()] == ["fan_out_fan_in"]
    with pytest.raises(TypeError):
        motifs.detect_motifs(legs(spark, FAN), bogus=1)


@pytest.mark.parametrize("gain", [0.01, 1e9])
def test_fan_pairs_either_way(spark, monkeypatch, gain):
    """Random graphs with hubs: ends that meet on rare mules are all there are."""
    rng = random.Random(5)
    monkeypatch.setattr(motifs, "PREFIX_GAIN", gain)
    name = lambda: rng.choice(["hub1", "hub2", *[f"n{i}" for i in range(14)]])
    edges = {(name(), name()) for _ in range(130)}
    t = legs(spark, [(a, b, 5, i) for i, (a, b) in enumerate(sorted(edges)) if a != b])
    for least in (1, 2, 3):
        out, want = {}, {}
        for a, b in edges:
            if a != b:
                out.setdefault(a, set()).add(b)
        for s in out:
            for m in out[s]:
                for d in out.get(m, ()):
                    if d != s:
                        want[s, d] = want.get((s, d), 0) + 1
        got = {(r.source, r.sink): r.n_mules for r in motifs.fan_pairs(t, least).collect()}
        assert got == {k: n for k, n in want.items() if n >= least}


def test_a_hub_makes_no_pairs_of_its_own(spark, monkeypatch):
    """1,500 sources and sinks around one mule: 2,250,000 paths, of which none is made."""
    n, made = 1500, []
    rows = [(f"s{i}", "hub", 1, i) for i in range(n)] + [("hub", f"t{i}", 1, i) for i in range(n)]
    rows += [(f"s{i}", f"a{i}", 1, i) for i in range(n)] + [(f"b{i}", f"t{i}", 1, i) for i in range(n)]
    rows += [(f"s{i}", "m", 1, i) for i in range(3)] + [("m", f"t{i}", 1, i) for i in range(2)]
    stored = motifs.stored
    monkeypatch.setattr(motifs, "stored", lambda df, name: made.append(stored(df, name)) or made[-1])
    got = {(r.source, r.sink, r.n_mules) for r in motifs.fan_pairs(legs(spark, rows), 2).collect()}
    assert got == {(f"s{i}", f"t{j}", 2) for i in range(3) for j in range(2)} and sum(df.count() for df in made) < 4 * len(rows)


def test_mule_hops_are_dealt_by_rows(spark, monkeypatch):
    """Mules that connect two ends at other times count too; no task gets more
    rows for tables being small on disk."""
    day = 86400
    rows = [("s", "m0", 100, 0), ("m0", "t", 95, 60), ("s", "m1", 100, 0), ("m1", "t", 95, 40 * day), ("s", "m0", 100, 9 * day)]
    rows += [("p", "m0", 100, 20 * day), ("m0", "q", 95, 20 * day + 60), ("s", "m2", 70, 5 * day), ("m2", "t", 70, 5 * day + 9), ("p", "m3", 7, 0), ("m3", "q", 7, 9), ("u", "m3", 7, 0)]
    want = {2: {("s", "m0", "t", 60), ("s", "m2", "t", 9), ("p", "m0", "q", 60), ("p", "m3", "q", 9)}, 3: {("s", "m0", "t", 60), ("s", "m2", "t", 9)}}
    want[1] = want[2] | {("u", "m3", "q", 9)}
    parts, dealt = [], motifs.dealt
    monkeypatch.setattr(shared, "TASK_ROWS", 1)
    monkeypatch.setattr(motifs, "dealt", lambda df, n, *keys: parts.append((keys, n)) or dealt(df, n, *keys))
    for least, hops in want.items():
        parts.clear()
        got = motifs.mule_hops(legs(spark, rows), 1800, least)
        assert {(r.source, r.mule, r.sink, r.gap) for r in got.collect()} == hops
        # last: the paths of ends with too few timely mules, by their sources' receivers
        assert parts == [(("from_address", "to_address"), 12), (("mule", "_bucket", "_band"), 72), (("mule", "sink"), {1: 0, 2: 1, 3: 6}[least])]
