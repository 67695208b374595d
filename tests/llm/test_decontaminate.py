import itertools
import random

from fundflow.llm import decontaminate


def holds(pattern, masks):
    ones = [[i for i, c in enumerate(m) if c == "1"] for m in masks]
    return any(all(pattern[o + i] for i in at) for m, at in zip(masks, ones) for o in range(len(pattern) - len(m) + 1))


def best_run(pattern):
    total = [0, *itertools.accumulate(1 if x else -2 for x in pattern)]
    _, start, stop = max((total[j] - min(total[: j + 1]), total.index(min(total[: j + 1])), j) for j in range(len(total)))
    return sum(pattern[start:stop])


def shortest_runs(run=(), score=0):
    """Beginnings of runs up to the twelfth match; no beginning is below zero."""
    if sum(run) == decontaminate.LEAST:
        yield run
        return
    yield from shortest_runs((*run, 1), score + 1)
    if score >= 2:
        yield from shortest_runs((*run, 0), score - 2)


def test_each_accepted_pattern_has_a_seed():
    runs = list(shortest_runs())
    assert len(runs) > 1000 and all(holds(r, decontaminate.MASKS) for r in runs)
    for n in range(decontaminate.SHORTEST, 26):
        masks = decontaminate.SHORT_MASKS.get(n, decontaminate.MASKS)
        for gone in itertools.combinations(range(n), n // 5):
            p = [int(i not in gone) for i in range(n)]
            assert n >= 16 and best_run(p) >= decontaminate.LEAST or holds(p, masks), (n, gone)


def test_one_word_in_five_changed(spark, frame):
    """Every passage with up to one word in five changed is found, one more is
    not; at the begin, within and at the end of a text."""
    rng = random.Random(7)
    items = {n: [f"i{n}w{k}" for k in range(n)] for n in range(5, 31)}
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    texts, want = [], set()
    for n, words in items.items():
        for trial in range(12):
            for more in (0, 1):
                if more and n > 13:
                    continue
                passage = list(words)
                for k in rng.sample(range(n), n // 5 + more):
                    passage[k] = "changed"
                around = [f"x{rng.randrange(99)}" for _ in range(30)]
                texts.append(" ".join([*around[: 0 if trial % 3 == 0 else 15], *passage, *around[: 0 if trial % 3 == 1 else 15]]))
                if not more:
                    want.add((len(texts) - 1, n))
    got = decontaminate.contaminated(frame(texts), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    for r in got:
        found = texts[r.doc_id][r.start : r.stop].split()
        assert len(found) == r.n_compared and sum(w in items[r.item_id] for w in found) == r.n_matched
        assert r.n_matched >= decontaminate.LEAST or 5 * r.n_matched >= 4 * r.item_id


def test_many_blocks_are_joined(spark, frame, monkeypatch):
    """Seeds joined by shuffle find what one block finds: repeated and null
    texts and items, short items, an item that most documents hold."""
    rng = random.Random(8)
    items = [(n, " ".join(f"i{n}w{k}" for k in range(rng.randrange(5, 40)))) for n in range(60)]
    items += [(60, items[3][1]), (None, items[4][1]), (61, None), (62, ""), (63, "one two")]
    texts = []
    for i in range(150):
        parts = [" ".join(f"x{rng.randrange(50)}" for _ in range(20))]
        for n in rng.sample(range(60), rng.randrange(3)) + [0] * (i % 3 > 0):
            w = items[n][1].split()
            for k in rng.sample(range(len(w)), len(w) // 6):
                w[k] = "changed"
            parts += [" ".join(w), f"y{rng.randrange(9)}"]
        texts.append(" ".join(parts))
    texts += [texts[0], texts[1], None, "", " "]
    docs, bench = frame(texts), spark.createDataFrame(items, "item_id long, text string")
    rows = lambda: sorted(map(repr, decontaminate.with_hits(docs.drop("n_chars"), bench).collect()))
    want = rows()
    assert sum("n_matched" in r for r in want) > 80
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 900)
    for passes, chars in ((100, 1 << 20), (1, 1 << 20), (1, 700)):
        monkeypatch.setattr(decontaminate, "PASSES", passes)
        monkeypatch.setattr(decontaminate, "GROUP_CHARS", chars)
        assert rows() == want
    assert decontaminate.clean(docs, bench).count() == sum("n_matched" not in r for r in want)
