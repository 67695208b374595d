import random
import re
from collections import defaultdict

import pytest

from fundflow.llm import jaccard_join, line_dedup, substring_dedup
from conftest import prose


def shingle_sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def components(sets):
    up = list(range(len(sets)))
    root = lambda x: x if up[x] == x else root(up[x])
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 80 * len(a | sets[j]):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return [root(i) for i in range(len(sets))]


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies of all degrees, shared passages, short texts."""
    rng = random.Random(11)
    passage = prose(rng, 60)
    out = [None, "", "one", "one", "two words", "Two Words"]
    for _ in range(12):
        base = prose(rng, 120).split()
        for _ in range(rng.randrange(2, 12)):
            copy = base[:]
            for _ in range(rng.randrange(0, 9)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            out.append(" ".join(copy))
    out += [prose(rng, 40) + " " + passage + " " + prose(rng, rng.randrange(5, 60)) for _ in range(25)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("small", [False, True])
def test_near_duplicates_against_all_pairs(frame, corpus, small, monkeypatch):
    if small:  # families, chunks, hubs and salts at a size that a test can hold
        monkeypatch.setattr(jaccard_join, "WIDE", 2)
        monkeypatch.setattr(jaccard_join, "CHUNK", 3)
        monkeypatch.setattr(jaccard_join, "HOT", 1)
        monkeypatch.setattr(jaccard_join, "SKETCHES", 5)
        monkeypatch.setattr(jaccard_join, "BROADCAST_BLOCKS", 2)
    sets = shingle_sets(corpus)
    want = {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, components(sets)))}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(frame(corpus)).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(want)


def test_one_of_each_group_stays(frame, corpus, odd, none):
    sets = shingle_sets(corpus)
    kept = {r.doc_id for r in jaccard_join.without_near_duplicates(frame(corpus)).collect()}
    assert kept == set(components(sets))
    rows = jaccard_join.near_duplicates(odd).collect()
    assert len(rows) == 11 and {r.component_id for r in rows if r.doc_id is None} == {None}
    left = jaccard_join.without_near_duplicates(odd)
    assert left.columns == odd.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 5, 5, 6, 7, 8]
    assert jaccard_join.near_duplicates(none).count() == 0


def test_rows_without_ids_and_ids_of_several_texts(frame):
    """Clean rows stay: those of a reused id, and those without an id that no other row copies."""
    rng = random.Random(12)
    a, b, c, d, e = (prose(rng, 60) for _ in range(5))
    texts, ids = [a, a, b, c, c, d, e, e, "", "", " "], [5, None, None, None, None, 7, 7, 7, None, None, 8]
    docs = frame(texts, ids)
    got = sorted(((r.doc_id or 0), r.text) for r in jaccard_join.without_near_duplicates(docs).collect())
    assert got == sorted([(5, a), (0, b), (0, c), (7, d), (7, e), (0, ""), (0, ""), (8, " ")])
    found = sorted(((r.doc_id or 0), r.component_id or 0) for r in jaccard_join.near_duplicates(docs).collect())
    assert found == sorted([(5, 5), (0, 5), *[(0, 0)] * 5, *[(7, 7)] * 3, (8, 8)])
    wide = docs.toDF("doc_id", "text", "TEXT", "node", "version")
    left = jaccard_join.without_near_duplicates(wide)
    assert left.columns == wide.columns and left.count() == 8


def test_columns_that_clash(frame):
    """User columns pass, whatever their names; the counts replace columns of theirs."""
    docs = frame([f"Common\nown {i}" for i in range(3)])
    wide = docs.toDF("doc_id", "text", "keep", "TEXT", "n_lines")
    rows = line_dedup.dedup_lines(wide, 2)
    assert rows.columns == ["doc_id", "text", "keep", "TEXT", "n_lines", "n_dropped"]
    assert {tuple(r)[1:] for r in rows.collect()} == {(f"own {i}", "en", "src0", 2, 1) for i in range(3)}
    odd = docs.toDF("doc_id", "text", "_id", "_version", "version")
    assert {tuple(r)[1:3] for r in line_dedup.dedup_lines(odd, 2).collect()} == {(f"own {i}", "en") for i in range(3)}


def test_many_repeated_lines(frame, monkeypatch):
    """Beyond the broadcast, all but the most frequent lines are joined by shuffle."""
    rng = random.Random(13)
    lines = [f"line {i}" for i in range(30)]
    texts = ["\n".join(rng.sample(lines, 6) + ["everywhere"]) for _ in range(40)]
    want = {tuple(r) for r in line_dedup.dedup_lines(frame(texts), 9, keep_first=True).collect()}
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 3)
    monkeypatch.setattr(line_dedup, "CELL_DOCS", 1)
    assert {tuple(r) for r in line_dedup.dedup_lines(frame(texts), 9, keep_first=True).collect()} == want


def test_lines(frame, odd, none):
    texts = [f"Common line\nown line {i}\n\n \tCOMMON LINE " for i in range(12)] + ["rare", None, "", "common line"]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(texts), 10).collect()}
    assert [(got[0].text, got[0].n_lines, got[0].n_dropped), (got[12].text, got[12].n_dropped), (got[15].text, got[15].n_dropped)] == [("own line 0\n", 4, 2), ("rare", 0), ("", 1)]
    assert got[13].text is None and got[13].n_lines == 1
    first = {r.doc_id: r for r in line_dedup.dedup_lines(frame(texts), 2, keep_first=True).collect()}
    assert first[0].text.startswith("Common line") and first[0].n_dropped == 1 and first[1].n_dropped == 2
    assert line_dedup.dedup_lines(odd, 2).count() == 11 and line_dedup.dedup_lines(none, 2).count() == 0
    assert line_dedup.line_key.__name__ and line_dedup.dedup_lines(frame(["É\né"] * 10), 10).first().n_dropped == 2
    many = "\n".join(f"l{i}" for i in range(500))
    assert line_dedup.dedup_lines(frame([many] * 9 + [many + "\nx"]), 10).where("doc_id = 9").first().text == "x"


def test_passages_are_found_with_their_places(frame, odd, none):
    rng = random.Random(8)
    passage = prose(rng, 60)
    texts = [prose(rng, 80) for _ in range(20)]
    for i in (3, 7, 12):
        cut = texts[i].index(" ", 120)
        texts[i] = f"{texts[i][:cut]} {passage} {texts[i][cut + 1:]}"
    spans = substring_dedup.repeated_spans(frame(texts)).collect()
    assert {r.doc_id for r in spans} == {7, 12} and all(r.kept_in == [3] for r in spans)
    for r in spans:
        assert texts[r.doc_id][r.start : r.stop].strip() in passage and r.n_words >= 40
    left = {r.doc_id: r.text for r in substring_dedup.without(frame(texts), substring_dedup.repeated_spans(frame(texts))).collect()}
    assert left[3] == texts[3] and len(left[7]) < len(texts[7]) - 200 and left[7][:100] == texts[7][:100]
    assert {r.doc_id for r in substring_dedup.repeated_spans(odd).collect()} <= {4, 5}
    assert substring_dedup.repeated_spans(none).count() == 0


def test_tree_prunes_no_link():
    import numpy as np

    from fundflow.llm.signature_tree import link_across, link_all, linked

    rng = np.random.default_rng(3)
    sets = []
    for _ in range(8):
        base = rng.integers(0, 1 << 63, 400).astype(np.uint64)
        sets += [np.unique(np.concatenate([base[: rng.integers(250, 400)], rng.integers(0, 1 << 63, rng.integers(0, 80)).astype(np.uint64)])) for _ in range(9)]
    linked_pairs = defaultdict(set)
    for i in range(len(sets)):
        for j in range(i):
            if linked(sets[i], sets[j]):
                linked_pairs[i].add(j)
    a = link_all(sets, list(range(len(sets))))
    assert all(a.root(i) == a.root(j) for i, js in linked_pairs.items() for j in js) and len({a.root(i) for i in range(len(sets))}) > 8
    b = link_across(sets[:40], list(range(40)), sets[40:], list(range(40, len(sets))))
    assert all(b.root(i) == b.root(j) for i, js in linked_pairs.items() for j in js if j < 40 <= i)
