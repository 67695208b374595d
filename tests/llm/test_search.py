import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from fundflow.llm import ranked_search
from conftest import prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=10):
    """Every document scored for every item."""
    found = [(i, terms(t)) for i, t in docs]
    found = [(i, t) for i, t in found if t]
    n_docs, total = len(found), sum(len(t) for _, t in found)
    df = {}
    for _, t in found:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    asked = {}
    for i, t in items:
        asked.setdefault(i, []).extend(terms(t))
    out = []
    for item, wanted in asked.items():
        scored = []
        for i, t in found:
            m = 25 + 75 * len(t) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * t.count(x) // (1000 * t.count(x) + 8 * m)) for x in wanted if x in df)
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def searched(spark, docs, items, **params):
    df = ranked_search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), **params)
    return sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()], key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(51)
    docs = [(i, prose(rng, rng.choice([5, 60, 200])) + rng.choice(["", " Zürich 中文", " rare" * rng.randrange(4)])) for i in range(400)]
    docs += [(1000 + i, docs[i % 7][1]) for i in range(60)]  # ties
    docs += [(None, docs[3][1]), (None, docs[3][1]), (5, "another text of id five rare"), (2000, None), (2001, "... \n"), (2002, "rare " * 30_000)]
    items = [(i, prose(rng, 12)) for i in range(20)] + [(30, "rare RARE zürich"), (31, None), (32, "unseenword"), (33, docs[3][1]), (34, "the"), (30, "of five"), (None, "中文")]
    return docs, items


def test_against_all_scores(spark, corpus):
    assert searched(spark, *corpus) == plain(*corpus)


@pytest.mark.parametrize("shard_docs,block,known", [(16, 40, 1_000_000), (7, 1, 3)])
def test_small_shards_and_blocks(spark, corpus, monkeypatch, shard_docs, block, known):
    monkeypatch.setattr(ranked_search, "SHARD_DOCS", shard_docs)
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", block)
    monkeypatch.setattr(ranked_search, "KNOWN_TERMS", known)
    docs, items = corpus
    assert searched(spark, docs, items[:6] + items[20:24], k=3) == plain(docs, items[:6] + items[20:24], k=3)


def test_a_search_ends_early_and_is_whole(monkeypatch):
    """A rare term decides: bounds end the search before the common terms' groups are added."""
    rng, added, n = random.Random(52), [], 3000
    texts = [" ".join(["rare"] * (i < 12) * 3 + [rng.choice("abc") for _ in range(50)]) for i in range(n)]
    shard, found = ranked_search._Shard(), lambda some: next(ranked_search.batches(pa.array(some)))[2]
    shard.add(list(range(n)), found(texts), ranked_search._Known(None))
    n_docs, n_terms, _, lengths, hashes, firsts, doc, tf = (c[0].as_py() for c in shard.row().columns)
    assert n_docs == n and n_terms == sum(len(t.split()) for t in texts)
    lengths, firsts, tf, doc = (np.frombuffer(x, t) for x, t in ((lengths, "<i8"), (firsts, "<i8"), (tf, "<i8"), (doc, "<i4")))
    cells = ranked_search.by_impact(lengths, firsts, doc, tf, n_docs, n_terms)
    ready = ranked_search.Shard(list(range(n)), hashes, *[c.tobytes() for c in cells])
    monkeypatch.setattr(ready, "_add", lambda group, value, among=None, add=ready._add: (added.append((len(group), among is None)), add(group, value, among)))
    h = np.frombuffer(hashes, "<u8")
    weights = [ranked_search.weight(int(df), n) for df in np.diff(firsts)]
    hits = ready.best(ranked_search.Item(1, h, np.array(weights, np.int64)), 10, 1)
    assert added[-1][1] is False and sum(k for k, whole in added if whole) < len(ready.impacts) / 2
    known = {int(ranked_search.terms_of(found([t])).hash[0]): t for t in ("rare", "a", "b", "c")}
    score = lambda words: sum(w * (10**9 * (k := words.count(known[int(x)])) // (1000 * k + 8 * (25 + 75 * len(words) * n // n_terms))) for x, w in zip(h, weights))
    want = sorted((-score(texts[d].split()), d) for d in range(12))
    assert [(-s, d) for s, d in sorted(hits, key=lambda x: (-x[0], x[1]))][:10] == want[:10]


def test_no_documents_no_items_and_clashing_columns(spark, frame, none, odd):
    items = spark.createDataFrame([(1, "no id here"), (2, "a")], "item_id long, text string")
    assert ranked_search.search(none, items).count() == 0 and ranked_search.search(frame(["a b"]), items.limit(0)).count() == 0
    rows = ranked_search.search(odd, items.withColumn("doc_id", items.item_id)).collect()
    want = plain([(r.doc_id, r.text) for r in odd.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in rows], key=repr) == want
