import random
from itertools import permutations

from fundflow.llm import filter_audit
from conftest import prose

DOCS = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


def fails(text):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    return {
        "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * sum(c.isascii() and c.isupper() for c in text) > 3 * len(text), "D": bool(set(text) & set("#$%&*|")),
    }


def plain(docs, labels):
    """Every order applied to the documents, one after the other."""
    texts = [t or "" for _, t, _ in docs]
    rank = lambda i: (i is not None, i or 0)
    bad = [fails(t) | {"E": any(u == t and rank(j[0]) < rank(d[0]) for j, u in zip(docs, texts))} for d, t in zip(docs, texts)]
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    out = {}
    for part in {d[2] or "" for d in docs}:
        mine = [i for i, d in enumerate(docs) if (d[2] or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [i for i in left if bad[i][f]]
                left = [i for i in left if not bad[i][f]]
                total[f] += len(gone)
                failing = [i for i in mine if bad[i][f]]
                alone = sum(sum(bad[i].values()) == 1 for i in failing)
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), alone, sum(docs[i][0] in good for i in gone), sum(docs[i][0] in toxic for i in gone), f]
        for key in out:
            if key[0] == part:
                out[key][6] = total[out[key][6]]
    return {k: tuple(v) for k, v in out.items()}


def audited(spark, docs, labels):
    rows = filter_audit.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(found) == len(rows)
    return found


def test_every_order_against_plain_filtering(spark):
    rng = random.Random(31)
    docs = []
    for i in range(60):
        text = prose(rng, rng.choice([150, 199, 200, 260]))
        text = rng.choice([text, text.upper(), f"{text} #", "same same " * 150, docs[rng.randrange(len(docs))][1] if docs else text])
        docs.append((i, text, rng.choice(["en", "de", None, ""])))
    docs += [(None, None, "en"), (None, "", "en"), (7, "", "de"), (7, "", "de"), (3, docs[0][1], "fr"), (61, "É" * 10 + " $", "xx"), (61, "\x0b \n", "xx")]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 70, 2)] + [(4, 0, 0), (4, 1, 1), (6, None, None), (None, 1, 1)]
    assert audited(spark, docs, labels) == plain(docs, labels)


def test_a_hot_text_is_spread_over_cells(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "CELL_ROWS", 5)
    docs = [(i, "one text of many" if i % 3 else f"text {i}", "en") for i in range(90)]
    found = audited(spark, docs, [])
    assert found["en", "EABCD", 1][:2] == (31, 59) and found == plain(docs, [])


def test_tables_without_rows_and_clashing_columns(spark, none):
    labels = spark.createDataFrame([(1, 1, 0)], LABELS)
    assert filter_audit.audit(none, labels).count() == 0
    docs = spark.createDataFrame([(1, "a b", "en", 5, "x")], f"{DOCS}, part int, bits string")
    rows = filter_audit.audit(docs, labels.withColumn("good", labels.toxic)).collect()
    assert len(rows) == 600 and {r.good_lost for r in rows if r.step == 1 and r.filter_order[0] == "A"} == {1}


def test_other_filters(spark):
    docs = spark.createDataFrame([(1, "a b c", "en"), (2, "a", "en"), (3, "A $", "en")], DOCS)
    rows = filter_audit.audit(docs, spark.createDataFrame([], LABELS), {"s": "has_symbol", "w": "n_words < 3"}).collect()
    assert {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in rows} == {
        ("sw", 1): (2, 1, 0, 0, 1), ("sw", 2): (1, 1, 1, 1, 3), ("ws", 1): (1, 2, 0, 1, 3), ("ws", 2): (1, 0, 1, 0, 1)}
