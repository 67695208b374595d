import random
import re

from pyspark.sql import functions as F

from fundflow.llm import substring_dedup
from conftest import prose

GRAM = substring_dedup.MIN_LINE_WORDS


def words_of(text):
    """(start, stop, lower-cased word) of each word."""
    return [(m.start(), m.end(), re.sub("[A-Z]", lambda x: x[0].lower(), m[0])) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]


def removed(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, []).append((r.start, r.stop))
    return out


def repeated_words(texts):
    """By document, the words in runs of GRAM words that an earlier place has, by plain search."""
    seen, out = {}, []
    for doc, text in enumerate(texts):
        words, mine = [w for _, _, w in words_of(text)], set()
        for k in range(len(words) - GRAM + 1):
            if seen.setdefault(tuple(words[k : k + GRAM]), (doc, k)) != (doc, k):
                mine.update(range(k, k + GRAM))
        out.append(mine)
    return out


def test_only_repeated_words_go(frame):
    """Every removed word stands in a repeated run; whole repeated lines and
    paragraphs go, whatever is around them; the first occurrence stays."""
    rng = random.Random(21)
    passages, line = [prose(rng, n) for n in (51, 60, 75, 120)], prose(rng, 20)
    texts = []
    for i in range(120):
        t = prose(rng, rng.randrange(30, 160)).split(" ")
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(t))
            t[at:at] = rng.choice(passages).split(" ")
        text = " ".join(t)
        if i % 3 == 0:
            text = f"{text}\n{line.upper()}  \n{prose(rng, 4)}"
        if i % 5 == 0:
            text = f"{text}\n\nshort one\n{line}\nand two\n\n{prose(rng, 7)}"
        texts.append(text)
    want = repeated_words(texts)
    spans = removed(substring_dedup.repeated_spans(frame(texts)).collect())
    line_key, first = re.sub("[A-Z]", lambda m: m[0].lower(), line), True
    for doc, text in enumerate(texts):
        words, cut = words_of(text), spans.get(doc, [])
        gone = {k for k, (a, b, _) in enumerate(words) for x, y in cut if x <= a and b <= y}
        assert gone <= want[doc], doc
        assert all(x == 0 or text[x - 1].isspace() for x, _ in cut) and all(y == len(text) or text[y - 1].isspace() for _, y in cut)
        at = 0
        for own in text.split("\n"):
            if own.strip().lower() == line_key.lower():
                assert first or any(x <= at and at + len(own.rstrip()) <= y for x, y in cut), doc
                first = False
            at += len(own) + 1
    assert len(spans) > 60


def test_recall_of_pasted_passages(frame):
    """Passages of 51 words and more at any place of a line, and runs of one word."""
    rng, texts, want = random.Random(22), [], set()
    for p in range(100):
        passage = (prose(rng, rng.randrange(51, 70)) if p % 10 else "spam " * 60).strip()
        for k in range(2):
            texts.append(f"{prose(rng, rng.randrange(1, 80))} {passage} {prose(rng, rng.randrange(1, 80))}")
        want.add(len(texts) - 1)
    got = set(removed(substring_dedup.repeated_spans(frame(texts)).collect()))
    assert len(got & want) >= 0.95 * len(want) and not {i for i in range(0, 200, 2) if (i // 2) % 10} & got
    assert {i for i in want if (i // 2) % 10 == 0 and i > 1} <= got


def test_a_common_line(frame):
    rng = random.Random(23)
    line = prose(rng, 20)
    texts = [f"{prose(rng, 30)}\n{line}\n{prose(rng, 30)}" for _ in range(50)]
    spans = substring_dedup.repeated_spans(frame(texts)).collect()
    assert sorted(r.doc_id for r in spans) == list(range(1, 50)) and {r.n_words for r in spans} == {20} and all(r.kept_in == [0] for r in spans)


def test_texts_of_one_id_are_documents_of_their_own(spark, frame):
    rng = random.Random(24)
    passage, clean = prose(rng, 60), prose(rng, 200)
    texts = [passage, f"{prose(rng, 50)} {passage} {prose(rng, 50)}", clean, clean]
    docs = frame(texts, [1, 2, 2, 2])
    spans = substring_dedup.repeated_spans(docs)
    left = {r.text for r in substring_dedup.without(docs, spans).collect()}
    assert clean in left and passage in left and texts[1] not in left and len(left) == 3


def test_a_text_that_repeats_itself(frame):
    rng = random.Random(25)
    part = prose(rng, 40)
    texts = [f"{part}\n{prose(rng, 10)}\n{part}", "word " * 200, "a b " * 200]
    left = {r.doc_id: r.text for r in substring_dedup.without(frame(texts), substring_dedup.repeated_spans(frame(texts))).collect()}
    assert left[0].count(part) == 1 and left[0].startswith(part)
    for i in (1, 2):  # a first run stays whole
        assert substring_dedup.MIN_WORDS <= len(left[i].split()) < 100


def test_clashing_columns(spark, frame):
    rng = random.Random(26)
    passage = prose(rng, 60)
    docs = frame([f"{prose(rng, 30)} {passage} {prose(rng, 30)}" for _ in range(2)])
    wide = docs.toDF("doc_id", "text", "_cut", "TEXT", "_version")
    left = substring_dedup.without(wide, substring_dedup.repeated_spans(wide))
    rows = {r[0]: r for r in left.collect()}
    assert left.columns == wide.columns and len(rows[1][1]) < len(rows[0][1]) - 150 and rows[1][2] == "en"


def test_texts_of_one_id_and_32_bit_hash(spark, frame):
    """Texts that Spark's hash() doesn't tell apart are cut by their own spans alone."""
    rng = random.Random(27)
    passage, clean = prose(rng, 60), prose(rng, 80)
    tail = F.concat(F.lit(f"{prose(rng, 5)} {passage} "), F.col("id").cast("string"))
    pasted = spark.range(150_000).select(tail.alias("p")).withColumn("h", F.hash("p"))
    alone = spark.range(150_000).select(F.concat(F.lit(f"{clean} "), F.col("id").cast("string")).alias("c")).withColumn("h", F.hash("c"))
    pair = pasted.join(alone, "h").first()
    for ids in ([1, 5, 5], [1, None, None]):
        docs = frame([passage, pair.p, pair.c], ids)
        left = [r.text for r in substring_dedup.without(docs, substring_dedup.repeated_spans(docs)).collect()]
        assert pair.c in left
        assert (passage in left and pair.p not in left) if ids[1] else (pair.p in left) != (passage in left)


def test_frequent_passages_are_salted_and_broadcast(spark, frame, monkeypatch):
    rng = random.Random(28)
    hot, rare = prose(rng, 60), [prose(rng, 60) for _ in range(20)]
    texts = [f"{prose(rng, 20)}\n{hot}\n{prose(rng, 5)}\n{rare[i % 20] if i < 40 else ''}" for i in range(150)]
    rows = lambda: sorted(map(tuple, substring_dedup.repeated_spans(frame(texts)).collect()), key=repr)
    want = rows()
    monkeypatch.setattr(substring_dedup, "BROADCAST_FIRSTS", 20)
    monkeypatch.setattr(substring_dedup, "HOT", 20)
    assert rows() == want and {r[0] for r in want} == set(range(1, 150))
