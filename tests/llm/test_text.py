import hashlib
import random

import pytest

from fundflow.llm import chat_format, decontaminate, language_id, quality_rules
from conftest import prose


def test_ledger_measures(frame, odd, none):
    rng = random.Random(5)
    clean, run = prose(rng, 60), "one two three four five six seven eight nine"
    texts = [clean, None, f"{run} {prose(rng, 30)} {run} {prose(rng, 30)}", "spam " * 50, " ".join(f"w{i}***" for i in range(40)), "a line here\n" * 3 + clean, "LOUD WORDS ONLY " * 2 + " ".join(f"W{i}ORD" for i in range(30)), "xx xx xx xx yy yy yy yy zz zz zz zz qq qq qq qq rr rr rr rr ss ss ss ss"]
    got = {r.doc_id: r for r in quality_rules.ledger(frame(texts)).collect()}
    names = lambda i: {n for k, n in enumerate(quality_rules.RULES) if got[i].failure_bits >> k & 1}
    assert names(0) == set() and names(1) == {"few_words"} and got[2].n_repeat_words == 18 and got[5].n_dup_lines == 2
    assert "repeated_words" in names(3) and got[3].n_repeat_words == 50 and names(4) == {"symbols"} and names(6) == {"shouting"} and names(7) == {"stuttering"}
    entries = quality_rules.ledger(frame(texts))
    by = {r.rule: (r.n_failed, r.n_only, r.n_rejected_without) for r in quality_rules.ablations(entries).collect()}
    rejected = sum(bool(names(i)) for i in got)
    assert by["symbols"] == (1, 1, rejected - 1) and by["few_words"][0] == 1
    assert quality_rules.ledger(odd).count() == 11 and quality_rules.ledger(none).count() == 0


def test_repeated_windows_against_a_plain_count(frame):
    rng = random.Random(6)
    texts = []
    for _ in range(25):
        w = [rng.choice("abc") for _ in range(rng.randrange(0, 60))]
        texts.append(" ".join(w + w[: rng.randrange(0, 20)]))
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.ledger(frame(texts)).collect()}
    for i, t in enumerate(texts):
        w, at = t.split(), {}
        for k in range(len(w) - 7):
            at.setdefault(tuple(w[k : k + 8]), []).append(k)
        assert got[i] == len({p + k for ps in at.values() if len(ps) > 1 for p in ps for k in range(8)})


LOG = "conv_id long, message long, seq long, kind string, role string, text string"


def test_events_fold(spark):
    rows = [
        (1, 1, 0, "start", "assistant", None), (1, 0, 0, "message", "user", "hi"), (1, 1, 2, "delta", "assistant", "lo"), (1, 1, 1, "delta", "assistant", "hel"),
        (1, 2, 0, "message", "user", "old"), (1, 2, 1, "edit", "user", "new"), (1, 3, 0, "message", "assistant", "bad"), (1, 3, 1, "regenerate", "assistant", None), (1, 3, 2, "delta", "assistant", "good"),
        (1, 4, 0, "message", "user", "gone"), (1, 4, 1, "delete", "user", None), (2, 0, 0, "message", None, None),
    ]
    got = {r.conv_id: r for r in chat_format.format_log(spark.createDataFrame(rows, LOG)).collect()}
    assert chat_format.parse(got[1].formatted) == [("user", "hi"), ("assistant", "hello"), ("user", "new"), ("assistant", "good")]
    assert [got[1].formatted[s.start : s.stop] for s in got[1].loss] == ["hello", "good"] and chat_format.parse(got[2].formatted) == [("", "")]
    with pytest.raises(Exception, match="unknown kind"):
        chat_format.format_log(spark.createDataFrame([(1, 0, 0, "bogus", "a", "b")], LOG)).collect()
    assert chat_format.format_log(spark.createDataFrame([], LOG)).count() == 0


def test_any_text_comes_back(spark, monkeypatch):
    rng = random.Random(9)
    bits = ["\\", "#", "### ", "### Assistant: ", "</turn>", "</", "<\\/", ":", ": ", "\n", "é", "a", "\\#", "\\\\"]
    talk = [(c, t, rng.choice(["user", "assistant", "sys:tem\\"]), "".join(rng.choices(bits, k=rng.randrange(8)))) for c in range(40) for t in range(6)]
    monkeypatch.setattr(chat_format, "PART_CHARS", 60)
    df = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.digests(chat_format.format_log(chat_format.log_of(df))).collect()}
    live = chat_format.format_log(chat_format.streamed_log(df), dealt=True)
    stored = live.repartition(7).sortWithinPartitions("formatted")  # in any order
    assert {tuple(r) for r in chat_format.digests(stored).collect()} == {tuple(r) for r in got.values()} == {tuple(r) for r in chat_format.digests(live, in_order=True).collect()}
    for c in range(40):
        turns = [(r, x) for k, _, r, x in talk if k == c]
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (6, len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_languages(spark, odd, none):
    rng = random.Random(2)
    kinds = {"xx": ["brumo", "kelta", "sivan", "dorup"], "yy": ["żółw", "ćma", "łąka", "gęś"], "zz": ["thinking", "worthy", "through", "wrong"]}
    rows = [(i, " ".join(rng.choices(kinds[k], k=rng.randrange(5, 30))), k) for i in range(600) for k in [rng.choice(list(kinds))]] + [(1000, None, "xx"), (1001, "12 34 !", None)]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    judged = [(got[i].lang_pred, k) for i, _, k in rows[:600] if got[i].held_out]
    assert len(judged) > 80 and sum(a == b for a, b in judged) / len(judged) > 0.97
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and all(0 <= r.score <= 1 for r in got.values())
    assert language_id.identify(odd).where("lang_pred <> 'und'").count() == 0 and language_id.identify(none).count() == 0


def test_leaks_against_a_plain_search(spark, frame, odd, none):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [" ".join(word() for _ in range(n)) for n in [*range(16, 56, 2), 6, 9]] + [None, "", "two words"]
    texts, want = [], set()
    for d in range(200):
        w = [word() for _ in range(rng.randrange(0, 200))]
        if d % 4 == 0:
            k = rng.randrange(22)
            passage = items[k].upper().split() if d % 8 else items[k].split()
            if len(passage) >= 16:
                for _ in range(len(passage) // 10):
                    passage[rng.randrange(len(passage))] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage
            want.add((d, k))
        texts.append("\n".join(w) if d % 3 else " ".join(w))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontaminate.contaminated(frame(texts), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert {r.doc_id for r in decontaminate.clean(frame(texts), bench).collect()} == set(range(200)) - {d for d, _ in want}
    for r in got:
        assert texts[r.doc_id][r.start : r.stop].lower().split()[0] in items[r.item_id].split()
    assert decontaminate.clean(odd, bench).count() == 11 and decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(frame(texts), bench.limit(0)).count() == 0


def test_hits_of_several_blocks_and_clashing_columns(spark, frame, monkeypatch):
    """A benchmark beyond a block has the same hits; user columns pass as they are."""
    rng = random.Random(31)
    items = [prose(rng, rng.randrange(8, 30)) for _ in range(40)]
    texts = [f"{prose(rng, 20)} {rng.choice(items)} {prose(rng, 9)} {rng.choice(items)}" if i % 3 else prose(rng, 40) for i in range(60)]
    bench, docs = spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), frame(texts + texts[:9], [*range(60), *[None] * 9])
    wide = docs.toDF("doc_id", "text", "hits", "TEXT", "v0")
    want = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()), key=str)
    kept = sorted(map(tuple, decontaminate.clean(wide, bench).collect()), key=str)
    assert len(want) > 60 and decontaminate.clean(wide, bench).columns == wide.columns and {r[1] for r in kept} == set(texts[::3])
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 600)
    assert sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()), key=str) == want
    assert sorted(map(tuple, decontaminate.clean(wide, bench).collect()), key=str) == kept


def test_ledger_of_clashing_columns(frame):
    docs = frame(["one two three", "word " * 40]).toDF("doc_id", "text", "TEXT", "n_words", "_m")
    rows = quality_rules.ledger(docs, keep_text=True).collect()
    assert {(r[0], r[1], r[2], r.n_words) for r in rows} == {(0, "one two three", "en", 3), (1, "word " * 40, "en", 40)}
    assert quality_rules.passing(docs, "v2").columns == docs.columns and quality_rules.passing(docs, "v2").count() == 0


def test_kernel_and_ridge_against_a_plain_version():
    """Scores by sets of n-grams, an inverse square root of the landmarks' kernel
    and the normal equations, each written out."""
    import numpy as np

    rng = random.Random(32)
    texts = [" ".join("".join(rng.choices(a, k=rng.randrange(2, 7))) for _ in range(rng.randrange(3, 12))) + rng.choice(["", "!", " 12"]) for a in ("abcde", "cdefgé", "ghijkaß") for _ in range(30)]
    langs = [y for y in ("x", "y", "z") for _ in range(30)]
    model = language_id.Model(texts, langs)
    letters = set(model.grams.letters)

    def grams(text):
        seq = [c if c in letters else "?" if c.isalpha() else " " for c in text.lower()]
        return {tuple(seq[i : i + n]) for n in (1, 2, 3) for i in range(len(seq) - n + 1)} - {(" ",) * n for n in (1, 2, 3)}

    kernel = lambda xs, ys: np.array([[len(a & b) / (len(a) * len(b)) ** 0.5 for b in ys] for a in xs])
    sets = [grams(t) for t in texts]
    share = language_id.LANDMARKS // 3
    marks = [s for y in "xyz" for s in [g for g, z in zip(sets, langs) if z == y][:share]]
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    good = values > 1e-6 * values.max()
    z = np.hstack([kernel(sets, marks) @ vectors[:, good] @ np.diag(values[good] ** -0.5), np.ones((len(sets), 1))])
    y = np.array([[1.0 if k == c else -1.0 for c in "xyz"] for k in langs])
    w = np.linalg.inv(z.T @ z + language_id.RIDGE * len(z) * np.eye(z.shape[1])) @ z.T @ y
    new = [" ".join("".join(rng.choices("abcdefghijé", k=4)) for _ in range(6)) for _ in range(40)]
    zn = np.hstack([kernel([grams(t) for t in new], marks) @ vectors[:, good] @ np.diag(values[good] ** -0.5), np.ones((len(new), 1))])
    odds = np.exp(language_id.SHARPNESS * (zn @ w))
    odds /= odds.sum(axis=1, keepdims=True)
    names, scores = model.predict(new)
    sure = np.sort(odds, axis=1)[:, -1] - np.sort(odds, axis=1)[:, -2] > 0.01
    assert [n for n, s in zip(names, sure) if s] == ["xyz"[i] for i, s in zip(odds.argmax(axis=1), sure) if s] and sure.sum() > 20
    assert np.abs(np.array(scores) - odds.max(axis=1)).max() < 0.01


def test_sample_is_bounded(spark, monkeypatch):
    """Many rows of one doc_id give one text; texts without a letter don't use the quota up."""
    monkeypatch.setattr(language_id, "PER_LANGUAGE", 5)
    rows = [(1, f"text number {i}", "xx") for i in range(400)] + [(i, None if i % 2 else "12", "yy") for i in range(300)] + [(1000 + i, f"word {i}", "yy") for i in range(40)] + [(2000, "a" * (language_id.TRAIN_CHARS + 1), "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.sample(docs).collect()
    by = {y: [r for r in got if r.lang == y] for y in ("xx", "yy", "zz")}
    assert len(by["xx"]) <= 1 and len(by["yy"]) == 5 and all("word" in r.text for r in by["yy"]) and not by["zz"]


def test_turns_that_tie(spark):
    """Rows of one turn are messages of their own, in order of role and text; nulls are empty."""
    rows = [(1, 0, "assistant", "bb"), (1, 0, "assistant", "aaa"), (1, 0, "assistant", "aaa"), (1, 0, None, None), (1, 1, "user", "é😀x"), (None, 0, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: chat_format.parse(r.formatted) for r in chat_format.format_log(chat_format.streamed_log(df), dealt=True).collect()}
    assert got == {1: [("", ""), ("assistant", "aaa"), ("assistant", "aaa"), ("assistant", "bb"), ("user", "é😀x")], None: [("user", "")]}
