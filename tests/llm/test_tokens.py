import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fundflow.llm import bpe_codec, token_counts, token_store

PIECES = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "a", "B", "é", "ß", "1", "23", "²", "½", "中文", " ", " ", "​", "\x1c", "\x85", "'s", "'RE", "_", "<|endoftext|>", "<|startoftext|>", "!", "...", "😀", "é", "Σ", "ΟΔΟΣ", "İ", "K", "ſ", "Ⅷ", "क", "▁", "▁▁", "\x00", "</s>", "word", "Reading"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    return [None, "", *["".join(rng.choices(PIECES, k=rng.randrange(1, 16))) for _ in range(1500)], "word " * 40_000, "x" * 5000]


def test_store_reads_back_what_the_library_encodes(spark, frame, texts, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    df = frame(texts).orderBy(F.rand(1))
    token_store.write_store(df, path, 2, f"file://{tmp_path}/store", segment_tokens=5000)
    got = {r.doc_id: r for r in token_store.read_index(spark, f"file://{tmp_path}/store").collect()}
    start = 0
    for i, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), repr(text)[:80]
        start += len(ids)
    segment = token_store.Segment(bytes(spark.read.parquet(f"file://{tmp_path}/store").orderBy("part", "seq").first().segment))
    ids = segment.ids()
    assert all(segment.token(i) == ids[i] for i in range(0, segment.n_tokens, 7)) and segment.n_tokens == len(ids)
    whole = [x for text in texts for x in [*t.encode(text or "", add_special_tokens=False).ids, 2]]
    places = [*range(0, len(whole), 97), len(whole) - 1, 5, 5, -1, len(whole)]
    read = token_store.tokens_at(spark, f"file://{tmp_path}/store", spark.createDataFrame([(i,) for i in places], "i long")).collect()
    assert sorted(map(tuple, read)) == sorted((i, whole[i]) for i in set(places) if 0 <= i < len(whole))


def test_codes_of_any_size():
    ids = np.array([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1] * 400, np.uint32)
    s = token_store.Segment(token_store.pack_segment([1, None], [1400, 1400], ids))
    assert (s.ids() == ids).all() and [s.token(i) for i in range(2800)] == ids.tolist() and s.nulls.tolist() == [0, 1]


def test_counts_are_those_of_the_library(frame, texts):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r for r in token_counts.token_counts(frame(texts), path).collect()}
    for i, text in enumerate(texts):
        assert (got[i].n_bytes, got[i].n_tokens) == (len((text or "").encode()), len(sp.encode(text or ""))), repr(text)[:80]


def test_codec_is_the_library(frame, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in bpe_codec.encode(frame(texts), path, digests=True).collect()}
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].n_tokens == len(ids), repr(text)[:80]
        assert got[i].decoded == t.decode(ids, skip_special_tokens=False)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(got[i].decoded.encode()).hexdigest()


def test_lexicon_finds_just_its_words():
    words = sorted({w.encode() for w in ("a", "ab", "abc", "b", "bing", "ing", "sing", "singing", "é", "zzz")})
    lengths = np.arange(1, len(words) + 1)
    lexicon = bpe_codec.Lexicon(bpe_codec.compile_lexicon(words, np.arange(lengths.sum()), lengths))
    assert lexicon.find(words).tolist() == list(range(len(words)))
    assert set(lexicon.find([b"", b"abcd", b"in", b"x", b"zz"]).tolist()) == {-1}
    assert len(lexicon.final) < sum(map(len, words))  # suffixes are shared


def test_odd_rows(odd, none):
    for df, n in ((odd, 11), (none, 0)):
        assert token_store.token_store(df, public_tokenizers.path("byte_bpe_50k.json"), 2).count() == n
        assert token_counts.token_counts(df, public_tokenizers.path("piece_bpe_32k.model")).count() == n
        assert bpe_codec.encode(df, public_tokenizers.path("word_bpe_49k.json")).count() == n


def test_frequent_words_of_many_tasks(spark, frame, monkeypatch):
    """Summaries merge in rounds; counts that no summary forgets are whole."""
    from fundflow.llm import frequent
    from fundflow.llm.words import Words

    rng = random.Random(6)
    texts = [" ".join(rng.choices(["often", "now", "and", "then"], [8, 4, 2, 1], k=30)) + f" once{i}" for i in range(300)]
    monkeypatch.setattr(frequent, "MERGED", 3)
    assert frequent.frequent_words(frame(texts).repartition(20), Words) == [b"and", b"now", b"often", b"then"]
    monkeypatch.setattr(frequent, "TASK_WORDS", 3)
    assert frequent.frequent_words(frame(texts).repartition(20), Words, 2) == [b"now", b"often"]
    assert frequent.frequent_words(frame([]), Words) == []
