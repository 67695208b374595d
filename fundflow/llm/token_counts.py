"""Token counts without tokenising every text.

Map-side lookup in two tiers. The first is a compact hash table of the token
counts of frequent pre-tokens, broadcast to all workers (at most
``frequent.ALL_WORDS`` entries of 10 bytes). What it lacks is looked up in a
table that each worker fills as it encodes unseen pre-tokens. The broadcast table
is chosen from one summary of bounded size per task (see frequent); these
summaries, at most ``frequent.TASK_WORDS`` words each, are the only pre-tokens
that are shuffled, and they decide speed, not counts. Pre-tokens are told apart
by 64-bit hashes (see words.WordTable).

Defined results: a null text has the tokens of an empty one (none); rows that
repeat are counted each; a text of any length is counted as a whole; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fundflow.llm.common import only
from fundflow.llm.frequent import frequent_words
from fundflow.llm.words import Texts, Words, WordTable, batches, sums

#: Stands for the count of a piece whose text must be encoded whole.
WHOLE = np.uint32(0xFFFFFFFF)
INSIDE = np.ones(256, bool)
INSIDE[[0x20, 0x0A]] = False
MARK = "▁"


def pieces(texts: Texts) -> Words:
    """A text cut before the spaces and line ends ahead of each word.

    No piece of the vocabulary has a space after anything else, or a line end,
    so no merge spans a cut. A word after exactly one space, or first in its
    text, stands for itself with a space before it; else a piece includes the
    spaces and line ends before it.
    """
    words = Words(texts, separators=INSIDE)
    data = words.data

    def part(begin: np.ndarray, start: np.ndarray, end: np.ndarray, at_start: np.ndarray):
        one = (start - begin == 1) & (data[begin] == 0x20) & ~at_start
        a = np.where(one, start, begin)
        return (a, end - a), (start, np.zeros_like(start))

    return words.with_gaps(texts, part)


class PieceCounter:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        for i in range(self.model.vocab_size()):
            piece = self.model.id_to_piece(i)
            if "\n" in piece or MARK in piece.lstrip(MARK):
                raise ValueError(f"pieces of this vocabulary span words: {piece!r}")

    def text(self, text: str) -> int:
        return len(self.model.encode(text)) if text else 0

    def counts(self, words: list[bytes]) -> np.ndarray:
        """The tokens of each piece where it stands, inside its text."""
        texts = [w.decode() for w in words]
        got = self.model.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        n = np.fromiter(map(len, got), np.int64, len(got))
        for i, t in enumerate(texts):
            if MARK in t:
                n[i] = WHOLE
            elif t[0] == "\n":
                n[i] -= 1  # the space that the library puts before a text
            elif t == " ":
                n[i] = 1
        return n.astype(np.uint32)


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_bytes, n_tokens."""
    spark = docs.sparkSession
    docs = only(docs, "doc_id", "text")
    frequent = frequent_words(docs, pieces)
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.uint16)
    if frequent:
        n = PieceCounter(model_path).counts(frequent)
        whole = pa.array([w for w, c in zip(frequent, n.tolist()) if c < 1 << 16], pa.large_binary())
        counts = n[n < 1 << 16].astype(np.uint16)
        if len(whole):
            keys = np.concatenate([_hashes(t) for _, _, t in batches(whole)])
    shipped = spark.sparkContext.broadcast((keys, counts))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(model_path)
        first, known = WordTable(None, np.uint32, 1 << 62), shipped.value
        first.add(known[0], known[1].astype(np.uint32), np.ones(len(known[0]), np.int64))
        second = WordTable(lambda words: (counter.counts(words), np.ones(len(words), np.int64)), np.uint32)
        for batch in rows:
            sizes, totals = [], []
            for _, _, texts in batches(batch.column(1)):
                words = pieces(texts)
                found = first.find(words.hash)
                n = first.pool[found]
                missed = np.flatnonzero(found < 0)
                if len(missed):
                    rest = words.spans(words.starts[missed], words.lengths[missed], np.zeros(1, np.int64))
                    rest._hash = words.hash[missed]
                    found = second.lookup(rest)
                    n[missed] = second.pool[found]
                total = sums(np.where(n == WHOLE, 0, n).astype(np.int64), words.first)
                size = np.diff(texts.offsets)
                odd = np.zeros(len(texts), bool)
                odd[np.searchsorted(words.first, np.flatnonzero(n == WHOLE), "right") - 1] = True
                odd |= (size > 0) & ~INSIDE[texts.data[texts.offsets[:-1]]]
                for i in np.flatnonzero(odd).tolist():
                    total[i] = counter.text(texts.text(i))
                sizes.append(size)
                totals.append(total)
            if sizes:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(totals))], ["doc_id", "n_bytes", "n_tokens"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def _hashes(texts: Texts) -> np.ndarray:
    """The hash that each text has as a piece."""
    words = Words(texts)
    return words.spans(texts.offsets[:-1], np.diff(texts.offsets), texts.offsets).hash
