"""Which words of a table are frequent enough for a lookup table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fundflow.llm.common import only
from fundflow.llm.words import Counts, Texts, Words, batches, heavy

#: Words of a task's summary and of merged ones, so also what the driver gets;
#: longer words (in bytes) are left to the workers, so a table has a bounded size.
TASK_WORDS, ALL_WORDS, WORD_BYTES = 8_192, 65_536, 64
#: Summaries that one task merges.
MERGED = 64
SUMMARY = "words binary, lengths binary, counts binary"


def _summary(words: list[bytes], counts: list[int], most: int) -> pa.RecordBatch:
    some = sorted(heavy(np.array(counts, np.int64), most).tolist(), key=words.__getitem__)
    out = b"".join(words[i] for i in some), np.array([len(words[i]) for i in some], np.uint8).tobytes(), np.array([counts[i] for i in some], "<i8").tobytes()
    return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in out], ["words", "lengths", "counts"])


def _entries(words: bytes, lengths: bytes, counts: bytes) -> Iterator[tuple[bytes, int]]:
    at = 0
    for n, count in zip(lengths, np.frombuffer(counts, "<i8").tolist()):
        yield words[at : at + n], count
        at += n


def frequent_words(docs: DataFrame, spans: Callable[[Texts], Words], k: int = ALL_WORDS) -> list[bytes]:
    """About the k most frequent words of all texts, sorted.

    Every text is read. Each task counts its own words in bounded memory and
    hands on one summary of its most frequent ones; summaries are merged by
    :data:`MERGED`, in as many rounds as it takes. A summary is one row of
    bounded size, so what is shuffled grows with the number of tasks and not
    with the words. The result decides what lookup tables hold and so how fast
    a word is found, not what is found for it.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for batch in rows:
            for _, _, texts in batches(batch.column(0)):
                counts.update(spans(texts))
        top = [(w, n) for w, n in zip(*counts.top(TASK_WORDS)) if len(w) <= WORD_BYTES]
        if top:
            yield _summary(*map(list, zip(*top)), TASK_WORDS)

    def merge(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}
        for batch in rows:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                for word, n in _entries(*row):
                    total[word] = total.get(word, 0) + n
        if total:
            yield _summary(list(total), list(total.values()), k)

    texts = only(docs, "text")
    parts, left = texts.mapInArrow(run, SUMMARY), texts.rdd.getNumPartitions()
    while left > 1:
        left = -(-left // MERGED)
        parts = parts.repartition(left).mapInArrow(merge, SUMMARY)
    return sorted(word for r in parts.collect() for word, n in _entries(r.words, r.lengths, r.counts) if n > 1)
