"""Substring deduplication by hashing lines, paragraphs and pieces of lines.

Units are whole lines and paragraphs (lines between empty ones), and, for
passages that were pasted into the middle of a line, windows of pieces. Every
line is cut into pieces at places that its words decide: before each word
whose hash is less than those of the :data:`REACH` words on either side, and
after :data:`LONGEST` words without such a place. The same passage is cut at
the same places wherever it stands. A window begins at each piece and has as
many whole pieces as it takes to reach ``min_words`` words.

Units are normalised to their lower-cased words. Their digests are counted
over all documents; of the occurrences of a repeated one, the earliest (by
doc_id, text, then offset) stays and the others are removed. Every word that is
removed thus belongs to a run of words that stands, word for word and in one
piece, in an earlier place. Removed units that touch form a span. Offsets are
code points of the original text: a span runs from its first word to where the
next one starts.

Digests that occur once are dropped by 64 bits; what is left is compared by
128 bits (two polynomials over 64-bit hashes of words), so that even among
10^13 windows no two different ones are expected to meet. Texts of one doc_id
are told apart by 128 bits too. Counting and the search for the earliest
occurrence combine rows before they shuffle. Where units are joined with their
digest, the units of the most frequent digests (:data:`HOT` at most) are dealt
out over :data:`SALTS` groups each, and the earliest occurrences are broadcast
as far as they are few or frequent, so no task gets all units of a passage.

Defined results: null and empty texts have no units; rows of one doc_id and
text are one document, so a repeated row isn't a repeat of itself, and rows of
one doc_id with other texts are documents of their own; a null doc_id ranks
first; a unit that a document repeats within itself counts, if it begins after
the first occurrence ends; a text of any length is cut as a whole by the task
that reads it; other columns are ignored by :func:`repeated_spans` and kept by
:func:`without`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundflow.llm.common import discard, only, packed, stored, unpacked
from fundflow.llm.words import Texts, Words, batches, mixed

REACH, LONGEST = 2, 16
#: Passages of over 50 words repeat with at least so many words of whole pieces.
MIN_WORDS = 32
#: Words that a whole line or paragraph must have. Lines of a dozen words (notices, headings) recur in half of all documents.
MIN_LINE_WORDS = 20
_M = np.uint64(0x9FB21C651E98DF25)
#: The multiplier of the other half of a digest.
_M2 = np.uint64(0xC2B2AE3D27D4EB4F)
#: Digests that count as frequent at most (8 bytes each), groups that the units of each are dealt to.
HOT, SALTS = 10_000, 64
#: Earliest occurrences (some 60 bytes each) that are broadcast; where there are more, the most frequent ones are.
BROADCAST_FIRSTS = 100_000
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
UNITS = "a long, b long, doc_id long, version long, version_b long, start int, stop int, word int, n_words int"


def pieces(texts: Texts, words: Words) -> np.ndarray:
    """The first words of all pieces."""
    h, n = words.hash, len(words)
    text = np.repeat(np.arange(len(texts)), np.diff(words.first))
    least = np.ones(n, bool)
    for k in range(1, REACH + 1):
        same = text[k:] == text[:-k]
        least[k:] &= h[k:] < np.where(same, h[:-k], _LAST)
        least[:-k] &= h[:-k] < np.where(same, h[k:], _LAST)
    least[words.first[:-1][np.diff(words.first) > 0]] = True
    after = np.searchsorted(words.starts, np.flatnonzero(texts.data == 0x0A))
    least[after[after < n]] = True
    at = np.arange(n)
    return np.flatnonzero((at - np.maximum.accumulate(np.where(least, at, 0))) % LONGEST == 0) if n else at


def blocks(texts: Texts, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(first word, word after the last) of lines, and of paragraphs of several lines."""
    begin = np.sort(np.concatenate([texts.offsets[:-1], np.flatnonzero(texts.data[:-8] == 0x0A) + 1]))
    at = np.searchsorted(words.starts, begin)
    a, b = at, np.append(at[1:], len(words))
    line = np.flatnonzero(b > a)
    if not len(line):
        return line, line
    text = np.searchsorted(words.first, a[line], "right")
    head = np.flatnonzero(np.concatenate([[True], (np.diff(line) > 1) | (np.diff(text) > 0)]))
    tail = np.append(head[1:], len(line)) - 1
    several = tail > head
    return np.concatenate([a[line], a[line[head[several]]]]), np.concatenate([b[line], b[line[tail[several]]]])


def windows(words: Words, first: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, word after the last) of the least run of pieces of
    ``min_words`` words from each piece on, where its text has one."""
    bounds = np.append(first, len(words))
    stop = np.searchsorted(bounds, first + min_words)
    end = words.first[np.searchsorted(words.first, first, "right")]  # of the text
    good = stop < len(bounds)
    good[good] = bounds[stop[good]] <= end[good]
    return first[good], bounds[stop[good]]


def _digests(h: np.ndarray, a: np.ndarray, b: np.ndarray, m: np.uint64) -> np.ndarray:
    """Of the words a to b - 1 of each unit: a polynomial in m, by running sums."""
    with np.errstate(over="ignore"):
        n = len(h)
        powers, back = (np.cumprod(np.full(n + 1, x)) for x in (m, np.uint64(pow(int(m), -1, 1 << 64))))
        total = np.concatenate([[np.uint64(0)], np.cumsum(h * powers[:n], dtype=np.uint64)])
        return mixed((total[b] - total[a]) * back[a] + (b - a).astype(np.uint64) * m)


def units(texts: Texts, min_words: int = MIN_WORDS, min_line_words: int = MIN_LINE_WORDS) -> tuple[np.ndarray, ...]:
    """(text, digest, its other half, start, stop, word, words) of all units."""
    words = Words(texts, lower=True)
    n = len(words)
    whole = np.stack(blocks(texts, words))
    whole = whole[:, whole[1] - whole[0] >= min_line_words]
    a, b = np.concatenate([np.stack(windows(words, pieces(texts, words), min_words)), whole], axis=1)
    digests = [_digests(words.hash, a, b, m) for m in (_M, _M2)]
    text = np.searchsorted(words.first, a, "right") - 1
    points = np.concatenate([[0], np.cumsum((texts.data[:-8] & 0xC0) != 0x80)])
    begin = points[texts.offsets]
    next_word = np.append(points[words.starts], 0)
    stop = np.where(b < words.first[text + 1], next_word[b], begin[text + 1]) - begin[text]
    return text, *digests, next_word[a] - begin[text], stop, a - words.first[text], b - a


def version(text: Column) -> tuple[Column, Column]:
    """Tell texts of one doc_id apart."""
    return F.xxhash64(text).alias("version"), F.xxhash64(F.lit(1), text).alias("version_b")


def unit_table(docs: DataFrame, min_words: int, min_line_words: int) -> DataFrame:
    """Rows of :data:`UNITS`: ``word`` is the place of the first word in its text."""
    names = [f.split()[0] for f in UNITS.split(", ")]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for a, b, texts in batches(batch.column(3)):
                text, *digests, start, stop, word, n = units(texts, min_words, min_line_words)
                own = [batch.column(i)[a:b].take(pa.array(text)) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*[pa.array(d.view(np.int64)) for d in digests], *own, *[pa.array(x.astype(np.int32)) for x in (start, stop, word, n)]], names)

    return only(docs, "doc_id", "text").select("doc_id", *version(F.col("text")), "text").mapInArrow(run, UNITS)


def _repeated(rows: DataFrame) -> DataFrame:
    """The units whose digest occurs again, by its first half, stored."""
    often = stored(rows.groupBy("a").agg(F.count("*").alias("n")).where("n > 1"), "repeated-digests")
    # at most HOT digests have more than this share of all repeated units
    hot = stored(often.where(F.col("n") > often.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] / HOT).select("a"), "hot-digests")
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    marked = lambda df: df.join(F.broadcast(hot.select("a", F.lit(True).alias("hot"))), "a", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    salted = marked(rows).withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "version", "start"), F.lit(SALTS)).cast("int")).otherwise(0))
    found = salted.join(marked(often).select("a", F.explode(salts).alias("salt")), ["a", "salt"]).select(rows.columns)
    out = stored(found, "repeated-units")
    discard(often, hot)
    return out


def _again(repeated: DataFrame) -> DataFrame:
    """The repeated units with ``first``, the earliest occurrence of theirs."""
    key = ["a", "b"]
    firsts = repeated.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "version", "version_b", "start", "stop")).alias("first")).where("n > 1")
    firsts = stored(firsts, "first-units")
    if firsts.count() <= BROADCAST_FIRSTS:
        return repeated.join(F.broadcast(firsts), key)
    # fewer than BROADCAST_FIRSTS digests can have more than this share
    hot = F.col("n") > firsts.agg(F.sum("n")).first()[0] / BROADCAST_FIRSTS
    frequent, rest = F.broadcast(firsts.where(hot)), firsts.where(~hot)
    return repeated.join(frequent, key).unionByName(repeated.join(frequent, key, "left_anti").join(rest, key))


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, min_line_words: int = MIN_LINE_WORDS) -> DataFrame:
    """One row per removed span: doc_id, version and version_b (of the text),
    start, stop, n_words, n_units, kept_in (the documents that keep its units)."""
    text = ["doc_id", "version", "version_b"]
    both = _again(_repeated(unit_table(docs, min_words, min_line_words)))
    here = F.struct(*text).eqNullSafe(F.struct(*[f"first.{c}" for c in text]))
    again = both.where(~here | (F.col("start") >= F.col("first.stop")))
    marked = again.select(*text, "start", "stop", "word", "n_words", F.col("first.doc_id").alias("kept")).distinct()
    order = Window.partitionBy(*text).orderBy("start", "stop")
    reached = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = marked.withColumn("begins", F.coalesce(reached < F.col("start"), F.lit(True))).withColumn("run", F.sum(F.col("begins").cast("int")).over(order))
    return runs.groupBy(*text, "run").agg(
        F.min("start").alias("start"),
        F.max("stop").alias("stop"),
        (F.max(F.col("word") + F.col("n_words")) - F.min("word")).alias("n_words"),
        F.count("*").alias("n_units"),
        F.sort_array(F.collect_set("kept")).alias("kept_in"),
    ).drop("run")


def without(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the spans cut out of their texts."""
    cut = spans.groupBy(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), F.col("version_b").alias("_version_b")).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("_cut"))
    rows = packed(docs, "doc_id", "text")
    a, b = version(F.col("text"))
    both = rows.join(cut, F.col("doc_id").eqNullSafe(F.col("_id")) & (a == F.col("_version")) & (b == F.col("_version_b")), "left")
    before = lambda i: F.coalesce(F.get(F.col("_cut"), i - 1)["stop"], F.lit(0))
    piece = lambda c, i: F.substring("text", before(i) + 1, c["start"] - before(i))
    rest = F.substring("text", F.element_at("_cut", -1)["stop"] + 1, F.length("text"))
    text = F.when(F.col("_cut").isNull(), F.col("text")).otherwise(F.concat(F.array_join(F.transform("_cut", piece), ""), rest))
    return unpacked(both, docs.columns, text=text)
