"""Ranked lexical search over an impact-ordered index, score at a time.

Documents are dealt into shards. A shard is one row of the index: its terms,
and for each term its documents in groups of exactly equal impact, greatest
first, where a document's impact for a term is ``1e9 * tf div (1000 * tf + 8 * m)``
and m its normalised length. Texts are read once (:func:`postings`); impacts
follow when the lengths of all documents are known (:func:`impact_index`).

A search goes through a shard for one item after the other. The groups of all
of the item's terms are put in descending order of what they add to a score,
and are added to accumulators in that order. What is left can raise a score by
no more than the sum of each term's next group. Once that sum says that no
document but a few can be among the k best (of the shard, and of those that
the task has seen before), the scores of these few are completed and the rest
of the groups is not added. Nothing else ends the search of a shard early, so
results are exact. Per task k documents an item are handed on.

Items come in blocks of at most :data:`BLOCK_TERMS` terms, which each task
gets; a block takes a pass over the index, not over texts. Only terms that some
item has are indexed, unless these are more than :data:`KNOWN_TERMS`: then all
are. Document frequencies, lengths and the number of documents are counted over
all documents. Terms are told apart by 64-bit hashes; a term of an item meets
one of 10^9 others in a corpus by chance once in 2 x 10^10 terms.

Defined results: a null or empty text has no terms, and neither is found nor
counted; rows of one doc_id are documents of their own, each ranked; a null
doc_id is less than all others among equal scores; items of one id are one item
with the terms of all their rows; an item without terms, or whose terms no
document has, has no rows; documents of score 0 aren't found; a text longer
than a shard is one; empty tables give no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundflow.llm.common import discard, only, stored
from fundflow.llm.words import Texts, Words, batches

#: Bytes of text, and documents, after which a shard ends.
SHARD_BYTES, SHARD_DOCS = 16 << 20, 8_192
#: Query terms up to which the index is limited to them (8 bytes each).
KNOWN_TERMS = 1_000_000
#: Terms of a block of items (32 bytes each); a longer item is a block of its own.
BLOCK_TERMS = 500_000
#: Scores are completed for at most this many times k documents; the shares of postings after which bounds are looked at.
FEW, LOOKS = 4, (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.85)
#: A term is a run of ASCII letters and digits, and of all that isn't ASCII.
TERM_BYTES = np.ones(256, bool)
TERM_BYTES[:0x80] = [chr(c).isalnum() for c in range(0x80)]
#: Rows are some MB, so the writer looks at its buffer after each.
_LARGE_ROWS = {"parquet.block.size": str(32 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}

POSTINGS = "n_docs long, n_terms long, doc_ids array<long>, lengths binary, terms binary, firsts binary, docs binary, tfs binary"
INDEX = "doc_ids array<long>, terms binary, groups binary, impacts binary, firsts binary, docs binary"


def terms_of(texts: Texts) -> Words:
    return Words(texts, lower=True, separators=TERM_BYTES)


def _i64(cell) -> np.ndarray:
    return np.frombuffer(cell, "<i8")


def _i32(cell) -> np.ndarray:
    return np.frombuffer(cell, "<i4")


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """begin[0] .. end[0] - 1, begin[1] .. end[1] - 1, ..."""
    n = end - begin
    before = np.cumsum(n) - n
    return np.arange(int(n.sum())) + np.repeat(begin - before, n)


class _Known:
    """Which hashes are those of known terms; all of them without a list."""

    def __init__(self, hashes: np.ndarray | None):
        self.hashes = hashes
        if hashes is not None:
            self.some = np.zeros(1 << 20, bool)
            self.some[hashes >> np.uint64(44)] = True

    def at(self, h: np.ndarray) -> np.ndarray:
        if self.hashes is None:
            return np.arange(len(h))
        at = np.flatnonzero(self.some[h >> np.uint64(44)])
        place = np.searchsorted(self.hashes, h[at])
        return at[(place < len(self.hashes)) & (self.hashes[np.minimum(place, len(self.hashes) - 1)] == h[at])] if len(self.hashes) else at[:0]


def _counted(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, document) with counts; documents come in ascending order."""
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return h[at], doc[at], np.diff(np.append(at, len(h)))


class _Shard:
    """The postings of some documents, as they come."""

    def __init__(self):
        self.ids, self.lengths, self.parts, self.bytes = [], [], [], 0

    def add(self, ids: list, texts: Texts, known: _Known) -> None:
        words = terms_of(texts)
        n = np.diff(words.first)
        doc = np.repeat(np.arange(len(texts)) + len(self.ids), n)
        at = known.at(words.hash)
        self.parts.append(_counted(words.hash[at], doc[at]))
        self.ids += ids
        self.lengths.append(n)
        self.bytes += len(texts.data)

    def row(self) -> pa.RecordBatch:
        h, doc, tf = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(h, kind="stable")
        h, doc, tf = h[order], doc[order], tf[order]
        firsts = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        lengths = np.concatenate(self.lengths)
        cells = lengths.astype("<i8"), h[firsts].astype("<u8"), np.append(firsts, len(h)).astype("<i8"), doc.astype("<i4"), tf.astype("<i8")
        return pa.RecordBatch.from_arrays(
            [pa.array([int((lengths > 0).sum())]), pa.array([int(lengths.sum())]), pa.array([self.ids], pa.list_(pa.int64())), *[pa.array([c.tobytes()], pa.binary()) for c in cells]],
            [f.split()[0] for f in POSTINGS.split(", ")],
        )


def postings(docs: DataFrame, known: np.ndarray | None = None) -> DataFrame:
    """Rows of :data:`POSTINGS`, a shard each, in the shared folder; only of
    terms whose (sorted) hashes are ``known``, if given."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, listed = _Shard(), _Known(known)
        for batch in rows:
            for a, b, texts in batches(batch.column(1)):
                shard.add(batch.column(0)[a:b].to_pylist(), texts, listed)
                if shard.bytes >= SHARD_BYTES or len(shard.ids) >= SHARD_DOCS:
                    yield shard.row()
                    shard = _Shard()
        if shard.ids:
            yield shard.row()

    return stored(only(docs, "doc_id", "text").mapInArrow(run, POSTINGS), "search-postings", **_LARGE_ROWS)


def by_impact(lengths: np.ndarray, firsts: np.ndarray, doc: np.ndarray, tf: np.ndarray, n_docs: int, n_terms: int) -> list[np.ndarray]:
    """groups, impacts, firsts and docs of :data:`INDEX`."""
    m = 25 + (75 * lengths * n_docs) // n_terms if n_terms else lengths
    impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
    term = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    order = np.lexsort((doc, -impact, term))
    doc, impact, term = doc[order], impact[order], term[order]
    new = np.ones(len(doc), bool)
    new[1:] = (term[1:] != term[:-1]) | (impact[1:] != impact[:-1])
    at = np.flatnonzero(new)
    return [np.searchsorted(term[at], np.arange(len(firsts))).astype("<i8"), impact[at].astype("<i8"), np.append(at, len(doc)).astype("<i8"), doc.astype("<i4")]


def impact_index(found: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """Rows of :data:`INDEX` in the shared folder, a shard each, of :func:`postings`.

    ``terms`` are sorted; the groups of term t are ``groups[t] .. groups[t + 1]``,
    by descending impact, the documents of group g ``firsts[g] .. firsts[g + 1]``.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for i in range(batch.num_rows):
                lengths, terms, firsts, doc, tf = (batch.column(c)[i].as_py() for c in range(1, 6))
                cells = by_impact(_i64(lengths), _i64(firsts), _i32(doc), _i64(tf), n_docs, n_terms)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i : i + 1], *[pa.array([c], pa.binary()) for c in (terms, *[x.tobytes() for x in cells])]], [f.split()[0] for f in INDEX.split(", ")])

    return stored(found.select("doc_ids", "lengths", "terms", "firsts", "docs", "tfs").mapInArrow(run, INDEX), "search-index", **_LARGE_ROWS)


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term (hash), times: the terms of each item with their repeats."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for a, _, texts in batches(batch.column(1)):
                words = terms_of(texts)
                h, item, n = _counted(words.hash, np.repeat(np.arange(len(texts)) + a, np.diff(words.first)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(item)), pa.array(h.view(np.int64)), pa.array(n)], ["item_id", "term", "times"])

    return only(items, "item_id", "text").mapInArrow(run, "item_id long, term long, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def document_frequencies(found: DataFrame) -> DataFrame:
    """term (hash), df over all shards of :func:`postings`."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for terms, firsts in zip(*[c.to_pylist() for c in batch.columns]):
                yield pa.RecordBatch.from_arrays([pa.array(_i64(terms)), pa.array(np.diff(_i64(firsts)))], ["term", "df"])

    return found.select("terms", "firsts").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass
class Item:
    """Hashes of an item's terms and what a unit of impact of each adds to a score."""

    item_id: int | None
    terms: np.ndarray
    weights: np.ndarray


class Shard:
    """A row of the index, ready to be searched."""

    def __init__(self, doc_ids: list, terms: bytes, groups: bytes, impacts: bytes, firsts: bytes, docs: bytes):
        self.doc_ids, self.terms = doc_ids, np.frombuffer(terms, "<u8")
        self.groups, self.impacts, self.firsts, self.docs = _i64(groups), _i64(impacts), _i64(firsts), _i32(docs)
        self.score = np.zeros(len(doc_ids), np.int64)

    def _postings(self, group: np.ndarray) -> np.ndarray:
        return _ranges(self.firsts[group], self.firsts[group + 1])

    def _add(self, group: np.ndarray, value: np.ndarray, among: np.ndarray | None = None) -> None:
        doc, add = self.docs[self._postings(group)], np.repeat(value, self.firsts[group + 1] - self.firsts[group])
        if among is not None:
            some = np.flatnonzero(among[doc])
            doc, add = doc[some], add[some]
        np.add.at(self.score, doc, add)

    def best(self, item: Item, k: int, least: int) -> list[tuple[int, int]]:
        """(score, place) of the shard's k best documents and of ties with the
        last one, as far as they have ``least`` at least."""
        place = np.searchsorted(self.terms, item.terms)
        have = np.flatnonzero((place < len(self.terms)) & (self.terms[np.minimum(place, len(self.terms) - 1)] == item.terms)) if len(self.terms) else []
        if not len(have):
            return []
        place, weights = place[have], item.weights[have]
        begin, end = self.groups[place], self.groups[place + 1]
        most = int((self.impacts[begin] * weights).sum())
        if most < max(least, 1):
            return []
        group = _ranges(begin, end)
        value = self.impacts[group] * np.repeat(weights, end - begin)
        follows = np.append(value[1:], 0)
        follows[np.cumsum(end - begin) - 1] = 0
        order = np.argsort(-value, kind="stable")
        group, value = group[order], value[order]
        left = most + np.cumsum(follows[order] - value)  # at most so much more, after each group
        size = np.cumsum(self.firsts[group + 1] - self.firsts[group])
        stops = np.unique(np.append(np.searchsorted(size, size[-1] * np.array(LOOKS), "right"), len(group)))
        self.score[:] = 0
        at = 0
        for stop in stops[stops > 0].tolist():
            self._add(group[at:stop], value[at:stop])
            at, more = stop, int(left[stop - 1])
            bar = max(least, 1, int(np.partition(self.score, -k)[-k]) if len(self.score) >= k else 0)
            among = (self.score + more >= bar) & (self.score > 0)
            if more < bar and np.count_nonzero(among) <= FEW * k:  # no other document can come up to the bar
                self._add(group[at:], value[at:], among)
                break
        found = np.flatnonzero(among & (self.score >= bar))
        return list(zip(self.score[found].tolist(), found.tolist()))


def _rank(hit: tuple[int, int | None]) -> tuple:
    score, doc_id = hit
    return -score, doc_id is not None, doc_id or 0


def search_block(index: DataFrame, block: list[Item], k: int) -> DataFrame:
    """item_id, doc_id, score: of each task the k best documents of each item."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int | None]]] = [[] for _ in block]
        for batch in rows:
            for i in range(batch.num_rows):
                shard = Shard(*[c[i].as_py() for c in batch.columns])
                for j, item in enumerate(block):
                    least = best[j][-1][0] if len(best[j]) == k else 1
                    if hits := shard.best(item, k, least):
                        best[j] = sorted(best[j] + [(score, shard.doc_ids[p]) for score, p in hits], key=_rank)[:k]
        hits = [(item.item_id, doc_id, score) for item, mine in zip(block, best) for score, doc_id in mine]
        yield pa.RecordBatch.from_arrays([pa.array([h[c] for h in hits], pa.int64()) for c in range(3)], ["item_id", "doc_id", "score"])

    return index.mapInArrow(run, "item_id long, doc_id long, score long")


def _blocks(items: DataFrame, n_docs: int) -> Iterator[list[Item]]:
    block, size = [], 0
    for r in items.toLocalIterator():
        terms = sorted((t.term & 0xFFFFFFFFFFFFFFFF, t.times * weight(t.df, n_docs)) for t in r.terms)
        item = Item(r.item_id, np.array([t for t, _ in terms], np.uint64), np.array([w for _, w in terms], np.int64))
        if block and size + len(terms) > BLOCK_TERMS:
            yield block
            block, size = [], 0
        block.append(item)
        size += len(terms)
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best of ``docs`` (doc_id,
    text) for each of ``items`` (item_id, text)."""
    wanted = stored(item_terms(items), "search-terms")
    listed = wanted.select("term").distinct().limit(KNOWN_TERMS + 1).toPandas()["term"].to_numpy(np.int64)
    found = postings(docs, np.sort(listed.view(np.uint64)) if len(listed) <= KNOWN_TERMS else None)
    n_docs, n_terms = found.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    weighed = wanted.join(document_frequencies(found), "term")
    asked = stored(weighed.groupBy("item_id").agg(F.collect_list(F.struct("term", "times", "df")).alias("terms")), "search-items")
    index = impact_index(found, n_docs, n_terms)
    discard(wanted, found)
    hits = index.select(F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("score")).limit(0)
    parts = [stored(search_block(index, block, k), "search-hits") for block in _blocks(asked, n_docs)]
    discard(index, asked)
    for part in parts:
        hits = hits.unionByName(part) if part is not parts[0] else part
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
