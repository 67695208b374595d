"""Benchmark decontamination by spaced seeds.

Fixed masks over a run of words say which positions count; the others may be
anything. The words under a mask hash to a seed. Every seed of every benchmark
item goes into a table; every position of every document is looked up in it
with each mask, and around each hit document and item are laid side by side
and compared word by word, so passages with substituted words are found too.
The masks are chosen so that each passage that counts as found holds the words
of at least one of them: tests go through all patterns of matching words.

The benchmark is broadcast in blocks of at most :data:`BLOCK_CHARS` of text (a
longer single item is a block of its own), whose tables of seeds take about 25
times as much memory. One block is one pass over the documents, which aren't
shuffled; up to :data:`PASSES` blocks have a pass each, whose hits are written
down, by digest of the text, before the next block is built and shipped. More
blocks are rows of a table: the seeds of all documents, as far as a filter of
:data:`FILTER_BITS` bits lets them through, are joined with the seeds of all
items, which says which text has to be compared with which block; texts are
then dealt to their blocks, in groups of at most :data:`GROUP_CHARS` of text or
so, and verified there. That takes two scans of the documents for any number of
blocks, and no item passes the driver.

A verified overlap is the best run of an alignment (+1 a match, -2 a
mismatch). An item counts as found in a document if the best run has at least
:data:`LEAST` matching words, or if all but one in five of the words of the
whole item match where it is laid; then the hit reaches from the first matching
word to the last. Words are compared with A-Z lower-cased.

Defined results: null or empty texts match nothing; items of fewer than
:data:`SHORTEST` words are passages of nothing and match nothing; repeated
items are found each by each (item_id decides ties); repeated documents are
judged each, by their texts alone, so doc_ids may repeat or be null; a text of
any length is searched whole; other columns are kept, whatever their names,
except that ``hits`` replaces a column of that name in :func:`with_hits`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from fundflow.llm.common import discard, only, stored
from fundflow.llm.words import Texts, Words, batches, mixed, ragged

SHORTEST = 5
LEAST = 12
#: Positions that count, for items of at least :data:`LEAST` words. The first
#: that many matches of a run have at most five mismatches between them.
MASKS = ("11101011", "11100100011", "1101100101", "1111001001", "11011000101", "10110111")
#: For shorter items, by length: all words but one in five match.
SHORT_MASKS = {
    5: ("1111", "11101", "11011", "10111"),
    6: ("1111", "11011"),
    7: ("11111", "111011", "110111"),
    8: ("111011", "11111"),
    9: ("1111011", "1101111"),
    10: ("1111011", "11001111", "110110011", "11110101", "10101111"),
    11: ("1110111", "111001011", "1011111", "111111"),
}
#: Words that are compared at once.
COMPARED = 1 << 20
BLOCK_CHARS = 4 << 20
#: Blocks up to which each has a pass over the documents.
PASSES = 3
#: Bits of the filter of all items' seeds that each task gets; text that is compared with a block at once.
FILTER_BITS, GROUP_CHARS = 1 << 25, 16 << 20
_MULTIPLIER = np.uint64(0x2545F4914F6CDD1D)
_FIELDS = ("item_id", "n_matched", "n_compared", "start", "stop")
_KIND = pa.list_(pa.struct([(f, pa.int32() if f.startswith("n_") else pa.int64()) for f in _FIELDS]))
HITS = ArrayType(StructType([StructField(f, IntegerType() if f.startswith("n_") else LongType()) for f in _FIELDS]))


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The seed at every position that has the whole mask before the end."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, len(mask), np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            h = (h ^ hashes[i : i + n]) * _MULTIPLIER
            h ^= h >> np.uint64(29)
    return mixed(h)


def _inside(first: np.ndarray, length: int, n: int) -> np.ndarray:
    """Positions from which ``length`` words belong to one text."""
    end = np.repeat(first[1:], np.diff(first))
    return (np.arange(n) + length <= end)[: max(0, n - length + 1)]


class Block:
    """The seeds of some items, by mask."""

    def __init__(self, ids: list, words: Words):
        self.ids, self.first, self.hashes = ids, words.first, words.hash
        sizes = np.diff(self.first)
        lengths: dict[str, set[int]] = {}
        for n in np.unique(np.minimum(sizes[sizes >= SHORTEST], LEAST)).tolist():
            for mask in SHORT_MASKS.get(n, MASKS):
                lengths.setdefault(mask, set()).add(n)
        self.masks = list(lengths)
        self.tables = []
        for mask in self.masks:
            h = seeds(self.hashes, mask)
            at = np.flatnonzero(_inside(self.first, len(mask), len(self.hashes)))
            item = np.searchsorted(self.first, at, "right") - 1
            at = at[np.isin(np.minimum(sizes[item], LEAST), list(lengths[mask]))]
            order = np.argsort(h[at], kind="stable")
            keys = h[at][order]
            maybe = np.zeros(1 << 20, bool)
            maybe[keys & np.uint64(len(maybe) - 1)] = True
            self.tables.append((keys, at[order], maybe))

    def hits(self, words: Words) -> np.ndarray:
        """Distinct (text, item, first word of the item in the text) of all hits."""
        found = []
        for mask, (keys, at, maybe) in zip(self.masks, self.tables):
            h = seeds(words.hash, mask)
            where = np.flatnonzero(maybe[h & np.uint64(len(maybe) - 1)])
            lo, hi = np.searchsorted(keys, h[where], "left"), np.searchsorted(keys, h[where], "right")
            where, lo, n = where[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            text = np.searchsorted(words.first, where, "right") - 1
            good = where + len(mask) <= words.first[text + 1]
            where, lo, n, text = where[good], lo[good], n[good], text[good]
            place = at[ragged(lo, n)]
            item = np.searchsorted(self.first, place, "right") - 1
            found.append(np.stack([np.repeat(text, n), item, np.repeat(where, n) - (place - self.first[item])], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)

    def likely(self, words: Words) -> np.ndarray:
        """The hits where enough words of the item match at all."""
        hits = self.hits(words)
        text, item, at = hits.T
        size = np.diff(self.first)[item]
        a, b = np.maximum(at, words.first[text]), np.minimum(at + size, words.first[text + 1])
        enough = np.minimum(LEAST, -(-4 * size // 5))
        ends = np.cumsum(b - a)
        good, i = np.zeros(len(hits), bool), 0
        while i < len(hits):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + COMPARED, "right")))
            n = b[i:j] - a[i:j]
            here = ragged(a[i:j], n)
            same = words.hash[here] == self.hashes[here + np.repeat(self.first[item[i:j]] - at[i:j], n)]
            good[i:j] = np.add.reduceat(same.astype(np.int64), np.cumsum(n) - n) >= enough[i:j]
            i = j
        return hits[good]

    def verified(self, texts: Texts) -> list[list[tuple]]:
        """Per text: (item_id, n_matched, n_compared, start, stop) of each item found."""
        words = Words(texts, lower=True)
        best: dict[tuple[int, int], tuple] = {}
        for text, item, at in self.likely(words).tolist():
            a, b = max(at, int(words.first[text])), min(at + int(self.first[item + 1] - self.first[item]), int(words.first[text + 1]))
            shift = int(self.first[item]) - at
            same = words.hash[a:b] == self.hashes[a + shift : b + shift]
            total = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
            low = np.minimum.accumulate(total)
            stop = int(np.argmax(total - low))
            start = int(np.argmin(total[: stop + 1]))
            matched = int(same[start:stop].sum())
            n = int(self.first[item + 1] - self.first[item])
            if matched < LEAST and 5 * int(same.sum()) >= 4 * n:
                start, stop, matched = int(np.argmax(same)), len(same) - int(np.argmax(same[::-1])), int(same.sum())
            if matched >= LEAST or 5 * matched >= 4 * n:
                run = (matched, -(stop - start), -(a + start))
                best[text, item] = max(best.get((text, item), run), run)
        out: list[list[tuple]] = [[] for _ in range(len(texts))]
        for (text, item), (matched, length, start) in sorted(best.items()):
            span = [int(words.starts[-start]), int(words.starts[-start - length - 1] + words.lengths[-start - length - 1])]
            begin = int(texts.offsets[text])
            chars = [len(texts.data[begin:x].tobytes().decode()) for x in span]
            out[text].append((self.ids[item], matched, -length, *chars))
        return out


def blocks(benchmark: DataFrame) -> Iterator[Block]:
    """The items in order of id, a block's worth on the driver at a time."""
    held: list[tuple] = []
    size = 0

    for row in only(benchmark, "item_id", "text").orderBy("item_id", "text").toLocalIterator():
        text = row.text or ""
        if held and size + len(text) > BLOCK_CHARS:
            yield _block(held)
            held, size = [], 0
        held.append((row.item_id, text))
        size += len(text)
    if held:
        yield _block(held)


def _block(items: list[tuple[int | None, str | None]]) -> Block:
    """A block of these items, in order of id."""
    items = sorted(items, key=lambda i: (i[0] is not None, i[0] or 0, i[1] or ""))
    ids, held = [i for i, _ in items], [t or "" for _, t in items]
    words = [Words(t, lower=True) for _, _, t in batches(pa.array(held, pa.string()))]
    whole = words[0].spans(np.zeros(0, np.int64), np.zeros(0, np.int64), np.concatenate([[0], *[w.first[1:] + n for w, n in zip(words, np.cumsum([0, *map(len, words)]))]]))
    whole._hash = np.concatenate([w.hash for w in words])
    return Block(ids, whole)


def _all_masks() -> list[str]:
    return sorted({*MASKS, *(m for masks in SHORT_MASKS.values() for m in masks)})


def _block_table(benchmark: DataFrame, n: int) -> DataFrame:
    """block, items: about :data:`BLOCK_CHARS` of text each, dealt by hash."""
    rows = only(benchmark, "item_id", "text").withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int"))
    return stored(rows.groupBy("block").agg(F.collect_list(F.struct("item_id", "text")).alias("items")), "benchmark-blocks")


def _block_seeds(blocks: DataFrame) -> DataFrame:
    """seed, block: of every item, by the masks that its length asks for."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for number, items in zip(*[c.to_pylist() for c in batch.columns]):
                for keys, _, _ in _block([(i["item_id"], i["text"]) for i in items]).tables:
                    found = np.unique(keys).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), number, np.int32))], ["seed", "block"])

    return stored(blocks.mapInArrow(run, "seed long, block int").distinct(), "benchmark-seeds")


def _text_seeds(texts: DataFrame, words: np.ndarray) -> DataFrame:
    """v0, v1, seed: of every text, the seeds whose bit is set; each once a text."""
    masks = _all_masks()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for a, b, part in batches(batch.column(0)):
                w, found = Words(part, lower=True), []
                for mask in masks:
                    h = seeds(w.hash, mask)
                    bit = h & np.uint64(FILTER_BITS - 1)
                    where = np.flatnonzero(words[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1))
                    text = np.searchsorted(w.first, where, "right") - 1
                    inside = where + len(mask) <= w.first[text + 1]
                    found.append(np.stack([text[inside].astype(np.uint64), h[where[inside]]]))
                text, h = np.unique(np.concatenate(found, axis=1), axis=1)
                own = [batch.column(i)[a:b].take(pa.array(text.astype(np.int64))) for i in (1, 2)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(h.view(np.int64))], ["v0", "v1", "seed"])

    return texts.mapInArrow(run, "v0 long, v1 long, seed long")


def _joined(rows: DataFrame, text: str, benchmark: DataFrame, n: int) -> DataFrame:
    """v0, v1, hits of all texts that hold an item, with the items in n blocks."""
    digest = [F.xxhash64(F.lit(k), text).alias(f"v{k}") for k in (0, 1)]
    blocks = _block_table(benchmark, n)
    asked = _block_seeds(blocks)
    bit = F.col("seed").bitwiseAND(F.lit(FILTER_BITS - 1))
    set_ = asked.groupBy(F.floor(bit / 64).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))).alias("bits"))
    words = np.zeros(FILTER_BITS >> 6, np.uint64)
    some = set_.toPandas()  # at most FILTER_BITS / 64 rows
    words[some["at"].to_numpy(np.int64)] = some["bits"].to_numpy(np.int64).view(np.uint64)
    texts = rows.select(F.col(text).alias("text"), *digest).where("text is not null")
    pairs = stored(_text_seeds(texts, words).join(asked, "seed").select("v0", "v1", "block").distinct(), "benchmark-pairs")
    once = texts.join(pairs.select("v0", "v1").distinct(), ["v0", "v1"], "left_semi").dropDuplicates(["v0", "v1"])
    dealt = stored(once.join(pairs, ["v0", "v1"]), "benchmark-candidates")
    groups = dealt.groupBy("block").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.length("text")) / GROUP_CHARS)).alias("groups"))
    sided = dealt.join(F.broadcast(groups), "block").withColumn("part", F.pmod("v0", "groups"))  # a row a block
    items = blocks.join(groups, "block").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))

    def verify(held: pa.Table, of: pa.Table) -> pa.Table:
        hits: list = []
        if held.num_rows:
            block = _block([(i["item_id"], i["text"]) for row in of.column("items").to_pylist() for i in row])
            hits = [h for chunk in held.column("text").chunks for _, _, part in batches(chunk) for h in block.verified(part)]
        some = pa.array([i for i, h in enumerate(hits) if h], pa.int64())
        found = pa.array([[dict(zip(_FIELDS, h)) for h in hits[i]] for i in some.to_pylist()], _KIND)
        return pa.table({"v0": held.column("v0").take(some), "v1": held.column("v1").take(some), "hits": found})

    kind = StructType([StructField("v0", LongType()), StructField("v1", LongType()), StructField("hits", HITS)])
    keys = ["block", "part"]
    found = sided.select(*keys, "v0", "v1", "text").groupBy(*keys).cogroup(items.select(*keys, "items").groupBy(*keys)).applyInArrow(verify, kind)
    out = stored(found, "benchmark-hits")
    discard(blocks, asked, pairs, dealt)
    return out


def _found(block: Broadcast, texts: pa.Array) -> pa.Array:
    """The hits of each text."""
    found = [[dict(zip(_FIELDS, h)) for h in hits] for _, _, part in batches(texts) for hits in block.value.verified(part)]
    return pa.array(found, _KIND)


def _with_block(rows: DataFrame, text: str, block: Broadcast) -> DataFrame:
    """``rows`` and their hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _found(block, batch.column(batch.schema.get_field_index(text)))], [*batch.schema.names, "hits"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("hits", HITS)]))


def _with_blocks(rows: DataFrame, text: str, items: Iterator[Block]) -> DataFrame:
    """The same for any number of blocks."""
    sc, passes = rows.sparkSession.sparkContext, None
    digest = [F.xxhash64(F.lit(k), text).alias(f"v{k}") for k in (0, 1)]
    for block in items:
        shipped = sc.broadcast(block)
        hits = _with_block(rows.select(text, *digest), text, shipped).where(F.size("hits") > 0).select("v0", "v1", "hits")
        one = stored(hits.dropDuplicates(["v0", "v1"]), "benchmark-hits")
        shipped.destroy()
        passes = one if passes is None else passes.unionByName(one)
    return _with_found(rows, text, passes)


def _with_found(rows: DataFrame, text: str, found: DataFrame) -> DataFrame:
    """``rows`` and the hits that were found for the digest of their text."""
    digest = [F.xxhash64(F.lit(k), text).alias(f"v{k}") for k in (0, 1)]
    of = found.groupBy("v0", "v1").agg(F.sort_array(F.flatten(F.collect_list("hits"))).alias("hits"))
    none = F.array().cast(HITS)
    return rows.withColumns(dict(zip(("v0", "v1"), digest))).join(of, ["v0", "v1"], "left").drop("v0", "v1").withColumn("hits", F.coalesce("hits", none))


def _searched(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, int]:
    """The columns of ``docs`` as c0, c1, ... with ``hits``, and the place of the text."""
    place = docs.columns.index(only(docs, "text").columns[0])
    rows, text = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), f"c{place}"
    chars = only(benchmark, "text").agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if chars > PASSES * BLOCK_CHARS:
        return _with_found(rows, text, _joined(rows, text, benchmark, -(-chars // BLOCK_CHARS))), place
    items = blocks(benchmark)
    first, second = next(items, None), next(items, None)
    if first is None:
        return rows.withColumn("hits", F.array().cast(HITS)), place
    if second is None:
        return _with_block(rows, text, docs.sparkSession.sparkContext.broadcast(first)), place
    return _with_blocks(rows, text, chain((first, second), items)), place


def with_hits(docs: DataFrame, benchmark: DataFrame, keep_text: bool = False) -> DataFrame:
    """The columns of ``docs`` (text only if asked) and ``hits``: an array of
    item_id, n_matched, n_compared, start and stop (in code points)."""
    rows, place = _searched(docs, benchmark)
    own = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() != "hits" and (keep_text or i != place)]
    return rows.select(*own, "hits")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item found in it: doc_id and the hit."""
    return with_hits(only(docs, "doc_id", "text"), benchmark).select("doc_id", F.inline("hits"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    rows, _ = _searched(docs, benchmark)
    return rows.where(F.size("hits") == 0).drop("hits").toDF(*docs.columns)
