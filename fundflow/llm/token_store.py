"""Token ids in files of directly addressable codes.

An id is cut into chunks of eight bits. Level 0 holds the low chunk of every
id, level k the k-th chunk of those ids that have one. A bitmap beside each
level says which ids go on; a directory of ranks (one count per 512 bits) says
where in the next level they go on. Token ``i`` is read with one probe per
level, without decoding a block.

Files: a token store is a Parquet folder with one row per *segment*; a segment
is a self-contained byte string (layout in :func:`pack_segment`), so the
executors write through Spark's commit protocol to whatever storage the
cluster uses, and a lost task writes again without leaving duplicates.
Documents never straddle segments. Pages are not compressed.
:func:`tokens_at` reads any tokens of a store by their places in it: the
narrow columns say which segments hold them, and only these are fetched and
probed, without decoding. A segment is one Parquet cell, so a fetch reads it
whole (about 2 MB).

Defined results: a null text is an empty one (only the end id); a null doc_id
sorts first; rows that repeat a doc_id are kept, in order of text; an empty
table gives an empty store; a text of any length is one document of one
segment, so a document ends at the 2^31 bytes of a cell (about 10^9 ids).
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundflow.llm.bpe import DOUBTFUL, Merger
from fundflow.llm.common import only, partitions, shared_dir
from fundflow.llm.words import Texts, Words, WordTable, batches, in_order

MAGIC = b"DACSEG01"
HEAD = struct.Struct("<8sQQI")
LEVEL = struct.Struct("<QQQ")
RANK_BITS = 512
#: A segment is closed by the document that brings it to so many ids.
SEGMENT_TOKENS = 1 << 20

SEGMENT_SCHEMA = "part int, seq int, tokens_before long, n_docs long, n_tokens long, segment binary"


def pack_levels(ids: np.ndarray) -> list[tuple[bytes, bytes, bytes]]:
    """(chunks, continuation bitmap, rank directory) per level."""
    levels, rest = [], ids.astype(np.uint32, copy=False)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(bits) // (RANK_BITS // 8)) * (RANK_BITS // 8), np.uint8)
        padded[: len(bits)] = bits
        ones = np.bitwise_count(padded.view(np.uint64)).astype(np.int64).reshape(-1, RANK_BITS // 64).sum(axis=1)
        ranks = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
        levels.append(((rest & 255).astype(np.uint8).tobytes(), padded.tobytes(), ranks.tobytes()))
        rest = rest[more] >> 8
        if not len(rest):
            return levels


def pack_segment(doc_ids: list, counts: list[int], ids: np.ndarray) -> bytes:
    """Header, table of documents (id, null flag, first token), levels."""
    levels = pack_levels(ids)
    starts = np.concatenate([[0], np.cumsum(counts)]).astype("<u8")
    out = [
        HEAD.pack(MAGIC, len(doc_ids), len(ids), len(levels)),
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        starts.tobytes(),
    ]
    for level in levels:
        out += [LEVEL.pack(*map(len, level)), *level]
    return b"".join(out)


class Segment:
    """Views into a segment's bytes; nothing is decoded on opening."""

    def __init__(self, data: bytes):
        magic, self.n_docs, self.n_tokens, n_levels = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = HEAD.size

        def view(kind: str, n: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(data, kind, n, at)
            at += x.nbytes
            return x

        self.doc_ids, self.nulls, self.starts = view("<i8", self.n_docs), view("u1", self.n_docs), view("<u8", self.n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            sizes = LEVEL.unpack_from(data, at)
            at += LEVEL.size
            self.levels.append((view("u1", sizes[0]), view("u1", sizes[1]), view("<u4", sizes[2] // 4)))

    def token(self, i: int) -> int:
        """The i-th id of the segment: one probe and one rank per level."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BITS * (RANK_BITS // 8)
            before = int(np.bitwise_count(bits[block : i >> 3]).sum()) + int(bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
            i, shift = int(ranks[i // RANK_BITS]) + before, shift + 8
        return value

    def ids(self) -> np.ndarray:
        """All ids, level by level from the last."""
        above = None
        for chunks, bits, _ in reversed(self.levels):
            out = chunks.astype("<u4")
            if above is not None:
                out[np.unpackbits(bits, count=len(chunks), bitorder="little").view(bool)] |= above << 8
            above = out
        return above


#: Stands for a word whose text the library must encode whole.
WHOLE = np.uint32(0xFFFFFFFF)


def _cut(begin: np.ndarray, start: np.ndarray, end: np.ndarray, at_start: np.ndarray):
    """White space before a word but its last character; that and the word."""
    lead = start > begin
    return (begin, start - begin - lead), (start - lead, end - start + lead)


class WordEncoder:
    """Encodes as the byte-level tokenizer of the file does.

    Its pre-tokens never span the place before the last white-space character
    ahead of a word, so a text is cut there and a worker looks the pieces up
    by hash; the library's own model merges a pre-token when it is first met.
    Texts with a special token's string, or with a piece that starts or ends
    in white space beyond ASCII, go to the library whole.
    """

    #: The pre-tokens of pieces, which a NUL separates, without doubtful characters.
    PLAIN = re.compile(r"\x00|'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w\x00]|_)+|\s+(?![^\s\x00])|\s+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        self.merger = Merger(self.tokenizer)
        self.table = WordTable(self.pieces, np.uint32)

    def library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def pieces(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each piece, merged together."""
        plain, texts, other, others = [], [], [], []
        for i, text in enumerate([w.decode() for w in words]):
            if DOUBTFUL.search(text) or "<" in text and self.special.search(text):
                whole = self.special.search(text) or text[-1].isspace() or text[1:2].isspace()
                other.append(i)
                others.append(np.array([WHOLE]) if whole else self.library(text))
            else:
                plain.append(i)
                texts.append(text)
        tokens = self.PLAIN.findall("\0".join(texts))
        ids, counts = self.merger.encode(["" if t == "\0" else t for t in tokens])
        owner = np.cumsum([t == "\0" for t in tokens])
        n = np.bincount(owner, counts, len(plain)).astype(np.int64) if tokens else np.zeros(len(plain), np.int64)
        return in_order(np.array(plain + other, np.int64), np.concatenate([ids.astype(np.uint32), *others]), np.concatenate([n, [len(x) for x in others]]).astype(np.int64), len(words))

    def encode(self, texts: Texts) -> list[np.ndarray]:
        """The ids of each text."""
        spans = Words(texts).with_gaps(texts, _cut)
        ids, lengths = self.table.expand(self.table.lookup(spans))
        bounds = np.concatenate([[0], np.cumsum(lengths)])[spans.first]
        out = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        for i in np.unique(np.searchsorted(bounds, np.flatnonzero(ids == WHOLE), "right") - 1).tolist():
            out[i] = self.library(texts.text(i))
        return out


def _segments(path: str, end_id: int, segment_tokens: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = WordEncoder(path), TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32)
        docs: list = []
        counts: list[int] = []
        held: list[np.ndarray] = []
        n = before = seq = 0

        def close() -> pa.RecordBatch:
            nonlocal n, before, seq
            row = [part, seq, before, len(docs), n, pack_segment(docs, counts, np.concatenate(held))]
            before, seq, n = before + n, seq + 1, 0
            for x in (docs, counts, held):
                x.clear()
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["part", "seq", "tokens_before", "n_docs", "n_tokens", "segment"])

        for batch in rows:
            for a, b, texts in batches(batch.column(1)):
                for doc_id, ids in zip(batch.column(0)[a:b].to_pylist(), encoder.encode(texts)):
                    docs.append(doc_id)
                    counts.append(len(ids) + 1)
                    held += ids, end
                    n += len(ids) + 1
                    if n >= segment_tokens:
                        yield close()
        if docs:
            yield close()

    return run


def write_store(docs: DataFrame, tokenizer_path: str, end_id: int, path: str, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encode ``docs(doc_id, text)`` into a token store at ``path``.

    The texts are range-partitioned and sorted by doc_id, so the number of the
    partition and of the segment in it order the store.
    """
    ordered = only(docs, "doc_id", "text").repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_segments(tokenizer_path, end_id, segment_tokens), SEGMENT_SCHEMA).write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a store: doc_id, start, n_tokens, ids_crc32."""
    store = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    bases = _bases(store)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                s = Segment(data.as_buffer())
                ids, starts = memoryview(s.ids()).cast("B"), s.starts.astype(np.int64)
                bounds = (starts * 4).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(s.doc_ids, pa.int64(), mask=s.nulls.astype(bool)),
                        pa.array(starts[:-1] + (bases[part] + before)),
                        pa.array(np.diff(starts)),
                        pa.array([zlib.crc32(ids[a:b]) for a, b in zip(bounds, bounds[1:])], pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return store.select("part", "tokens_before", "segment").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _bases(store: DataFrame) -> dict[int, int]:
    """The first token of each partition of a store; the driver adds up one
    count per partition, no more."""
    base, bases = 0, {}
    for part, n in sorted(tuple(r) for r in store.groupBy("part").agg(F.sum("n_tokens")).collect()):
        bases[part] = base
        base += n
    return bases


def tokens_at(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """Per distinct ``places(i)``, 0 for the store's first token: i and token.
    Places that the store doesn't have give no row."""
    store = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    base = spark.createDataFrame(list(_bases(store).items()), "part int, base long")
    ranges = store.select("part", "seq", "tokens_before", "n_tokens").join(base, "part")
    first = F.col("base") + F.col("tokens_before")
    step = SEGMENT_TOKENS
    spans = ranges.select("part", "seq", first.alias("first"), (first + F.col("n_tokens")).alias("stop"))
    spans = spans.withColumn("step", F.explode(F.sequence(F.expr(f"first div {step}"), F.expr(f"(stop - 1) div {step}"))))
    wanted = only(places, "i").where("i >= 0").distinct().withColumn("step", F.expr(f"i div {step}"))
    found = wanted.join(spans, "step").where("i >= first and i < stop")
    asked = found.groupBy("part", "seq", F.expr("i div 65536").alias("few")).agg(F.first("first").alias("first"), F.collect_list("i").alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, asked, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                s = Segment(data.as_buffer())
                yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), pa.array([s.token(i - begin) for i in asked], pa.int64())], ["i", "token"])

    both = store.select("part", "seq", "segment").join(asked, ["part", "seq"])
    return both.select("first", "places", "segment").mapInArrow(run, "i long, token long")


def token_store(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None) -> DataFrame:
    """Write the store, then its index as read back from the files."""
    spark = docs.sparkSession
    path = path or shared_dir(spark, "token-store")
    write_store(docs, tokenizer_path, end_id, path)
    return read_index(spark, path)
