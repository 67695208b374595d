"""Line deduplication with DataFrame functions only.

Every line is reduced to a 128-bit hash of its key (the line without white
space at its ends, A-Z lower-cased). The hashes are range-partitioned together
with a cell of documents and sorted by document and position, so that a hash's
first occurrence comes first; a very common line is dealt out over its cells,
each of about :data:`CELL_DOCS` documents, which are added up afterwards. What
comes back per document is a compressed bitmap of the lines to keep, never text.

Defined results: a null or empty text is one empty line; an empty key is never
a duplicate; rows with the same doc_id and text count as one document and get
the same bitmap; rows with the same doc_id and other texts are documents of
their own; null doc_ids are ids like any other; a text of any length is split
as a whole. Other columns pass through :func:`without_lines` as they are, but
for columns named ``n_lines`` or ``n_dropped``, which the counts replace.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundflow.llm.common import only, packed, stored, unpacked

#: Documents of a hash that share a range, and the least number of cells.
CELL_DOCS, CELLS = 50_000, 64
#: So many repeated lines (24 bytes each) are broadcast. Where there are more,
#: these are the most frequent ones and the rest is joined by shuffle.
BROADCAST_LINES = 200_000
SPACES = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(SPACES)), ascii_uppercase, ascii_lowercase)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _with(value: Column, then) -> Column:
    """``then(value)``, with the value computed once."""
    return F.transform(F.array(value), then)[0]


def _bit(pos: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (pos % 64).cast("int"))


def line_hashes(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, version (of the text) and the hash of every line, null
    where the key is empty; written to the shared folder."""
    one = lambda key: F.when(key != "", F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b")))
    hashes = F.transform(lines_of(F.col("text")), lambda line: _with(line_key(line), one))
    return stored(docs.select("doc_id", _version(), hashes.alias("hashes")), "line-hashes")


def _version() -> Column:
    return F.xxhash64("text").alias("version")


def first_occurrences(hashes: DataFrame) -> DataFrame:
    """Per hash: a, b, n_docs, first (doc_id, version, pos)."""
    at = F.posexplode("hashes").alias("pos", "hash")
    cells = max(CELLS, hashes.count() // CELL_DOCS)
    occurrences = hashes.select("doc_id", "version", F.pmod(F.xxhash64("doc_id", "version"), F.lit(cells)).alias("cell"), at).where("hash is not null")
    lines = occurrences.select(F.col("hash.a"), F.col("hash.b"), "cell", "doc_id", "version", "pos")
    dealt = lines.repartitionByRange("a", "b", "cell").sortWithinPartitions("a", "b", "cell", "doc_id", "version", "pos")
    # equal (hash, cell) rows share a partition and arrive by document and position
    per_doc = dealt.groupBy("a", "b", "cell", "doc_id", "version").agg(F.min("pos").alias("pos"))
    per_cell = per_doc.groupBy("a", "b", "cell").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "version", "pos")).alias("first"))
    return per_cell.groupBy("a", "b").agg(F.sum("n").alias("n_docs"), F.min("first").alias("first"))


def keep_bitmaps(docs: DataFrame, min_docs: int, keep_first: bool = False) -> DataFrame:
    """Per document that loses lines: doc_id, version, n_dropped and keep.

    ``keep`` has a word of 64 lines (bit i of word k: line 64 k + i stays) for
    each word that isn't all ones. Lines whose key occurs in at least
    ``min_docs`` documents go, with ``keep_first`` all but the first occurrence.
    """
    hashes = line_hashes(only(docs, "doc_id", "text"))
    repeated = stored(first_occurrences(hashes).where(F.col("n_docs") >= min_docs), "repeated-lines")
    lines = hashes.select("doc_id", "version", F.posexplode("hashes").alias("pos", "hash")).where("hash is not null")
    same = (F.col("hash.a") == F.col("a")) & (F.col("hash.b") == F.col("b"))
    if repeated.count() <= BROADCAST_LINES:
        gone = lines.join(F.broadcast(repeated), same)
    else:
        # fewer than BROADCAST_LINES lines can have more than this share of all documents' lines
        hot = F.col("n_docs") > repeated.agg(F.sum("n_docs")).first()[0] / BROADCAST_LINES
        gone = lines.join(F.broadcast(repeated.where(hot)), same).unionByName(lines.join(repeated.where(~hot), same))
    if keep_first:
        gone = gone.where(~F.struct("doc_id", "version", "pos").eqNullSafe(F.col("first")))
    words = gone.groupBy("doc_id", "version", F.expr("pos div 64").alias("word")).agg(F.bit_or(_bit(F.col("pos"))).alias("bits"))
    return words.groupBy("doc_id", "version").agg(
        F.sum(F.bit_count("bits")).alias("n_dropped"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("bits"))))).alias("keep"),
    )


def without_lines(docs: DataFrame, bitmaps: DataFrame, counts: bool = True) -> DataFrame:
    """``docs`` with the text that its bitmap keeps; n_lines, n_dropped beside
    if ``counts``."""
    keyed = bitmaps.select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), F.col("n_dropped").alias("_dropped"), "keep").hint("shuffle_hash")
    both = packed(docs, "doc_id", "text").join(keyed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_version")), "left")
    lines = lines_of(F.col("text"))
    last = (F.size(lines) - 1).cast("long")
    dense = F.transform(F.sequence(F.lit(0).cast("long"), F.floor(last / 64)), lambda k: F.coalesce(F.col("keep")[k], F.lit(-1).cast("long")))
    kept = _with(dense, lambda bits: F.array_join(F.filter(lines, lambda line, i: F.get(bits, F.floor(i / 64).cast("int")).bitwiseAND(_bit(i)) != 0), "\n"))
    beside = [F.size(lines).cast("long").alias("n_lines"), F.coalesce("_dropped", F.lit(0).cast("long")).alias("n_dropped")] if counts else []
    return unpacked(both, docs.columns, *beside, text=F.when(F.col("keep").isNull(), F.col("text")).otherwise(kept))


def dedup_lines(docs: DataFrame, min_docs: int, keep_first: bool = False, counts: bool = True) -> DataFrame:
    """``docs`` without its repeated lines, with n_lines and n_dropped."""
    return without_lines(docs, keep_bitmaps(docs, min_docs, keep_first), counts)
