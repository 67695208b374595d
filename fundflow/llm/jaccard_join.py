"""Near-duplicate documents: an exact Jaccard join of sets of word n-grams.

Sets are never stored whole for all documents; they are cheap to compute and
each pass over the texts computes them anew.

1. The first pass writes a narrow table: per document the size and a digest of
   the whole set (equal sets are one *node* from here); and per task how many
   sets have a token of each of a fixed number of buckets.
2. Tokens are ranked by their bucket's count over all documents, then by hash.
   Two sets that link share at least ``need`` tokens among the rarest fifth
   (and a few more) of the larger and the rarest ninth (and a few more) of the
   smaller. The second pass lists these rare tokens. A row of the list counts
   if another node of a size that can link has the token too; only nodes with
   enough such rows are *candidates*.
3. The third pass writes the candidates' sets and, beside each, its bitmap.
   Those with the same least token under a fixed permutation are joined by a
   signature tree (signature_tree); so are, under three more permutations,
   those of blocks that are not one class yet. A tree of bitmaps alone comes
   first, and only sets that may link are shuffled. This finds nearly all links.
4. The rest, exactly: where two classes still share enough rare tokens, and
   their bitmaps' roots enough bits, the trees of the two classes are traversed
   against each other. Nodes whose rare tokens are shared by more than
   :data:`WIDE` classes are not paired up by token but form families, whose
   trees are traversed as a whole.

Groups of any size are dealt out in chunks of at most about :data:`CHUNK` sets
and :data:`CHUNK_TOKENS` tokens, so no task holds more than two chunks of one;
the links between chunks are found in steps 3 and 4. A table is deleted once
its successor is written. Nothing is sampled or capped, and the driver gets no
more than the counts of the buckets (16 MB) and a filter of candidates (4 MB).

Sets are compared by 64-bit hashes of n-grams, nodes by 64-bit digests: of
10^9 different sets two share a digest with a chance of about 3 in 100.

Defined results: a text without words has an empty set, links with nothing and
is its own component; a text shorter than an n-gram is one n-gram; a text of
any length is one set, held whole by the task that reads it; rows of one
doc_id are one document of several texts; rows of null doc_ids are documents
of their own, and a component's id is null only if all its ids are; an empty
table gives an empty result; other columns are ignored by
:func:`near_duplicates` and kept by :func:`without_near_duplicates`, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundflow.llm.common import WORD_PATTERN, discard, only, packed, partitions, stored, unpacked
from fundflow.llm.signature_tree import bitmap, link_across, link_all, may_link, possible, unshared
from fundflow.llm.words import Texts, Words, batches, mixed
from fundflow.plans.components import components

N_GRAM = 5
CHUNK, CHUNK_TOKENS = 4096, 1 << 22
#: Bitmaps that one task holds of a block.
SKETCHES = 1 << 16
#: Rare tokens that two sets must share, if they have so many.
NEED = 12
#: A token of more classes than this makes their nodes a family.
WIDE = 64
#: Buckets in which tokens are counted, and pieces in which counts travel.
BUCKETS, PIECES = 1 << 22, 16
#: Tokens of more sets than this, and than twice the mean of the buckets more,
#: are dealt out by node.
HOT, SALTS = 1_000_000, 100
#: Bits of a filter of nodes: 32 for each, within these bounds.
FILTER_BITS = (1 << 16, 1 << 25)
#: So many large blocks are broadcast (a row of 12 bytes each); more are joined by shuffle.
BROADCAST_BLOCKS = 200_000
_M = np.uint64(0x9FB21C651E98DF25)
_TURNS = [np.uint64(x) for x in (1, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_NODE = {"doc_id": pa.int64(), "n": pa.int32(), "node": pa.int64()}
NODES = "doc_id long, n int, node long"
_LEASTS = [f"m{k}" for k in range(4)]
#: Stands for a null doc_id.
_NO_ID = (1 << 63) - 1


def shingles(texts: Texts, n: int = N_GRAM) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's n-grams of lower-cased words."""
    words = Words(texts, lower=True)
    h, count = words.hash, len(words)
    with np.errstate(over="ignore"):
        grams = h[: max(0, count - n + 1)].copy()
        for k in range(1, n):
            grams = grams * _M + h[k : k + len(grams)]
        grams = mixed(grams)
        out = []
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            if b - a >= n:
                out.append(np.unique(grams[a : b - n + 1]))
            elif b > a:
                whole = np.uint64(b - a)
                for x in h[a:b]:
                    whole = whole * _M + x
                out.append(mixed(np.array([whole], np.uint64)))
            else:
                out.append(h[:0])
    return out


def _node(tokens: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int((np.bitwise_xor.reduce(mixed(tokens)) + np.uint64(len(tokens)) * _M + tokens.sum(dtype=np.uint64)).view(np.int64))


def _turned(tokens: np.ndarray, k: int) -> np.ndarray:
    return tokens if not k else mixed(tokens ^ _TURNS[k])


def _leasts(sets: list[np.ndarray]) -> list[pa.Array]:
    """The least token of each set under every permutation."""
    with np.errstate(over="ignore"):
        return [pa.array([int(_turned(t, k).min().view(np.int64)) for t in sets], pa.int64()) for k in range(4)]


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[np.ndarray], list]]:
    """(doc_ids, sets, nodes) of parts of a batch of (doc_id, text)."""
    for a, b, texts in batches(batch.column(1)):
        sets = shingles(texts)
        yield batch.column(0)[a:b], sets, [_node(s) if len(s) else None for s in sets]


def _buckets(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(20) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _rows(docs: DataFrame) -> DataFrame:
    return only(docs, "doc_id", "text").select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), "text", F.xxhash64("text").alias("version"))


def node_table(docs: DataFrame) -> DataFrame:
    """Rows of :data:`NODES` with the text's version, and rows of counts: piece and counts (32 bits a
    bucket, compressed)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = np.zeros(BUCKETS, np.uint32), [], 0
        names = [*_NODE, "version", "piece", "counts"]
        for batch in rows:
            done = 0
            for ids, sets, nodes in _sets(batch):
                held += sets
                n += sum(map(len, sets))
                if n > 1 << 20:
                    total += np.bincount(_buckets(np.concatenate(held)), minlength=BUCKETS).astype(np.uint32)
                    held, n = [], 0
                sizes = pa.array([len(t) for t in sets], pa.int32())
                version = batch.column(2)[done : done + len(sets)]
                done += len(sets)
                yield pa.RecordBatch.from_arrays([ids, sizes, pa.array(nodes, pa.int64()), version, pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], names)
        if held:
            total += np.bincount(_buckets(np.concatenate(held)), minlength=BUCKETS).astype(np.uint32)
        if total.any():
            for k, part in enumerate(np.split(total, PIECES)):
                yield pa.RecordBatch.from_arrays([*[pa.nulls(1, kind) for kind in (*_NODE.values(), pa.int64())], pa.array([k], pa.int32()), pa.array([_pack(part)], pa.binary())], names)

    return stored(_rows(docs).mapInArrow(run, f"{NODES}, version long, piece int, counts binary"), "nodes", compression="zstd")


def _pack(counts: np.ndarray) -> bytes:
    planes = np.minimum(counts, 0xFFFFFFFF).astype("<u4").view(np.uint8).reshape(-1, 4).T  # the high bytes are mostly zero
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * BUCKETS // PIECES, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").reshape(-1)


def bucket_counts(table: DataFrame) -> np.ndarray:
    """The counts of all tasks, added up (saturated at 32 bits)."""

    def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in rows:
            for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                totals[piece] = totals.get(piece, 0) + _unpack(counts).astype(np.uint64)
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([_pack(t) for t in totals.values()], pa.binary())], ["piece", "counts"])

    out = np.zeros((PIECES, BUCKETS // PIECES), np.uint32)
    for r in table.where("piece is not null").select("piece", "counts").repartition(PIECES, "piece").mapInArrow(add, "piece int, counts binary").collect():
        out[r.piece] = _unpack(r.counts)
    return out.reshape(-1)


def need(n: Column, share: float = 0.8) -> Column:
    """Rare tokens that a set of ``n`` shares with one that it links with; 0.64: at least, whatever the other's size."""
    return F.least(F.lit(NEED), F.ceil(n * share - 1e-9))


def rare_tokens(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """(token, node, size, salt) for the rarest tokens of each set: so many that
    it shares :func:`need` of them with a smaller set that it links with.

    ``size`` is twice the size of the set, and one more for the still rarer
    tokens that it would share with a larger set. ``salt`` is 0, or for tokens
    of very many sets one of 1 to :data:`SALTS`, by node.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(counts)
    hot = HOT + 2 * float(counts.mean())

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shipped.value
        for batch in rows:
            for _, sets, nodes in _sets(batch):
                tokens, own, sizes, salts, seen = [], [], [], [], set()
                for t, node in zip(sets, nodes):
                    if node is None or node in seen:
                        continue
                    seen.add(node)
                    n = len(t)
                    shared = -(-4 * n // 5)
                    spare = min(NEED, shared)
                    k, early = n - shared + spare, n - -(-8 * n // 9) + spare
                    count = often[_buckets(t)]
                    rarest = np.lexsort((t, count))[:k]
                    tokens.append(t[rarest])
                    own.append(node)
                    salts.append(np.where(count[rarest] > hot, 1 + node % SALTS, 0))
                    sizes.append(2 * n + (np.arange(k) < early))
                if own:
                    k = [len(t) for t in tokens]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(own, np.int64), k)), pa.array(np.concatenate(sizes).astype(np.int32)), pa.array(np.concatenate(salts).astype(np.int8))], ["token", "node", "size", "salt"]
                    )

    return _rows(docs).mapInArrow(run, "token long, node long, size int, salt byte")


def shared_tokens(rare: DataFrame) -> DataFrame:
    """(token, node, n, early) where another node of the token can link as far
    as sizes say (of tokens of very many sets, any); just the nodes that have
    enough of these."""
    by = Window.partitionBy("token", "salt").orderBy("n", "node")
    rows = rare.repartition("token", "salt").select("token", "salt", "node", F.expr("size div 2").cast("int").alias("n"), (F.col("size") % 2 == 1).alias("early"))
    once = rows.withColumn("was", F.lag("node").over(by)).where("was is null or was <> node").drop("was")
    below = F.last(F.when(F.col("early"), F.col("n")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    around = once.withColumn("below", below).withColumn("above", F.lead("n").over(by))
    useful = around.where("salt > 0 or 5 * below >= 4 * n or early and 5 * n >= 4 * above").drop("salt", "below", "above")
    counted = useful.withColumn("k", F.count("*").over(Window.partitionBy("node")))
    return stored(counted.where(F.col("k") >= need(F.col("n"), 0.64)).drop("k"), "shared-tokens")


def _filter(nodes: DataFrame, key: Column) -> np.ndarray:
    """A bitmap of hashed keys, of at most 4 MB."""
    low, high = FILTER_BITS
    bits = min(high, max(low, 1 << (32 * nodes.count()).bit_length()))
    bit = F.pmod(key, F.lit(bits))
    words = nodes.groupBy(F.floor(bit / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))).alias("bits")).collect()
    table = np.zeros(bits // 64, np.int64)
    table[[r.word for r in words]] = [r.bits for r in words]
    return table


def _passes(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys % (len(table) * 64)
    return table[at >> 6] >> (at & 63) & 1 == 1


def candidate_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """For ``nodes(node, doc_id)``: node, n, m0.., sketch, tokens (as one doc_id
    has them). Rows that only pass the filter stay while they are few: they link
    with nothing."""
    shipped = docs.sparkSession.sparkContext.broadcast(_filter(nodes, F.col("node").bitwiseXOR(F.col("doc_id"))))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for ids, sets, nodes in _sets(batch):
                some = [i for i, node in enumerate(nodes) if node is not None]
                keys = np.array([nodes[i] for i in some], np.int64) ^ np.array(ids.to_pylist(), np.int64)[some]
                keep = [i for i, good in zip(some, _passes(shipped.value, keys).tolist()) if good]
                if keep:
                    kept = [sets[i] for i in keep]
                    sizes, own = pa.array([len(t) for t in kept], pa.int32()), pa.array([nodes[i] for i in keep], pa.int64())
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep)), sizes, own, *_leasts(kept), *[pa.array([f(t).tobytes() for t in kept], pa.binary()) for f in (bitmap, np.asarray)]], [*_NODE, *_LEASTS, "sketch", "tokens"])

    few = _rows(docs).mapInArrow(run, f"{NODES}, {', '.join(f'{m} long' for m in _LEASTS)}, sketch binary, tokens binary")
    if nodes.count() * 32 > FILTER_BITS[1]:
        few = few.join(nodes, ["node", "doc_id"], "left_semi")
    return stored(few.drop("doc_id"), "candidates", compression="none")


def _with_tokens(members: DataFrame, candidates: DataFrame) -> DataFrame:
    """``members`` (kept in a table, with a node) with the tokens of their nodes;
    only sets that pass a filter of these nodes are shuffled."""
    shipped = members.sparkSession.sparkContext.broadcast(_filter(members, F.col("node")))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            yield batch.filter(pa.array(_passes(shipped.value, batch.column(0).to_numpy(zero_copy_only=False))))

    return members.join(candidates.select("node", "tokens").mapInArrow(run, "node long, tokens binary"), "node")


def _grouped(members: DataFrame, keys: list[str], then: Callable[[list[tuple]], Iterator[tuple]]) -> DataFrame:
    """(a, b) of ``then`` for the rows of each group of keys; the other columns
    are label, tokens and what else ``then`` reads, in order."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []
        for batch in rows:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[: len(keys)] != key:
                    if len(held) > 1:
                        out += then(held)
                    key, held = row[: len(keys)], []
                held.append(row[len(keys) :])
            if len(out) > 4096:
                yield _links(out)
                out = []
        if len(held) > 1:
            out += then(held)
        yield _links(out)

    spark = members.sparkSession
    rest = [c for c in members.columns if c not in keys]
    dealt = members.select(*keys, *rest).repartition(partitions(spark), *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "a long, b long")


def _links(pairs: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])


def _tokens(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def _all(rows: list[tuple]) -> Iterator[tuple]:
    """Members (label, tokens) of one block."""
    labels = [r[0] for r in rows]
    classes = link_all([_tokens(r[1]) for r in rows], labels)
    return ((x, classes.root(x)) for x in set(labels) if classes.root(x) != x)


def _across(rows: list[tuple]) -> Iterator[tuple]:
    """Members (label, tokens, side) of a class and of others that may link with it."""
    sides = [[r for r in rows if r[2] == side] for side in (0, 1)]
    if not all(sides):
        return iter(())
    classes = link_across(*(x for side in sides for x in ([_tokens(r[1]) for r in side], [r[0] for r in side])))
    return ((x, classes.root(x)) for x in {r[0] for r in rows} if classes.root(x) != x)


def _either(rows: list[tuple]) -> Iterator[tuple]:
    """Members of two chunks of a family, or of one with itself."""
    return _across(rows) if any(r[2] for r in rows) else _all([r[:2] for r in rows])


def _chunks(size: Column, tokens: Column) -> Column:
    return F.greatest(F.ceil(size / CHUNK), F.ceil(tokens / CHUNK_TOKENS)).cast("int")


def _in_chunk(salt: int, chunks: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), "node"), F.col(chunks)).cast("int")


def _compatible(entries: DataFrame, *keys: str) -> DataFrame:
    """Rows (node, n, label) of groups of several classes that have a neighbour,
    by size, with which they can link."""
    group = Window.partitionBy(*keys)
    by = group.orderBy("n", "node")
    around = entries.withColumn("below", F.lag("n").over(by)).withColumn("above", F.lead("n").over(by)).withColumn("low", F.min("label").over(group)).withColumn("high", F.max("label").over(group))
    return around.where("low <> high and (5 * below >= 4 * n or 5 * n >= 4 * above)").drop("below", "above", "low", "high")


def _bitmaps(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)


def _promising(entries: DataFrame) -> DataFrame:
    """(node, n, turn, least) of a table of blocks, entries (node, n, label,
    turn, least, sketch), where the bitmaps leave room for a link."""
    spark = entries.sparkSession

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close() -> pa.RecordBatch:
            some = []
            if len(held) > 1:
                least, node, n, label, sketch = zip(*held)
                some = np.flatnonzero(possible(_bitmaps(sketch), np.array(n, np.int64), np.array(node, np.int64), np.array(label, np.int64))).tolist()
            cols = [[held[i][1] for i in some], [held[i][2] for i in some], [key[0]] * len(some), [held[i][0] for i in some]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int64()))], ["node", "n", "turn", "least"])

        for batch in rows:
            for turn, least, part, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if (turn, least, part) != key or len(held) == SKETCHES:
                    if len(held) > 1:
                        yield close()
                    key, held = (turn, least, part), []
                held.append((least, *row))
        if len(held) > 1:
            yield close()

    # blocks are dealt by size first: only like sizes link
    part = F.floor(F.log(F.col("n").cast("double")) * 2).cast("int").alias("part")
    sides = F.explode(F.array(part, part + 1)).alias("part")
    keys = ["turn", "least", "salt", "part"]
    dealt = entries.select("turn", "least", "salt", sides, "node", "n", "label", "sketch").repartition(partitions(spark), *keys).sortWithinPartitions(*keys, "n")
    dealt = dealt.select("turn", "least", F.struct("salt", "part"), "node", "n", "label", "sketch")
    return stored(dealt.mapInArrow(run, "node long, n int, turn int, least long").distinct(), "promising")


def _salted(entries: DataFrame) -> DataFrame:
    """Entries with a salt that deals very large blocks out."""
    large = entries.groupBy("turn", "least").agg(F.count("*").alias("size")).where(F.col("size") > SKETCHES)
    salt = F.pmod(F.xxhash64(F.lit(4), "node"), F.ceil(F.col("size") / SKETCHES)).cast("int")
    return entries.join(_few(large), ["turn", "least"], "left").withColumn("salt", F.coalesce(salt, F.lit(0))).drop("size")


def _few(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_BLOCKS else table


def _block_links(entries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Links of nodes within the blocks of :func:`_promising` entries."""
    some = _promising(entries)
    shipped = some.sparkSession.sparkContext.broadcast(_filter(some, _entry_key()))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = np.array(_TURNS).view(np.int64)
        for batch in rows:
            node = batch.column(0).to_numpy(zero_copy_only=False)
            for k in range(4):
                good = np.flatnonzero(_passes(shipped.value, node ^ turns[k]))
                if len(good):
                    part = batch.take(pa.array(good))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(good), k, np.int32)), part.column(1 + k), part.column(0), part.column(5)], ["turn", "least", "node", "tokens"])

    members = candidates.select("node", *_LEASTS, "tokens").mapInArrow(run, "turn int, least long, node long, tokens binary")
    large = some.groupBy("turn", "least").agg(_chunks(F.count("*"), F.sum("n")).alias("chunks")).where("chunks > 1")
    members = members.join(_few(large), ["turn", "least"], "left").select("turn", "least", F.coalesce(_in_chunk(1, "chunks"), F.lit(0)).alias("chunk"), "node", "tokens")
    found = stored(_grouped(members, ["turn", "least", "chunk"], _all), "block-links")
    discard(some)
    return found


def _entry_key() -> Column:
    """Distinct for each turn of a node."""
    return F.col("node").bitwiseXOR(F.element_at(F.array(*[F.lit(int(t.view(np.int64))) for t in _TURNS]), F.col("turn") + 1))


def classes(docs: DataFrame, table: DataFrame, firsts: DataFrame) -> DataFrame:
    """(node, n, label) for every node that may link with another; nodes of one
    component have one label. ``firsts(node, doc_id)``: a document per node."""
    shared = shared_tokens(rare_tokens(docs, bucket_counts(table)))
    nodes = stored(firsts.join(shared.select("node").distinct(), "node", "left_semi"), "candidate-nodes")
    candidates = candidate_sets(docs, nodes)
    discard(nodes)

    # blocks of one least token
    first = candidates.select("node", "n", F.col("node").alias("label"), F.lit(0).alias("turn"), F.col("m0").alias("least"), "sketch")
    links = _block_links(_compatible(_salted(first), "turn", "least", "salt"), candidates)
    labels = _relabelled(stored(candidates.select("node", "n", F.col("node").alias("label")).distinct(), "labels"), links)

    # blocks of more permutations that are not one class yet
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("turn"), F.col(f"m{k}").alias("least")) for k in (1, 2, 3)])).alias("b")
    sketched = candidates.select("node", "sketch", each).select("node", "sketch", "b.turn", "b.least").join(labels, "node")
    links = _block_links(_compatible(_salted(sketched), "turn", "least", "salt"), candidates)
    labels = _relabelled(labels, _of_classes(links, labels))

    # classes that share a rare token; one that many of them share makes a family
    named = shared.join(labels.select("node", "label"), "node")
    spread = named.groupBy("token", "label").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("early").alias("early"))
    spread = stored(spread.withColumn("width", F.count("*").over(Window.partitionBy("token"))).where("width > 1"), "spread-tokens")
    wide = spread.where(F.col("width") > WIDE).select("token").distinct()
    wide = stored(shared.join(wide, "token", "left_semi").join(labels, "node").select("token", "node", "label", shared["n"]), "wide-tokens")
    discard(shared)
    labels = _relabelled(labels, _family_links(wide, candidates))
    labels = _relabelled(labels, _pair_links(spread.where(F.col("width") <= WIDE), labels, candidates))
    discard(wide, spread, candidates)
    return labels


def _family_links(wide: DataFrame, candidates: DataFrame) -> DataFrame:
    """Links among nodes that share a token with many classes.

    All wide tokens of a node belong to one family, so each node is in one;
    its family meets itself in pairs of chunks, whatever tokens are shared.
    """
    if wide.isEmpty():
        return wide.select(F.col("node").alias("a"), F.col("node").alias("b"))
    first = wide.groupBy("node").agg(F.min("token").alias("a"), F.first("label").alias("label"), F.first("n").alias("n"))
    families = components(wide.join(first.select("node", "a"), "node").select("a", F.col("token").alias("b"))).toDF("a", "family")
    members = first.join(families, "a", "left").select("node", "n", "label", F.coalesce("family", "a").alias("family"))
    sizes = members.groupBy("family").agg(_chunks(F.count("*"), F.sum("n")).alias("chunks"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").drop("low", "high")
    dealt = members.join(_few(sizes), "family").withColumn("mine", _in_chunk(2, "chunks"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    pairs = dealt.select("node", "label", "family", "mine", other).select("node", "label", "family", F.least("mine", "other").alias("row"), F.greatest("mine", "other").alias("col"), F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"))
    members = stored(pairs, "family-members")
    discard(families)
    return _grouped(_with_tokens(members, candidates).select("family", "row", "col", "label", "tokens", "side"), ["family", "row", "col"], _either)


def _pair_links(spread: DataFrame, labels: DataFrame, candidates: DataFrame) -> DataFrame:
    """Links between classes that share enough tokens, none of them wide. The
    smaller class of a pair visits the larger one, its hub."""
    a, b = (spread.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("label", "low", "high", "early")]) for s in "ab")
    met = a.join(b, "token").where("label_a < label_b and (early_a or early_b) and 100 * high_a >= 80 * low_b and 100 * high_b >= 80 * low_a")
    met = met.groupBy("label_a", "label_b").agg(F.count("*").alias("k"), F.min("low_a").alias("low_a"), F.min("low_b").alias("low_b"))
    met = met.where(F.col("k") >= F.least(need(F.col("low_a")), need(F.col("low_b"))))
    was = spread.select("label").distinct()
    now = was.join(labels.select(F.col("node").alias("label"), F.col("label").alias("now")), "label")  # a label is a node of its class
    pairs = met.join(now.toDF("label_a", "now_a"), "label_a").join(now.toDF("label_b", "now_b"), "label_b").where("now_a <> now_b")
    pairs = stored(pairs.select(F.least("now_a", "now_b").alias("label_a"), F.greatest("now_a", "now_b").alias("label_b")).distinct(), "pairs")
    pairs = _alike(pairs, labels, candidates)
    if pairs.isEmpty():
        return pairs.select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
    sizes = stored(labels.groupBy("label").agg(F.count("*").alias("size"), F.sum("n").alias("sum")), "sizes")
    size_of = lambda c: sizes.select(F.col("label").alias(f"label_{c}"), F.col("size").alias(f"size_{c}"), F.col("sum").alias(f"sum_{c}"))
    sized = pairs.join(size_of("a"), "label_a").join(size_of("b"), "label_b")
    larger = F.col("size_a") >= F.col("size_b")
    side = lambda c, hub: F.when(larger == hub, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b"))
    sides = stored(sized.select(side("label", True).alias("hub"), side("label", False).alias("label"), side("size", False).alias("size"), side("sum", False).alias("sum")), "hubs")
    own = sizes.select(F.col("label").alias("hub"), _chunks(F.col("size"), F.col("sum")).alias("rows"))
    hubs = sides.groupBy("hub").agg(_chunks(F.sum("size"), F.sum("sum")).alias("cols")).join(own, "hub")
    mine = hubs.select(F.col("hub").alias("label"), "hub", "rows", "cols").join(labels, "label").select("hub", "node", "label", F.lit(0).alias("side"), _in_chunk(2, "rows").alias("row"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"))
    theirs = sides.select("hub", "label").join(hubs, "hub").join(labels, "label").select("hub", "node", "label", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), _in_chunk(3, "cols").alias("col"))
    members = stored(mine.unionByName(theirs), "hub-members")
    discard(pairs, sizes, sides)
    return _grouped(_with_tokens(members, candidates).select("hub", "row", "col", "label", "tokens", "side"), ["hub", "row", "col"], _across)


def _alike(pairs: DataFrame, labels: DataFrame, candidates: DataFrame) -> DataFrame:
    """The ``pairs(label_a, label_b)``, a table, of classes whose bitmaps, each
    the OR of its members', leave room for a link."""
    spark, root = pairs.sparkSession, "label long, low int, high int, extra int, sketch binary"

    def one_each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def close() -> pa.RecordBatch:
            cols = list(zip(*[(k, *v[:3], v[3].tobytes()) for k, v in held.items()]))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["label", "low", "high", "extra", "sketch"])

        for batch in rows:
            for label, low, high, extra, sketch in zip(*[c.to_pylist() for c in batch.columns]):
                bits = np.frombuffer(sketch, np.uint64)
                if label in held:
                    was = held[label]
                    was[:] = min(was[0], low), max(was[1], high), max(was[2], extra), was[3] | bits
                else:
                    held[label] = [low, high, extra, bits]
            if len(held) > SKETCHES:
                yield close()
                held.clear()
        if held:
            yield close()

    def of_sets(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            n = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            extra = unshared(_bitmaps(batch.column(2).to_pylist()), n) if len(n) else n
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(1), pa.array(extra.astype(np.int32)), batch.column(2)], ["label", "low", "high", "extra", "sketch"])

    def check(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if batch.num_rows:
                sides = []
                for at in (2, 6):
                    low, high, extra = (batch.column(at + i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
                    sides.append((_bitmaps(batch.column(at + 3).to_pylist()), low, high, extra))
                yield batch.select([0, 1]).filter(pa.array(may_link(*sides)))

    ends = pairs.select(F.explode(F.array("label_a", "label_b")).alias("label")).distinct()
    members = labels.join(ends, "label").select("label", "node").join(candidates.select("node", "n", "sketch"), "node")
    roots = members.select("label", "n", "sketch").mapInArrow(of_sets, root).mapInArrow(one_each, root).repartition(partitions(spark), "label").sortWithinPartitions("label").mapInArrow(one_each, root)
    roots = stored(roots, "roots")
    of = lambda c: roots.select(*[F.col(x).alias(f"{x}_{c}") for x in roots.columns])
    both = pairs.join(of("a"), "label_a").join(of("b"), "label_b")
    cols = [f"{x}_{c}" for c in "ab" for x in ("low", "high", "extra", "sketch")]
    out = stored(both.select("label_a", "label_b", *cols).mapInArrow(check, "label_a long, label_b long"), "pairs")
    discard(pairs, roots)
    return out


def _of_classes(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Links of nodes as links of their classes."""
    a, b = (labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
    return links.join(a, "a").join(b, "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels(node, n, label)``, a table, with the classes joined by ``links``
    of labels."""
    found = components(links)
    out = stored(labels.join(found.toDF("label", "root"), "label", "left").select("node", "n", F.coalesce("root", "label").alias("label")), "labels")
    discard(labels, found, links)
    return out


def _components(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n, node, version, label and component_id, with
    :data:`_NO_ID` for null ids. A label names a component of texts."""
    table = node_table(docs)
    rows = table.where("piece is null").select("doc_id", "n", "node", "version")
    least = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"))
    found = classes(docs, table, least.select("node", F.col("first").alias("doc_id")))
    whole = stored(least.join(found, "node", "left").select("node", "first", F.coalesce("label", "node").alias("label")), "classes")
    discard(found)
    of = whole.join(whole.groupBy("label").agg(F.min("first").alias("component_id")), "label").select("node", "label", "component_id")
    return rows.join(_shared_ids(rows, of), "node", "left").select("doc_id", "n", "node", "version", "label", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id (the
    least doc_id that links lead to)."""
    null = lambda c: F.nullif(F.col(c), F.lit(_NO_ID)).alias(c)
    return _components(docs).select(null("doc_id"), F.col("n").cast("long").alias("n_shingles"), null("component_id"))


def _shared_ids(rows: DataFrame, of: DataFrame) -> DataFrame:
    """Components joined where one doc_id has several texts."""
    known = rows.where((F.col("doc_id") != _NO_ID) & F.col("node").isNotNull())
    several = known.groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("doc_id")
    several = stored(several, "several")
    if several.isEmpty():
        return of
    mine = rows.join(several, "doc_id", "left_semi").join(of, "node").groupBy("doc_id").agg(F.min("component_id").alias("a"), F.collect_set("component_id").alias("all"))
    roots = components(mine.select("a", F.explode("all").alias("b"))).toDF("component_id", "root")
    return of.join(roots, "component_id", "left").select("node", "label", F.coalesce("root", "component_id").alias("component_id"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, that of the least doc_id.

    Of that document each text stays once. Of a component without any id one
    text stays, once. Rows without words stay, but for repeated rows of an id.
    """
    found = stored(_components(docs), "near-duplicates")
    again = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_id")).distinct()
    rows = packed(docs, "doc_id", "text").withColumn("version", F.xxhash64("text"))
    kept = rows.join(again.hint("shuffle_hash"), F.col("doc_id") == F.col("_id"), "left_anti")
    # rows without an id are known by their texts
    nameless = found.where((F.col("doc_id") == _NO_ID) & F.col("node").isNotNull())
    if not nameless.isEmpty():
        one = nameless.where(F.col("component_id") == _NO_ID).groupBy("label").agg(F.min("version").alias("version"))
        copies = nameless.select("version").distinct().join(one.select("version"), "version", "left_anti").withColumnRenamed("version", "_version")
        kept = kept.join(copies, F.col("doc_id").isNull() & (F.col("version") == F.col("_version")), "left_anti")
    if found.groupBy("doc_id", "version").count().where("count > 1").isEmpty():
        return unpacked(kept, docs.columns)
    bare = F.col("doc_id").isNull() & ~F.coalesce(F.col("text").rlike(WORD_PATTERN), F.lit(False))
    once = kept.where(~bare).withColumn("other", F.xxhash64(F.lit(1), "text")).dropDuplicates(["doc_id", "version", "other"])
    return unpacked(once.drop("other").unionByName(kept.where(bare)), docs.columns)
