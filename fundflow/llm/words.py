"""Words of whole batches of texts as arrays.

Texts arrive as Arrow columns, so a batch is one array of UTF-8 bytes with
offsets. Words are found, hashed and looked up for all texts of a batch at
once; Python sees a word as a string only the first time a worker meets it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled at once (one longer text is a batch of its own).
BATCH_BYTES = 2 << 20
#: A table of words starts anew when it holds this many.
TABLE_WORDS = 1_200_000

NONSPACE = np.ones(256, bool)
NONSPACE[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


class Texts:
    """Bytes and offsets of some texts (a null is empty)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> str:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().decode()


def batches(column: pa.Array) -> Iterator[tuple[int, int, Texts]]:
    """(first row, row after the last, texts) of slices of a string column."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BATCH_BYTES, "right")) - 1)
        b = min(b, len(column))
        data = np.zeros(offsets[b] - offsets[a] + 8, np.uint8)
        data[:-8] = raw[offsets[a] : offsets[b]]
        yield a, b, Texts(data, offsets[a : b + 1] - offsets[a])
        a = b


class Words:
    """The words of some texts: first byte, length, hash; ``first[i]`` is the
    number of words before text i. The data has eight spare bytes."""

    def __init__(self, texts: Texts, lower: bool = False, separators: np.ndarray = NONSPACE):
        data, offsets = texts.data, texts.offsets
        self.data = LOWER[data] if lower else data
        inside = separators[data]
        inside[-8:] = False
        edge = np.empty(len(inside), bool)
        edge[0] = True
        np.not_equal(inside[1:], inside[:-1], out=edge[1:])
        begin = edge & inside
        cuts = offsets[1:-1]
        begin[cuts] |= inside[cuts]
        self.starts = np.flatnonzero(begin)
        after = edge & ~inside
        after[0] = False
        after[cuts[(cuts > 0) & inside[cuts - 1]]] = True
        self.lengths = np.flatnonzero(after) - self.starts
        self.first = np.searchsorted(self.starts, offsets)
        self._hash: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.starts[i] + self.lengths[i]].tobytes()

    def some(self, which: np.ndarray) -> list[bytes]:
        data = self.data.data
        return [bytes(data[a:b]) for a, b in zip(self.starts[which].tolist(), (self.starts[which] + self.lengths[which]).tolist())]

    def spans(self, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> Words:
        """Other spans of the same data, in place of the words."""
        out = Words.__new__(Words)
        out.data, out.starts, out.lengths, out.first, out._hash = self.data, starts, lengths, first, None
        return out

    def with_gaps(self, texts: Texts, part: Callable) -> Words:
        """Words and what lies between them, as ``part`` cuts it.

        ``part(begin, start, end, at_start)`` gets, for every word, where the
        gap before it begins, where it starts and ends and whether the text
        starts with it; it gives (starts, lengths) of up to two spans for it,
        the earlier first; one of no length counts as none. A gap at the end
        of a text is a span.
        """
        n, offsets = len(self), texts.offsets
        ends = self.starts + self.lengths
        lead = np.flatnonzero(np.diff(self.first))
        at_start = np.zeros(n, bool)
        at_start[self.first[lead]] = True
        begin = np.empty(n, np.int64)
        begin[1:] = ends[:-1]
        begin[self.first[lead]] = offsets[lead]
        (a, la), (b, lb) = part(begin, self.starts, ends, at_start)
        last = offsets[:-1].copy()
        last[lead] = ends[self.first[lead + 1] - 1]
        left = offsets[1:] - last
        starts, lengths = np.concatenate([a, b, last]), np.concatenate([la, lb, left])
        some = lengths > 0
        starts, lengths = starts[some], lengths[some]
        order = np.argsort(starts, kind="stable")
        return self.spans(starts[order], lengths[order], np.searchsorted(starts[order], offsets))

    @property
    def hash(self) -> np.ndarray:
        """64 bits per word, never 0."""
        if self._hash is None:
            self._hash = hash_spans(self.data, self.starts, self.lengths)
        return self._hash


def hash_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Eight bytes of every span at a time are mixed into its hash."""
    eight = np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))
    h = mixed(lengths.astype(np.uint64) * _A)
    at = np.arange(len(starts))
    pos, left = starts, lengths
    while len(at):
        x = eight[pos] & _MASK[np.minimum(left, 8)]
        h[at] = mixed((h[at] ^ x) + _A)
        longer = np.flatnonzero(left > 8)
        at, pos, left = at[longer], pos[longer] + 8, left[longer] - 8
    h[h == 0] = 1
    return h


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every span, one after another."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return np.zeros(0, np.int64)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])


class WordTable:
    """What ``make`` gives for a word, remembered by the word's hash.

    ``make`` gets new words and gives the values of all of them one after
    another and how many each has.

    Open addressing over arrays: about 16 bytes a word beside its values. Words
    are told apart by their hashes alone. Of the 1.2 million words that a table
    holds at most, two share 64 bits with a chance of 4 in 10^8; the later of
    them would get the value of the earlier.
    """

    def __init__(self, make: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], dtype, most: int = TABLE_WORDS):
        self.make, self.dtype, self.most = make, dtype, most
        self._empty()

    def _empty(self) -> None:
        self.n = 0
        self.keys, self.slots = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int32)
        self.starts, self.lengths = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int32)
        self.pool, self.used = np.zeros(1 << 17, self.dtype), 0

    def _place(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that the table does not hold yet."""
        mask = np.uint64(len(self.keys) - 1)
        slot = keys & mask
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == 0)
            self.keys[slot[free]] = keys[free]
            won = self.keys[slot] == keys
            self.slots[slot[won]] = values[won]
            keys, values, slot = keys[~won], values[~won], (slot[~won] + np.uint64(1)) & mask

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each word, or -1."""
        mask = np.uint64(len(self.keys) - 1)
        slot = h & mask
        held = self.keys[slot]
        out = np.where(held == h, self.slots[slot], -1)
        open_ = np.flatnonzero((held != h) & (held != 0))
        slot = slot[open_]
        while len(open_):
            slot = (slot + np.uint64(1)) & mask
            held = self.keys[slot]
            hit = held == h[open_]
            out[open_[hit]] = self.slots[slot[hit]]
            on = ~hit & (held != 0)
            open_, slot = open_[on], slot[on]
        return out

    def add(self, keys: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> None:
        """Distinct hashes that the table does not hold yet, with their values."""
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool) // 2, len(flat)), self.dtype)])
        while self.n + len(keys) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        new = np.arange(self.n, self.n + len(keys))
        self.pool[self.used : self.used + len(flat)] = flat
        self.starts[new] = self.used + np.cumsum(lengths) - lengths
        self.lengths[new] = lengths
        self.used += len(flat)
        if (self.n + len(keys)) * 2 > len(self.keys):
            old = np.flatnonzero(self.keys)
            old_keys, old_values = self.keys[old], self.slots[old]
            size = len(self.keys)
            while (self.n + len(keys)) * 2 > size:
                size *= 2
            self.keys, self.slots = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self._place(old_keys, old_values)
        self._place(keys, new.astype(np.int32))
        self.n += len(keys)

    def lookup(self, words: Words) -> np.ndarray:
        """The number of every word; see :attr:`starts`, :attr:`lengths`, :attr:`pool`."""
        h = words.hash
        found = self.find(h)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            keys, where = np.unique(h[missing], return_index=True)
            if self.n + len(keys) > self.most and self.n:
                self._empty()
                return self.lookup(words)
            self.add(keys, *self.make(words.some(missing[where])))
            found[missing] = self.find(h[missing])
        return found

    def expand(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of all words one after another, how many each has)."""
        lengths = self.lengths[found].astype(np.int64)
        return self.pool[ragged(self.starts[found], lengths)], lengths


def in_order(where: np.ndarray, flat: np.ndarray, lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ragged values that are given for the words ``where``, as all n words have them."""
    counts, starts = np.zeros(n, np.int64), np.zeros(n, np.int64)
    counts[where], starts[where] = lengths, np.cumsum(lengths) - lengths
    return flat[ragged(starts, counts)], counts


def heavy(counts: np.ndarray, k: int) -> np.ndarray:
    """The indices of the k largest counts."""
    return np.argpartition(counts, len(counts) - k)[-k:] if len(counts) > k else np.arange(len(counts))


def sums(lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of ``lengths`` per text, given the index of its first one."""
    return np.diff(np.concatenate([[0], np.cumsum(lengths)])[first])


def identity(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For :class:`WordTable`: the words themselves, as bytes."""
    return np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words))


class Counts:
    """The most frequent words of a stream, in bounded memory.

    Beyond ``most`` words the rarer half is forgotten, so a count is a lower
    bound; that is enough where it only decides what a cache holds.
    """

    def __init__(self, most: int = 600_000):
        self.most = most
        self._start()

    def _start(self) -> None:
        self.table, self.n = WordTable(identity, np.uint8, 1 << 62), np.zeros(1 << 16, np.int64)

    def update(self, words: Words) -> None:
        found = self.table.lookup(words)
        if self.table.n > len(self.n):
            self.n = np.concatenate([self.n, np.zeros(max(len(self.n), self.table.n - len(self.n)), np.int64)])
        self.n += np.bincount(found, minlength=len(self.n))
        if self.table.n > self.most:
            t, n = self.table, self.n
            keep = heavy(n[: t.n], self.most // 2)
            order = np.flatnonzero(t.keys)
            keys = np.empty(t.n, np.uint64)
            keys[t.slots[order]] = t.keys[order]
            flat, lengths = t.expand(keep)
            self._start()
            self.table.add(keys[keep], flat, lengths)
            self.n = n[keep]

    def top(self, k: int) -> tuple[list[bytes], list[int]]:
        t, keep = self.table, heavy(self.n[: self.table.n], k)
        ends = (t.starts[keep] + t.lengths[keep]).tolist()
        return [t.pool[a:b].tobytes() for a, b in zip(t.starts[keep].tolist(), ends)], self.n[keep].tolist()
