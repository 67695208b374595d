"""Encoding and decoding with a word-level byte-pair vocabulary.

The corpus's frequent words are compiled, with their ids, into a minimal
acyclic automaton: words share prefixes and suffixes, and the numbers on the
arcs of a word's path add up to its place in the table of ids. Workers map
the compiled lexicon into memory; words that it lacks are merged exactly, by
rank, and remembered.

Words are runs of anything but ASCII white space, which the vocabulary drops;
normalisation and pre-tokenisation never look beyond a word.

A worker maps the broadcast lexicon from a file in its own memory, which goes
with it: nobody else reads it, and a new worker writes it anew, so a lost
executor loses nothing. Which words it holds comes from one
summary of bounded size per task (see frequent).

Defined results: a null text is an empty one (no ids, decoded to nothing);
rows that repeat are encoded each; a text of any length is encoded as a whole
(an array of ids ends at 2^31); an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import mmap
import os
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fundflow.llm.bpe import DOUBTFUL, Merger
from fundflow.llm.common import only
from fundflow.llm.frequent import frequent_words
from fundflow.llm.words import Words, WordTable, batches, in_order, ragged, sums

HEAD = struct.Struct("<8sQQQ")
MAGIC = b"MADLEX01"


def compile_lexicon(words: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """``words``: sorted and distinct; ``ids`` one after another, ``lengths`` of each."""
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    known: dict[tuple, int] = {}
    path: list[tuple[int, int, int]] = []  # (state, byte, target) of the last word, not yet shared

    def share(depth: int) -> None:
        while len(path) > depth:
            state, byte, target = path.pop()
            form = (final[target], *arcs[target].items())
            arcs[state][byte] = known.setdefault(form, target)

    last = b""
    for word in words:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        share(same)
        state = path[-1][2] if path else 0
        for byte in word[same:]:
            arcs.append({})
            final.append(False)
            arcs[state][byte] = len(arcs) - 1
            path.append((state, byte, len(arcs) - 1))
            state = len(arcs) - 1
        final[state] = True
        last = word
    share(0)

    number, order = {0: 0}, [0]
    for state in order:
        for target in arcs[state].values():
            if target not in number:
                number[target] = len(order)
                order.append(target)
    below: dict[int, int] = {}
    stack = [0]
    while stack:
        state = stack[-1]
        waiting = [t for t in arcs[state].values() if t not in below]
        stack.extend(waiting)
        if not waiting:
            below[stack.pop()] = final[state] + sum(below[t] for t in arcs[state].values())
    keys, targets, adds = [], [], []
    for state in order:
        before = int(final[state])
        for byte, target in sorted(arcs[state].items()):
            keys.append(number[state] << 8 | byte)
            targets.append(number[target])
            adds.append(before)
            before += below[target]
    body = [
        np.array(keys, "<u8"), np.array(targets, "<u4"), np.array(adds, "<u4"), np.array([final[s] for s in order], "u1"),
        np.concatenate([[0], np.cumsum(lengths)]).astype("<u4"), np.asarray(ids, "<u4"),
    ]
    return HEAD.pack(MAGIC, len(keys), len(order), len(words)) + b"".join(x.tobytes() for x in body)


class Lexicon:
    """A compiled lexicon, mapped from a file in memory, in no folder."""

    def __init__(self, data: bytes):
        with open(os.memfd_create("lexicon"), "w+b") as file:
            file.write(data)
            file.flush()
            mapped = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        magic, n_arcs, n_states, n_words = HEAD.unpack_from(mapped)
        if magic != MAGIC:
            raise ValueError("not a lexicon")
        at = HEAD.size

        def view(kind: str, n: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(mapped, kind, n, at)
            at += x.nbytes
            return x

        self.keys, self.targets, self.adds = view("<u8", n_arcs), view("<u4", n_arcs), view("<u4", n_arcs)
        self.final, self.bounds = view("u1", n_states), view("<u4", n_words + 1)
        self.ids = view("<u4", int(self.bounds[-1]))

    def find(self, words: list[bytes]) -> np.ndarray:
        """The place of each word in the table of ids, or -1; all words walk
        their arcs side by side."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data, starts = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes
        out = np.full(len(words), -1, np.int64)
        at, state, place, step = np.arange(len(words)), np.zeros(len(words), np.uint64), np.zeros(len(words), np.int64), 0
        while len(at) and len(self.keys):
            over = sizes[at] == step
            good = over & (self.final[state] == 1)
            out[at[good]] = place[good]
            at, state, place = at[~over], state[~over], place[~over]
            key = state << np.uint64(8) | data[starts[at] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[arc] == key
            arc, at = arc[on], at[on]
            state, place, step = self.targets[arc].astype(np.uint64), place[on] + self.adds[arc], step + 1
        return out


class WordCoder:
    """Encodes as the tokenizer of the file does, word by word."""

    #: The pre-tokens of normalised words, which a NUL separates, without doubtful characters.
    PLAIN = re.compile(r"\x00|'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\s\w\x00]|_)+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        self.merger = Merger(self.tokenizer)

    def exact(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, merged together."""
        plain, texts, other, others = [], [], [], []
        for i, text in enumerate([w.decode() for w in words]):
            if DOUBTFUL.search(text) or "<" in text and self.special.search(text):
                other.append(i)
                others.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int64))
            else:
                plain.append(i)
                texts.append(text)
        joined = unicodedata.normalize("NFC", "\0".join(texts)).replace("Σ", "σ").lower()
        tokens = self.PLAIN.findall(joined)
        ids, counts = self.merger.encode(["" if t == "\0" else t for t in tokens])
        owner = np.cumsum([t == "\0" for t in tokens])
        n = np.bincount(owner, counts, len(plain)).astype(np.int64) if tokens else np.zeros(len(plain), np.int64)
        return in_order(np.array(plain + other, np.int64), np.concatenate([ids, *others]), np.concatenate([n, [len(x) for x in others]]).astype(np.int64), len(words))

    def tokens(self) -> list[str]:
        """The string of every id."""
        return [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]


class Strings:
    """Strings by id, to be joined with spaces."""

    def __init__(self, strings: list[str]):
        made = [f"{s} ".encode() for s in strings]
        self.lengths = np.fromiter(map(len, made), np.int64, len(made))
        self.starts, self.data = np.cumsum(self.lengths) - self.lengths, np.frombuffer(b"".join(made), np.uint8)

    def join(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The joined strings of ids[bounds[i]:bounds[i + 1]] for each i."""
        lengths = self.lengths[ids]
        flat = self.data[ragged(self.starts[ids], lengths)].tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths)])[bounds].tolist()
        return [flat[a : max(a, b - 1)] for a, b in zip(ends, ends[1:])]


def encode(docs: DataFrame, tokenizer_path: str, ids: bool = True, decoded: bool = True, digests: bool = False) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_tokens, and as asked ids
    (array), decoded (text) and the SHA-256 of both (ids: decimal, joined by
    spaces)."""
    frequent = frequent_words(docs, Words)
    coder = WordCoder(tokenizer_path)
    shipped = docs.sparkSession.sparkContext.broadcast(compile_lexicon(frequent, *coder.exact(frequent)))
    names = ["doc_id", "n_tokens", *["ids"] * ids, *["decoded"] * decoded, *["ids_sha256", "decoded_sha256"] * digests]
    kinds = {"doc_id": "long", "n_tokens": "long", "ids": "array<int>"}

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, lexicon = WordCoder(tokenizer_path), Lexicon(shipped.value)
        tokens = coder.tokens()
        decimal, strings = Strings([str(i) for i in range(len(tokens))]), Strings(tokens)

        def make(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            place = lexicon.find(words)
            hit, miss = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
            a = lexicon.bounds[place[hit]].astype(np.int64)
            n = lexicon.bounds[place[hit] + 1] - a
            merged, m = coder.exact([words[i] for i in miss.tolist()])
            return in_order(np.concatenate([hit, miss]), np.concatenate([lexicon.ids[ragged(a, n)], merged]), np.concatenate([n, m]), len(words))

        table = WordTable(make, np.uint32)
        for batch in rows:
            for a, b, texts in batches(batch.column(1)):
                words = Words(texts)
                flat, lengths = table.expand(table.lookup(words))
                n = sums(lengths, words.first)
                bounds = np.concatenate([[0], np.cumsum(n)])
                out = [batch.column(0)[a:b], pa.array(n)]
                if ids:
                    out.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat.astype(np.int32))))
                back = strings.join(flat, bounds) if decoded or digests else []
                if decoded:
                    out.append(pa.array([x.decode() for x in back], pa.string()))
                if digests:
                    for side in (decimal.join(flat, bounds), back):
                        out.append(pa.array([hashlib.sha256(x).hexdigest() for x in side], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names)

    return only(docs, "doc_id", "text").mapInArrow(run, ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names))
