"""Byte-pair merging of many words at once.

Works on the vocabulary and the list of merges of a tokenizer file as arrays:
in each round every word that still has a mergeable pair merges its leftmost
pair of the lowest rank, which is the order that defines the encoding.
"""

from __future__ import annotations

import json
import re

import numpy as np

from fundflow.llm.words import in_order

#: Characters that Python's classes of them and the library's may differ on.
DOUBTFUL = re.compile(r"[^\x01-\x1B\x20-\x84\x86-\x9F\xA1-\xB1\xB4-\xB8\xBA-\xBB\xBF-\u02FF\u0370-\u0377\u0384-\u0482\u048A-\u052F\u2010-\u2027\u2030-\u205E]")
#: Longer words are left to the library.
LONGEST = 96
_NONE = np.int64(1) << 30


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Merger:
    """``tokenizer``: of the tokenizers library, with a byte-level BPE model."""

    def __init__(self, tokenizer):
        model = json.loads(tokenizer.to_str())["model"]
        vocab, self.model = model["vocab"], tokenizer.model
        self.suffix = model.get("end_of_word_suffix") or ""
        self.letters = byte_letters()
        self.symbols = np.array([vocab.get(c, -1) for c in self.letters], np.int64)
        self.last = np.array([vocab.get(c + self.suffix, -1) for c in self.letters], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.order = np.argsort(keys)
        self.keys, self.made = keys[self.order], made

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], _NONE)

    def library(self, word: bytes) -> np.ndarray:
        return np.array([t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, word)))], np.int64)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, how many each has)."""
        words = [w.encode() for w in words]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        long = np.flatnonzero(sizes > LONGEST)
        counts, parts = np.zeros(len(words), np.int64), []
        for i in long.tolist():
            ids = self.library(words[i])
            counts[i] = len(ids)
            parts.append((np.array([i]), ids))
        at = np.flatnonzero((sizes > 0) & (sizes <= LONGEST))
        if len(at):
            data = np.frombuffer(b"".join([words[i] for i in at.tolist()] if len(at) < len(words) else words), np.uint8)
            size = sizes[at]
            ends = np.cumsum(size)
            sym = self.symbols[data]
            sym[ends - 1] = self.last[data[ends - 1]]
            rank = np.full(len(sym), _NONE)
            rank[:-1] = self._rank(sym[:-1], sym[1:])
            rank[ends - 1] = _NONE
            while len(at):
                first = np.cumsum(size) - size
                best = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), first)
                done = best >> 32 == _NONE
                if done.any():
                    over = np.repeat(done, size)
                    counts[at[done]] = size[done]
                    parts.append((at[done], sym[over]))
                    moved = np.cumsum(over) - over
                    at, size, best, sym, rank, left = at[~done], size[~done], best[~done], sym[~over], rank[~over], moved[first[~done]]
                    if not len(at):
                        break
                    best = best - left
                    first = np.cumsum(size) - size
                p = best & 0xFFFFFFFF
                sym[p] = self.made[best >> 32]
                keep = np.ones(len(sym), bool)
                keep[p + 1] = False
                tail = rank[p + 1]
                before = p[p > first]
                after = p[p + 1 < first + size - 1]
                rank[before - 1] = self._rank(sym[before - 1], sym[before])
                rank[p] = tail
                rank[after] = self._rank(sym[after], sym[after + 2])
                sym, rank, size = sym[keep], rank[keep], size - 1
        if not parts:
            return np.zeros(0, np.int64), counts
        where = np.concatenate([w for w, _ in parts])
        return in_order(where, np.concatenate([s for _, s in parts]), counts[where], len(words))
