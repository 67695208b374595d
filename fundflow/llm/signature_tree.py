"""Trees of token bitmaps that find similar sets.

A leaf holds a few sets of similar size. Every node holds the OR of the token
bitmaps below it, the range of their sizes and the most tokens that any of
them loses by sharing bits. Two trees (or one with itself) are traversed
together; a pair of nodes is dropped when no two sets below it can overlap
enough: an overlap has at most as many tokens as the two bitmaps share bits,
and the tokens that share bits. What is left is compared token by token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BITS = 2048
FAN = 8


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """The OR of one bit for each token."""
    flags = np.zeros(BITS, bool)
    flags[(tokens & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").view(np.uint64)


def unshared(bitmaps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many tokens each set loses by sharing bits."""
    return sizes - np.bitwise_count(bitmaps).sum(axis=1, dtype=np.int64)


def may_link(mine: tuple[np.ndarray, ...], theirs: tuple[np.ndarray, ...]) -> np.ndarray:
    """Which pairs of nodes, given as (bitmaps, least sizes, greatest sizes,
    most tokens lost) of either side, can hold sets that link."""
    (am, al, ah, ae), (bm, bl, bh, be) = mine, theirs
    shared = np.bitwise_count(am & bm).sum(axis=1, dtype=np.int64) + np.minimum(ae, be)
    most = np.minimum(shared, np.minimum(ah, bh))
    return (9 * most >= 4 * (al + bl)) & (100 * ah >= 80 * bl) & (100 * bh >= 80 * al)


class Tree:
    """Over members with these bitmaps, sizes and, for equal sizes, keys that
    put alike ones side by side."""

    def __init__(self, bitmaps: np.ndarray, sizes: np.ndarray, keys: np.ndarray):
        self.order = np.lexsort((keys, sizes))
        bitmaps, size = bitmaps[self.order], sizes[self.order]
        self.levels = [(bitmaps, size, size, unshared(bitmaps, size))]
        while len(self.levels[-1][1]) > 1:
            maps, low, high, extra = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(extra, at)))

    def nodes(self, level: int, which: np.ndarray) -> tuple[np.ndarray, ...]:
        return tuple(x[which] for x in self.levels[level])

    def deepened(self, level: int) -> None:
        """The root repeated, up to this level."""
        while len(self.levels) <= level:
            self.levels.append(self.levels[-1])


class SetTree(Tree):
    """``sets``: sorted distinct 64-bit tokens of each member."""

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        super().__init__(np.stack([bitmap(t) for t in sets]), sizes, np.array([t[0] for t in sets], np.uint64))
        self.sets = [sets[i] for i in self.order.tolist()]


def possible(bitmaps: np.ndarray, sizes: np.ndarray, keys: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Which members have another one, of another label, with which they may link."""
    tree = Tree(bitmaps, sizes, keys)
    label, found = labels[tree.order], np.zeros(len(sizes), bool)
    side = np.arange(len(sizes) - 1)
    near = (label[1:] != label[:-1]) & may_link(tree.nodes(0, side), tree.nodes(0, side + 1))
    found[1:] |= near
    found[:-1] |= near
    rest = np.flatnonzero(~found)
    if len(rest):
        few = Tree(*(x[tree.order][rest] for x in (bitmaps, sizes, keys)))
        mine = rest[few.order]
        for i, j in pairs(few, tree, label[mine], label):
            if label[mine[i]] != label[j]:
                found[mine[i]] = found[j] = True
    out = np.zeros(len(sizes), bool)
    out[tree.order] = found
    return out


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """At least four in five of the tokens of either are tokens of both."""
    if 100 * min(len(a), len(b)) < 80 * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= 80 * (len(a) + len(b) - shared)


def pairs(one: Tree, two: Tree, roots: np.ndarray, others: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of members, by place in the trees, that may link and whose labels
    differed when this began; ``one`` may be ``two``."""
    level = max(len(one.levels), len(two.levels)) - 1
    for tree in (one, two):
        tree.deepened(level)
    spans = [_spans(one, roots), _spans(two, others)]
    start = np.zeros((1, 2), np.int64)
    stack = [(level, start)]
    while stack:
        level, nodes = stack.pop()
        (alow, ahigh), (blow, bhigh) = spans[0][level], spans[1][level]
        a, b = nodes.T
        one_class = (alow[a] == ahigh[a]) & (blow[b] == bhigh[b]) & (alow[a] == blow[b])
        nodes = nodes[~one_class]
        nodes = nodes[may_link(one.nodes(level, nodes[:, 0]), two.nodes(level, nodes[:, 1]))]
        if level == 0:
            yield from map(tuple, nodes.tolist())
            continue
        for part in np.array_split(nodes, max(1, -(-len(nodes) // 256))):
            if len(part):
                below = _children(part, len(one.levels[level - 1][1]), len(two.levels[level - 1][1]), one.levels[level] is one.levels[level - 1], two.levels[level] is two.levels[level - 1])
                stack.append((level - 1, below[below[:, 0] < below[:, 1]] if one is two and level == 1 else below[below[:, 0] <= below[:, 1]] if one is two else below))


def _children(nodes: np.ndarray, n: int, m: int, same_a: bool, same_b: bool) -> np.ndarray:
    fan = np.arange(FAN)
    a = nodes[:, :1] if same_a else nodes[:, :1] * FAN + fan
    b = nodes[:, 1:] if same_b else nodes[:, 1:] * FAN + fan
    grid = np.stack([np.repeat(a, b.shape[1], axis=1), np.tile(b, a.shape[1])], axis=2).reshape(-1, 2)
    return grid[(grid[:, 0] < n) & (grid[:, 1] < m)]


def _spans(tree: Tree, labels: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The least and greatest label below each node."""
    out = [(labels, labels)]
    for level in range(1, len(tree.levels)):
        low, high = out[-1]
        if tree.levels[level] is tree.levels[level - 1]:
            out.append((low, high))
        else:
            at = np.arange(0, len(low), FAN)
            out.append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))
    return out


class Classes:
    """Union-find over labels; the least label is the root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        path = []
        while (y := self.up.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            self.up[p] = x
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def link_all(sets: list[np.ndarray], labels: list[int]) -> Classes:
    """Joins the labels of all sets that link."""
    classes, tree = Classes(), SetTree(sets)
    label = [labels[i] for i in tree.order.tolist()]
    for i in range(1, len(sets)):
        if classes.root(label[i - 1]) != classes.root(label[i]) and linked(tree.sets[i - 1], tree.sets[i]):
            classes.join(label[i - 1], label[i])
    roots = np.array([classes.root(x) for x in label], np.int64)
    for i, j in pairs(tree, tree, roots, roots):
        if classes.root(label[i]) != classes.root(label[j]) and linked(tree.sets[i], tree.sets[j]):
            classes.join(label[i], label[j])
    return classes


def link_across(sets: list[np.ndarray], labels: list[int], other_sets: list[np.ndarray], other_labels: list[int]) -> Classes:
    """Joins the labels of sets of one side that link with sets of the other."""
    classes, one, two = Classes(), SetTree(sets), SetTree(other_sets)
    label, other = [labels[i] for i in one.order.tolist()], [other_labels[i] for i in two.order.tolist()]
    for i, j in pairs(one, two, np.array(label, np.int64), np.array(other, np.int64)):
        if classes.root(label[i]) != classes.root(other[j]) and linked(one.sets[i], two.sets[j]):
            classes.join(label[i], other[j])
    return classes
