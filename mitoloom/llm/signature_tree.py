"""Signature trees over token sets: nodes hold OR-combined bitmaps and size ranges; a dual traversal joins two trees."""

from __future__ import annotations

import numpy as np

from mitoloom.llm.words import ranges

LEAF, FANOUT, SLICE = 16, 8, 4096


class Sets:
    """Token sets of one group: ``values[offsets[i]:offsets[i + 1]]`` are set i's sorted distinct 64-bit tokens."""

    def __init__(self, offsets: np.ndarray, values: np.ndarray):
        self.sizes = np.diff(offsets).astype(np.int64)
        self.offsets = offsets.astype(np.int64)
        distinct, ids = np.unique(values, return_inverse=True)
        self.ids, self.mark = ids.astype(np.int32), np.zeros(len(distinct), dtype=bool)
        smallest = values[np.minimum(offsets[:-1], max(0, len(values) - 1))] if len(values) else np.zeros(len(self.sizes), np.uint64)
        self.smallest = np.where(self.sizes > 0, smallest, np.uint64(0))
        middle = int(np.median(self.sizes)) if len(self.sizes) else 1
        self.bits = int(min(8192, max(256, 1 << int(np.ceil(np.log2(max(1, 4 * middle)))))))
        self.maps = np.zeros((len(self.sizes), self.bits // 64), dtype=np.uint64)
        slot = (values >> np.uint64(64 - int(np.log2(self.bits)))).astype(np.int64)
        for a in range(0, len(self.sizes), 1024):
            b = min(len(self.sizes), a + 1024)
            dense = np.zeros((b - a, self.bits), dtype=np.uint8)
            dense[np.repeat(np.arange(b - a), self.sizes[a:b]), slot[offsets[a] : offsets[b]]] = 1
            self.maps[a:b] = np.packbits(dense, axis=1).view(np.uint64)
        self.spare = self.sizes - np.bitwise_count(self.maps).sum(axis=1, dtype=np.int64)  # tokens that share a bit with another

    def common(self, one: int, others: np.ndarray) -> np.ndarray:
        """Exact intersection sizes of set ``one`` with each of ``others``."""
        own = self.ids[self.offsets[one] : self.offsets[one + 1]]
        self.mark[own] = True
        counts = self.sizes[others]
        hit = np.concatenate([[0], np.cumsum(self.mark[self.ids[ranges(self.offsets[others], counts)]])])
        self.mark[own] = False
        ends = np.cumsum(counts)
        return hit[ends] - hit[ends - counts]


def sketch(values: np.ndarray) -> bytes:
    """A set's size, smallest token and bitmap, of 2 to 4 bits a token, 256 at least and 8192 at most."""
    bits = int(min(8192, max(256, 1 << int(np.ceil(np.log2(max(1, 2 * len(values))))))))
    dense = np.zeros(bits, dtype=np.uint8)
    dense[(values >> np.uint64(65 - bits.bit_length())).astype(np.int64)] = 1
    return np.array([len(values), values[0] if len(values) else 0], dtype="<u8").tobytes() + np.packbits(dense).tobytes()


class Sketches:
    """The same view of sets as Sets, of their sketches alone: whether two could be similar enough, not whether they are."""

    def __init__(self, raw: list[bytes]):
        heads = np.array([np.frombuffer(r, "<u8", 2) for r in raw])
        self.sizes, self.smallest = heads[:, 0].astype(np.int64), heads[:, 1]
        width = min(len(r) for r in raw) - 16  # larger bitmaps are folded: neighbours' bits meet
        maps = []
        for r in raw:
            bits = np.frombuffer(r, np.uint8, offset=16)
            maps.append(bits if len(bits) == width else np.packbits(np.unpackbits(bits).reshape(8 * width, -1).max(axis=1)))
        self.maps = np.array(maps).view(np.uint64)
        self.spare = self.sizes - np.bitwise_count(self.maps).sum(axis=1, dtype=np.int64)

    def common(self, one: int, others: np.ndarray) -> np.ndarray:
        most = np.bitwise_count(self.maps[one] & self.maps[others]).sum(axis=1, dtype=np.int64) + np.minimum(self.spare[one], self.spare[others])
        return np.minimum(most, np.minimum(self.sizes[one], self.sizes[others]))


class Tree:
    """Level 0 holds the sets in ``order``; a node of level k covers ``step[k]`` consecutive ones."""

    def __init__(self, sets: Sets, members: np.ndarray):
        self.order = members[np.lexsort((sets.sizes[members], sets.smallest[members]))]
        maps, size, spare = sets.maps[self.order], sets.sizes[self.order], sets.spare[self.order]
        self.levels, self.steps = [(maps, size, size, spare)], [1]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, spare = self.levels[-1]
            starts = np.arange(0, len(maps), LEAF if len(self.levels) == 1 else FANOUT)
            self.levels.append((np.bitwise_or.reduceat(maps, starts, axis=0), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), np.maximum.reduceat(spare, starts)))
            self.steps.append(self.steps[-1] * (LEAF if len(self.steps) == 1 else FANOUT))

    def uniform(self, labels: np.ndarray) -> list[np.ndarray]:
        """For each level, the label that all sets below a node have, or -1."""
        low = high = labels[self.order]
        out = [low]
        for k in range(1, len(self.levels)):
            starts = np.arange(0, len(low), LEAF if k == 1 else FANOUT)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            out.append(np.where(low == high, low, -1))
        return out

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width, below = (LEAF if level == 1 else FANOUT), len(self.levels[level - 1][0])
        return nodes * width, np.minimum(width, below - nodes * width)


def possible(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether nodes i of one level and j of the other can hold a pair with num/den Jaccard similarity or more.

    Common tokens fill at most the bits set on both sides, and at most min(spare) of them share a bit with another.
    """
    keep = np.zeros(len(i), dtype=bool)
    for at in range(0, len(i), 65_536):
        x, y = i[at : at + 65_536], j[at : at + 65_536]
        most = np.bitwise_count(a[0][x] & b[0][y]).sum(axis=1, dtype=np.int64) + np.minimum(a[3][x], b[3][y])
        most = np.minimum(most, np.minimum(a[2][x], b[2][y]))
        keep[at : at + 65_536] = (most * (num + den) >= num * (a[1][x] + b[1][y])) & (a[2][x] * den >= num * b[1][y]) & (b[2][y] * den >= num * a[1][x]) & (most > 0)
    return keep


def linked_groups(sets: Sets | Sketches, num: int, den: int, labels: np.ndarray | None = None, left: np.ndarray | None = None) -> np.ndarray:
    """A label for each set: sets linked by Jaccard similarity of num/den or more, directly or by way of others, share one.

    ``labels`` may start with known groups (numbers below the count of sets). With ``left`` (positions) only pairs with one
    side in ``left`` are searched, as when two blocks are joined. Pairs of nodes that are already in one group are not visited
    again, so a group of thousands of near copies costs about one pass over its members rather than all its pairs.
    """
    n = len(sets.sizes)
    labels = np.arange(n) if labels is None else labels.copy()
    if n < 2 or (left is not None and not len(left)):
        return labels
    if n == 2:
        linked = int(sets.common(0, np.array([1]))[0]) * (num + den) >= num * int(sets.sizes.sum())
        return np.full(2, labels[0]) if linked else labels
    right = Tree(sets, np.arange(n))
    tree = right if left is None else Tree(sets, left)
    same = left is None
    la, lb = len(tree.levels) - 1, len(right.levels) - 1
    stack = [(la, lb, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    ua, ub, dirty = tree.uniform(labels), right.uniform(labels), False
    while stack:
        la, lb, i, j = stack.pop()
        if dirty:
            ua, ub, dirty = tree.uniform(labels), right.uniform(labels), False
        keep = (ua[la][i] < 0) | (ua[la][i] != ub[lb][j])
        i, j = i[keep], j[keep]
        keep = possible(tree.levels[la], right.levels[lb], i, j, num, den)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if la == 0 and lb == 0:
            a, b = tree.order[i], right.order[j]
            if same:
                a, b = np.where(i < j, a, b), np.where(i < j, b, a)
            keep = a != b
            a, b = a[keep], b[keep]
            by = np.argsort(a, kind="stable")
            a, b = a[by], b[by]
            starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else []
            for s, e in zip(starts, [*starts[1:], len(a)], strict=True) if len(a) else ():
                one, others = a[s], b[s:e]
                others = others[labels[others] != labels[one]]
                if not len(others):
                    continue
                common = sets.common(one, others)
                others = others[common * (num + den) >= num * (sets.sizes[one] + sets.sizes[others])]
                if len(others):
                    to = np.arange(n)
                    to[labels[others]] = labels[one]
                    labels, dirty = to[labels], True
            continue
        # open the higher side, or both when they stand on one level; the first pairs of a slice are popped first
        open_a, open_b = la >= lb, lb >= la
        ca, na = tree.children(la, i) if open_a else (i, np.ones(len(i), np.int64))
        cb, nb = right.children(lb, j) if open_b else (j, np.ones(len(j), np.int64))
        which = np.repeat(np.arange(len(i)), na * nb)
        inner = np.arange(len(which)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
        x, y = ca[which] + inner // nb[which], cb[which] + inner % nb[which]
        la, lb = la - open_a, lb - open_b
        if same:
            keep = x <= y if la == lb else np.ones(len(x), bool)
            if la == lb == 0:
                keep = x < y
            x, y = x[keep], y[keep]
        stack.extend((la, lb, x[at : at + SLICE], y[at : at + SLICE]) for at in range((len(x) - 1) // SLICE * SLICE if len(x) else -1, -1, -SLICE))
    return labels
