"""Self-join of texts by a binary trie over the unary code of their character counts.

The code of a text has one bit for each (character, k): whether the text has the
character at least k times. Inserting or deleting one character flips exactly one
bit, so d insertions and deletions flip at most d, and the Hamming distance of two
codes never exceeds d. A pair of texts with d <= share (la + lb) therefore stays
within that error budget, and pruning at it loses none.

The trie asks the most telling bit first: each node splits at the middle of the
character whose count is spread widest below it. Bits that all texts of a node have
in common (the counts below the least, those above the largest) belong to its path,
as in any compressed trie. Pairs of nodes go down together; the bits in which their
paths differ add up, and a pair goes as soon as they exceed the budget of the
longest texts below it, or as its sizes lie too far apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

#: Buckets of characters: printable ASCII has one each, others share them, which keeps the bound.
BUCKETS = 96
#: Texts of a node that is not split further.
LEAF = 16
#: Node pairs looked at in one go.
STEP = 1 << 14
_MOST = np.iinfo(np.int16).max


def histograms(texts: list[str], step: int = 1 << 22) -> np.ndarray:
    """Characters per bucket of each text, int16; counts beyond its range stop there, which keeps the bound."""
    out = np.zeros((len(texts), BUCKETS), dtype=np.int16)
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (size == 0 or size + len(texts[hi]) <= step):
            size += len(texts[hi])
            hi += 1
        part = texts[lo:hi]
        points = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lens = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
        bucket = np.where((points >= 32) & (points < 128), points - 32, points % BUCKETS).astype(np.int64)
        counted = np.bincount(bucket + np.repeat(np.arange(len(part)) * BUCKETS, lens), minlength=len(part) * BUCKETS)
        out[lo:hi] = np.minimum(counted, _MOST).reshape(len(part), BUCKETS)
        lo = hi
    return out


@dataclass
class Level:
    """Nodes of one depth: where their texts start, the ends of their counts and sizes, and their children."""

    start: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    ends: list[tuple[np.ndarray, np.ndarray]]
    child: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    children: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


class Trie:
    """Tries over rows of counts, one for each value of ``root``.

    sizes: (least, largest) of each row in the quantities that a pair may not differ
    too much in; the length of the text comes first.
    """

    def __init__(self, counts: np.ndarray, root: np.ndarray, sizes: list[tuple[np.ndarray, np.ndarray]], leaf: int = LEAF) -> None:
        self.counts, self.sizes = counts, sizes
        self.order = np.argsort(root, kind="stable")
        by = root[self.order]
        start = np.flatnonzero(np.append(True, by[1:] != by[:-1])) if len(by) else np.zeros(0, np.int64)
        self.roots = by[start]
        self.levels: list[Level] = []
        n = len(by)
        while True:
            at = counts[self.order]
            level = Level(start, np.minimum.reduceat(at, start), np.maximum.reduceat(at, start), [(np.minimum.reduceat(x[self.order], start), np.maximum.reduceat(y[self.order], start)) for x, y in sizes]) if n else Level(start, at, at, [(x, y) for x, y in sizes])
            self.levels.append(level)
            held = np.diff(np.append(start, n))
            split = (held > leaf) & (level.hi > level.lo).any(axis=1) if n else np.zeros(0, bool)
            if not split.any():
                break
            which = self._telling(at, start, held)
            node = np.repeat(np.arange(len(start)), held)
            value = np.where(split[node], at[np.arange(n), which[node]], 0)
            sorted_ = np.lexsort((value, node))
            self.order, value = self.order[sorted_], value[sorted_]
            least = level.lo[np.arange(len(start)), which]
            bit = np.maximum(value[start + held // 2], least + 1)  # "at least so many" is true of some below the node, not of all
            below = np.add.reduceat((value < bit[node]).astype(np.int64), start)
            children = np.where(split, 2, 1)
            level.children, level.child = children, np.cumsum(children) - children
            nxt = np.zeros(int(children.sum()), dtype=np.int64)
            nxt[level.child] = start
            nxt[level.child[split] + 1] = start[split] + below[split]
            start = nxt
        self.opened = 0

    @staticmethod
    def _telling(at: np.ndarray, start: np.ndarray, held: np.ndarray) -> np.ndarray:
        """The character of each node whose counts vary most."""
        x = at.astype(np.float32)
        mean = np.add.reduceat(x, start) / held[:, None]
        return (np.add.reduceat(x * x, start) / held[:, None] - mean * mean).argmax(axis=1)

    def pairs(self, u: np.ndarray, v: np.ndarray, budget: tuple[int, int], bands: list[tuple[int, int] | None], most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(i, j): the rows below each pair of roots (positions in ``roots``) within the budget; a root with itself gives each pair once.

        budget (a, b): b d <= a (la + lb). bands: for each further size (up, down),
        down |x - y| <= up max(x, y) must be possible. At most about ``most`` pairs are open at once.
        """
        stack = [(0, u, v)]
        last = len(self.levels) - 1
        while stack:
            depth, u, v = stack.pop()
            keep = self._within(self.levels[depth], u, v, budget, bands)
            u, v = u[keep], v[keep]
            if not len(u):
                continue
            level = self.levels[depth]
            if depth == last:
                first, many = level.start, np.diff(np.append(level.start, len(self.order)))
            else:
                first, many = level.child, level.children
            total = many[u] * many[v]
            ends = np.cumsum(total)
            cuts = np.searchsorted(ends, np.arange(most, ends[-1], most), side="right") if ends[-1] > most else np.zeros(0, np.int64)
            for s, e in zip(np.append(0, cuts), np.append(cuts, len(u)), strict=True):
                if s == e:
                    continue
                for a, b, at in _below(first[u[s:e]], many[u[s:e]], first[v[s:e]], many[v[s:e]], most):
                    same = u[s:e][at] == v[s:e][at]
                    keep = ~same | (a < b if depth == last else a <= b)
                    a, b = a[keep], b[keep]
                    if depth < last:
                        stack.append((depth + 1, a, b))
                        continue
                    i, j = self.order[a], self.order[b]
                    keep = self._close([(x[i], y[i], x[j], y[j]) for x, y in self.sizes], budget, bands)
                    i, j = i[keep], j[keep]
                    self.opened += len(i)
                    keep = self._fit(self.counts, self.counts, i, j, self.sizes[0][1], budget)
                    if keep.any():
                        yield i[keep], j[keep]

    def _within(self, level: Level, u: np.ndarray, v: np.ndarray, budget: tuple[int, int], bands) -> np.ndarray:
        """Which node pairs may have a pair of rows below them."""
        keep = self._close([(x[u], y[u], x[v], y[v]) for x, y in level.ends], budget, bands)
        at = np.flatnonzero(keep & (u != v))
        self.opened += int(keep.sum())
        keep[at] = self._fit(level.lo, level.hi, u[at], v[at], level.ends[0][1], budget)
        return keep

    @staticmethod
    def _fit(lo: np.ndarray, hi: np.ndarray, u: np.ndarray, v: np.ndarray, longest: np.ndarray, budget: tuple[int, int]) -> np.ndarray:
        """Whether the bits in which the paths of each pair differ are within the budget."""
        keep = np.empty(len(u), dtype=bool)
        for s in range(0, len(u), STEP):
            a, b = u[s : s + STEP], v[s : s + STEP]
            differ = lo[a] - hi[b]
            np.maximum(differ, lo[b] - hi[a], out=differ)
            if lo is not hi:
                np.maximum(differ, 0, out=differ)
            keep[s : s + STEP] = differ.sum(axis=1, dtype=np.int32) * budget[1] <= (longest[a].astype(np.int64) + longest[b]) * budget[0]
        return keep

    @staticmethod
    def _close(ends, budget: tuple[int, int], bands) -> np.ndarray:
        """Whether the sizes of two nodes come near enough to each other."""
        x0, x1, y0, y1 = (e.astype(np.int64) for e in ends[0])
        a, b = budget
        keep = ((b - a) * x0 <= (b + a) * y1) & ((b - a) * y0 <= (b + a) * x1)
        for band, (x0, x1, y0, y1) in zip(bands, ends[1:], strict=True):
            if band is not None:
                up, down = band
                keep &= ((down - up) * x0.astype(np.int64) <= down * y1.astype(np.int64)) & ((down - up) * y0.astype(np.int64) <= down * x1.astype(np.int64))
        return keep


def _below(u0, nu, v0, nv, most):
    """All (child of u, child of v, number of the pair), in slices of about ``most``."""
    total = nu * nv
    if len(u0) == 1 and total[0] > most:
        step = max(1, most // int(nv[0]))
        for lo in range(0, int(nu[0]), step):
            k = min(step, int(nu[0]) - lo)
            a = np.repeat(np.arange(u0[0] + lo, u0[0] + lo + k), nv[0])
            yield a, np.tile(np.arange(v0[0], v0[0] + nv[0]), k), np.zeros(len(a), np.int64)
        return
    at = np.repeat(np.arange(len(u0)), total)
    inside = np.arange(len(at)) - np.repeat(np.cumsum(total) - total, total)
    yield u0[at] + inside // nv[at], v0[at] + inside % nv[at], at
