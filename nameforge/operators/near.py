"""Pairs of similar texts within bounded cells: trie over character counts, then the exact distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nameforge.functions.similarity import lcs
from nameforge.operators import cells, trie

#: Rows of a block, or of a size bin of a larger one, per hash chunk; a cell holds about twice as many at most.
CAP = 4000


def rows_below(of: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): the rows of each item side by side."""
    order = np.argsort(of, kind="stable")
    return order, np.searchsorted(of[order], np.arange(count + 1))


def spread(order: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of a, row of b, number of the pair) for pairs of items, in slices of about ``most``; an item with itself gives each pair of its rows once."""
    many = (starts[a + 1] - starts[a]) * (starts[b + 1] - starts[b])
    ends = np.cumsum(many)
    lo = 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        for x, y, at in trie._below(starts[a[lo:hi]], starts[a[lo:hi] + 1] - starts[a[lo:hi]], starts[b[lo:hi]], starts[b[lo:hi] + 1] - starts[b[lo:hi]], most):
            keep = (a[lo + at] != b[lo + at]) | (x < y)
            yield order[x[keep]], order[y[keep]], lo + at[keep]
        lo = hi


def distance(texts: list[str], x: int, y: int, known: dict[tuple[int, int], int]) -> int:
    """Insertions and deletions between two texts, worked out once."""
    p = (x, y) if x < y else (y, x)
    if p not in known:
        known[p] = len(texts[x]) + len(texts[y]) - 2 * lcs(texts[x], texts[y])
    return known[p]


def similar(texts: list[str], of: np.ndarray, cell: np.ndarray, side: np.ndarray, sizes: list[np.ndarray], budget: tuple[int, int], bands: list[tuple[int, int]], known: dict[tuple[int, int], int] | None = None, opened: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, d): rows of one cell whose texts are d insertions and deletions apart, d <= budget (la + lb).

    of: the text of each row. In a cell of side 0 each pair of rows comes once; else i
    has side 1 and j side 2. sizes: for each row what the bands limit. Equal texts of
    a cell are one item of the trie, and each pair of texts is checked once; known keeps
    the distances, opened gets the number of pairs that the trie looked at.
    """
    root = cell.astype(np.int64) * 3 + side
    item, first, back = np.unique(root * len(texts) + of, return_index=True, return_inverse=True)
    text = of[first]
    low = []
    for s in sizes:
        lo, hi = np.full(len(item), np.iinfo(np.int64).max), np.full(len(item), np.iinfo(np.int64).min)
        np.minimum.at(lo, back, s)
        np.maximum.at(hi, back, s)
        low.append((lo, hi))
    length = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    counts = trie.histograms(texts)
    t = trie.Trie(counts[text], item // len(texts), [(length[text], length[text]), *low])
    at = {int(r): k for k, r in enumerate(t.roots)}
    alone = [k for r, k in at.items() if r % 3 == 0]
    two = [(k, at[r + 1]) for r, k in at.items() if r % 3 == 1 and r + 1 in at]
    order, starts = rows_below(back, len(item))
    known = {} if known is None else known
    num, den = budget

    def out(a: np.ndarray, b: np.ndarray, d: np.ndarray):
        for i, j, k in spread(order, starts, a, b):
            keep = np.ones(len(i), dtype=bool)
            for s, (up, down) in zip(sizes, bands, strict=True):
                keep &= down * np.abs(s[i] - s[j]) <= up * np.maximum(s[i], s[j])
            if keep.any():
                yield i[keep], j[keep], d[k[keep]]

    def checked(a: np.ndarray, b: np.ndarray):
        d = np.empty(len(a), dtype=np.int64)
        for k, (x, y) in enumerate(zip(text[a].tolist(), text[b].tolist(), strict=True)):
            d[k] = distance(texts, x, y, known)
        keep = d * den <= num * (length[text[a]] + length[text[b]])
        return a[keep], b[keep], d[keep]

    copies = np.flatnonzero((np.diff(starts) > 1) & (item // len(texts) % 3 == 0))
    yield from out(copies, copies, np.zeros(len(copies), np.int64))
    for u, v in ((np.array(alone, np.int64), np.array(alone, np.int64)), (np.array([x for x, _ in two], np.int64), np.array([y for _, y in two], np.int64))):
        if not len(u):
            continue
        for a, b in t.pairs(u, v, budget, list(bands)):
            # Of a cell of two sides the first row is that of side 1.
            yield from out(*checked(a, b))
    if opened is not None:
        opened.append(t.opened)


def pairs(records: DataFrame, keys: DataFrame, budget: tuple[int, int], sizes: list[str], bands: list[tuple[int, int]], cap: int = CAP, block: str = "block", id_col: str = "id", text: str = "text") -> DataFrame:
    """(a, b, d, n), a < b: rows of one block whose texts, of n characters together, are d <= budget n insertions and deletions apart.

    The sizes of a pair lie within the bands: down |x - y| <= up max(x, y); hot blocks
    are laid out by the first. keys: block and first size of every row, without its
    text. Ids must be unique whole numbers. Nothing is dropped: the result is exact.
    """
    placed = cells.self_cells(records, keys, block, id_col, cap, sizes[0] if sizes else None, bands[0] if bands else None)

    def work(t: pa.Table, code: np.ndarray) -> Iterator[pa.RecordBatch]:
        held = np.bincount(code)
        keep = held[code] > 1  # a lone row has no partner
        if not keep.any():
            return
        t, code = t.filter(pa.array(keep)), code[keep]
        whole = t.column(text).combine_chunks().dictionary_encode()
        ids = t.column(id_col).to_numpy()
        texts, of = whole.dictionary.to_pylist(), whole.indices.to_numpy().astype(np.int64)
        length = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))[of]
        limits = [t.column(s).to_numpy().astype(np.int64) for s in sizes]
        for i, j, d in similar(texts, of, code, t.column("side").to_numpy(), limits, budget, bands):
            x, y = ids[i], ids[j]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(d), pa.array(length[i] + length[j])], names=["a", "b", "d", "n"])

    return cells.map_cells(placed, block, work, "a long, b long, d long, n long", ["side", id_col, text, *sizes])
