"""Same or near-same records across splits: partitioned word n-gram hashes and containment."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nameforge.functions.names import name_of
from nameforge.operators import cells, near

#: Words per shingle.
WORDS = 5
#: Least share of an evaluation record's shingles that a training record must hold to be checked.
LEAST = 0.05

_WORD = re.compile(r"[^\W_]\w*|_\w*")


def features(df: DataFrame, id_col: str = "test_id", name: str = "funname_aligned", code: str = "code", split: str = "in_train") -> DataFrame:
    """(id, block, side, words, text): side 1 is evaluation (split 0), side 2 training (split 1).

    Rows of another or null split, null code or no name are left out. words is the
    code without comments in lower case, text that without white space.
    """
    bare = F.lower(F.regexp_replace(F.regexp_replace(F.col(code), r"(?s)/\*.*?\*/", ""), r"//[^\r\n]*", ""))
    return (
        df.where(F.col(split).isin(0, 1) & F.col(code).isNotNull())
        .select(F.col(id_col).alias("id"), name_of(F.col(name)).alias("block"), F.when(F.col(split) == 0, 1).otherwise(2).alias("side"), bare.alias("words"))
        .where(F.col("block").isNotNull())
    )


def shingles(text: str, known: dict[str, int], n: int = WORDS) -> np.ndarray:
    """Distinct hashes of the n-word shingles of a text; a shorter text has one, of all its words.

    Words are hashed by xxHash, so a shingle has one value in every process; known keeps the words met so far.
    """
    words = _WORD.findall(text)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ (h[k : len(h) - n + 1 + k] + np.uint64(k))
        out ^= out >> np.uint64(29)
    return np.unique(out)


def contained(ask: list[np.ndarray], have: list[np.ndarray], least: float, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(asking, holding, containment): which hold at least ``least`` of an asking record's shingles, and more than none.

    The asking records' shingles are an inverted index. The holding records are scanned
    for hits, so many at a time that their hits stay near ``most``; hits are then
    counted by (asking, holding), and only pairs with a hit take any room.
    """
    if not ask or not have:
        return
    size = np.fromiter(map(len, ask), dtype=np.int64, count=len(ask))
    keys, owner = np.concatenate(ask), np.repeat(np.arange(len(ask)), size)
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    probe = np.concatenate(have)
    by = np.repeat(np.arange(len(have)), [len(g) for g in have])
    a, b = np.searchsorted(keys, probe), np.searchsorted(keys, probe, side="right")
    hits = np.add.reduceat(np.append(b - a, 0), np.searchsorted(by, np.arange(len(have)))) * np.fromiter((len(g) > 0 for g in have), dtype=bool, count=len(have))
    ends = np.cumsum(hits)
    lo = 0
    while lo < len(have):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        s, e = np.searchsorted(by, [lo, hi])
        run = (b - a)[s:e]
        inside = np.arange(run.sum()) - np.repeat(np.cumsum(run) - run, run)
        code = np.repeat(by[s:e] - lo, run) * len(ask) + owner[np.repeat(a[s:e], run) + inside]
        if (hi - lo) * len(ask) <= 4 * len(code):  # no more places than hits: counted in place, else by sorting
            count = np.bincount(code)
            pair = np.flatnonzero(count)
            count = count[pair]
        else:
            pair, count = np.unique(code, return_counts=True)
        h, q = lo + pair // len(ask), pair % len(ask)
        share = count / size[q]
        keep = count >= least * size[q]
        yield q[keep], h[keep], share[keep]
        lo = hi


def overlaps(records: DataFrame, per: int = 10, least: float = LEAST, n: int = WORDS, cap: int = near.CAP, sound: bool = False) -> DataFrame:
    """(eval_id, train_id, containment): pairs of one name with likeness >= 1 - 1 / per.

    records: as from ``features``. Evaluation shingles are partitioned with the
    training records of their name; names beyond ``cap`` rows of either side are cut
    into chunks that meet pairwise. A training record that holds ``least`` of an
    evaluation record's shingles is checked exactly. Edits that touch nearly every
    shingle leave fewer: with ``sound`` such pairs come from the trie over unary codes,
    whose budget loses none, and the result is exact (README has the recall without).
    Records without any character left have no overlap.
    """
    placed = cells.cross_cells(records, records.select("block", "side"), "block", "side", "id", cap)

    def work(t: pa.Table, code: np.ndarray) -> Iterator[pa.RecordBatch]:
        side = t.column("side").to_numpy()
        ones, twos = np.bincount(code, side == 1), np.bincount(code, side == 2)
        keep = (ones[code] > 0) & (twos[code] > 0)
        if not keep.any():
            return
        t, code, side = t.filter(pa.array(keep)), code[keep], side[keep]
        whole = t.column("words").combine_chunks().dictionary_encode()
        words, of = whole.dictionary.to_pylist(), whole.indices.to_numpy().astype(np.int64)
        texts = ["".join(w.split()) if w.isascii() else w.translate(_ASCII_SPACE) for w in words]
        met: dict[str, int] = {}
        grams = [shingles(w, met, n) for w in words]
        length = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        ids = t.column("id").to_numpy()
        known: dict[tuple[int, int], int] = {}
        # A text of a side of a cell is one item, however many rows hold it.
        item, first, back = np.unique((code.astype(np.int64) * 3 + side) * len(words) + of, return_index=True, return_inverse=True)
        text, root = of[first], item // len(words)
        order, starts = near.rows_below(back, len(item))
        seen: set[tuple[int, int]] = set()

        def rows_of(i, j):
            share = [_share(grams[x], grams[y]) for x, y in zip(of[i].tolist(), of[j].tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j]), pa.array(share, pa.float64())], names=["eval_id", "train_id", "containment"])

        # All cells are searched at once: a cell's number goes into its shingles.
        mine = [grams[x] ^ mixed for x, mixed in zip(text, (root // 3).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), strict=True)]
        ask, have = np.flatnonzero(root % 3 == 1), np.flatnonzero(root % 3 == 2)
        for q, h, _ in contained([mine[k] for k in ask], [mine[k] for k in have], least):
            a, b = ask[q], have[h]
            x, y = text[a], text[b]
            keep = (root[a] + 1 == root[b]) & (length[x] > 0) & (length[y] > 0) & (np.abs(length[x] - length[y]) * per <= length[x] + length[y])
            a, b = a[keep], b[keep]
            good = [near.distance(texts, x, y, known) * per <= len(texts[x]) + len(texts[y]) for x, y in zip(text[a].tolist(), text[b].tolist(), strict=True)]
            a, b = a[good], b[good]
            seen.update(zip(a.tolist(), b.tolist(), strict=True))
            for i, j, _ in near.spread(order, starts, a, b):
                yield rows_of(i, j)
        if not sound:
            return
        for i, j, _ in near.similar(texts, of, code, side, [], (1, per), [], known):
            new = (length[of[i]] > 0) & (length[of[j]] > 0)
            new &= np.fromiter(((a, b) not in seen for a, b in zip(back[i].tolist(), back[j].tolist(), strict=True)), dtype=bool, count=len(i))
            if new.any():
                yield rows_of(i[new], j[new])

    return cells.map_cells(placed, "block", work, "eval_id long, train_id long, containment double", ["side", "id", "words"])


def _share(ask: np.ndarray, have: np.ndarray) -> float:
    return len(np.intersect1d(ask, have, assume_unique=True)) / len(ask) if len(ask) else 0.0


_ASCII_SPACE = dict.fromkeys(map(ord, " \t\n\r\x0b\x0c"))


def report(records: DataFrame, found: DataFrame, sources: DataFrame) -> DataFrame:
    """Per split and source: evaluation records, those with an overlap, the overlaps.

    sources: (id, eval_set, source) of all evaluation records; null splits and
    sources are groups of their own.
    """
    per = found.groupBy(F.col("eval_id").alias("id")).agg(F.count("*").alias("_n"))
    return sources.join(per, "id", "left").groupBy("eval_set", "source").agg(F.count("*").alias("records"), F.count("_n").alias("leaked"), F.coalesce(F.sum("_n"), F.lit(0)).alias("overlaps"))
