"""Similarities of strings, token lists and vectors."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence; bit-parallel, after common ends are cut off."""
    if a == b:
        return len(a)
    k, most = 0, min(len(a), len(b))
    while k < most and a[k] == b[k]:
        k += 1
    t = 0
    while t < most - k and a[-1 - t] == b[-1 - t]:
        t += 1
    x, y = a[k : len(a) - t], b[k : len(b) - t]
    if not x or not y:
        return k + t
    at: dict[str, int] = {}
    for i, c in enumerate(x):
        at[c] = at.get(c, 0) | 1 << i
    mask = (1 << len(x)) - 1
    row = mask
    for c in y:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & mask
    return k + t + len(x) - row.bit_count()


def lcs_many(texts: list[str], other: str, most: int = 1 << 20) -> list[int]:
    """``lcs`` of each text with one other; the texts lie side by side in one long integer.

    Each text has whole bytes and at least one bit more than characters: the bit takes
    up the carry, so no text touches the next.
    """
    if len(texts) > 1 and sum(map(len, texts)) > most:
        half = len(texts) // 2
        return lcs_many(texts[:half], other, most) + lcs_many(texts[half:], other, most)
    lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    room = lens // 8 + 1
    first = np.cumsum(room) - room
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    place = np.arange(len(points)) + np.repeat(8 * first - (np.cumsum(lens) - lens), lens)

    def bits(places: np.ndarray) -> int:
        flags = np.zeros(8 * int(room.sum()), dtype=np.uint8)
        flags[places] = 1
        return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")

    at = {c: bits(place[points == ord(c)]) for c in set(other)}
    row = mask = bits(place)
    for c in other:
        hit = row & at[c]
        row = ((row + hit) | (row - hit)) & mask
    left = np.bitwise_count(np.frombuffer(row.to_bytes(int(room.sum()), "little"), dtype=np.uint8)).astype(np.int64)
    return (lens - np.add.reduceat(left, first)).tolist() if len(texts) else []


def ratios(a: list[str | None], b: list[str | None]) -> list[float | None]:
    """The ratio of each pair of texts; pairs that share a text are compared with it together."""
    turned = len(set(a)) < len(set(b))
    by: dict[str, dict[str, float]] = {}
    for x, y in zip(b, a, strict=True) if not turned else zip(a, b, strict=True):
        if x is not None and y is not None:
            by.setdefault(x, {})[y] = 100.0
    for x, others in by.items():
        asked = [y for y in others if y != x]
        for y, n in zip(asked, lcs_many(asked, x), strict=True):
            others[y] = 200.0 * n / (len(x) + len(y))
    pairs = zip(a, b, strict=True) if turned else zip(b, a, strict=True)
    return [None if x is None or y is None else by[x][y] for x, y in pairs]


@F.pandas_udf(DoubleType())
def indel_ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """100 (1 - d / (la + lb)), d the insertions and deletions of characters between two texts; two empty texts have 100."""
    for a, b in batches:
        yield pd.Series(ratios(a.tolist(), b.tolist()), dtype="float64")


def rounded_ratio(ratio: Column) -> Column:
    """The ratio as a whole number, halves to the even one."""
    return F.bround(ratio, 0).cast("int")


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 0 for two empty texts."""
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, F.lit(0.0)).otherwise((most - F.levenshtein(a, b)) / most)


def recall(a: Column, b: Column) -> Column:
    """Share of the set b that set a has; 0 for an empty b."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_distinct(b)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of equal length, in double."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def letter_cosine(a: Column, b: Column) -> Column:
    """Cosine of two texts' counts of the letters a to z, letter case ignored; 0 where either has none. Stands in for an encoder."""

    def counts(x: Column) -> Column:
        low = F.lower(x)
        return F.transform(F.array(*(F.lit(chr(c)) for c in range(97, 123))), lambda c: (F.length(low) - F.length(F.replace(low, c, F.lit("")))).cast("double"))

    return F.coalesce(F.nanvl(cosine(counts(a), counts(b)), F.lit(0.0)), F.lit(0.0))


def cluster_match(clusters: dict[str, list[int]], most: int = 20_000, match=None):
    """A token match with word clusters, {word: numbers}; a side table of at most ``most`` words."""
    if len(clusters) > most:
        raise ValueError(f"{len(clusters)} words are more than {most}")
    known = F.from_json(F.lit(json.dumps(clusters)), "map<string,array<int>>")
    return lambda a, b: (match or near_token)(a, b, F.try_element_at(known, a), F.try_element_at(known, b))


def same_token(a: Column, b: Column, clusters_a: Column | None = None, clusters_b: Column | None = None) -> Column:
    """Equal, one a prefix or suffix of the other (the shorter of 2 letters or more), or of a shared word cluster."""
    short = F.least(F.length(a), F.length(b)) >= 2
    out = (a == b) | (short & (F.startswith(a, b) | F.startswith(b, a) | F.endswith(a, b) | F.endswith(b, a)))
    if clusters_a is not None:
        out = out | F.coalesce(F.arrays_overlap(clusters_a, clusters_b), F.lit(False))
    return out


def near_token(a: Column, b: Column, clusters_a: Column | None = None, clusters_b: Column | None = None) -> Column:
    """Equal or a prefix (an empty token is one of all); else shared clusters if both have some; else equal first letter and an edit distance under a third."""
    close = (F.length(a) > 1) & (F.length(b) > 1) & (F.substring(a, 1, 1) == F.substring(b, 1, 1)) & (F.levenshtein(a, b) * 3 < F.greatest(F.length(a), F.length(b)))
    out = F.when((a == b) | F.startswith(a, b) | F.startswith(b, a), True)
    if clusters_a is not None:
        out = out.when(clusters_a.isNotNull() & clusters_b.isNotNull(), F.arrays_overlap(clusters_a, clusters_b))
    return out.otherwise(close)


def score_names(gt: Column, pred: Column, tokens=None, match=near_token) -> Column:
    """Struct (precision, recall) of a predicted name against the true one.

    Names are lowered first; equal names score 1 and 1, a NULL or token-less side 0
    and 0. Matched tokens count as sets, all tokens as lists. ``tokens`` cuts a name
    into tokens (default: words), ``match`` compares two.
    """
    from nameforge.functions.names import words

    cut = tokens or words
    g, p = F.lower(gt), F.lower(pred)
    tg, tp = cut(g), cut(p)
    hit_p = F.size(F.array_distinct(F.filter(tp, lambda x: F.exists(tg, lambda y: match(y, x)))))
    hit_g = F.size(F.array_distinct(F.filter(tg, lambda y: F.exists(tp, lambda x: match(y, x)))))
    none = F.struct(F.lit(0.0).alias("precision"), F.lit(0.0).alias("recall"))
    return (
        F.when(gt.isNull() | pred.isNull(), none)
        .when(g == p, F.struct(F.lit(1.0).alias("precision"), F.lit(1.0).alias("recall")))
        .when((F.size(tg) == 0) | (F.size(tp) == 0), none)
        .otherwise(F.struct((hit_p / F.size(tp)).alias("precision"), (hit_g / F.size(tg)).alias("recall")))
    )


def f1(precision: Column, recall_: Column) -> Column:
    return F.when(precision + recall_ > 0, 2 * precision * recall_ / (precision + recall_)).otherwise(F.lit(0.0))


def hybrid_reward(pred: Column, gt: Column, semantic=None) -> Column:
    """Mean over the true mapping's keys of a name's reward; 0 when the key sets differ or are empty.

    pred, gt: arrays of (k, v), keys distinct. Equal values score 1, ``-`` on one
    side 0, else 0.2 edit similarity + 0.6 recall of letter tokens + 0.2 semantic
    similarity (a function of two values; absent it counts 0).
    """
    from nameforge.functions.names import letter_tokens
    from nameforge.functions.pairs import keys, let

    return let(pred, lambda p: let(gt, lambda g: _reward(p, g, letter_tokens, keys, let, semantic)))


def _reward(pred, gt, letter_tokens, keys, let, semantic) -> Column:
    def one(e: Column) -> Column:
        return let(F.element_at(F.filter(pred, lambda x: x["k"] == e["k"]), 1)["v"], lambda p: value(p, e["v"]))

    def value(p: Column, g: Column) -> Column:
        mixed = 0.2 * edit_similarity(p, g) + 0.6 * recall(letter_tokens(p), letter_tokens(g))
        if semantic is not None:
            mixed = mixed + 0.2 * semantic(p, g)
        return F.when(p == g, F.lit(1.0)).when((p == "-") | (g == "-"), F.lit(0.0)).otherwise(mixed)

    scores = F.transform(gt, one)
    total = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x)
    same = F.array_sort(keys(pred)) == F.array_sort(keys(gt))
    return F.when(same & (F.size(gt) > 0), total / F.size(gt)).otherwise(F.lit(0.0))
