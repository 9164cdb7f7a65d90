"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nameforge.session import checkpoint


def plan(available: dict[str, int], targets: dict[str, tuple[float, int]], total: float) -> dict[str, float]:
    """Expected copies of each text per source.

    A source gets its share of ``total`` tokens, at most max_repeat copies of what it
    has. What capped sources lack is spread over the others in proportion to their
    shares, so that the size is met if it can be.
    """
    tokens = {s: 0.0 for s in targets}
    open_ = {s for s in targets if available.get(s) and targets[s][0] > 0}
    left = float(total)
    while open_:
        weight = sum(targets[s][0] for s in open_)
        full = {s for s in open_ if left * targets[s][0] / weight >= available[s] * targets[s][1]}
        if not full:
            for s in open_:
                tokens[s] = left * targets[s][0] / weight
            break
        for s in full:
            tokens[s] = float(available[s] * targets[s][1])
            left -= tokens[s]
        open_ -= full
    return {s: tokens[s] / available[s] if available.get(s) else 0.0 for s in targets}


#: Size classes to a doubling of the size; hash pieces of a class.
STEPS, PIECES = 16, 64


def mix(sized: DataFrame, targets: list[tuple[str, float, int]], share: float = 0.25, seed: int = 7, steps: int = STEPS, pieces: int = PIECES) -> DataFrame:
    """(doc_id, source, n_tokens, copy): the sampled collection, one row per use of a text.

    sized: doc_id, source, n_tokens, digest (of the text) of the whole corpus. The
    collection has ``share`` of the corpus's tokens. Equal texts count as one text,
    that of the smallest doc_id within the sources to mix. Texts of a source stand in
    order of their size (to 1 / steps of a doubling), by hash within it; the running
    sum of their expected copies plus one random offset, drawn from the seed, emits a
    copy at each whole number it passes. So every text of a source is drawn with the
    same chance, all sizes in proportion, and at most ceil(expected) <= max_repeat
    times; the tokens of a source miss its target by about its largest text. targets is a
    small parameter list; null or unlisted sources only count to the corpus.
    """
    sized = checkpoint(sized)
    total = sized.agg(F.sum("n_tokens")).first()[0] or 0
    wanted = {s: (float(w), int(m)) for s, w, m in targets}
    scale = sum(w for w, _ in wanted.values()) or 1.0
    wanted = {s: (w / scale, m) for s, (w, m) in wanted.items()}
    texts = sized.where(F.col("source").isin(*wanted)).groupBy("digest").agg(F.min_by(F.struct("doc_id", "source", "n_tokens"), "doc_id").alias("t")).select("t.*").where("n_tokens > 0")
    texts = checkpoint(texts.withColumn("c", F.floor(F.log2("n_tokens") * steps).cast("int")).withColumn("b", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(pieces)).cast("int")))
    sums = texts.groupBy("source", "c", "b").agg(F.count("*").alias("k"), F.sum("n_tokens").alias("n"))
    available = {r["source"]: r["n"] for r in sums.groupBy("source").agg(F.sum("n").alias("n")).collect()}  # one row per listed source
    copies = plan(available, wanted, share * total)
    # The rank in two steps: counts of (class, piece) are summed up within the source, then each of them is numbered.
    starts = sums.withColumn("before", F.sum("k").over(Window.partitionBy("source").orderBy("c", "b")) - F.col("k")).select("source", "c", "b", "before")
    inside = F.row_number().over(Window.partitionBy("source", "c", "b").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id"))
    ranked = texts.withColumn("inside", inside).join(starts, ["source", "c", "b"]).withColumn("rank", F.col("before") + F.col("inside"))
    most = _by_source({s: m for s, (_, m) in wanted.items()})
    rate = _by_source(copies)
    offset = F.lit(random.Random(seed).random())
    times = F.least((F.floor(offset + rate * F.col("rank")) - F.floor(offset + rate * (F.col("rank") - 1))).cast("int"), most)
    return ranked.withColumn("times", times).where("times > 0").select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))


def _by_source(values: dict[str, float]) -> Column:
    return F.coalesce(*(F.when(F.col("source") == s, F.lit(v)) for s, v in values.items()), F.lit(0))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, texts, copies, most): what each source really has."""
    used = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count_if(F.col("copy") == 1).alias("texts"), F.count("*").alias("copies"), F.max("copy").alias("most"))
    joined = targets.select("source", "target_share").join(used, "source", "left").fillna(0, ["tokens", "texts", "copies", "most"])
    return joined.select("source", "target_share", (F.col("tokens") / F.sum("tokens").over(Window.partitionBy())).alias("actual_share"), "tokens", "texts", "copies", "most")
