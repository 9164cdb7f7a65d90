"""Retrieval of the one most similar candidate, with the reasons where there is none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nameforge.functions.code import jaccard
from nameforge.operators import near
from nameforge.operators.cells import size_bin
from nameforge.session import checkpoint

#: Sizes may differ by so much of the larger.
BAND = (3, 10)

# The outcomes, in the order of their tests.
STATUSES = ["missing_index", "short_loc", "no_match", "matched", "ambiguous"]
METHODS = ["similarity", "numeric_constant_jaccard", "numeric_constant_jaccard_unavailable", "unresolved_numeric_constant_jaccard"]


def indexed(index: Column) -> Column:
    """Whether all four features are there."""
    return index.isNotNull() & index["arg_count"].isNotNull() & index["return_type"].isNotNull() & index["loc"].isNotNull() & index["full_loc"].isNotNull()


def eligible(index: Column, most: int = 1) -> Column:
    """Not of 1 to ``most`` lines; no line at all is eligible, most = 0 excludes nothing."""
    return ~index["loc"].between(1, most)


def within(a: Column, b: Column, band: tuple[int, int] = BAND) -> Column:
    """Whether two sizes differ by at most band[0] / band[1] of the larger."""
    return F.abs(a - b) * band[1] <= F.greatest(a, b) * band[0]


def retrieve(
    targets: DataFrame,
    candidates: DataFrame,
    text: str,
    source: str,
    numbers: str,
    key: str = "id",
    index: str = "index",
    threshold: float = 90.0,
    excluded_loc: int = 1,
    keep: tuple[str, ...] = (),
    not_self: bool = False,
    cap: int = near.CAP,
) -> DataFrame:
    """targets with ``match`` (struct of the winner's key and ``keep`` columns) and ``retrieval`` (diagnostics).

    Candidates have a non-empty ``source`` text and an index with the target's
    arg_count and return_type and loc and full_loc within ``BAND``. The score is the
    ratio of the texts. The best one over the threshold wins if it is unique; a tie goes
    to the unique largest Jaccard of the number sets. A NULL text has no score. Keys are
    unique whole numbers; all targets are kept. not_self: targets and candidates are the
    same rows, and none is its own candidate.

    Pairs over the threshold come from the trie, so scores below it are not known: best
    and second are NULL there. Number sets are read for ties only, and the candidates
    within the bands are counted from the counts of (loc, full_loc), without pairs.
    """
    i = F.col(index)
    has = F.coalesce(indexed(i), F.lit(False))
    t = targets.withColumn("_has", has)

    def rows(df: DataFrame, flags: Column) -> DataFrame:
        known = df.withColumn("_f", flags.cast("int")).where("_f > 0").where(F.col(text).isNotNull())
        return known.select((F.col(key).cast("long") * 4 + F.col("_f")).alias("id"), F.concat_ws("\x01", i["arg_count"].cast("string"), i["return_type"]).alias("block"), i["loc"].cast("long").alias("loc"), i["full_loc"].cast("long").alias("full_loc"), F.col(text).alias("text"))

    asks = F.when(has & eligible(i, excluded_loc), 2).otherwise(0)
    offers = F.when(has & (F.length(source) > 0), 1).otherwise(0)
    all_rows = rows(targets, asks + offers) if not_self else rows(targets, asks).unionByName(rows(candidates, offers))
    narrow = all_rows.drop("text")
    found = near.pairs(all_rows, narrow.select("block", "loc"), (round((100 - threshold) * 1000), 100_000), ["loc", "full_loc"], [BAND, BAND], cap)
    both = found.select(F.explode(F.array(F.struct(F.col("a").alias("t"), F.col("b").alias("c")), F.struct(F.col("b").alias("t"), F.col("a").alias("c")))).alias("p"), F.when(F.col("n") == 0, 100.0).otherwise((F.col("n") - F.col("d")) * 100.0 / F.col("n")).alias("s")).select("p.*", "s")
    both = both.where((F.col("t").bitwiseAND(2) > 0) & (F.col("c").bitwiseAND(1) > 0) & (F.col("s") > threshold))
    # Written once: the levels and the ties read it.
    scored = checkpoint(both.select(F.shiftright("t", 2).alias("t"), F.shiftright("c", 2).alias("c"), "s"))
    levels = scored.groupBy("t", "s").agg(F.count("*").alias("top"), F.min("c").alias("one"))
    two = levels.withColumn("_n", F.row_number().over(Window.partitionBy("t").orderBy(F.desc("s")))).withColumn("qualified", F.sum("top").over(Window.partitionBy("t"))).where("_n <= 2")
    first = F.col("_n") == 1
    best = two.groupBy("t").agg(*(F.max(F.when(first, F.col(c))).alias(c) for c in ("s", "top", "one", "qualified")), F.max(F.when(~first, F.col("s"))).alias("below"))
    tied = scored.join(best.where("top > 1").select("t", "s"), ["t", "s"])
    tied = tied.join(targets.select(F.col(key).cast("long").alias("t"), F.col(numbers).alias("c0")), "t").join(candidates.select(F.col(key).cast("long").alias("c"), F.col(numbers).alias("c1")), "c")
    shared = tied.select("t", "c", F.when(F.size("c0") > 0, jaccard(F.col("c1"), F.col("c0"))).alias("j")).groupBy("t", "j").agg(F.count("*").alias("m"), F.min("c").alias("c"))
    shared = shared.groupBy("t").agg(
        F.coalesce(F.sum(F.when(F.col("j").isNull(), F.col("m"))), F.lit(0)).alias("gaps"),
        F.max("j").alias("j1"),
        F.max_by("m", "j").alias("topj"),
        F.max_by("c", "j").alias("jc"),
        F.try_element_at(F.sort_array(F.collect_set("j"), False), F.lit(2)).alias("jb"),
    )
    stats = best.join(shared, "t", "left").withColumn("second", F.when(F.col("top") > 1, F.col("s")).otherwise(F.col("below"))).withColumnRenamed("s", "best")
    sized = band_counts(narrow, not_self)
    full = t.join(stats.join(sized, "t", "full").withColumnRenamed("t", key), key, "left")
    return _diagnosed(full, targets, candidates, key, i, excluded_loc, threshold, keep)


def band_counts(rows: DataFrame, not_self: bool) -> DataFrame:
    """(t, size_filtered): how many candidates every target has within the bands.

    rows: as in ``retrieve``, (id, block, loc, full_loc), the id's last two bits telling
    targets (2) and candidates (1). Distinct sizes are joined, not rows.
    """
    grid = ["block", "loc", "full_loc"]
    here = rows.withColumn("_b", size_bin(F.col("loc"), BAND))
    asked = here.where(F.col("id").bitwiseAND(2) > 0)
    offered = here.where(F.col("id").bitwiseAND(1) > 0).groupBy(*grid, "_b").agg(F.count("*").alias("_n")).select("block", F.col("loc").alias("l1"), F.col("full_loc").alias("f1"), "_n", F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1)).alias("_b"))
    counted = asked.select(*grid, "_b").distinct().join(offered, ["block", "_b"]).where(within(F.col("loc"), F.col("l1")) & within(F.col("full_loc"), F.col("f1"))).groupBy(*grid).agg(F.sum("_n").alias("_n"))
    own = F.when(F.col("id").bitwiseAND(1) > 0, 1).otherwise(0) if not_self else F.lit(0)
    return asked.join(counted, grid).select(F.shiftright("id", 2).alias("t"), (F.col("_n") - own).alias("size_filtered"))


def _diagnosed(full: DataFrame, targets: DataFrame, candidates: DataFrame, key: str, i: Column, excluded_loc: int, threshold: float, keep: tuple[str, ...]) -> DataFrame:
    unavailable = F.coalesce(F.col("gaps") > 0, F.lit(False))
    status = (
        F.when(~F.col("_has"), "missing_index")
        .when(~eligible(i, excluded_loc), "short_loc")
        .when(F.coalesce(F.col("best") <= threshold, F.lit(True)), "no_match")
        .when(F.col("top") == 1, "matched")
        .when(unavailable, "ambiguous")
        .when(F.col("topj") == 1, "matched")
        .otherwise("ambiguous")
    )
    over = F.col("best") > threshold
    tie = over & (F.col("top") > 1)
    method = F.when(over & (F.col("top") == 1), METHODS[0]).when(tie & unavailable, METHODS[2]).when(tie & (F.col("topj") == 1), METHODS[1]).when(tie, METHODS[3])
    winner = F.when(over & (F.col("top") == 1), F.col("one")).when(tie & ~unavailable & (F.col("topj") == 1), F.col("jc"))
    retrieval = F.struct(
        status.alias("status"),
        F.col("best").alias("best_score"),
        F.col("second").alias("second_best_score"),
        F.coalesce("qualified", F.lit(0)).alias("qualified_candidate_count"),
        F.coalesce("size_filtered", F.lit(0)).alias("size_filtered_candidate_count"),
        F.when(over, F.col("top")).otherwise(0).alias("top_similarity_candidate_count"),
        method.alias("selection_method"),
        F.when(tie & ~unavailable, F.col("j1")).alias("best_numeric_constant_jaccard"),
        F.when(tie & ~unavailable, F.when(F.col("topj") > 1, F.col("j1")).otherwise(F.col("jb"))).alias("second_best_numeric_constant_jaccard"),
        F.when(tie & unavailable, F.col("top")).when(tie, F.col("topj")).otherwise(0).alias("top_jaccard_candidate_count"),
    )
    out = full.select(*targets.columns, winner.alias("_w"), retrieval.alias("retrieval"))
    won = candidates.select(F.col(key).alias("_w"), F.struct(F.col(key), *keep).alias("match"))
    return out.join(won, "_w", "left").drop("_w")
