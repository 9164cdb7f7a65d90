"""Scores of predicted names: per name, averaged over groups, best of several answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nameforge.functions.similarity import f1

KINDS = ("fun", "param", "var")


def scored_pairs(df: DataFrame, predicted: Column, key: str, maps: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, kind, name, gt, pred, keep...): each predicted name that a true map has, once for every kind that has it.

    Only predicted names count: a true name that was never predicted is no row.
    """
    long = df.select(key, *keep, F.explode(predicted).alias("_e"), *maps.values())
    out = None
    for kind, column in maps.items():
        gt = F.try_element_at(F.col(column), F.col("_e.k"))
        part = long.where(F.map_contains_key(F.col(column), F.col("_e.k"))).select(key, *keep, F.lit(kind).alias("kind"), F.col("_e.k").alias("name"), gt.alias("gt"), F.col("_e.v").alias("pred"))
        out = part if out is None else out.unionByName(part)
    return out


def averages(scored: DataFrame, split: str = "in_train") -> DataFrame:
    """(split, kind, names, precision, recall, f1) for each kind, params and vars together, all together; each of split 1, 0 and all (NULL).

    One pass: kinds and splits are grouping sets over sums and counts; the means are
    of names, not of tokens. Rows of another split count to all only.
    """
    groups = F.array(
        F.col("kind"),
        F.when(F.col("kind") != "fun", F.lit("params_vars")),
        F.lit("total"),
    )
    each = scored.select(F.explode(F.filter(groups, lambda g: g.isNotNull())).alias("kind"), F.col(split).alias("split"), "precision", "recall")
    spread = each.select("kind", F.explode(F.array(F.when(F.col("split").isin(0, 1), F.col("split").cast("string")), F.lit("all"))).alias("split"), "precision", "recall").where(F.col("split").isNotNull())
    p, r = F.avg("precision"), F.avg("recall")
    return spread.groupBy("split", "kind").agg(F.count("*").alias("names"), p.alias("precision"), r.alias("recall")).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def best_of(df: DataFrame, keys: list[str], prob: str, tie: str, k: int = 3) -> DataFrame:
    """Of the k likeliest answers of each key the last that is no worse in both scores than the best before it.

    df: keys, prob, tie (arrival order), precision, recall and more. The fold depends
    on the order; NULL probs come last.
    """
    rest = [c for c in df.columns if c not in keys]
    top = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(prob), tie))).where(F.col("_n") <= k)
    grouped = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_n", *rest))).alias("a"))
    fold = F.aggregate(F.slice("a", 2, k), F.element_at("a", 1), lambda acc, x: F.when((x["precision"] >= acc["precision"]) & (x["recall"] >= acc["recall"]), x).otherwise(acc))
    return grouped.select(*keys, fold.alias("_b")).select(*keys, *(F.col("_b")[c].alias(c) for c in rest))


def top_with_runner_up(df: DataFrame, key: str, value: str, tie: str) -> DataFrame:
    """(key, best_id, best, second, ties): the largest value, how many have it, and the next one (the same on a tie).

    One scan: rows are combined to (key, value) before the shuffle, and the two largest of each key are kept.
    """
    levels = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("ties"), F.min(tie).alias("best_id"))
    two = levels.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(value)))).where("_n <= 2")
    first = F.col("_n") == 1
    best = two.groupBy(key).agg(*(F.max(F.when(first, F.col(c))).alias(a) for c, a in (("best_id", "best_id"), (value, "best"), ("ties", "ties"))), F.max(F.when(~first, F.col(value))).alias("_below"))
    return best.select(key, "best_id", "best", F.when(F.col("ties") > 1, F.col("best")).otherwise(F.col("_below")).alias("second"), "ties")
