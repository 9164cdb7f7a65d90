"""Filters, lookups with conflict checks, pending work and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nameforge.functions.text import strip


def clean(df: DataFrame, prompt: str, label: str, tokens, most: int = 16384) -> DataFrame:
    """Records with a non-blank label whose prompt and label, as one text, have at most ``most`` tokens.

    tokens: a function from a text column to its token count. NULL prompts count as ''.
    """
    kept = df.where(F.coalesce(strip(F.col(label)), F.lit("")) != "")
    return kept.withColumn("_n", tokens(F.concat(F.coalesce(prompt, F.lit("")), F.col(label)))).where(F.col("_n") <= most).drop("_n")


def lookup_conflicts(side: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, values): keys with two or more different non-blank values."""
    return side.where(strip(F.col(value)) != "").groupBy(*keys).agg(F.countDistinct(strip(F.col(value))).alias("values")).where("values > 1")


def lookup_join(df: DataFrame, side: DataFrame, keys: list[str], value: str) -> DataFrame:
    """df with ``value`` of side by keys and ``lookup_status`` (found, missing, conflict); conflicting keys give no value.

    Keys are compared with NULLs unequal. Side is reduced to one row per key first.
    """
    one = side.where(strip(F.col(value)) != "").groupBy(*keys).agg(F.min(strip(F.col(value))).alias("_lo"), F.max(strip(F.col(value))).alias("_hi"))
    out = df.drop(value).join(one, keys, "left")
    same = F.col("_lo") == F.col("_hi")
    return out.withColumn(value, F.when(same, F.col("_lo"))).withColumn("lookup_status", F.when(F.col("_lo").isNull(), "missing").when(same, "found").otherwise("conflict")).drop("_lo", "_hi")


def pending_status(done: Column, prompt: Column, overwrite: bool = False) -> Column:
    """completed (a non-blank output, unless overwriting), missing_prompt, or pending."""
    has = F.coalesce(strip(done), F.lit("")) != ""
    return F.when(has & F.lit(not overwrite), "completed").when(F.coalesce(strip(prompt), F.lit("")) == "", "missing_prompt").otherwise("pending")


def resume(tasks: DataFrame, written: DataFrame, key: str) -> DataFrame:
    """Tasks whose key is not written yet; by key, so a changed task list never shifts results."""
    return tasks.join(written.select(key).distinct(), key, "left_anti")


def split_by_presence(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(records with the column, records without it): the costly step sees the first part only."""
    return df.where(F.col(column).isNotNull()), df.where(F.col(column).isNull())


def counters(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row with how many records meet each condition, and ``total``."""
    return df.agg(F.count("*").alias("total"), *(F.count_if(c).alias(n) for n, c in conditions.items()))
