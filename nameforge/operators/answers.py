"""Older answer records: ranked maps, and raw texts that could not be read as one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nameforge.functions.names import interesting

_MAP = "map<string,string>"


def read_answer(text: Column) -> Column:
    """The map in a raw answer, or NULL: its last ``{...}``, then without its first, then without its last entry.

    Read as JSON with single quotes allowed; never evaluated.
    """
    options = {"allowSingleQuotes": "true", "mode": "PERMISSIVE"}
    inner = F.regexp_extract(text, r"(?s)\{([^{}]*)\}?[^{}]*$", 1)

    def reading(body: Column) -> Column:
        got = F.from_json(F.concat(F.lit("{"), body, F.lit("}")), _MAP, options)
        return F.when((body != "") & (F.size(got) > 0), got)

    no_first = F.regexp_replace(inner, r"(?s)^[^,]*,", "")
    no_last = F.regexp_replace(inner, r"(?s),[^,]*$", "")
    return F.coalesce(reading(inner), reading(no_last), reading(no_first), reading(F.regexp_replace(no_first, r"(?s),[^,]*$", "")))


def ranked(df: DataFrame, key: str, answers: str = "answer_and_probs") -> DataFrame:
    """(key, pos, prob, answer, error): one row per answer; answer is NULL where the text stays unreadable, which is then in error."""
    rows = df.select(key, F.posexplode(answers).alias("pos", "_a"))
    raw = F.try_element_at(F.col("_a.answer"), F.lit("Error"))
    got = F.when(raw.isNotNull(), read_answer(raw)).otherwise(F.col("_a.answer"))
    return rows.select(key, "pos", F.col("_a.prob").alias("prob"), got.alias("answer"), F.when(got.isNull(), raw).alias("error"))


def by_name(answers: DataFrame, key: str) -> DataFrame:
    """(key, name, pos, prob, value): the answers for each placeholder, in arrival order by pos."""
    return answers.where(F.col("answer").isNotNull()).select(key, "pos", "prob", F.explode("answer").alias("name", "value"))


def to_score(answers: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """answers joined with truth (keys, gt) by key and name, by the skip rules of scoring.

    A true name that is not interesting or is still the placeholder is left out, and so
    is a placeholder that no answer names: none of these counts as a miss.
    """
    rows = truth.where(interesting(F.col("gt")) & (F.col("gt") != F.col("name")))
    return answers.join(rows, [*keys, "name"])


def first(answers: DataFrame, keys: list[str]) -> DataFrame:
    """The answer that came first for each key, whatever its probability."""
    rest = [c for c in answers.columns if c not in keys]
    return answers.groupBy(*keys).agg(F.min_by(F.struct(*rest), "pos").alias("_r")).select(*keys, "_r.*")


def with_errors(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable, unreadable): the main output and the one for inspection."""
    return answers.where(F.col("answer").isNotNull()), answers.where(F.col("answer").isNull()).select("error", *(c for c in answers.columns if c not in ("error", "answer")))


def error_rates(df: DataFrame, by: str, answers: str = "answer_and_probs") -> DataFrame:
    """(by, answers, errors, error_share): answers per group, and those that are a raw text in place of a map."""
    each = df.select(by, F.explode(answers).alias("_a")).select(by, F.coalesce(F.map_contains_key(F.col("_a.answer"), "Error"), F.lit(False)).alias("_e"))
    return each.groupBy(by).agg(F.count("*").alias("answers"), F.count_if("_e").alias("errors"), (F.count_if("_e") / F.count("*")).alias("error_share"))


def legacy_names(df: DataFrame, func: str = "func_name", case_study: bool = False) -> DataFrame:
    """Records whose function name is a generated one, or all for a case study."""
    return df if case_study else df.where(F.col(func).rlike("^(sub_|FUN_)"))
