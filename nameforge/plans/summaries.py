"""The two summary stages: prompts from evidence, cut to the limit, answered where an answer is pending."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nameforge.functions.text import strip
from nameforge.operators.curate import lookup_join, pending_status
from nameforge.plans import prompts
from nameforge.plans.generate import Generator, echo_names, generate


def _answered(df: DataFrame, prompt: Column, output: str, make: Callable[[], Generator], overwrite: bool, cut: Callable[[Column], Column]) -> DataFrame:
    """df with input, output and status; the model sees the pending rows only, and a finished output stays as it is."""
    rows = df.withColumn("input", cut(prompt))
    done = F.col(output) if output in df.columns else F.lit(None).cast("string")
    rows = rows.withColumn("_old", done).withColumn("status", pending_status(F.col("_old"), F.col("input"), overwrite))
    rows = rows.withColumn("_ask", F.when(F.col("status") == "pending", F.col("input")))
    said = generate(rows.drop(output), "_ask", "_new", make)
    return said.withColumn(output, F.coalesce(strip(F.col("_new")), F.col("_old"))).drop("_old", "_new", "_ask")


def domain_summaries(df: DataFrame, make: Callable[[], Generator] = echo_names, overwrite: bool = False, output: str = "domain_summary", most: int = prompts.MOST_CHARS) -> DataFrame:
    """Programs (``analysis``: evidence) with input, ``output`` and status (completed, pending, missing_prompt: as it was before)."""
    made = prompts.domain_prompt(F.col("analysis.project_name"), F.col("analysis.file_output"), F.col("analysis.ldd_output"), F.col("analysis.strings_truncated"))
    return _answered(df, F.when(F.col("analysis").isNotNull(), made["prompt"]), output, make, overwrite, lambda p: prompts.cut_domain(p, most))


def identifier_summaries(df: DataFrame, programs: DataFrame, make: Callable[[], Generator] = echo_names, overwrite: bool = False, output: str = "identifier_summary", most: int = prompts.MOST_CHARS) -> DataFrame:
    """Functions with input, ``output``, status and lookup_status; the program's summary comes from programs by (proj, bin).

    A function whose program has no summary, or several, gets no prompt.
    """
    rows = lookup_join(df, programs, ["proj", "bin"], "domain_summary")
    none = F.array().cast("array<string>")
    made = prompts.identifier_prompt(F.col("domain_summary"), F.col("code"), F.array_sort(F.coalesce(F.map_keys("params_aligned"), none)), F.array_sort(F.coalesce(F.map_keys("vars_aligned"), none)), F.col("funname"), F.col("callees"))
    return _answered(rows, made, output, make, overwrite, lambda p: prompts.cut_identifier(p, most))
