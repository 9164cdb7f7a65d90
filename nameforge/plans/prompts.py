"""Prompts as column expressions. Tags and line order are fixed formats; the instructions are parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nameforge.functions.text import after_first, between_tags, cut_between, distinct_lines, drop_header, normal

# Markers and limits of the two kinds of shortening.
STRINGS_MARK = "\n...[STRINGS TRUNCATED TO FIT MODEL CONTEXT]...\n"
CODE_MARK = "\n...[CODE TRUNCATED TO FIT MODEL CONTEXT]...\n"
NO_LIBRARIES, NO_STRINGS = "(no LDD evidence available)", "(no readable string evidence available)"
MOST_CHARS = 262_144

DOMAIN_TASK = "Say in a few sentences what the program below is for, from its project name and the evidence given. Do not guess beyond the evidence."
IDENTIFIER_TASK = "Explain what each identifier listed below stands for in the function, given what the program does."


def targets(params: Column, variables: Column, funname: Column, callees: Column) -> Column:
    """What is to be named, in this order: parameters, variables, the function, its callees (as written before the colon)."""
    names = F.transform(F.coalesce(callees, F.array().cast("array<string>")), lambda c: F.split_part(c, F.lit(":"), F.lit(1)))
    empty = F.array().cast("array<string>")
    return F.array_join(F.concat(F.coalesce(params, empty), F.coalesce(variables, empty), F.array(funname), names), ", ")


def _ask(names: Column) -> Column:
    return F.concat(F.lit("predict the original names of "), names, F.lit("."))


def context_prompt(summary: Column, callsites: Column, callees: Column, code: Column, names: Column) -> Column:
    """Prompt of a round: summary, call sites and callees of the last one, code; NULL without a summary."""
    bare = F.replace(F.replace(summary, F.lit("<SUMMARY>"), F.lit("")), F.lit("</SUMMARY>"), F.lit(""))
    none = F.array().cast("array<string>")
    return F.concat(
        F.lit("\n<SUMMARY>\n"), bare, F.lit("\n</SUMMARY>\n<CallSites>\n"), F.array_join(F.coalesce(callsites, none), ", "), F.lit("\n</CallSites>\n<Callees>\n"), F.array_join(F.coalesce(callees, none), ", "), F.lit("\n</Callees>\n<code>\n"), code, F.lit("\n</code>\n"), _ask(names), F.lit("\n    ")
    )


def retrieval_prompt(similar: Column, code: Column, names: Column) -> Column:
    """Prompt with the most similar known function; NULL without one."""
    return F.concat(F.lit("<unstripped_code>\n"), similar, F.lit("\n</unstripped_code>\n<code>\n"), code, F.lit("\n</code>\n"), _ask(names))


def prompt(similar: Column, context: Column, retrieval: Column) -> Column:
    """The retrieval prompt where there is a similar function, else the context prompt."""
    return F.when(similar.isNotNull(), retrieval).otherwise(context)


def domain_prompt(project: Column, kind: Column, libraries: Column, strings: Column, task: str = DOMAIN_TASK) -> Column:
    """Struct (prompt, no_libraries, no_strings) of a program's evidence."""
    libs, texts = distinct_lines(libraries), distinct_lines(strings)
    body = F.concat(
        F.lit(f"{task}\n<PROJECT_NAME>\n"), normal(project), F.lit("\n</PROJECT_NAME>\n<FILE_OUTPUT>\n"), normal(kind), F.lit("\n</FILE_OUTPUT>\n<LDD_OUTPUT>\n"), F.when(libs == "", NO_LIBRARIES).otherwise(libs), F.lit("\n</LDD_OUTPUT>\n<STRINGS_OUTPUT>\n"), F.when(texts == "", NO_STRINGS).otherwise(texts), F.lit("\n</STRINGS_OUTPUT>\n")
    )
    return F.struct(body.alias("prompt"), (libs == "").alias("no_libraries"), (texts == "").alias("no_strings"))


def identifier_prompt(summary: Column, code: Column, params: Column, variables: Column, funname: Column, callees: Column, task: str = IDENTIFIER_TASK) -> Column:
    """Prompt about the identifiers of a function; NULL for a blank code."""
    body = drop_header(normal(code))
    calls = F.array_distinct(F.filter(F.transform(F.coalesce(callees, F.array().cast("array<string>")), lambda c: normal(F.split_part(c, F.lit(":"), F.lit(1)))), lambda c: c != ""))
    empty = F.array().cast("array<string>")

    def listed(word: str, names: Column) -> Column:
        return F.transform(F.coalesce(names, empty), lambda n: F.concat(F.lit(f"{word}: "), n))

    entities = F.concat(listed("PARAM", params), listed("VAR", variables), F.array(F.concat(F.lit("FUNC: "), funname)), listed("CALL", calls))
    text = F.concat(F.lit(f"{task}\n<SUMMARY>\n"), between_tags(summary, "SUMMARY"), F.lit("\n</SUMMARY>\n<FUNCTION_CODE>\n"), body, F.lit("\n</FUNCTION_CODE>\n<IDENTIFIERS>\n"), F.array_join(entities, "\n"), F.lit("\n</IDENTIFIERS>\n"))
    return F.when(body != "", text)


def cut_domain(text: Column, most: int = MOST_CHARS) -> Column:
    return cut_between(text, most, "STRINGS_OUTPUT", STRINGS_MARK, 2_000, 5)


def cut_identifier(text: Column, most: int = MOST_CHARS) -> Column:
    return cut_between(text, most, "FUNCTION_CODE", CODE_MARK, 8_000, 4, (3, 4))


def forced_prefix(text: Column, label: Column) -> Column:
    """A prompt that already starts the answer: its first placeholder and a colon; NULL if the label has no colon."""
    return F.when(F.contains(label, F.lit(":")), F.concat(text, F.split_part(label, F.lit(":"), F.lit(1)), F.lit(":")))


def with_prefix(answer: Column, label: Column) -> Column:
    """The answer to a forced prompt with that start put back."""
    return F.concat(F.split_part(label, F.lit(":"), F.lit(1)), F.lit(":"), answer)


def project_of(folder: Column) -> Column:
    """The project in ``number_project``: what follows the first underscore."""
    return after_first(folder, "_")
