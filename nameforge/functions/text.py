"""Text primitives with the semantics of Python strings, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line ends of str.splitlines, white space of str.strip.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085  ]"
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Without white space at either end, Unicode included; NULL stays NULL."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+$", "")


def lines(text: Column) -> Column:
    """The lines of a text without their ends; a final end starts no further line."""
    parts = F.split(text, LINE_END)
    trailing = (F.size(parts) > 0) & (F.element_at(parts, -1) == "")
    return F.when(trailing, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def distinct_lines(text: Column) -> Column:
    """Stripped non-empty lines, each where it first occurs, joined by line feeds; NULL gives ''."""
    kept = F.filter(F.transform(lines(F.coalesce(text, F.lit(""))), strip), lambda x: x != "")
    return F.array_join(F.array_distinct(kept), "\n")


def normal(text: Column) -> Column:
    """Stripped text, NULL as ''."""
    return strip(F.coalesce(text, F.lit("")))


def file_evidence(text: Column) -> Column:
    """Output of a file-type tool: per line without the leading ``path:``."""
    kept = F.transform(lines(F.coalesce(text, F.lit(""))), lambda x: F.regexp_replace(strip(x), r"^[^:]+:\s*", ""))
    return distinct_lines(F.array_join(kept, "\n"))


def library_evidence(text: Column) -> Column:
    """Output of a library lister: what stands left of ``=>``, else without a trailing address; distinct lines."""

    def one(x: Column) -> Column:
        s = strip(x)
        return F.when(F.contains(s, F.lit("=>")), strip(F.split_part(s, F.lit("=>"), F.lit(1)))).otherwise(strip(F.regexp_replace(s, r"\s*\(0x[0-9a-fA-F]+\)$", "")))

    return distinct_lines(F.array_join(F.transform(lines(F.coalesce(text, F.lit(""))), one), "\n"))


def readable_strings(text: Column) -> Column:
    """Distinct lines without format marks, hexadecimal numbers, or lines without any letter."""
    kept = F.filter(F.transform(lines(F.coalesce(text, F.lit(""))), strip), lambda x: ~x.rlike(r"%[sdlu]") & ~x.rlike(r"0x[0-9a-fA-F]+") & ~x.rlike(r"(?U)^[\W\d_]+$"))
    return distinct_lines(F.array_join(kept, "\n"))


def after_first(text: Column, mark: str) -> Column:
    """What follows the first mark; the whole text without one."""
    return F.when(F.contains(text, F.lit(mark)), F.substring(text, F.locate(mark, text) + F.lit(len(mark)), F.length(text))).otherwise(text)


def before_first(text: Column, mark: str) -> Column:
    return F.split_part(text, F.lit(mark), F.lit(1))


def between_tags(text: Column, tag: str) -> Column:
    """Stripped text between the first opening and the last closing tag; without both, the stripped text."""
    start, end = f"<{tag}>", f"</{tag}>"
    opened = F.locate(start, text)
    closed = F.when(F.contains(text, F.lit(end)), F.length(F.substring_index(text, end, -1)))
    inner = F.substring(text, opened + len(start), F.length(text) - closed - len(end) - opened - len(start) + 1)
    return F.when((opened > 0) & closed.isNotNull() & (F.length(text) - closed - len(end) >= opened + len(start) - 1), strip(inner)).otherwise(strip(text))


def drop_header(text: Column, start: str = "code:") -> Column:
    """Without the first line if it begins with ``start``."""
    return F.when(F.startswith(text, F.lit(start)), F.when(F.contains(text, F.lit("\n")), after_first(text, "\n")).otherwise(F.lit(""))).otherwise(text)


def cut_between(prompt: Column, most: int, tag: str, marker: str, tail_most: int, tail_part: int, head_share: tuple[int, int] | None = None) -> Column:
    """A prompt of at most ``most`` characters, shortened between ``<tag>`` and ``</tag>``.

    Only the text between the tags gives way, at a line end, for a marker; with
    head_share (a, b) it keeps a / b of the room at its head and the rest at its
    tail. Without usable tags the head and the last min(tail_most, most // tail_part)
    characters of the prompt stay. Shorter prompts and NULL are returned as they are.
    """
    start, end = f"<{tag}>", f"</{tag}>"
    n = F.length(prompt)
    a, z = F.locate(start, prompt), F.locate(end, prompt)
    begin = a + len(start) - 1  # characters before the evidence
    evidence = F.substring(prompt, begin + 1, z - 1 - begin)
    prefix, suffix = F.substring(prompt, F.lit(1), begin), F.substring(prompt, z, n)
    room = F.lit(most - len(marker)) - begin - (n - z + 1)
    if head_share:
        head = F.floor(room * head_share[0] / head_share[1]).cast("int")
        kept = F.concat(F.substring(evidence, F.lit(1), head), F.lit(marker), F.substring(evidence, F.length(evidence) - (room - head) + 1, room - head))
    else:
        first = F.substring(evidence, F.lit(1), room)
        kept = F.concat(F.when(F.contains(first, F.lit("\n")), F.substring(first, F.lit(1), F.length(first) - F.length(F.substring_index(first, "\n", -1)) - 1)).otherwise(first), F.lit(marker))
    tail = min(tail_most, most // tail_part)
    fallback = F.concat(F.substring(prompt, F.lit(1), F.lit(max(0, most - tail - len(marker)))), F.lit(marker), F.substring(prompt, n - tail + 1, F.lit(tail)))
    inner = (a > 0) & (z > a) & (room > 0)
    return F.when(n <= most, prompt).otherwise(F.substring(F.when(inner, F.concat(prefix, kept, suffix)).otherwise(fallback), 1, most))
