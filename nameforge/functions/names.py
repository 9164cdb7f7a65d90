"""Names in funname_aligned maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = " \t\n\r\x0b\x0c"

# Names that compilers add, and how more of them begin.
COMPILER_MADE = (
    "deregister_tm_clones",
    "register_tm_clones",
    "__do_global_dtors_aux",
    "__libc_csu_init",
    "__libc_csu_fini",
    "_start",
    "_fini",
    "_init",
    "__do_global_ctors_aux",
    "frame_dummy",
    "__gmon_start__",
)
COMPILER_PREFIX = r"^(__|\.|_start|_init|_fini)"


def name_of(names: Column) -> Column:
    """The name in a funname_aligned map: trimmed, lower case; NULL where there is none.

    A null or empty map, an empty or blank value and ``unknown`` are no name.
    """
    name = F.lower(F.btrim(F.element_at(F.map_values(names), F.lit(1)), F.lit(WHITE)))
    return F.when(F.size(names) > 0, F.when((name != "") & (name != "unknown"), name))


def interesting(name: Column) -> Column:
    """Not blank, not generated (``v1``, ``a2``, ``_12`` at its start) and not trivial (i, j, k, ret)."""
    bare = F.coalesce(name, F.lit(""))
    generated = (F.btrim(bare, F.lit(WHITE)) == "") | bare.rlike(r"(?U)^(?:v\d+\b|a\d+\b|[_0-9]+\b)")
    return ~(generated | bare.isin("i", "j", "k", "ret"))


def compiler_made(name: Column) -> Column:
    """Start-up and tear-down functions that a compiler or linker adds."""
    return F.coalesce(name.isin(*COMPILER_MADE) | name.rlike(COMPILER_PREFIX), F.lit(False))


def external_segment(segment: Column) -> Column:
    """Segments of linkage tables and imports."""
    return F.coalesce(segment.rlike(r"\.(plt|extern|got|idata|import)"), F.lit(False))


def words(name: Column) -> Column:
    """Words of an identifier, lower case: cut at non-letters and before capitals, runs of single letters fused."""
    spaced = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^\p{L}]", " "), r"(\p{Lu})", " $1")
    # A run of single letters becomes one word: blanks between two single letters go.
    fused = F.regexp_replace(F.regexp_replace(F.concat(F.lit(" "), spaced, F.lit(" ")), r"\s+", "  "), r"(?<=\s\p{L})\s+(?=\p{L}\s)", "")
    parts = F.split(F.lower(F.btrim(fused)), r"\s+")
    return F.filter(parts, lambda w: w != "")


def letter_tokens(name: Column) -> Column:
    """Runs of a-z of the trimmed lower-case name."""
    return F.regexp_extract_all(F.lower(F.btrim(name, F.lit(WHITE))), F.lit("[a-z]+"), F.lit(0))


def base_name(demangled: Column) -> Column:
    """The function or operator name of a demangled C++ signature, without scope, template arguments and parameters."""
    bare = F.regexp_replace(demangled, r"\(.*$", "")
    operator = F.regexp_extract(demangled, r"(operator\s*(?:\(\)|\[\]|[^\s(]+))", 1)
    scoped = F.regexp_replace(bare, r"<[^<>]*>", "")
    return F.when(operator != "", operator).otherwise(F.regexp_extract(scoped, r"(~?[A-Za-z_]\w*)\s*$", 1))
